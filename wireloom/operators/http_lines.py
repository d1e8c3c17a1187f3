"""HTTP headers of any size: a line automaton whose effect on a block of a stream is a small map.

Reading a header means reading lines until the blank one. What a block does to a header that is open when the block begins depends only on
the state of the open line, so it is a map of nine states: either the header ends in the block, or it leaves in another state. Blocks are
read independently; the maps of the blocks behind a block are composed from the back, in groups; a header that its own block leaves open looks
its end up in the map of all later blocks. No byte is copied to another block and no header is too long.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from wireloom.operators.reassembly import KEY
from wireloom.operators.stage import materialise
from wireloom.operators.walk import NEVER, by_group, map_groups, taken, walk

# States of the open line at a border: in the start line, at a line's beginning, in a field's name, in a valid line, in an invalid one;
# the odd ones have just seen a carriage return.
START, START_CR, BEGIN, BEGIN_CR, NAME, VALID, VALID_CR, INVALID, INVALID_CR = range(9)
DONE = -1
_WITH_CR = (START_CR, BEGIN_CR, VALID_CR, INVALID_CR)
_CHARS = rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]"
_FIELD = re.compile(rb"[ \t]|" + _CHARS + rb"+:")
_OPEN_NAME = re.compile(_CHARS + rb"+")
_REST = re.compile(_CHARS + rb"*:")
_OPEN_REST = re.compile(_CHARS + rb"*")

#: Outcome of reading on: state that is left open (or DONE), end of the header, end of the segment it lies in, whether a blank line ended
#: it, and the end of its start line where that was read here (0: not here). Positions are absolute.
_END = ST.StructType([
    ST.StructField("state", ST.IntegerType()), ST.StructField("stop", ST.LongType()), ST.StructField("seg_end", ST.LongType()),
    ST.StructField("complete", ST.BooleanType()), ST.StructField("line_end", ST.LongType()),
])
_START = ST.StructType([
    ST.StructField("pos", ST.LongType()), ST.StructField("p", ST.LongType()), ST.StructField("frame_no", ST.LongType()), ST.StructField("start_seq", ST.LongType()), *_END.fields,
])
_ARROW_END = [("state", pa.int32()), ("stop", pa.int64()), ("seg_end", pa.int64()), ("complete", pa.bool_()), ("line_end", pa.int64())]
_ARROW_ENDS = pa.list_(pa.struct(_ARROW_END))
_ARROW_START = [("pos", pa.int64()), ("p", pa.int64()), ("frame_no", pa.int64()), ("start_seq", pa.int64()), *_ARROW_END]


class _Block:
    """The contiguous bytes of a block, read as header lines from any place."""

    def __init__(self, segments: list[tuple[int, int, int, bytes]]):
        self.base, self.data = segments[0][0], b"".join(s[3] for s in segments)
        self.ends, at = [], self.base
        for s in segments:
            at += len(s[3])
            self.ends.append(at)
        self.known: dict[int, tuple] = {}

    def _after_cr(self, plain: int) -> int:
        return plain + 1 if self.data.endswith(b"\r") else plain

    def _left_open(self, at: int) -> int:
        """State of the line that begins at ``at`` and has no end in the block."""
        data = self.data
        if at == len(data):
            return BEGIN
        if data[at:] == b"\r":
            return BEGIN_CR
        if _FIELD.match(data, at):
            return self._after_cr(VALID)
        return NAME if _OPEN_NAME.fullmatch(data, at) else self._after_cr(INVALID)

    def lines(self, at: int) -> tuple[int, int, bool]:
        """(state, end, complete) of reading field lines from the line that begins at ``at``."""
        passed = []
        while at not in self.known:
            end = self.data.find(b"\r\n", at)
            if end < 0:
                self.known[at] = (self._left_open(at), 0, False)
            elif end == at:
                self.known[at] = (DONE, at + 2, True)
            elif not _FIELD.match(self.data, at):
                self.known[at] = (DONE, end + 2, False)
            else:
                passed.append(at)
                at = end + 2
        found = self.known[at]
        for a in passed:
            self.known[a] = found
        return found

    def start_line(self, at: int) -> tuple[int, int, bool, int]:
        """The same from within a start line; the place where that line ends comes last."""
        end = self.data.find(b"\r\n", at)
        if end < 0:
            return self._after_cr(START), 0, False, 0
        return *self.lines(end + 2), end + 2

    def enter(self, state: int) -> tuple[int, int, bool, int]:
        """The same for a header that is open in ``state`` when the block begins."""
        data = self.data
        if state == BEGIN:
            return *self.lines(0), 0
        if state in _WITH_CR and data.startswith(b"\n"):
            if state == BEGIN_CR:
                return DONE, 1, True, 0
            if state == INVALID_CR:
                return DONE, 1, False, 0
            return *self.lines(1), 1 if state == START_CR else 0
        if state in (START, START_CR):
            return self.start_line(0)
        end = data.find(b"\r\n")
        if state == NAME and end < 0 and _OPEN_REST.fullmatch(data):
            return NAME, 0, False, 0
        valid = state in (VALID, VALID_CR) or state == NAME and bool(_REST.match(data))
        if end < 0:
            return self._after_cr(VALID if valid else INVALID), 0, False, 0
        return (*self.lines(end + 2), 0) if valid else (DONE, end + 2, False, 0)

    def placed(self, outcome: tuple[int, int, bool, int]) -> dict:
        """An outcome with absolute positions and the end of the segment in which the header ends."""
        state, stop, complete, line_end = outcome
        seg_end = self.ends[bisect.bisect_left(self.ends, self.base + stop)] if state == DONE else 0
        return {"state": state, "stop": self.base + stop if state == DONE else 0, "seg_end": seg_end, "complete": complete, "line_end": self.base + line_end if line_end else 0}


_BLOCK_KEY = [*KEY, "blk"]


def _read(start_in: Callable[[bytes], int]):
    def make(key, segments):
        block = _Block(segments)
        starts = []
        for off, frame, seq, payload in segments:
            at = start_in(payload)
            if at >= 0:
                starts.append({"pos": off, "p": off + at, "frame_no": frame, "start_seq": seq + at, **block.placed(block.start_line(off + at - block.base))})
        return [(*key, starts, [block.placed(block.enter(s)) for s in range(9)])]

    out = [("starts", pa.list_(pa.struct(_ARROW_START))), ("ends", _ARROW_ENDS)]
    return lambda batches: by_group(batches, _BLOCK_KEY, ("off", "frame_no", "seq", "payload"), make, out, len(_BLOCK_KEY))


def _then(first: list, later: list | None) -> list:
    """The map of a block followed by the map of what lies behind it (None: the stream ends)."""
    if later is None:
        return first
    out = []
    for x in first:
        if x["state"] != DONE:
            x = {**later[x["state"]], "line_end": x["line_end"] or later[x["state"]]["line_end"]}
        out.append(x)
    return out


def _composed(key: tuple, rows: list) -> list:
    later = None
    for _blk, ends in reversed(rows):
        later = _then(ends, later)
    return [(*key, later)]


def _behind(key: tuple, rows: list) -> list:
    """For each block (or group) the map of all that lie behind it; ``above`` is handed down to the last one, which has none without."""
    later, out = rows[0][2] if len(rows[0]) > 2 else None, []
    for blk, ends, *_ in reversed(rows):
        out.append((*key[: len(KEY)], blk, later))
        later = _then(ends, later)
    return out


def _with_later(blocks: DataFrame, fan: int) -> DataFrame:
    """Adds ``behind``, the map of all later blocks. Keys of one block have none behind them and stay out of it."""
    longer = blocks.where("blk > 0").select(*KEY).distinct()
    maps = blocks.join(longer, KEY, "left_semi").select(*KEY, "blk", "ends", F.floor(F.col("blk") / fan).cast("bigint").alias("sup"))
    key_fields = [blocks.schema[c] for c in KEY]
    several = ST.ArrayType(_END)
    whole = ST.StructType([*key_fields, ST.StructField("blk", ST.LongType()), ST.StructField("ends", several)])
    after = ST.StructType([*key_fields, ST.StructField("blk", ST.LongType()), ST.StructField("behind", several)])
    out_map, out_after = [("blk", pa.int64()), ("ends", _ARROW_ENDS)], [("blk", pa.int64()), ("behind", _ARROW_ENDS)]
    groups = map_groups(maps, [*KEY, "sup"], "blk", ["blk", "ends"], _composed, out_map, whole, len(KEY))
    above = map_groups(groups, KEY, "blk", ["blk", "ends"], _behind, out_after, after, len(KEY)).select(*KEY, F.col("blk").alias("sup"), F.col("behind").alias("above"))
    found = map_groups(maps.join(above, [*KEY, "sup"]), [*KEY, "sup"], "blk", ["blk", "ends", "above"], _behind, out_after, after, len(KEY))
    return blocks.join(found, [*KEY, "blk"], "left")


def _cut():
    def make(key, rows):
        segments = [(r[0], r[3]) for r in rows if r[3] is not None]
        if not segments:
            return []
        base, data = segments[0][0], b"".join(s[1] for s in segments)
        return [(*key, r[0], data[max(r[1] - base, 0) : max(r[2] - base, 0)]) for r in rows if r[3] is None]

    out = [("pos", pa.int64()), ("part", pa.binary())]
    return lambda batches: by_group(batches, _BLOCK_KEY, ("off", "p", "q", "payload"), make, out, len(_BLOCK_KEY))


def headers_of(placed: DataFrame, start_in: Callable[[bytes], int], block: int, fan: int, levels: int) -> DataFrame:
    """Headers of segments ``(key, frame_no, seq, off, payload)`` whose ``off`` is their place in the flow direction's bytes."""
    # Read twice, for the lines and for the bytes of taken headers.
    rows = materialise(placed.select(*KEY, "frame_no", "seq", F.col("off").cast("bigint").alias("off"), F.floor(F.col("off") / block).cast("bigint").alias("blk"), "payload"))
    ready = rows.repartition(*KEY, "blk").sortWithinPartitions(*KEY, "blk", "off")
    keys = [ready.schema[c] for c in KEY]
    schema = ST.StructType([*keys, ST.StructField("blk", ST.LongType()), ST.StructField("starts", ST.ArrayType(_START)), ST.StructField("ends", ST.ArrayType(_END))])
    blocks = materialise(ready.mapInArrow(_read(start_in), schema))
    if blocks.where("blk > 0").isEmpty():
        known = blocks.withColumn("behind", F.lit(None).cast(ST.ArrayType(_END)))
    else:
        known = _with_later(blocks, fan)
    # An open start ends where the later blocks say; one that no later block ends either has only its start line, if that was read.
    items = F.expr(f"""transform(transform(starts, x -> struct(x as x, case when x.state = {DONE} or behind is null then
          named_struct('state', x.state, 'stop', x.stop, 'seg_end', x.seg_end, 'complete', x.complete, 'line_end', x.line_end) else behind[x.state] end as e)),
        y -> struct(y.x.pos as pos, if(y.e.state = {DONE}, y.e.seg_end, {NEVER}L) as nxt, y.x.frame_no as frame_no, y.x.start_seq as start_seq, y.x.p as p,
          case when y.e.state = {DONE} and y.e.complete then y.e.stop else if(y.x.line_end > 0, y.x.line_end, y.e.line_end) end as q,
          y.e.state = {DONE} and y.e.complete as complete))""")
    known = known.select(*KEY, "blk", items.alias("items"))
    entered = F.transform(taken(F.col("items.pos"), F.col("items.nxt"), F.lit(0).cast("bigint")), lambda i: F.get(F.col("items"), i))
    known = materialise(known.where("blk > 0").unionByName(known.where("blk = 0").withColumn("items", entered)))
    jump = known.select(F.max(F.expr(f"array_max(transform(filter(items, x -> x.nxt < {NEVER}L), x -> x.nxt - x.pos))"))).first()[0] or 0
    found = walk(known, KEY, "items", block, jump, fan, levels).where("__item.q > 0")
    found = materialise(found.select(*KEY, "__item.pos", "__item.frame_no", "__item.start_seq", "__item.p", "__item.q", "__item.complete"))
    # Only now are bytes fetched, and only of blocks that hold taken headers.
    parts = found.select(*KEY, F.explode(F.sequence(F.floor(F.col("pos") / block).cast("bigint"), F.floor((F.col("q") - 1) / block).cast("bigint"))).alias("blk"), F.col("pos").alias("off"), "p", "q")
    none = F.lit(None).cast("bigint")
    held = rows.join(parts.select(*KEY, "blk").distinct(), [*KEY, "blk"], "left_semi").select(*KEY, "blk", "off", none.alias("p"), none.alias("q"), "payload")
    both = held.unionByName(parts.withColumn("payload", F.lit(None).cast("binary"))).repartition(*KEY, "blk").sortWithinPartitions(*KEY, "blk", F.col("payload").isNull(), "off")
    out = ST.StructType([*keys, ST.StructField("blk", ST.LongType()), ST.StructField("pos", ST.LongType()), ST.StructField("part", ST.BinaryType())])
    cut = both.mapInArrow(_cut(), out)
    whole = cut.groupBy(*KEY, "pos").agg(F.array_sort(F.collect_list(F.struct("blk", F.hex("part").alias("part")))).alias("parts"))
    return found.join(whole, [*KEY, "pos"]).select(*KEY, "frame_no", "start_seq", F.unhex(F.array_join("parts.part", "")).alias("header"), "complete")
