"""Following a chain of jumps through a byte stream, in parallel.

TLS records, HTTP messages and capture records share one shape: a reader stands at a position, takes the first *candidate* at or
after it, and jumps to where that candidate says the next one begins.  The place of every record depends on all earlier lengths, which
looks serial.  It is not: for a block of the stream the effect of reading it is a step function ``entry -> exit`` that can be computed
without knowing the entry.  Blocks are evaluated independently, their functions are composed in bounded groups, the true entries are
handed back down, and only then is each block read for real.  A stream of any length is thus shared by the whole cluster.

A block map is ``(keys..., blk, pos ARRAY<BIGINT>, nxt ARRAY<BIGINT>)``: sorted candidate positions and jump targets (absolute).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.operators.stage import materialise

NEVER = 1 << 62  # jump target of a candidate after which nothing more is read


def follow(pos: np.ndarray, nxt: np.ndarray, entry: int) -> list[int]:
    """Indexes of the candidates a reader entering at ``entry`` takes."""
    target = np.searchsorted(pos, nxt)
    i, n, taken = int(np.searchsorted(pos, entry)), len(pos), []
    while i < n:
        taken.append(i)
        i = int(target[i])
    return taken


def leave(pos: np.ndarray, nxt: np.ndarray, entry: int) -> int:
    """Position after applying a block function (identity when no candidate is at or after the entry)."""
    i = int(np.searchsorted(pos, entry))
    return int(nxt[i]) if i < len(pos) else entry


def exits(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """For each candidate, where the chain through it leaves the block (pointer doubling)."""
    n = len(pos)
    out, jump = nxt.copy(), np.searchsorted(pos, nxt)
    live = np.flatnonzero(jump < n)
    while len(live):
        out[live], jump[live] = out[jump[live]], jump[jump[live]]
        live = live[jump[live] < n]
    return out


def squeeze(pos: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries between two candidates with the same exit behave alike: keep the last candidate of each run."""
    if len(pos) == 0:
        return pos, out
    keep = np.append(out[1:] != out[:-1], True)
    return pos[keep], out[keep]


def _arr(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64)


def _cells(column: pa.Array) -> list:
    """Values of a column; lists of numbers stay views of its buffer."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type):
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return column.to_pylist()


def by_group(batches: Iterator[pa.RecordBatch], by: Sequence[str], names: Sequence[str], make: Callable, out: Sequence[tuple], copied: int, held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``make(key, rows)`` for each run of rows with equal ``by``, its results in batches.

    The partition is sorted by ``by``; rows are tuples of ``names``. A result is a tuple of the first ``copied`` columns of ``by`` and the
    columns ``out`` (name, Arrow type). Its last column counts towards ``held``, after which a batch is given out.
    """
    schema = None

    def batch_of(done):
        columns = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)

    key, rows, done, size = None, [], [], 0
    for batch in batches:
        schema = schema or pa.schema([*[batch.schema.field(c) for c in by[:copied]], *[pa.field(n, t) for n, t in out]])
        keys = zip(*[batch.column(n).to_pylist() for n in by])
        for k, row in zip(keys, zip(*[_cells(batch.column(n)) for n in names])):
            if k != key:
                if key is not None:
                    made = make(key, rows)
                    size += sum(len(r[-1]) if hasattr(r[-1], "__len__") else 1 for r in made)
                    done.extend(made)
                key, rows = k, []
                if size > held or len(done) >= 1024:
                    if done:
                        yield batch_of(done)
                    done, size = [], 0
            rows.append(row)
    if key is not None:
        done.extend(make(key, rows))
    if done:
        yield batch_of(done)


def map_groups(df: DataFrame, by: Sequence[str], order: str, names: Sequence[str], make: Callable, out: Sequence[tuple], schema: T.StructType, copied: int) -> DataFrame:
    """``by_group`` over all groups of ``df``, in ``order`` inside each; one task reads many small groups in one go."""
    ready = df.repartition(*by).sortWithinPartitions(*by, order).select(*by, *[n for n in names if n not in by])
    return ready.mapInArrow(partial(by_group, by=list(by), names=list(names), make=make, out=out, copied=copied), schema)


def _compose(fan_bytes: int, max_span: int):
    def run(key: tuple, rows: list) -> list:
        sup = key[-1]
        p, e = np.empty(0, np.int64), np.empty(0, np.int64)
        for _blk, pos, nxt in reversed(rows):
            out = exits(pos, nxt)
            i = np.searchsorted(p, out)
            hit = i < len(p)
            out[hit] = e[i[hit]]
            p, e = squeeze(np.concatenate([pos, p]), np.concatenate([out, e]))
        near = np.flatnonzero(p <= sup * fan_bytes + max_span)  # a reader cannot enter further in than one jump
        last = near[-1] + 2 if len(near) else 1
        return [(*key, p[:last], e[:last])]

    return run


def _sweep(keys: int):
    def run(key: tuple, rows: list) -> list:
        at = 0 if len(key) == keys else rows[0][3]
        out = []
        for blk, pos, nxt, *_ in rows:
            out.append((*key[:keys], blk, at))
            at = leave(pos, exits(pos, nxt), at)
        return out

    return run


def resolve_entries(maps: DataFrame, keys: Sequence[str], block: int, max_span: int, fan: int = 512, levels: int = 2) -> DataFrame:
    """True entry position of every block: ``(keys..., blk, entry)``.

    No group ever holds more than ``fan`` block maps, except the topmost one per key, which sees one map per ``fan**levels`` blocks
    (32 GiB of stream at the default sizes).
    """
    keys = list(keys)
    key_fields = [f for f in maps.schema.fields if f.name in keys]
    key_fields.sort(key=lambda f: keys.index(f.name))
    blk = T.StructField("blk", T.LongType())
    map_schema = T.StructType([*key_fields, blk, T.StructField("pos", T.ArrayType(T.LongType())), T.StructField("nxt", T.ArrayType(T.LongType()))])
    entry_schema = T.StructType([*key_fields, blk, T.StructField("entry", T.LongType())])
    sup = F.floor(F.col("blk") / fan).cast("bigint")
    longs = pa.list_(pa.int64())
    out_map, out_entry = [("blk", pa.int64()), ("pos", longs), ("nxt", longs)], [("blk", pa.int64()), ("entry", pa.int64())]
    levels_df = [maps.select(*keys, "blk", "pos", "nxt")]
    span = block
    for _ in range(levels):
        span *= fan
        grouped = levels_df[-1].withColumn("__sup", sup)
        levels_df.append(map_groups(grouped, [*keys, "__sup"], "blk", ["blk", "pos", "nxt"], _compose(span, max_span), out_map, map_schema, len(keys)))
    entries = map_groups(levels_df[-1], keys, "blk", ["blk", "pos", "nxt"], _sweep(len(keys)), out_entry, entry_schema, len(keys))
    for lower in reversed(levels_df[:-1]):
        up = entries.withColumnRenamed("blk", "__sup")
        tagged = lower.withColumn("__sup", sup).join(up, [*keys, "__sup"])
        entries = map_groups(tagged, [*keys, "__sup"], "blk", ["blk", "pos", "nxt", "entry"], _sweep(len(keys)), out_entry, entry_schema, len(keys))
    return entries


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def taken(pos: pd.Series, nxt: pd.Series, entry: pd.Series) -> pd.Series:
    """Indexes (0-based) of the candidates that the reader takes in each block."""
    return pd.Series([follow(_arr(p), _arr(n), int(e)) for p, n, e in zip(pos, nxt, entry)])


def walk(blocks: DataFrame, keys: Sequence[str], items: str, block: int, max_span: int, fan: int = 512, levels: int = 2) -> DataFrame:
    """Explode the taken candidates of ``blocks``: ``items`` is an ARRAY<STRUCT<pos, nxt, ...>> sorted by ``pos``.

    Block 0 of every key is entered at 0, so keys that fit one block (nearly all) never take part in entry resolution, and the
    resolution is left out of the plan when there is no longer key at all.
    """
    keys = list(keys)
    blocks = materialise(blocks)
    first = blocks.where("blk = 0").withColumn("__item", F.explode(items)).drop(items)
    if blocks.where("blk > 0").isEmpty():
        return first.drop("blk")
    arrays = blocks.withColumns({"pos": F.col(f"{items}.pos"), "nxt": F.col(f"{items}.nxt")})
    longer = blocks.where("blk > 0").select(*keys).distinct()
    entries = resolve_entries(arrays.join(longer, keys, "left_semi"), keys, block, max_span, fan, levels)
    later = arrays.where("blk > 0").join(entries, [*keys, "blk"])
    picked = later.withColumn("__i", F.explode(taken("pos", "nxt", "entry"))).withColumn("__item", F.get(items, F.col("__i")))
    return first.unionByName(picked.drop(items, "pos", "nxt", "entry", "__i")).drop("blk")
