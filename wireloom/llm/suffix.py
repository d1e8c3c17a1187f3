"""Repeated-passage removal by a logarithmic family of suffix arrays.

The result is exact: a byte goes if a LENGTH-byte string over it also starts earlier. Suffixes cut to LENGTH bytes stand in the arrays by a
64-bit hash, so that equal ones meet. To sort few of them, three steps narrow down what can match at all:

1. Each window of LENGTH bytes is named by its least GRAM-byte hash (its anchor); equal windows have equal anchors. Runs of windows with
   one anchor follow each other, some thirty-five windows long. Anchors that only one document has are set aside, as no other can match there.
2. A run is entered into the arrays as a whole (its first and last suffix span it). A run that an earlier document has goes entirely.
3. Where documents share an anchor but not the whole run, the few passages with that anchor are compared window by window, or, if there
   are more than GROUP of them, all their suffixes are entered one by one.

Batches are ranges of document ids. A batch's own sorted array is merge-scanned against the levels, which hold only earlier documents, then
what is new in it becomes a level; levels of equal size merge. Repeats inside a document are found where its text is.

Texts are read where they lie, some times over; what a reader has to know (copies, shared anchors, listed runs, marked rows) is sent as hashes,
or as a bit map of bounded size that may tell a few too many, which changes no result. Only texts of marked rows are shuffled to their spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import written
from wireloom.llm.words import distinct, mixed

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
PIECE = 1 << 20
#: Most hashes that the driver collects and each Python worker holds; for more a bit map stands.
BROADCAST_ROWS = 1_500_000
#: Most bits of such a map, as a power of two: 32 MiB.
MAP_BITS = 28
#: Most copied texts that are broadcast to the names of documents.
BROADCAST_COPIES = 50_000
#: Passages with one anchor that are compared together; the suffixes of more common anchors are entered into the arrays.
GROUP = 20_000
#: Bytes of such passages that are hashed at once.
SLICE = 1 << 18
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _powers(b: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... top bytes."""
    out, h, n, m = {}, _BYTES[b], 1, _M
    out[1] = h
    while n < top:
        h = h[:-n] * m + h[n:] if len(h) > n else h[:0]
        n *= 2
        m = m * _M + np.uint64(2)
        out[n] = h
    return out


def _windows(p: dict[int, np.ndarray]) -> np.ndarray:
    n = len(p[1]) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return mixed(mixed(p[64][:n]) * _M + mixed(p[32][64 : 64 + n] + np.uint64(3)) * np.uint64(0xC2B2AE3D27D4EB4F) + p[4][96 : 96 + n])


def _anchors(p: dict[int, np.ndarray]) -> np.ndarray:
    """The least gram hash of every window."""
    m = mixed(p[GRAM])
    width = 1
    while width * 2 <= REACH:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (REACH - width)], m[REACH - width :]) if REACH > width else m


def _pieces(texts):
    """(row, offset, bytes) with every window in exactly one piece, then joined to blocks: (bytes, [(row, offset, start in block, windows)])."""
    block, of, size = [], [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - LENGTH + 1, PIECE):
            part = raw[at : at + PIECE + LENGTH - 1]
            if size + len(part) > PIECE + LENGTH and of:
                yield b"".join(block), of
                block, of, size = [], [], 0
            of.append((row, at, size, len(part) - LENGTH + 1))
            block.append(part)
            size += len(part)
    if of:
        yield b"".join(block), of


def _runs(block: bytes, of: list, hashes: bool):
    """Of a block: (piece number, start, end, anchor, run hash) arrays; starts and ends are windows, counted in the block."""
    p = _powers(np.frombuffer(block, np.uint8), 64 if hashes else GRAM)
    m = _anchors(p)
    start = np.zeros(len(m), bool)
    start[1:] = m[1:] != m[:-1]
    piece = np.full(len(m), -1, np.int64)
    for k, (_, _, at, n) in enumerate(of):
        piece[at : at + n] = k
        start[at] = True
        if at + n < len(m):
            start[at + n] = True
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(m)) - 1
    inside = piece[first] >= 0
    first, last = first[inside], last[inside]
    long = last - first >= REACH
    if long.any():  # periodic text: runs are cut so that their two ends always span them
        cut = [np.arange(a, b + 1, REACH) for a, b in zip(first[long], last[long], strict=True)]
        more = np.concatenate(cut)
        ends = np.concatenate([np.append(c[1:] - 1, b) for c, b in zip(cut, last[long], strict=True)])
        first, last = np.concatenate([first[~long], more]), np.concatenate([last[~long], ends])
    w = _windows(p) if hashes else None
    return piece[first], first, last, m[first], mixed(mixed(w[first]) * _M + mixed(w[last] + np.uint64(5)) + (last - first).astype(np.uint64)) if hashes else None


def _among(v: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of v are in the sorted array."""
    return wanted[np.minimum(np.searchsorted(wanted, v), len(wanted) - 1)] == v if len(wanted) else np.zeros(len(v), bool)


def _mapped(v: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of v may be in a bit map: all that are, and few others."""
    bits, out = np.uint64(len(words) * 64 - 1), np.ones(len(v), bool)
    for shift in (0, MAP_BITS):
        at = (v >> np.uint64(shift)) & bits
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _bit_map(hashes: DataFrame, n: int) -> np.ndarray:
    """Two bits for each hash, put together on the executors: what the driver collects is bounded, however many there are."""
    bits = 1 << min(MAP_BITS, max(16, (8 * n).bit_length()))
    at = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("v", shift).bitwiseAND(F.lit(bits - 1)) for shift in (0, MAP_BITS)])).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _sent(hashes: DataFrame):
    """A broadcast for a column ``v`` of hashes, and the function that tells which hashes are in it; of very many it may tell a few too many."""
    n = hashes.count()
    few = n <= BROADCAST_ROWS
    held = np.sort(hashes.toArrow().column("v").to_numpy().view(np.uint64)) if few else _bit_map(hashes, n)
    return hashes.sparkSession.sparkContext.broadcast(held), _among if few else _mapped


def _texts(b, gone) -> list:
    """The last column of a batch, without the texts of the rows whose first column, a hash of their name, is in the broadcast list."""
    texts = b.column(b.num_columns - 1).to_pylist()
    if gone is not None:
        for i in np.flatnonzero(_among(b.column(0).to_numpy().view(np.uint64), gone.value)):
            texts[i] = None
    return texts


def _count(gone):
    """(hash, text) -> (anchor, documents that have it, 2 for more), summed in the task."""

    def run(batches):
        held, size = [], 0

        def summed():
            every = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(every[first].view(np.int64)), pa.array(np.minimum(np.diff(np.append(first, len(every))), 2))], ["v", "n"])

        for b in batches:
            for block, of in _pieces(_texts(b, gone)):
                piece, _, _, v, _ = _runs(block, of, False)
                row = np.array([x[0] for x in of])[piece]
                order = np.lexsort((v, row))
                row, v = row[order], v[order]
                held.append(v[np.concatenate(([True], (v[1:] != v[:-1]) | (row[1:] != row[:-1])))])
                size += len(held[-1])
                if size > 3_000_000:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return run


def _entries(shared, chosen, gone):
    """(hash, id, dk, text) -> (v, key, id, dk, s, e) of the runs whose anchor is chosen by what was broadcast of the shared ones."""

    def run(batches):
        for b in batches:
            for block, of in _pieces(_texts(b, gone)):
                piece, first, last, v, c = _runs(block, of, True)
                ok = chosen(v, shared.value)
                piece, first, last, v, c = (x[ok] for x in (piece, first, last, v, c))
                row, off, at = (np.array([x[i] for x in of])[piece] for i in range(3))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.view(np.int64)), pa.array(c.view(np.int64)), b.column(1).take(take), b.column(2).take(take), pa.array(first - at + off), pa.array(last - at + off)],
                    ["v", "key", "id", "dk", "s", "e"],
                )

    return run


def _run_names(w: np.ndarray, v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return mixed(mixed(w + v) * _M + s.astype(np.uint64))


def _listed(batches):
    """(hash, v, s) -> name of the run that begins there."""
    for b in batches:
        w, v, s = (b.column(i).to_numpy() for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(_run_names(w.view(np.uint64), v.view(np.uint64), s).view(np.int64))], ["v"])


def _found(batches, sent, chosen, gone):
    """Of (hash, id, dk, text): (batch, block, row, start in the text, first, last, anchor) of the runs that were sent; first and last are counted in the block.

    Runs are found again where the texts are, so that no text is moved to a list of them."""
    for b in batches:
        w = b.column(0).to_numpy().view(np.uint64)
        for block, of in _pieces(_texts(b, gone)):
            piece, first, last, v, _ = _runs(block, of, False)
            row, off, at = (np.array([x[i] for x in of])[piece] for i in range(3))
            s = first - at + off
            ok = chosen(_run_names(w[row], v, s), sent.value)
            if ok.any():
                yield b, block, row[ok], s[ok], first[ok], last[ok], v[ok]


def _suffixes(sent, chosen, gone):
    """(hash, id, dk, text) -> (key, id, dk, s, e) of every window of the runs sent."""

    def run(batches):
        for b, block, row, s, first, last, _ in _found(batches, sent, chosen, gone):
            n = last - first + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            take, at = pa.array(np.repeat(row, n)), pa.array(np.repeat(s, n) + step)
            key = _windows(_powers(np.frombuffer(block, np.uint8), 64))[np.repeat(first, n) + step]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1).take(take), b.column(2).take(take), at, at], ["key", "id", "dk", "s", "e"])

    return run


def _passages(sent, chosen, gone):
    """(hash, id, dk, text) -> (v, id, dk, s, bytes of the windows) of the runs sent."""

    def run(batches):
        for b, block, row, s, first, last, v in _found(batches, sent, chosen, gone):
            take = pa.array(row)
            parts = pa.array([block[a : z + LENGTH] for a, z in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), b.column(1).take(take), b.column(2).take(take), pa.array(s), parts], ["v", "id", "dk", "s", "passage"])

    return run


def _compared(batches):
    """Sorted by anchor: (id, dk, s, e) of the windows that a passage of the same anchor and a smaller id has. An anchor has at most GROUP passages."""

    def found(b):
        v, ids, dk, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        parts = b.column(4).to_pylist()
        sizes, held = np.array([len(x) for x in parts]), []
        begins = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(begins, np.arange(0, sizes.sum(), SLICE))  # whole passages; some slices may have none
        for a, z in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
            if a < z:
                h = _windows(_powers(np.frombuffer(b"".join(parts[a:z]), np.uint8), 64))
                r = np.repeat(np.arange(a, z), sizes[a:z])[: len(h)]
                o = np.arange(len(h)) - (begins[r] - begins[a])
                inside = o + LENGTH <= sizes[r]
                held.append((h[inside], r[inside], o[inside]))
        w, row, at = (np.concatenate([x[i] for x in held]) for i in range(3))
        key = mixed(w + mixed(v.astype(np.int64).view(np.uint64))[row])
        order = np.lexsort((ids[row], key))
        start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        least = np.empty(len(order), ids.dtype)
        least[order] = np.repeat(ids[row][order][start], np.diff(np.append(start, len(order))))
        again = np.flatnonzero(ids[row] > least)
        if not len(again):
            return
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(again) != 1) | (np.diff(row[again]) != 0))))
        first, last = again[cut], again[np.append(cut[1:], len(again)) - 1]
        r = row[first]
        yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(r)), b.column(2).take(pa.array(r)), pa.array(s[r] + at[first]), pa.array(s[r] + at[last])], ["id", "dk", "s", "e"])

    rest = None
    for b in batches:
        if not len(b):
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        v = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(v, v[-1]))  # the last anchor may go on in the next batch
        if cut:
            yield from found(b.slice(0, cut))
        rest = b.slice(cut)
    if rest is not None:
        yield from found(rest)


def _earlier(entries: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The entries (key, id, dk, s, e) whose key an entry of a smaller id has, batch by batch."""
    levels: list[tuple[int, DataFrame]] = []
    out = None
    for lo, hi in ranges:
        batch = entries
        if lo is not None:
            batch = batch.where(F.col("id") > F.lit(lo))
        if hi is not None:
            batch = batch.where(F.col("id") <= F.lit(hi))
        array = batch.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).sortWithinPartitions("key")
        hit = None  # a level holds what no earlier one has, so a key is in one level at most
        for _, level in levels:
            level = level.select("key", F.lit(True).alias("hit"))
            hit = level if hit is None else hit.unionAll(level)
        found = array.select("key", "first", "last", F.lit(False).alias("old"))
        if hit is not None:
            found = array.join(hit, "key", "left").select("key", "first", "last", F.coalesce("hit", F.lit(False)).alias("old"))
        found = written(found, "suffix-array")
        dup = batch.join(found.where("old or last > first"), "key").where("old or id > first").select("id", "dk", "s", "e")
        out = dup if out is None else out.unionAll(dup)
        levels.append((1, found.where("not old").select("key")))
        while len(levels) > 1 and levels[-1][0] == levels[-2][0] and hi is not None:
            (n, a), (_, b) = levels.pop(), levels.pop()
            levels.append((2 * n, written(a.unionAll(b), "level")))
    return out


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(removed bytes, maximal removed runs, sha256 of the rest) for removed [start, end) spans."""
    kept, at, n, removed = hashlib.sha256(), 0, 0, 0
    last = -1
    for s, e in sorted(spans):
        if s > last:
            kept.update(raw[at:s])
            n += 1
            removed += e - s
            last = e
        elif e > last:
            removed += e - last
            last = e
        at = last
    kept.update(raw[at:])
    return removed, n, kept.hexdigest()


def _own(raw: bytes) -> list[tuple[int, int]]:
    """Spans of windows that start earlier in the same text."""
    if len(raw) <= LENGTH:
        return []
    w = np.concatenate([_windows(_powers(np.frombuffer(raw[at : at + PIECE + LENGTH - 1], np.uint8), 64)) for at in range(0, len(raw) - LENGTH + 1, PIECE)])
    sorted_ = np.sort(w)
    if not (sorted_[1:] == sorted_[:-1]).any():
        return []
    order = np.argsort(w, kind="stable")
    again = np.sort(order[1:][w[order][1:] == w[order][:-1]])
    breaks = np.flatnonzero(np.diff(again) > 1)
    return [(int(again[a]), int(again[b]) + LENGTH) for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(again) - 1), strict=True)]


def _merged(batches):
    """(id, dk, [(s, e)]) -> the same with runs of windows made one where the bytes they span overlap or touch."""
    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            s, e = np.array(sorted((x["s"], x["e"]) for x in spans)).T
            e = np.maximum.accumulate(e)
            first = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1] + LENGTH)))
            out.append([{"s": a, "e": z} for a, z in zip(s[first].tolist(), e[np.append(first[1:], len(e)) - 1].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["id", "dk", "spans"])


_DONE = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _unmarked(sent, chosen):
    """(hash, id, dk, text) -> (id, dk, text, results): results of the rows that were not sent, which lose their text, and the texts of the others."""

    def run(batches):
        for b in batches:
            wait = chosen(b.column(0).to_numpy().view(np.uint64), sent.value)
            texts, done = b.column(3).to_pylist(), []
            for i in np.flatnonzero(~wait):
                raw = texts[i].encode("utf-8", "surrogatepass")
                texts[i] = None
                done.append((len(raw), *_cut(raw, _own(raw))))
            place = np.cumsum(~wait) - 1
            take = pa.array(place, mask=wait)
            cols = [pa.array(c, kind).take(take) for c, kind in zip(list(zip(*done, strict=True)) or [[]] * 4, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(texts, pa.string()), *cols], ["id", "dk", "text", *_DONE])

    return run


_KINDS = [pa.int64()] * 3 + [pa.string()]


def _finish(batches):
    """(id, text, whole, spans, results) -> results, of the rows that still have a text by its spans and by what it repeats itself."""
    for b in batches:
        out = []
        for _, text, whole, spans, *done in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if text is None:
                out.append(done)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            if whole and len(raw) >= LENGTH:
                every = [(0, len(raw))]
            else:
                every = _own(raw) + [(x["s"], x["e"] + LENGTH) for x in spans or []]
            out.append((len(raw), *_cut(raw, every)))
        cols = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, kind) for c, kind in zip(cols, _KINDS, strict=True)]], ["id", *_DONE])


def repeated(docs: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).

    A null text is empty. Rows with equal ids do not count as earlier than each other, nor does a null id count as earlier or later than any;
    both still lose what their own text repeats. Repeated rows get equal results. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("dk"), t.alias("text"))
    # whole copies: only the smallest id of a text takes part, the others go entirely; texts stay where they are, their names are shuffled
    long = rows.where("id is not null").where(F.octet_length("text") >= LENGTH)
    named = long.select("id", "dk", F.md5(F.col("text").cast("binary")).alias("tkey"))
    copies = written(named.groupBy("tkey").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("tkey", "first"), "copies")
    whole = named.join(F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies, "tkey").where("id > first")
    whole = written(whole.select("id", "dk").distinct(), "whole")
    name = F.xxhash64("id", "dk")
    own, gone = long.select(name.alias("w"), "id", "dk", "text"), None
    if whole.count() <= BROADCAST_ROWS:
        gone, _ = _sent(whole.select(name.alias("v")))
    else:
        own = written(own.join(whole, ["id", "dk"], "left_anti").select("w", "id", "dk", "text"), "own")

    shared = own.select("w", "text").mapInArrow(_count(gone), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    sent = _sent(written(shared.where("n > 1").select("v"), "anchors"))  # an anchor too many only adds runs that meet nothing
    runs = own.mapInArrow(_entries(*sent, gone), f"v long, key long, id {kind}, dk long, s long, e long")
    runs = written(runs, "runs")
    cuts = [None, *sorted(set(own.approxQuantile("id", [i / batches for i in range(1, batches)], 0.02))), None] if kind in ("bigint", "int") else [None, None]
    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
    by_run = _earlier(runs.drop("v"), ranges)

    # equal runs collapse before they meet by anchor, and a common anchor's contexts may be split by the join
    context = runs.groupBy("v", "key").agg(F.min(F.struct("id", "dk", "s", "e")).alias("x"))
    context = written(context.select("v", "key", "x.*"), "contexts")
    apart = written(context.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "mixed-anchors")
    spans = by_run
    for common in (False, True):
        group = apart.where((F.col("n") > GROUP) if common else (F.col("n") <= GROUP)).select("v")
        if group.isEmpty():
            continue
        listed = context.join(group, "v").select(name.alias("w"), "v", "s").mapInArrow(_listed, "v long")
        sent = _sent(written(listed, "listed"))  # nor does a passage too many, which is compared with real ones as it is
        if common:
            suffixes = own.mapInArrow(_suffixes(*sent, gone), f"key long, id {kind}, dk long, s long, e long")
            spans = spans.unionAll(_earlier(written(suffixes, "suffixes"), ranges))
        else:
            parts = own.mapInArrow(_passages(*sent, gone), f"v long, id {kind}, dk long, s long, passage binary").repartition("v").sortWithinPartitions("v")
            spans = spans.unionAll(parts.mapInArrow(_compared, f"id {kind}, dk long, s long, e long"))

    spans = spans.groupBy("id", "dk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = spans.mapInArrow(_merged, f"id {kind}, dk long, spans array<struct<s:long,e:long>>").withColumn("whole", F.lit(False))
    marks = written(spans.unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True), "spans")
    # only texts of marked rows are shuffled; a row sent too many finds no mark and is as the others
    results = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = rows.select(name.alias("w"), "id", "dk", "text").mapInArrow(_unmarked(*_sent(marks.select(name.alias("v")))), f"id {kind}, dk long, text string, {results}")
    out = out.join(marks, ["id", "dk"], "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans", *_DONE)
    return out.mapInArrow(_finish, f"id {kind}, {results}").withColumnRenamed("id", id_col)
