"""Language-model scoring by a probabilistic suffix tree over bytes, next to a smoothed unigram score.

The tree reads a text as its words, lower-cased, joined by single spaces and closed by a line feed, byte by byte. Counts of every
(context, byte) come from the whole training part. A context stays if its next-byte distribution diverges from its parent's by more than
``gain`` nats in total; a byte is scored in the longest context that stayed, smoothed through its suffixes down to the uniform one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import fold, written
from wireloom.llm.words import words

DEPTH = 5
END = b"\n"
HELD = 400_000  # distinct words, or five times as many byte runs, that a task gathers before it sends them on
SLOTS = 21
CHUNK = 1 << 20


def _runs(stream: bytes) -> np.ndarray:
    """One number per byte behind the first DEPTH ones: the DEPTH bytes before it and itself. Runs over a zero byte (a border of texts) are left out."""
    b = np.frombuffer(stream, np.uint8).astype(np.int64)
    n = len(b) - DEPTH
    if n <= 0:
        return np.empty(0, np.int64)
    key = b[:n].copy()
    for i in range(1, DEPTH + 1):
        key <<= 8
        key |= b[i : i + n]
    zero = b == 0
    return key[~np.logical_or.reduce([zero[i : i + n] for i in range(DEPTH + 1)])] if zero.any() else key


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _gather(batches):
    """Counts of words (kind 0, hashed) and of byte runs (kind 1), summed in the task before they move."""

    def rows(kind, keys, counts):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["kind", "key", "n"])

    seen, parts, held, buffer = Counter(), [], 0, bytearray()

    def runs():
        nonlocal held
        if len(buffer) > DEPTH:
            for at in range(0, len(buffer), CHUNK):
                k = _runs(bytes(buffer[at : at + CHUNK + DEPTH]))
                if len(k):
                    parts.append(_counted(k))
                    held += len(parts[-1][0])
            buffer.clear()

    def merged():
        nonlocal held
        k, c = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        parts[:] = [(k, c)]
        held = len(k)

    for b in batches:
        for text in b.column(0).to_pylist():
            ws = words(text)
            buffer += _stream(ws) + b"\0"
            ws.append(END)
            seen.update(ws)
            if len(buffer) >= CHUNK:
                runs()
                if held > 10 * HELD:
                    merged()
                    if held > 5 * HELD:
                        yield rows(1, *parts.pop())
                        held = 0
            if len(seen) > HELD:
                yield rows(0, [_signed(xxhash.xxh3_64_intdigest(w)) for w in seen], list(seen.values()))
                seen.clear()
    runs()
    if parts:
        merged()
        yield rows(1, *parts[0])
    if seen:
        yield rows(0, [_signed(xxhash.xxh3_64_intdigest(w)) for w in seen], list(seen.values()))


class Model:
    """What scoring needs of a training corpus: word counts (a table, and its most frequent rows), totals, and the tree.

    Of a tree too large to send to every task, ``states`` and ``entries`` hold the contexts of one byte at most and ``deeper`` (code, n) is a
    table of the others.
    """

    def __init__(self, counts: DataFrame, total: int, distinct: int, frequent: dict[int, int], states: tuple, entries: tuple, deeper: DataFrame | None = None):
        self.counts, self.total, self.distinct, self.frequent, self.states, self.entries, self.deeper = counts, total, distinct, frequent, states, entries, deeper


def _arrays(code: np.ndarray, n: np.ndarray) -> tuple[tuple, tuple]:
    """The states (context, sum, number of bytes) and entries (context and byte, count) of a tree, both sorted."""
    order = np.argsort(code)
    code, n = code[order], n[order].astype(np.float64)
    node = code >> 8
    if not len(node):
        return (node, n, n), (code, n)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return (node[first], np.add.reduceat(n, first), np.diff(np.append(first, len(node))).astype(np.float64)), (code, n)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gain: float = 12.0, least: int = 20, entries: int = 3_000_000, frequent: int = 200_000) -> Model:
    """Learns from every row outside the held-out part (a null id counts as the empty text).

    Contexts seen fewer than ``least`` times are not tested; all that pass the test stay, with their suffixes. ``entries`` bounds the tree and
    ``frequent`` the word counts that are sent to every task; a larger tree and the counts of all other words are joined, so neither bound
    changes a score.
    """
    learn = docs.where(fold(id_col, 7) != 2).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = learn.mapInArrow(_gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-counts")
    of_words = counts.where("kind = 0").select(F.col("key").alias("h"), "n")
    total, distinct = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = of_words.orderBy(F.desc("n"), "h").limit(frequent).toArrow()
    hs, ns = top.column("h").to_numpy(), top.column("n").to_numpy()

    # all suffix contexts of a run, with their next bytes
    run = counts.where("kind = 1").select("key", "n")
    ctx = F.expr("(key >> 8) & ((1L << (8 * depth)) - 1)")
    of = (
        run.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
        .select("depth", ctx.alias("ctx"), (F.col("key").bitwiseAND(255)).alias("sym"), "n")
        .groupBy("depth", "ctx", "sym").agg(F.sum("n").alias("n"))
        .groupBy("depth", "ctx").agg(F.sum("n").alias("n"), F.collect_list(F.struct("sym", "n")).alias("next"))  # 256 symbols at most
        .where(F.col("n") >= least)
    )
    of = written(of, "lm-contexts")
    child = of.select("depth", "ctx", "n", "next", (F.col("depth") - 1).alias("d"), F.expr("ctx & ((1L << (8 * (depth - 1))) - 1)").alias("c")).where("depth > 0")
    parent = of.select(F.col("depth").alias("d"), F.col("ctx").alias("c"), F.col("n").alias("pn"), F.map_from_entries("next").alias("before"))
    gained = (
        child.join(parent, ["d", "c"])  # a parent has at least its child's count
        .select("depth", "ctx", F.expr("aggregate(next, 0D, (s, x) -> s + x.n * ln((x.n / n) / (before[x.sym] / pn)))").alias("gain"))
        .where(F.col("gain") > gain)
    )
    closed = gained.select(F.explode(F.expr("transform(sequence(0, depth), d -> named_struct('depth', d, 'ctx', ctx & ((1L << (8 * d)) - 1)))")).alias("s")).select("s.*")
    closed = closed.union(of.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ctx"))).distinct()
    kept = of.join(closed, ["depth", "ctx"])
    kept = written(kept.select("depth", "ctx", F.explode("next").alias("x")).select(F.expr("((depth * (1L << 48) + ctx) << 8) + x.sym").alias("code"), "x.n"), "lm-tree")
    deeper = kept.where(f"code >= {2 << 56}") if kept.count() > entries else None
    got = (kept if deeper is None else kept.where(f"code < {2 << 56}")).toArrow()
    tree = _arrays(got.column("code").to_numpy(), got.column("n").to_numpy())
    return Model(of_words, int(total), int(distinct), dict(zip(hs.tolist(), ns.tolist(), strict=True)), *tree, deeper)


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions, or -1."""
    if not len(table):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


def log10_next(runs: np.ndarray, states: tuple, entries: tuple) -> np.ndarray:
    """log10 P(byte | longest kept suffix of the bytes before it) of each run; a state of n counts over k bytes leaves k / (n + k) to its suffix."""
    sym, p = runs & 255, np.full(len(runs), 1 / 256)
    alive = np.ones(len(runs), bool)
    for depth in range(DEPTH + 1):
        code = (depth << 48) + ((runs >> 8) & ((1 << (8 * depth)) - 1))
        at = _find(states[0], code)
        alive &= at >= 0
        if not alive.any():
            break
        e = _find(entries[0], (code << 8) + sym)
        n, k = states[1][at], states[2][at]
        c = np.where(e >= 0, entries[1][e] if len(entries[1]) else 0.0, 0.0)
        p = np.where(alive, (c + k * p) / (n + k), p)
    return np.log10(p)


class _Scorer:
    """log10 of whole texts; remembers the probabilities of recent runs in a table of fixed size."""

    def __init__(self, states: tuple, entries: tuple):
        self.states, self.entries = states, entries
        self.keys = np.full(1 << SLOTS, -1, np.int64)
        self.values = np.zeros(1 << SLOTS)

    def runs(self, k: np.ndarray) -> np.ndarray:
        slot = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != k)
        if len(missed):
            new, back = np.unique(k[missed], return_inverse=True)
            value = log10_next(new, self.states, self.entries)
            out[missed] = value[back]
            self.keys[slot[missed]], self.values[slot[missed]] = k[missed], value[back]
        return out

    def texts(self, many: list[bytes]) -> np.ndarray:
        """Sums by text, of texts as ``_stream`` gives them; short ones are looked up together."""
        out, at = np.zeros(len(many)), 0
        while at < len(many):
            end, size = at, 0
            while end < len(many) and (end == at or size + len(many[end]) <= CHUNK):
                size += len(many[end])
                end += 1
            whole = b"\0".join(many[at:end])
            if end == at + 1:
                out[at] = sum(self.runs(_runs(whole[i : i + CHUNK + DEPTH])).sum() for i in range(0, len(whole) - DEPTH, CHUNK))
            else:
                starts = np.cumsum([0] + [len(x) - DEPTH for x in many[at : end - 1]])
                out[at:end] = np.add.reduceat(self.runs(_runs(whole)), starts)
            at = end
        return out


def _stream(ws: list[bytes]) -> bytes:
    return b"\n" * DEPTH + b" ".join(ws).replace(b"\0", b"\x01") + END


class _Known(dict):
    """Counts of frequent words by word; 0 marks the others. Forgets all when large."""

    def __init__(self, by_hash: dict[int, int]):
        super().__init__()
        self.by_hash = by_hash

    def __missing__(self, w: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        c = self[w] = self.by_hash.get(_signed(xxhash.xxh3_64_intdigest(w)), 0)
        return c


def _joined(runs: DataFrame, model: Model) -> DataFrame:
    """(r, lp) of each distinct run; runs and contexts meet by the last two bytes of the context."""
    top = runs.sparkSession.sparkContext.broadcast(model.entries)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        k, code, n = x.column("r").to_numpy(), y.column("code").to_numpy(), y.column("n").to_numpy()
        lp = log10_next(k, *_arrays(np.concatenate((top.value[0], code)), np.concatenate((top.value[1], n)))) if len(k) else np.empty(0)
        return pa.table({"r": pa.array(k, pa.int64()), "lp": pa.array(lp, pa.float64())})

    x = runs.select("r").distinct().withColumn("x", F.expr("(r >> 8) & 65535"))
    y = model.deeper.withColumn("y", F.expr("(code >> 8) & 65535"))
    return x.groupBy("x").cogroup(y.groupBy("y")).applyInArrow(run, "r long, lp double")


def _run_rows(rid: list, texts: list, kind: pa.DataType):
    """The distinct runs of each text and their numbers, as rows of ``score``; long texts go chunk by chunk."""
    for row, text in zip(rid, texts, strict=True):
        stream = _stream(words(text))
        for at in range(0, len(stream) - DEPTH, CHUNK):
            k, n = _counted(_runs(stream[at : at + CHUNK + DEPTH]))
            none = pa.nulls(len(k), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), row)), pa.nulls(len(k), kind), pa.nulls(len(k), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(k), pa.int64()), none, none, pa.array(k)],
                ["rid", "i", "h", "n", "k", "s", "p", "r"],
            )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Null and empty texts have the end token alone. Null ids count as the empty text for ``held_out``. Repeated rows get equal results; an
    empty training part leaves uniform probabilities. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared, whole = spark.sparkContext.broadcast((model.frequent, model.states, model.entries)), model.deeper is None

    def run(batches):
        frequent, states, entries = shared.value
        known, tree = _Known(frequent), _Scorer(states, entries)
        for b in batches:
            rid, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
            own, streams, rare = [], [], ([], [], [])
            if not whole:
                yield from _run_rows(rid, texts, b.column(1).type)
            for r, text in zip(rid, texts, strict=True):
                ws = words(text)
                streams.append(_stream(ws))
                ws.append(END)
                c = np.fromiter(map(known.__getitem__, ws), np.float64, len(ws))
                own.append((len(ws), int((c > 0).sum()), float(np.log10(c + 1).sum())))
                others = Counter(ws[i] for i in np.flatnonzero(c == 0))
                rare[0].extend([r] * len(others))
                rare[1].extend(_signed(xxhash.xxh3_64_intdigest(w)) for w in others)
                rare[2].extend(others.values())
            n, k, s = (list(x) for x in zip(*own, strict=True)) if own else ([], [], [])
            none = [None] * len(rare[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid + rare[0], pa.int64()), pa.concat_arrays([b.column(1), pa.nulls(len(none), b.column(1).type)]),
                    pa.array([None] * len(rid) + rare[1], pa.int64()), pa.array(n + rare[2], pa.int64()),
                    pa.array(k + none, pa.int64()), pa.array(s + none, pa.float64()), pa.concat_arrays([pa.array(tree.texts(streams) if whole else np.zeros(len(streams)), pa.float64()), pa.nulls(len(none), pa.float64())]),
                    pa.nulls(len(rid) + len(none), pa.int64()),
                ],
                ["rid", "i", "h", "n", "k", "s", "p", "r"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id(), F.col(id_col), F.col(text_col)).mapInArrow(run, f"rid long, i {kind}, h long, n long, k long, s double, p double, r long")
    rows = written(rows, "lm-scores")  # after this a row's number is fixed
    rare = rows.where("h is not null").select("rid", "h", "n")
    counts = model.counts.withColumnRenamed("n", "c")
    rest = rare.join(counts, "h").groupBy("rid").agg(F.sum("n").alias("more_k"), F.sum(F.expr("n * log10(c + 1D)")).alias("more_s"))
    below = float(np.log10(model.total + model.distinct + 1))
    texts = rows.where("h is null and r is null")
    if not whole:
        runs = rows.where("r is not null").select("rid", "r", "n")
        sums = runs.join(written(_joined(runs, model), "lm-runs"), "r").groupBy("rid").agg(F.sum(F.expr("n * lp")).alias("more_p"))
        texts = texts.join(sums, "rid", "left").withColumn("p", F.coalesce("more_p", "p"))
    return (
        texts.join(rest, "rid", "left")
        .select(
            F.col("i").alias(id_col), (fold("i", 7) == 2).alias("held_out"), F.col("n").alias("n_tokens"), F.expr("k + coalesce(more_k, 0)").alias("n_known"),
            F.lit(model.total).cast("long").alias("train_tokens"), (F.expr("s + coalesce(more_s, 0D)") - F.col("n") * F.lit(below)).alias("base_score"),
            F.col("p").alias("score"),
        )
    )
