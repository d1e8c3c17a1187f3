"""Near duplicates by a chosen-path set similarity join over 5-word shingle sets.

Every distinct set has 64 minwise tokens. In each of several independent trees the root picks some of their places and sends a set to one
child for each, named by its token there; a child with many sets picks places of its own and branches again. Sets that are similar enough
share most tokens, so they meet in some small node; others are soon apart. Nodes of at most ``leaf`` sets are compared exhaustively, in larger
ones all sets are compared with the smallest. What a sketch of the tokens does not rule out is confirmed on the full sets.

A large node whose members these links have joined already is done; only others are branched. What is still large and not joined at the
lowest level is compared block by block. Equal sets are one member throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.graph import components
from wireloom.llm.store import forget, small_batches, unused, written
from wireloom.llm.words import WordHashes, mixed, shingles, words

COORDS = 64
TREES = 6
CHOSEN = 2  # places that a node picks: of 12 at the roots, two sets at 0.85 have none in common with probability 1e-10, at 0.80 with 4e-9
LEVELS = 3
BROADCAST_ROWS = 500_000
TILE = 2048  # members of a block, or 128 times as many shingles
COLUMNS = 1024
BATCH = 500  # rows that a Python task gets at once
_rng = np.random.default_rng(20)
_XOR, _MUL = (_rng.integers(1, 2**63, COORDS, dtype=np.int64).astype(np.uint64) for _ in range(2))
_MUL |= np.uint64(1)
_ROOTS = _rng.permutation(COORDS)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes(200_000)


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set; long sets go slice by slice."""
    least = np.full(COORDS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_equal(percent: int) -> int:
    """Places at which the two-bit sketches of a pair must be equal: of pairs at exactly ``percent`` one in 10**12 has fewer."""
    t = percent / 100 + (1 - percent / 100) / 4
    k, tail = 0, (1 - t) ** COORDS
    while tail < 1e-12:
        k += 1
        tail += math.comb(COORDS, k) * t**k * (1 - t) ** (COORDS - k)
    return k


def _sketch(sigs: np.ndarray) -> list[np.ndarray]:
    """The two lowest bits of all tokens of each set, as two 64-bit numbers."""
    return [np.packbits(((sigs >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64).ravel() for k in range(2)]


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _summary(batches):
    """(id, tkey, text) -> size, fingerprint and tokens of the set; tokens are null without a word."""
    for b in _sliced(batches):
        sets = [shingles(_hashes.of(words(t)), 5) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["id", "tkey", "n", "fp", "sig"],
        )


def _sliced(batches):
    """Few rows at a time, so that the sets of a batch need little memory."""
    for b in batches:
        for at in range(0, len(b), 128):
            yield b.slice(at, 128)


def _full(batches):
    for b in _sliced(batches):
        sets = [shingles(_hashes.of(words(t)), 5) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "grams"])


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def _child(node: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(node + (place.astype(np.uint64) + np.uint64(1)) * _GOLD) ^ (token.astype(np.uint64) * _GOLD)).view(np.int64)


def _planted(batches):
    """(fp, n, sig) -> the children of the roots of all trees: (node, fp, n, p, q)."""
    for b in batches:
        if not len(b):
            continue
        sigs = _tokens(b.column(2))
        p, q = map(pa.array, _sketch(sigs))
        for tree in range(TREES):
            for place in _ROOTS[CHOSEN * tree : CHOSEN * (tree + 1)]:
                node = _child(np.full(len(b), tree, np.uint64), np.full(len(b), place), sigs[:, place])
                yield pa.RecordBatch.from_arrays([pa.array(node), b.column(0), b.column(1), p, q], ["node", "fp", "n", "p", "q"])


def _branched(batches):
    """(fp, n, p, q, comp, nodes, sig) -> the children of all nodes that hold the set; a node picks places by its own name: (node, fp, n, p, q, comp)."""
    for b in batches:
        if not len(b):
            continue
        nodes = b.column(5)
        of, sigs = np.repeat(np.arange(len(b)), nodes.value_lengths().to_numpy()), _tokens(b.column(6))
        node = nodes.flatten().to_numpy().view(np.uint64)
        rest, picked = [c.take(pa.array(of)) for c in b.columns[:5]], mixed(node + _GOLD)
        for k in range(CHOSEN):
            place = ((picked + np.uint64(k) * (np.uint64(1) + (picked >> np.uint64(32)) % np.uint64(COORDS - 1))) % np.uint64(COORDS)).astype(np.int64)
            child = _child(node, place, sigs[of, place])
            yield pa.RecordBatch.from_arrays([pa.array(child), *rest], ["node", "fp", "n", "p", "q", "comp"])


def _confirmed(percent: int):
    def run(batches):
        for b in _sliced(batches):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared shingles of the sets ``left`` and ``right``, as a matrix. Shingles of one set alone add nothing and are left out."""
    row, tokens = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    _, column, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    row, column = row[counts[column] > 1], place[column[counts[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((counts > 1).sum()), COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        some = np.zeros((len(sets), COLUMNS), np.float32)
        some[row[i:j], column[i:j] - at] = 1
        out += some[left] @ some[right].T
    return out


def _forest(linked: np.ndarray):
    """Pairs (row, column) that join what ``linked`` joins, and no more than one for each row and column."""
    fresh_x, fresh_y = np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        todo = [(start, True)] if fresh_x[start] else []
        fresh_x[start] = False
        while todo:
            at, is_row = todo.pop()
            fresh = fresh_y if is_row else fresh_x
            found = np.flatnonzero((linked[at] if is_row else linked[:, at]) & fresh)
            fresh[found] = False
            for k in found.tolist():
                yield (at, k) if is_row else (k, at)
                todo.append((k, not is_row))


def _tile(percent: int):
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        """The links of strays ``x`` with members ``y`` of other components, or as many of them as join the same."""
        both = dict(zip(x.column("fp").to_pylist() + y.column("fp").to_pylist(), x.column("grams").to_pylist() + y.column("grams").to_pylist(), strict=True))
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        place = {fp: k for k, fp in enumerate(both)}
        sets = [np.frombuffer(g, np.uint64) for g in both.values()]
        fx, fy = x.column("fp").to_pylist(), y.column("fp").to_pylist()
        left, right = np.array([place[f] for f in fx]), np.array([place[f] for f in fy])
        size = np.array([len(s) for s in sets])
        shared = _shared(sets, left, right).astype(np.int64)
        comp = {c: k for k, c in enumerate({*x.column("comp").to_pylist(), *y.column("comp").to_pylist()})}
        cx, cy = (np.array([comp[c] for c in t.column("comp").to_pylist()]) for t in (x, y))
        linked = (100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)) & (cx[:, None] != cy[None, :])
        pairs = [sorted((fx[i], fy[j])) for i, j in _forest(linked)]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return run


def _near(level: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Pairs (a, b) within nodes that sizes and sketches do not rule out: all of a small node, those with the smallest set of a large one.

    ``level``: node, fp, n, p, q, comp (what earlier links have joined), size and hub of the node.
    """
    differ = f"bit_count((x.p ^ y.p) | (x.q ^ y.q)) <= {COORDS - least_equal(percent)} and x.comp <> y.comp"
    fits = f"{percent} * greatest(x.n, y.n) <= 100 * least(x.n, y.n)"
    few = level.where(F.col("size") <= leaf).groupBy("node").agg(F.collect_list(F.struct("fp", "n", "p", "q", "comp")).alias("m"))
    every = few.select(F.explode(F.expr(f"flatten(transform(m, x -> transform(filter(m, y -> y.fp > x.fp and {fits} and {differ}), y -> struct(x.fp as a, y.fp as b))))")).alias("r")).select("r.*")
    many = level.where(F.col("size") > leaf).select(F.col("hub").alias("x"), F.struct("fp", "n", "p", "q", "comp").alias("y")).where(f"x.fp <> y.fp and {fits} and {differ}")
    return every.unionAll(many.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))).distinct()


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (node, fp, n, p, q, comp) of nodes that hold more than one component, with the node's size and its smallest set as hub."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("fp", "n", "p", "q", "comp")).alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    return written(rows.join(sizes.where("size > 1 and c0 <> c1").drop("c0", "c1"), "node"), "nodes")


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.drop("comp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def _still_open(large: DataFrame) -> DataFrame:
    """Members (token, fp, comp, main, m, strays, grams) of nodes with more than one component; strays are those outside the largest one.

    Of nodes with the same members one is left.
    """
    rows = large.select(F.col("node").alias("token"), "fp", "n", "comp")
    parts = rows.groupBy("token", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
    nodes = parts.groupBy("token").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("m"), (F.sum("m") - F.max("m")).alias("strays"), F.sum("grams").alias("grams"), F.sum("x").alias("x"), F.bit_xor("y").alias("y")
    )
    nodes = nodes.where("strays > 0").groupBy("m", "x", "y").agg(F.min_by(F.struct("token", "main", "strays", "grams"), "token").alias("node")).select("m", "node.*")
    return written(rows.join(nodes, "token"), "open-nodes")


def _held(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, grams, places) of the open nodes' members: a set is joined once for all nodes that hold it; places: token, comp, main, parts of the node."""
    parts = F.ceil(F.greatest(F.col("m") / TILE, F.col("grams") / (TILE * 128))).cast("int").alias("parts")
    return open_.groupBy("fp").agg(F.collect_list(F.struct("token", "comp", "main", parts)).alias("places")).join(sets, "fp")


def _tiled(open_: DataFrame, texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The links of all strays with all members of other components, block by block; blocks are bounded by members and by shingles."""
    sets = _sets(open_.select("fp").distinct(), texts, reps)
    held = _held(open_, sets)
    at = lambda places: held.select("fp", "grams", F.explode(places).alias("at")).select("fp", "grams", "at.*")
    block, every = F.expr("cast(pmod(xxhash64(fp), parts) as int)"), F.explode(F.expr("sequence(0, parts - 1)"))
    x = at(F.filter("places", lambda p: p["comp"] != p["main"])).withColumn("i", block).withColumn("j", every)
    y = at(F.col("places")).withColumn("j", block).withColumn("i", every)
    x = x.select("token", "i", "j", "fp", "comp", "grams")
    y = y.select(*(F.col(c).alias(f"{c}_y") for c in ("token", "i", "j")), "fp", "comp", "grams").toDF("token_y", "i_y", "j_y", "fp", "comp", "grams")
    pairs = x.groupBy("token", "i", "j").cogroup(y.groupBy("token_y", "i_y", "j_y")).applyInArrow(_tile(percent), "a binary, b binary")
    return written(pairs.distinct(), "links")


def _sets(members: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(fp, grams) of the members, made again from one text of each."""
    keys = written(members.join(reps.select("fp", "tkey"), "fp").select("tkey"), "members")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    sets = texts.join(few, "tkey", "left_semi").select("text").mapInArrow(_full, "fp binary, grams binary").groupBy("fp").agg(F.first("grams").alias("grams"))
    out = written(sets, "sets")
    forget(keys)
    return out


def _links(pairs: DataFrame, texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), texts, reps)
    left, right = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a binary, b binary"), "links")
    forget(sets)
    return out


def _apart(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The pairs that no component holds already."""
    if comps is None:
        return pairs
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _joined(links: DataFrame | None, new: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All links, and their components in place of the earlier ones."""
    links = new if links is None else links.unionAll(new)
    if comps is not None:
        forget(comps)
    return links, written(components(links), "components")


def similar(texts: DataFrame, reps: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(node, comp) of the members linked with any other."""
    planted = reps.select("fp", "n", "sig").mapInArrow(_planted, "node long, fp binary, n long, p long, q long")
    level = _sized(planted.withColumn("comp", F.col("fp")))
    pairs = written(_near(level, percent, leaf), "pairs")
    # one pair of each member first: what these links join needs no other pair, and large nodes that they join need no branching
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links, comps = _joined(None, _links(first, texts, reps, percent), None)
    met = [written(_apart(pairs.join(first, ["a", "b"], "left_anti"), comps), "pairs")]
    forget(pairs)
    for depth in range(1, LEVELS):
        large = level.where(F.col("size") > leaf).drop("size", "hub")
        if depth == 1:
            large = _placed(large, comps)
            mixed_ = large.groupBy("node").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("node")
            large = large.join(mixed_, "node", "left_semi")
        # one row of a set for all its nodes, of which it has no more than TREES * CHOSEN ** depth
        held = large.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "p", "q", "comp")), F.collect_list("node").alias("nodes"))
        going = held.join(reps.select("fp", "sig"), "fp").select("fp", "n", "p", "q", "comp", "nodes", "sig")
        new = _sized(going.mapInArrow(_branched, "node long, fp binary, n long, p long, q long, comp binary"))
        forget(level)
        level = new
        met.append(written(_near(level, percent, leaf), "pairs"))
    rest = met[0]
    for more in met[1:]:
        rest = rest.unionAll(more)
    links, comps = _joined(links, _links(written(rest.distinct(), "pairs"), texts, reps, percent), comps)
    forget(*met)
    # as large as ever at the lowest level: strays are compared with all members in full
    open_ = _still_open(_placed(level.where(F.col("size") > leaf).drop("size", "hub"), comps))
    forget(level)
    if not open_.isEmpty():
        links, comps = _joined(links, _tiled(open_, texts, reps, percent), comps)
    forget(open_)
    return comps


def _classes(docs: DataFrame, percent: int, leaf: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tkey, n, component_id, kept) per row; ``tkey`` is a digest of the row's text."""
    texts = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tkey"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession, BATCH):
        rows = written(texts.select("id", "tkey", "text").mapInArrow(_summary, f"id {kind}, tkey string, n long, fp binary, sig binary"), "signatures")
        reps = written(rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min("tkey").alias("tkey"), F.first("sig").alias("sig"), F.first("n").alias("n")), "members")
        comps = similar(texts, reps, percent, leaf)
    placed = reps.select("fp", "id").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    placed = placed.join(least, "comp").select("fp", "component_id")
    out = rows.select("id", "tkey", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(placed, "fp", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "tkey", "n", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, leaf: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of all linked documents), kept (id = component_id).

    Texts are linked if 100 * shared shingles >= ``percent`` * all shingles. Null and empty texts have no shingle and are linked with
    nothing. Rows with equal ids are separate documents that share a name: each is linked by its own text. A null id is never the smallest
    unless a component has no other; such a row is kept as its component's only one. Other columns are ignored.
    """
    out = _classes(docs, percent, leaf, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def without_near_duplicates(docs: DataFrame, percent: int = 85, leaf: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of each component's smallest id; texts without words all stay.

    Rows that share an id are separate: one goes only if its own text is in a component with a smaller id. Of rows that repeat id and
    text all stay or all go.
    """
    names = [unused(docs, "gone_id"), unused(docs, "gone_text")]
    gone = _classes(docs, percent, leaf, id_col, text_col).where(~F.col("kept"))
    gone = written(gone.select(F.col("id").alias(names[0]), F.col("tkey").alias(names[1])).distinct(), "near-duplicates")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    digest = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (digest == F.col(names[1])), "left_anti")
