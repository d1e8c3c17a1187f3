"""Prefix trie of conversations with subtree totals, by time-forward processing.

A node is a sequence of first turns that some conversation begins with. It is named by its depth and the exclusive-or of 128-bit hashes of
its turns and their places, which can be summed block by block, so that one endless conversation is shared by many tasks.

Runs of nodes that all their members pass through are one chain. Chains are sorted by reverse level order and processed from the deepest up:
each takes the totals that its children sent from a priority queue, and sends its own to the place of its parent in that order. This runs
within shards, which are whole subtrees of bounded size; what the roots of shards send is summed per parent and handed to the next level of
shards, up to the one that holds the root.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm.store import written
from wireloom.operators.scan import running, running_count

BLOCK = 1024  # turns of one conversation, or nodes of one chain, that a task handles together
SHARD = 2048  # members of a shard of the lowest level, which then has at most twice as many chains
GROWTH = 64  # members of a shard, level by level
QUEUE = 500_000  # waiting messages held in memory
IDS = 4096  # neighbouring ids listed together
NODE = ["depth", "d1", "d2"]


class SpillingQueue:
    """A priority queue of five-number messages; beyond ``limit`` of them it writes sorted runs to a scratch file of the task and merges them when read."""

    _form = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()  # noqa: SIM115 (closed when drained); only this task reads it
        run.writelines(self._form.pack(*m) for m in sorted(self.heap))
        run.seek(0)
        self.heap = []
        self._advance(len(self.runs), self._read(run))

    def _read(self, run) -> Iterator[tuple]:
        with run:
            while some := run.read(self._form.size * 4096):
                yield from self._form.iter_unpack(some)

    def _advance(self, number: int, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, number, run))

    def take(self, key: tuple) -> Iterator[tuple]:
        """Pops all messages for ``key``, the smallest that can be waiting."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:3] == key:
            head, number, run = heapq.heappop(self.runs)
            yield head
            self._advance(number, run)


_IN = ["bottom", "b1", "b2", "top", "p1", "p2", "root", "own", "kids", "leaves", "below", "conv", "n"]
_OUT = "conv long, n long, top long, bottom long, b1 long, b2 long, p1 long, p2 long, root boolean, kids long, leaves long, below long, total long"


def _forward(limit: int):
    """Chains of whole shards in reverse level order -> their totals; shard roots are marked and send nothing here."""

    def run(batches):
        queue = SpillingQueue(limit)
        for b in batches:
            out = []
            for bottom, b1, b2, top, p1, p2, root, own, kids, leaves, below, conv, n in zip(*(b.column(c).to_pylist() for c in _IN), strict=True):
                for m in queue.take((-bottom, b1, b2)):
                    kids, leaves, below = kids + 1, leaves + m[3], below + m[4]
                if not kids:
                    leaves = 1
                if not root:
                    queue.push((1 - top, p1, p2, leaves, own + below))
                out.append((conv, n, top, bottom, b1, b2, p1, p2, root, kids, leaves, below, own + below))
            if out:
                kinds = [pa.bool_() if i == 8 else pa.int64() for i in range(13)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _OUT.split(", ")])
        if queue.heap or queue.runs:
            raise AssertionError("a chain's parent is missing from its shard")

    return run


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, h1, h2, size): turns by place, from 0, with hashes of role and text and the text's code points.

    Null turns come first; equal turns are ordered by those hashes. Null role or text is empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63))).alias("at"),
        F.xxhash64(F.lit(1), F.octet_length(role), role, text).alias("h1"), F.xxhash64(F.lit(2), F.octet_length(role), role, text).alias("h2"), F.length(text).cast("long").alias("size"),
    )
    slim = written(slim, "turns")
    return running_count(slim, ["conv"], "at", "pos", tie_break=["h1", "h2", "size"], width=BLOCK).drop("at")


def rebuilt(conversations: DataFrame, hundred: int = 100, most: int = 6, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(turns as ``turns_of``, (conv,) of all conversations): conversation c begins with the first h turns of c - c % ``hundred``
    (all it has, none if there is no such one), h = crc32(c in decimal) % ``most``, and goes on with its own turns after its first h."""
    own = written(turns_of(conversations, **columns), "numbered")
    base, h = F.col("conv") - F.col("conv") % hundred, F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.groupBy("conv").agg(F.count("*").alias("turns")).withColumns({"base": base, "h": h})
    have = convs.where(F.col("conv") % hundred == 0).select(F.col("conv").alias("base"), F.col("turns").alias("have"))
    convs = written(convs.join(have, "base", "left").fillna(0, ["have"]), "conversations")
    heads = own.where((F.col("conv") % hundred == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    first = convs.where("h > 0").select("conv", "base", "h").join(heads, "base").where("pos < h").select("conv", "pos", "h1", "h2", "size")
    short = convs.where("have < h").select("conv", (F.col("h") - F.col("have")).alias("lack"))
    rest = own.where(F.col("pos") >= h).join(short, "conv", "left").select("conv", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "h1", "h2", "size")
    return first.unionByName(rest), convs.select("conv")


def _placed(turns: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, p1, p2, size): the node that a conversation has reached after each turn, and the one before."""
    mark = lambda k: F.xxhash64(F.lit(k), "pos", "h1", "h2")
    rows = written(turns.withColumns({"m1": mark(3), "m2": mark(4), "blk": F.expr(f"pos div {BLOCK}")}).drop("h1", "h2"), "marks")
    totals = rows.groupBy("conv", "blk").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    before = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv", "blk", *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    inside = Window.partitionBy("conv", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"l{k}": F.bit_xor(f"m{k}").over(inside) for k in (1, 2)}).join(carry, ["conv", "blk"])
    at = local.select("conv", (F.col("pos") + 1).alias("depth"), "size", "m1", "m2", *(F.col(f"l{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"d{k}") for k in (1, 2)))
    return written(at.select("conv", *NODE, *(F.col(f"d{k}").bitwiseXOR(F.col(f"m{k}")).alias(f"p{k}") for k in (1, 2)), "size"), "placed")


def _chain_totals(chains: DataFrame, nodes: DataFrame, placed: DataFrame, members: int, shard: int, growth: int, queue: int) -> DataFrame:
    """``chains`` with kids, leaves, below (what is saved below the bottom) and total, level by level of shards."""
    done, lower, limit = None, 0, shard
    while True:
        last = limit >= members
        part = chains.where((F.col("n") > lower) & (F.col("n") <= (members if last else limit)))
        if last:
            part = part.withColumns({"s1": F.lit(0), "s2": F.lit(0), "root": F.col("top") == 0})
        else:
            big = nodes.where((F.col("n") > limit) | (F.col("depth") == 0)).select(*NODE)
            above = big.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"))
            roots = placed.join(above, ["depth", "p1", "p2"], "left_semi").join(big, NODE, "left_anti")
            part = part.join(roots.select("conv", F.col("depth").alias("at"), F.col("d1").alias("s1"), F.col("d2").alias("s2")), "conv").withColumn("root", F.col("top") == F.col("at"))
        if done is not None:
            sent = done.where("root").groupBy((F.col("top") - 1).alias("bottom"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
            part = part.join(sent.agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("total").alias("below")), ["bottom", "b1", "b2"], "left")
        else:
            part = part.withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "below")})
        part = part.fillna(0, ["kids", "leaves", "below"]).select(*_IN, "s1", "s2")
        part = (part.repartition(1) if last else part.repartition("s1", "s2")).sortWithinPartitions(F.col("bottom").desc(), "b1", "b2")
        out = written(part.select(*_IN).mapInArrow(_forward(queue), _OUT), "totals")
        done = out if done is None else done.unionByName(out)
        if last:
            return done
        lower, limit = limit, limit * growth


def _listed(batches):
    """(node, ids of a block in order) sorted by node and block -> one sha256 per node, streamed."""
    node, digest = None, None
    row = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])
    for b in batches:
        for depth, d1, d2, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if (depth, d1, d2) != node:
                if node is not None:
                    yield row()
                node, digest = (depth, d1, d2), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if node is not None:
        yield row()


def _ends(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, sha256 of the ids that end there). Ids of a node are listed in blocks of neighbours, so a node with very many is many rows."""
    every = placed.select("conv", *NODE).unionByName(convs.select("conv", *(F.lit(0).cast("long").alias(c) for c in NODE)))
    last = every.groupBy("conv").agg(F.max_by(F.struct(*NODE), "depth").alias("x")).select("conv", "x.*")
    ids: Column = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")))
    blocks = last.groupBy(*NODE, F.floor(F.col("conv") / IDS).alias("chunk")).agg(ids.alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(_listed, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, growth: int = GROWTH, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of ``turns`` (see ``turns_of``) of the conversations ``convs`` (turnless ones included).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's name d1, d2. A node's turns are the first ``depth`` turns of its ``conv_id``. Equal conversations share all nodes. Without
    conversations there is no node.
    """
    placed = _placed(turns)
    convs = convs.distinct()
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    nodes = placed.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("size").alias("size"))
    zero = {c: F.lit(0).cast("long") for c in (*NODE, "p1", "p2", "size")}
    nodes = written(nodes.unionByName(root.withColumns(zero)).withColumn("own", (F.col("n") - 1) * F.col("size")), "nodes")
    chains = nodes.groupBy("conv", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max_by(F.struct("d1", "d2"), "depth").alias("b"), F.min_by(F.struct("p1", "p2"), "depth").alias("p"), F.sum("own").alias("own")
    )
    chains = written(chains.select("conv", "n", "top", "bottom", "own", F.col("b.d1").alias("b1"), F.col("b.d2").alias("b2"), "p.p1", "p.p2"), "chains")
    members = (root.first() or {"n": 0})["n"]
    totals = _chain_totals(chains, nodes, placed, members, shard, growth, queue)
    parents = chains.select((F.col("bottom") + 1).alias("top"), F.col("b1").alias("p1"), F.col("b2").alias("p2"), F.col("conv").alias("parent"))
    totals = totals.join(parents, ["top", "p1", "p2"], "left").select("conv", "n", "top", "bottom", "kids", "leaves", "below", "parent")
    summed = running(nodes.withColumn("up", -F.col("depth")), ["conv", "n"], "up", F.col("own"), "saved", width=BLOCK, inclusive=True)
    out = summed.join(totals, ["conv", "n"]).join(_ends(placed, convs), NODE, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "d1", "d2",
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``), without the nodes' names."""
    return trie(*rebuilt(conversations, **columns)).drop("d1", "d2")
