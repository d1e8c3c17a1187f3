"""The conversation trie against a plain walk."""

import hashlib
import random
import zlib

import pytest
from cases import clashing
from compare import compare, connection
from wireloom.llm import queries as Q
from wireloom.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [out[x] for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        m = sorted(members[node])
        ends = ",".join(str(c) for c in m if len(new[c]) == len(node))
        own_saved = (len(m) - 1) * len(node[-1][1]) if node else 0
        parent = min(members[node[:-1]]) if node else None
        out[node] = (m[0], len(node), parent, len(m), len(below), sum(b[5] for b in below) or 1, own_saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def run(spark, rows, **kw):
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    out = T.trie(*T.rebuilt(df), **kw).drop("d1", "d2")
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def some(seed, n=120):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "déjà\n vu"])) for c in range(0, 2 * n, 2) for t in range(rng.randrange(0, 9))]


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(5, 0, "user", "hi")], [(0, None, None, None)], [(3, 0, "u", "x"), (3, 0, "u", "x"), (3, 0, "u", "x")]])
def test_small(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_awkward(spark):
    rows = some(1, 60) + [(7, None, "user", "first"), (7, 3, None, None), (500, 0, "user", "x" * 70_000), (500, 1, "user", "y"), (None, 0, "user", "z")]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    rows += [(401, t, "user", str(t % 7)) for t in range(300)]  # one long conversation
    assert run(spark, rows) == plain(rows)


def test_small_shards_blocks_and_queue(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "IDS", 5)
    rows = some(2) + [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    assert run(spark, rows, shard=3, growth=4, queue=2) == plain(rows)


def test_queue_spills_in_order():
    q = T.SpillingQueue(5)
    rng = random.Random(3)
    for k in sorted(range(40), key=lambda _: rng.random()):
        q.push((k // 4, 0, 0, k, 1))
    assert len(q.runs) > 2
    assert [sorted(m[3] for m in q.take((j, 0, 0))) for j in range(10)] == [[4 * j + i for i in range(4)] for j in range(10)]


def test_query(spark, sf):
    n, error = compare(spark, connection(sf), "op13", Q.QUERIES["op13_trie"], Q.ORACLES["op13_trie"], sf)
    assert error is None and n > 0
