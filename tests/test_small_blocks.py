"""Many small groups of block maps: resolved like a plain walk, without a call per group between Spark and Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from wireloom.operators import http_headers as hh
from wireloom.operators.walk import by_group, resolve_entries

MAPS = T.StructType([T.StructField("k", T.StringType()), T.StructField("blk", T.LongType()), T.StructField("pos", T.ArrayType(T.LongType())), T.StructField("nxt", T.ArrayType(T.LongType()))])


def _maps(key, blocks, block):
    rnd = random.Random(key)
    return [(f"k{key}", b, pos, [p + rnd.randint(1, 2 * block) for p in pos]) for b in range(blocks) for pos in [sorted(rnd.sample(range(b * block, (b + 1) * block), rnd.randint(0, 3)))]]


def _walked(maps, block):
    jumps, at, out = {p: n for m in maps for p, n in zip(m[2], m[3])}, 0, {}
    for key, blk, _pos, _nxt in maps:
        out[key, blk] = at
        while at < (blk + 1) * block and any(p >= at for p in jumps if p < (blk + 1) * block):
            at = jumps[min(p for p in jumps if p >= at)]
    return out


@pytest.mark.parametrize("fan,levels", [(2, 2), (4, 1)])
def test_entries_of_many_small_groups(spark, fan, levels):
    maps = [_maps(k, 1 + k % 11, 10) for k in range(300)]
    rows = [m for ms in maps for m in ms]
    found = resolve_entries(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), MAPS), ["k"], 10, 20, fan, levels)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {(r["k"], r["blk"]): r["entry"] for r in found.collect()} == {k: v for ms in maps for k, v in _walked(ms, 10).items()}


def test_groups_may_spread_over_batches():
    batches = [pa.record_batch({"k": ["a", "a", "b"], "v": [1, 2, 3]}), pa.record_batch({"k": ["b", None, None], "v": [4, 5, 6]})]
    out = list(by_group(iter(batches), ["k"], ["v"], lambda key, rows: [(*key, [r[0] for r in rows])], [("vs", pa.list_(pa.int64()))], 1, held=0))
    assert [r for b in out for r in b.to_pylist()] == [{"k": "a", "vs": [1, 2]}, {"k": "b", "vs": [3, 4]}, {"k": None, "vs": [5, 6]}]
    assert list(by_group(iter([]), ["k"], ["v"], None, [], 1)) == []


def test_headers_over_small_blocks(spark):
    body = b"GET / HTTP/1.1\r\n" + b"".join(b"F%d: %s\r\n" % (i, b"x" * 30) for i in range(40)) + b"\r\ndone"
    rows = [("c", f"t{k}", "forward", i, i * 64, len(body[i * 64 : i * 64 + 64]), body[i * 64 : i * 64 + 64], 1024, 80) for k in range(20) for i in range((len(body) + 63) // 64)]
    s = spark.createDataFrame(rows, "capture_id string, tuple_key string, direction string, frame_no long, seq long, len long, payload binary, sport long, dport long")
    found = hh.message_headers(s, block=128, fan=2)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {(r["tuple_key"], bytes(r["header"]), r["complete"]) for r in found.collect()} == {(f"t{k}", body[:-4], True) for k in range(20)}
