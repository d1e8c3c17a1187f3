import random

import pyarrow as pa
from cases import documents
from test_suffix import check
from wireloom.llm import suffix


def _one_by_one(batches):
    raise AssertionError("suffixes of a group of some hundreds are entered one by one")
    yield


def test_hundreds_of_passages_of_one_anchor_are_compared_together(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_suffixes", _one_by_one)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common = word(160)
    got = check(documents(spark, [word(120) + common + word(120) for _ in range(450)]))
    assert sum(0 < g[2] < g[1] for g in got) == 449


def test_slices_of_passages_change_no_span(monkeypatch):
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcd") for _ in range(400))
    rows = sorted((rnd.randrange(3), rnd.randrange(40), k, 0, base[(a := rnd.randrange(200)) : a + rnd.randrange(100, 200)]) for k in range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], ["v", "id", "dk", "s", "passage"])
    spans = lambda: sorted(tuple(r.values()) for b in suffix._compared([batch]) for r in b.to_pylist())
    whole = spans()
    monkeypatch.setattr(suffix, "SLICE", 250)
    assert len(whole) > 20 and spans() == whole


def _texts_with_marks(n):
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    whole, common = word(60_000), word(400)
    return [whole, whole + "x", whole[:150] + word(90) + common, *(word(150) + (common if i < 2 else "") for i in range(n))]


def test_lists_are_not_broadcast_and_no_text_without_spans_is_moved(spark, monkeypatch):
    """A side that is broadcast was bounded by its rows only: one row listed each of some thousand runs of a text."""
    sent, broadcast, made, written = [], suffix.F.broadcast, {}, suffix.written
    monkeypatch.setattr(suffix.F, "broadcast", lambda df: (sent.append(df), broadcast(df))[1])
    monkeypatch.setattr(suffix, "written", lambda df, name: made.update({name: written(df, name)}) or made[name])
    got = check(documents(spark, _texts_with_marks(5) + ["a" * 120, "a" * 120]))
    assert got[1][2] == 60_000
    assert [kind for df in sent for _, kind in df.dtypes if kind.startswith("array")] == []
    assert 0 < max(len(r.spans or ()) for r in made["spans"].collect()) < 20


def test_runs_of_many_anchors_are_still_narrowed_down(spark, monkeypatch):
    """Of more anchors than the driver collects, all runs of all texts were entered."""
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    made, written = {}, suffix.written
    monkeypatch.setattr(suffix, "written", lambda df, name: made.update({name: written(df, name)}) or made[name])
    rnd = random.Random(6)
    word = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    common = word(300)
    got = check(documents(spark, [word(8_000) for _ in range(20)] + [word(200) + common, common + word(200)]))
    assert [g[2] for g in got if g[2]] == [300]
    assert made["runs"].count() < 60


def test_bit_map_tells_all_and_few_others(spark):
    v = spark.range(20_000).selectExpr("xxhash64(id) AS v")
    words, own = suffix._bit_map(v, 20_000), v.toArrow().column("v").to_numpy().view("uint64")
    others = spark.range(20_000, 40_000).selectExpr("xxhash64(id) AS v").toArrow().column("v").to_numpy().view("uint64")
    assert suffix._mapped(own, words).all() and suffix._mapped(others, words).mean() < 0.1


def test_suffixes_of_common_anchors_with_maps(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(suffix, "BROADCAST_COPIES", -1)
    monkeypatch.setattr(suffix, "GROUP", 2)
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common, copy = word(230), word(300)
    texts = [word(120) + common[rnd.randrange(90) :] + word(120) for _ in range(30)] + [copy, copy, copy + "x", None, "", "é" * 130]
    check(documents(spark, [*enumerate(texts), (None, copy), (31, copy)]))
