import re

from cases import awkward, clashing, documents, real
from wireloom.llm import contamination as C


def shingles(text):
    ws = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(docs, items):
    its = [(r.item_id, shingles(r.text)) for r in items.collect()]
    out = []
    for d in docs.collect():
        s = shingles(d.text)
        out += [(d.doc_id, i, len(x), len(x & s)) for i, x in its if x and len(x & s) * 10 >= len(x) * 8]
    return sorted(out, key=str)


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_equals_brute_force(spark, sf):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute(docs, items)
    assert want and sorted(map(tuple, C.contamination(docs, items).collect()), key=str) == want
    left = C.without_items(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len({w[0] for w in want})


def test_shuffled_way_gives_the_same(spark, sf, monkeypatch):
    docs, items = real(spark, sf, 500), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(docs, items)
    monkeypatch.setattr(C, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, C.contamination(docs, items).collect()), key=str) == want


def test_awkward_rows(spark):
    items = items_of(spark, ["one two three four five six seven eight", None, "", "a", "Nine TEN eleven twelve. one", "odd\nmarks"])
    docs = awkward(spark)
    got = sorted(map(tuple, C.contamination(clashing(docs), items).collect()), key=str)
    assert got == brute(docs, items) and any(g[0] is None for g in got)


def test_empty_tables(spark):
    docs, items = documents(spark, []), items_of(spark, ["one two three four five six"])
    assert C.contamination(docs, items).count() == 0 and C.without_items(docs, items).count() == 0
    assert C.contamination(awkward(spark), items.limit(0)).count() == 0
    assert C.without_items(awkward(spark), items.limit(0)).count() == awkward(spark).count()


def test_clashing_name_stays(spark):
    from cases import documents

    docs = documents(spark, ["a b c d e f g h", "other words"]).selectExpr("*", "'x' as contaminated", "'y' as _contaminated_fp")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    rows = C.without_items(docs, items).collect()
    assert [(r.doc_id, r.contaminated) for r in rows] == [(1, "x")]
