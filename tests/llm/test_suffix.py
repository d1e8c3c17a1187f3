import hashlib

from cases import awkward, clashing, documents
from wireloom.llm import suffix


def brute(df):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    first = {}
    for d, raw in rows:
        if d is not None:
            for p in range(len(raw) - 99):
                w = raw[p : p + 100]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in rows:
        gone, mine = bytearray(len(raw)), set()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in mine or (d is not None and first[w] < d):
                gone[p : p + 100] = b"\1" * 100
            mine.add(w)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(df, **k):
    got = sorted(map(tuple, suffix.repeated(df, **k).collect()), key=str)
    want = brute(df)
    assert [g for g in got if g not in want] == [] and got == want
    return got


def test_equals_brute_force(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert any(0 < g[2] < g[1] for g in got)


def test_shuffled_way_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(suffix, "GROUP", 2)
    import random

    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, q = word(150), word(99)
    texts = [word(50) + p + word(80), p[:120] + word(30) + p[30:], q + word(9), q + "!", word(200) + p[10:109] + "x", "ab" * 300, "zab" * 90, p + p, word(60) + p[25:] + q, "é" * 60, "é" * 61]
    check(documents(spark, texts), batches=3)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 512)
    import random

    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(3000))
    check(documents(spark, [base, base[700:2500] + "x" + base[1000:1400], base[::-1] + base[2000:2130]]))


def test_awkward_rows_and_empty_table(spark):
    df = awkward(spark)
    assert sorted(map(tuple, suffix.repeated(clashing(df)).collect()), key=str) == brute(df)
    assert suffix.repeated(documents(spark, [])).count() == 0
