import re

from cases import awkward, clashing, documents, real
from wireloom.llm import graph, near_dup


def grams(text):
    ws = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def brute(df):
    rows = [(r.doc_id, grams(r.text)) for r in df.collect()]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        f = find(i)
        least[f] = d if least.get(f) is None else (least[f] if d is None else min(d, least[f]))
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(rows)), key=str)


def check(df):
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=str)
    assert got == brute(df)
    return got


def test_equals_brute_force(spark, sf):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(not g[3] for g in got)


def test_large_group_with_a_chain(spark):
    """More near copies than a leaf holds, and a chain whose ends are not linked themselves."""
    base = [f"w{i}" for i in range(400)]
    many = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 400, 5)]
    chain = [" ".join(f"c{i}" for i in range(k, k + 300)) for k in range(0, 100, 20)]
    got = check(documents(spark, many + chain + many[:3]))
    assert {g[2] for g in got} == {0, 80}


def test_awkward_rows_clashing_names_and_empty_table(spark):
    df = awkward(spark)
    assert sorted(map(tuple, near_dup.near_duplicates(clashing(df)).collect()), key=str) == brute(df)
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dup.without_near_duplicates(df).columns == df.columns


def test_sketch_cut_follows_percent():
    from math import comb

    for percent in (50, 80, 85, 100):
        t, cut = percent / 100 + (1 - percent / 100) / 4, near_dup.least_equal(percent)
        assert sum(comb(64, k) * t**k * (1 - t) ** (64 - k) for k in range(cut)) < 1e-12
    assert near_dup.least_equal(50) < near_dup.least_equal(80) < near_dup.least_equal(85)


def test_rows_that_share_an_id_stay_apart(spark):
    """Only the row goes whose own text has a copy with a smaller id."""
    x, y = (" ".join(f"{w}{i}" for i in range(30)) for w in "xy")
    df = documents(spark, [(3, x), (5, x), (5, y), (None, y), (7, None)])
    df = clashing(df).selectExpr("*", "1 as gone_id", "2 as _gone_text", "3 as gone_text")
    got = near_dup.without_near_duplicates(df)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, x), (5, y), (7, None)], key=str)
    assert got.columns == df.columns


def test_trees_reach_the_links_of_a_template_group(spark, monkeypatch):
    """Recall of the trees alone, without blocks at the end, against brute force on thousands of texts of one template."""
    import random

    rnd = random.Random(8)
    base, texts = [f"t{i}" for i in range(200)], []
    for k in range(1500):
        own = list(base)
        for at in rnd.sample(range(0, 200, 5), 12):
            own[at] = f"k{k}x{at}"
        texts.append(" ".join(own))
        own[rnd.choice(range(2, 199, 5))] = f"k{k}y"
        texts.append(" ".join(own))
    monkeypatch.setattr(near_dup, "_tiled", lambda open_, texts, reps, percent: spark.createDataFrame([], "a binary, b binary"))
    df = documents(spark, texts)
    comp = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    met = sum(comp[2 * k] == comp[2 * k + 1] for k in range(1500))
    assert met >= 0.9 * 1500


def test_large_group_of_members_that_are_not_linked_with_its_smallest_one(spark, monkeypatch):
    """Texts of one template at 0.7 to 0.8 of each other, two by two at 0.9: every node is large, and no member but one has the smallest as its pair."""
    import random

    rnd = random.Random(5)
    base, texts = [f"t{i}" for i in range(300)], []
    for k in range(150):
        own = list(base)
        for at in rnd.sample(range(0, 300, 6), 6):
            own[at] = f"k{k}x{at}"
        texts.append(" ".join(own))
        own[rnd.choice(range(1, 299, 6))] = f"k{k}y"
        texts.append(" ".join(own))
    monkeypatch.setattr(near_dup, "TILE", 64)
    got = check(documents(spark, texts))
    assert len({g[2] for g in got}) > 24


def test_a_set_is_joined_once_for_all_open_nodes(spark):
    """Joined once for each node that holds it, a group of n sets made up to 48 n rows with all their shingles."""
    fps = [bytes([k]) * 16 for k in range(40)]
    rows = [(t, fp, fps[k % 3], fps[0], 40, 27, 400 + t * 1_000_000) for t in range(9) for k, fp in enumerate(fps)]
    open_ = spark.createDataFrame(rows, "token long, fp binary, comp binary, main binary, m long, strays long, grams long")
    sets = spark.createDataFrame([(fp, fp * 3) for fp in fps], "fp binary, grams binary")
    held = near_dup._held(open_, sets).collect()
    assert sorted((bytes(r.fp), bytes(r.grams)) for r in held) == [(fp, fp * 3) for fp in fps]
    want = sorted((t, fp, comp, main, max(1, -(-g // (near_dup.TILE * 128)))) for t, fp, comp, main, _, _, g in rows)
    assert sorted((p.token, bytes(r.fp), bytes(p.comp), bytes(p.main), p.parts) for r in held for p in r.places) == want


def test_tile_joins_what_all_links_join():
    import numpy as np

    rnd = np.random.default_rng(1)
    for _ in range(20):
        linked = rnd.random((30, 40)) < 0.04
        pairs = list(near_dup._forest(linked))
        assert all(linked[p] for p in pairs)

        def joined(edges):
            up = list(range(70))
            for _ in range(70):
                for i, j in edges:
                    up[i] = up[30 + j] = min(up[i], up[30 + j])
            return up

        assert joined(pairs) == joined(list(zip(*np.nonzero(linked), strict=True)))


def test_components(spark):
    import random

    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
