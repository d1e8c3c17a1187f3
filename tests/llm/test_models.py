import math
import zlib
from collections import Counter

from cases import awkward, clashing, documents
from wireloom.llm import quality, suffix_tree, toxicity

SF = "/root/testdata/sf0.01"


def test_classifiers_beat_the_prior_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r.doc_id: r for r in labels.collect()}
    for module, score, label, parts, rest in ((toxicity, toxicity.toxicity, "toxic", 5, 0), (quality, quality.quality, "quality", 3, 1)):
        rows = score(docs, module.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows)
        held = [(r.score, marks[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in marks]
        ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
        auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
        assert auc > 0.8
        trained = [r.score for r in score(clashing(awkward(spark)), module.train(docs, labels)).collect()]
        assert len(trained) == 12 and all(0 < s < 1 for s in trained)
        texts = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
        assert score(texts, module.train(texts, labels.selectExpr("concat('d', doc_id) as doc_id", label))).count() == docs.count()
        odd = score(clashing(awkward(spark)), module.train(docs, labels.limit(0))).collect()
        assert len(odd) == 12 and all(r.score == 0.5 for r in odd)
        assert score(documents(spark, []), module.train(documents(spark, []), labels)).count() == 0


def base(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return Counter((d, held(d), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)


def check(df, **k):
    rows = suffix_tree.score(df, suffix_tree.train(df, **k)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == base([(r.doc_id, r.text) for r in df.collect()])
    assert all(r.score < 0 for r in rows)
    return rows


def test_base_scores_equal_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), frequent=50)
    check(clashing(awkward(spark)))
    empty = documents(spark, [])
    assert suffix_tree.score(empty, suffix_tree.train(empty)).count() == 0


def test_next_byte_probabilities_sum_to_one(spark):
    import numpy as np

    m = suffix_tree.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), gain=5.0)
    for ctx in (b"e the", b"\n\n\n\n\n", b"zzzzz", b" ing "):
        runs = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.int64)
        assert abs((10 ** suffix_tree.log10_next(runs, m.states, m.entries)).sum() - 1) < 1e-9


def test_all_contexts_that_pass_stay_and_a_joined_tree_scores_alike(spark):
    """A tree too large to be sent to every task is joined, not cut."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent, joined = suffix_tree.train(docs, gain=1.0), suffix_tree.train(docs, gain=1.0, entries=0)
    assert sent.deeper is None and joined.deeper is not None
    assert len(joined.entries[0]) + joined.deeper.count() == len(sent.entries[0])
    for df in (docs, awkward(spark)):
        a, b = (sorted(((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score(df, m).collect()), key=str) for m in (sent, joined))
        assert a == b


def test_features_are_made_where_the_rows_are(spark):
    """Labelled texts are drawn by id, features made in the tasks that read them; of a repeated id one row is learnt from."""
    from pyspark.sql import functions as F
    from wireloom.llm import labelled

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(2000)] + [(2, "other")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    chosen = labelled.sample(docs, labels, "toxic", F.lit(True), 100)
    n = labelled.fitted(chosen, toxicity.features, lambda xs, y: [len(xs), y.sum()], 2)
    assert list(n) == [2, 1]
    assert chosen.rdd.getNumPartitions() >= 4


def test_classifier_scores_equal_brute_force(spark):
    """Scores from given weights, made again from n-grams as text."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    w = toxicity.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    place = {}
    for r in toxicity.toxicity(docs, w).collect():
        grams = {texts[r.doc_id][i : i + n] for n in toxicity.ORDERS for i in range(len(texts[r.doc_id]) - n + 1)}
        buckets = set()
        for g in grams:
            if g not in place:
                # of a text of n characters only its own n-gram is new to the n-grams of its parts
                inner = {b for m in toxicity.ORDERS if m < len(g) for i in range(len(g) - m + 1) for b in toxicity.features(g[i : i + m])}
                own = set(toxicity.features(g).tolist()) - inner if len(g) > min(toxicity.ORDERS) else set(toxicity.features(g).tolist())
                place[g] = own
            buckets |= place[g]
        z = sum(float(w[b]) for b in buckets) + float(w[-1])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_quality_scores_equal_brute_force(spark):
    import numpy as np

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    w = quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.quality(docs, w).collect():
        ws = texts[r.doc_id].encode().lower().split()
        single = {x.decode(): int(quality.features(x.decode())[0]) for x in set(ws)}
        buckets = set(single.values())
        for a, b in set(zip(ws, ws[1:])):
            a, b = a.decode(), b.decode()
            buckets |= set(quality.features(f"{a} {b}").tolist())
        z = sum(float(w[k]) for k in buckets) / max(1, len(buckets)) ** 0.5 + float(w[-1])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6
