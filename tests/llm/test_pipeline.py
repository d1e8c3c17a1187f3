"""Each stage of the pipeline against plain Python on its own input, and the whole run."""

import os
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from cases import documents  # noqa: E402
from test_secrets import ASSIGN  # noqa: E402
from wireloom.llm import secrets, toxicity  # noqa: E402


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def rows_of(df):
    return sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(os.path.join(sf, "documents.parquet"))


def test_toxicity_keeps_what_the_model_keeps(spark, sf, docs):
    model = toxicity.train(docs, spark.read.parquet(os.path.join(sf, "labels.parquet")))
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    out = pipeline.drop_toxic(spark, docs, sf)
    assert out.columns == docs.columns
    assert rows_of(out) == [(i, t) for i, t in rows_of(docs) if score[i] < 0.5]


def near_groups(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: top(i) for i in ids}


def test_one_of_each_near_duplicate_group_stays(spark, sf, docs):
    out = pipeline.drop_near_duplicates(spark, docs, sf)
    group = near_groups(rows_of(docs))
    assert out.columns == docs.columns
    assert rows_of(out) == [(i, t) for i, t in rows_of(docs) if group[i] == i]


def contaminated(text, items):
    have = shingles(text)
    return any(s and 10 * len(s & have) >= 8 * len(s) for s in items)


def test_documents_that_hold_an_item_go(spark, sf, docs):
    items = [shingles(r.text) for r in spark.read.parquet(os.path.join(sf, "benchmark.parquet")).collect()]
    out = pipeline.drop_contaminated(spark, docs, sf)
    assert out.columns == docs.columns
    kept = [(i, t) for i, t in rows_of(docs) if not contaminated(t, items)]
    assert rows_of(out) == kept and 0 < len(kept) < docs.count()


def test_secrets_are_masked_and_documents_stay(spark, sf, docs):
    out = pipeline.mask_secrets(spark, docs, sf)
    spans = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
    assert out.columns == docs.columns and out.count() == docs.count()
    before = dict(rows_of(docs))
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert (r.text or "") == before[r.doc_id] if not spans[r.doc_id] else "<" in r.text
        assert not [m for m in ASSIGN.finditer(r.text or "") if len(m[2]) >= 6 and m[0] in before[r.doc_id]]


def test_whole_run(spark, sf, docs):
    out = pipeline.run(spark, sf).collect()
    assert len(out) == len({r.doc_id for r in out}) and all(r.exact for r in out)
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
    texts = {i: t for i, t in rows_of(left)}
    assert {r.doc_id for r in out} == set(texts)


def test_empty_documents(spark, sf):
    none = documents(spark, [])
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, none, sf).count() == 0, name
