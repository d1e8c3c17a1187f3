import re

from cases import awkward, clashing, documents, real
from wireloom.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    at = {}
    for i in range(len(ws) - 4):
        at.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def check(df):
    rows = rules.rules(df).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(rows) == df.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in [brute(t) for t in texts[r.doc_id]]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    return rows


def test_base_counts_equal_brute_force(spark, sf):
    rows = check(real(spark, sf, 2000))
    assert sum(r.kept for r in rows) > len(rows) / 2


def test_awkward_rows_and_clashing_names(spark):
    check(clashing(awkward(spark)))


def test_lines_of_the_letter_f_and_of_form_feeds(spark):
    """A SQL literal reads a backslash before f as the letter alone."""
    texts = ["ff\nff\nfine", "\f\n\f\nfine"]
    check(documents(spark, texts))
    assert [(r.n_lines, r.n_dup_lines) for r in rules.measured(documents(spark, texts)).orderBy("id").collect()] == [(3, 1), (1, 0)]


def test_empty_table(spark):
    assert rules.rules(documents(spark, []).limit(0)).count() == 0


def test_clean_stays_and_junk_goes(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in rules.rules(real(spark, sf, 10**9)).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    assert sum(good) / len(good) > 0.95


def test_em_tells_rules_apart():
    """Votes drawn from known accuracies: the estimate ranks the good rule over the random one."""
    import random

    rnd = random.Random(5)
    acc = [0.95, 0.9, 0.9, 0.5, 0.9, 0.85, 0.85]
    counts = {}
    for _ in range(20000):
        y = 1 if rnd.random() < 0.8 else -1
        v = tuple((y if rnd.random() < a else -y) if rnd.random() < 0.7 else 0 for a in acc)
        counts[v] = counts.get(v, 0) + 1
    before, plus, minus = rules.accuracies(list(counts.items()))
    assert 1.0 < before < 1.8
    assert plus[0] > plus[3] and minus[0] < minus[3] and abs(plus[3]) < 0.3
