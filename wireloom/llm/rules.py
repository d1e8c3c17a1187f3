"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how often each is right, and the posterior
probability of good quality decides. Only DataFrame functions on the rows; the driver sees the counts of vote patterns (at most 3 to the
power of the number of rules)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import written

BLANK = r"[ \t\n\u000B\f\r]"
SYMBOLS = "#*$%&|<>"

#: name -> (SQL that is true for a good text, SQL that is true for a bad one); neither means that the rule abstains.
RULES = {
    "length": ("n_words >= 40", "n_words < 10"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "4 * n_symbols >= n_words"),
    "lines": ("n_lines >= 3 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("n_words >= 20 and n_repeat_words = 0", "20 * n_repeat_words > 3 * n_words"),
    "sentences": ("60 * n_stops >= n_words", "200 * n_stops < n_words"),
    "letters": ("10 * n_letters >= 8 * word_chars and n_words > 0", "10 * n_letters < 6 * word_chars"),
}


def _repeat_words() -> Column:
    """Words covered by 5-word windows that occur at least twice among ``ws``. Windows are compared by a 64-bit hash."""
    hashes = "transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]))"
    # sorted (hash, place) pairs; equal neighbours are repeats; their places in order give the covered words
    places = (
        "transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), s -> "
        "array_sort(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 and s[j].x = s[j - 1].x) or (j < size(s) - 1 and s[j].x = s[j + 1].x)), j -> s[j].i)))[0]"
    )
    covered = f"aggregate(transform(array({places}), p -> zip_with(p, slice(p, 2, size(p)), (a, b) -> least(5, coalesce(b - a, 5))))[0], 0L, (s, x) -> s + x)"
    return F.expr(f"case when size(ws) < 6 then 0L else transform(array({hashes}), h -> case when size(array_distinct(h)) = size(h) then 0L else {covered} end)[0] end")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts that the rules read, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    lines = F.expr(rf"filter(split(t, '\n', -1), x -> x rlike '[^ \t\n\u000B\u000C\r]')")
    split = base.withColumn("ws", F.filter(F.split("t", BLANK + "+", -1), lambda w: w != "")).withColumn("ls", lines)
    return split.select(
        "id",
        F.size("ws").cast("long").alias("n_words"),
        F.expr("aggregate(ws, 0L, (s, w) -> s + length(w))").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", ".!?", ""))).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


def _votes() -> list[Column]:
    return [F.expr(f"case when {good} then 1 when {bad} then -1 else 0 end") for good, bad in RULES.values()]


def accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[float], list[float]]:
    """(log-odds of good quality before any vote, weights of a good vote, weights of a bad vote) by expectation-maximisation.

    Each rule has P(votes good | good), P(votes bad | bad) and the two error rates; a rule is held to be right more often than wrong (both
    weights keep their sign), and counts are smoothed by a few agreeing texts, so that no data leaves the starting guess.
    """
    k = len(RULES)
    prior, good, bad = 0.8, [[0.7, 0.05] for _ in range(k)], [[0.2, 0.4] for _ in range(k)]  # P(good vote), P(bad vote) by class
    log = math.log
    for _ in range(rounds):
        mass, g, b = [2.0, 0.5], [[1.4, 0.1] for _ in range(k)], [[0.1, 0.2] for _ in range(k)]
        for votes, n in patterns:
            z = log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v:
                    z += log(good[j][v < 0] / bad[j][v < 0])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            mass[0] += n * p
            mass[1] += n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    g[j][v < 0] += n * p
                    b[j][v < 0] += n * (1 - p)
        prior = min(0.99, max(0.5, mass[0] / sum(mass)))
        for j in range(k):
            good[j] = [g[j][0] / mass[0], g[j][1] / mass[0]]
            bad[j] = [min(b[j][0] / mass[1], good[j][0] / 1.05), max(b[j][1] / mass[1], good[j][1] * 1.05)]
    return log(prior / (1 - prior)), [log(good[j][0] / bad[j][0]) for j in range(k)], [log(good[j][1] / bad[j][1]) for j in range(k)]


def rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    ``kept``: the base rule passes and the posterior probability of good quality is at least ``threshold``. A null text counts as empty and
    fails; repeated rows get equal verdicts; an empty table gives an empty result. Other columns are ignored.
    """
    counts = written(measured(docs, id_col, text_col), "rules")  # narrow rows; read for the patterns and for the verdicts
    voted = counts.withColumn("votes", F.array(*_votes()))
    patterns = [(tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect()]
    before, plus, minus = accuracies(patterns)
    odds = F.lit(before)
    for j in range(len(RULES)):
        odds = odds + F.when(F.col("votes")[j] == 1, F.lit(plus[j])).when(F.col("votes")[j] == -1, F.lit(minus[j])).otherwise(F.lit(0.0))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return (
        voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
        .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
    )
