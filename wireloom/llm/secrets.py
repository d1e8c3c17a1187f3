"""Secret scan: candidates by pattern, then their hashes counted over distinct repositories and owners of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.sql import folded
from wireloom.llm.store import written

#: Fixed patterns: kind -> (pattern, group that holds the value, least length of that value).
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Spans that the method adds: long tokens of mixed letters and digits.
ADDED = {"mixed": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[a-z])[A-Za-z0-9_-]{32,}", 0, 32)}
KINDS = [*BASE, *ADDED]
SPAN = "struct<s:int,r:int,e:int,k:string,v:string>"


def _spans(kind: str) -> str:
    """SQL: array of (start, rank, end, kind, value) of the matches in ``t``, in code points. Pieces between matches give the places."""
    pattern, group, least = (BASE | ADDED)[kind]
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    step = (
        "(a, i) -> struct(a.at + length(x.b[i]) + length(x.m[i]) as at, concat(a.out, array(struct(a.at + length(x.b[i]) as s, "
        f"{KINDS.index(kind)} as r, a.at + length(x.b[i]) + length(x.m[i]) as e, '{kind}' as k, x.v[i] as v))) as out)"
    )
    # split drops nothing with -1, so there is one piece more than matches
    found = (
        f"transform(array(struct(split(t, {p}, -1) as b, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {group}) as v)), x -> "
        f"{folded('sequence(0, size(x.m) - 1)', '0', step, SPAN)}.out)[0]"
    )
    return f"case when t rlike {p} then filter({found}, x -> length(x.v) >= {least}) else cast(array() as array<{SPAN}>) end"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(row, id, owner, spans) of every document, written once so that row numbers are fixed."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    spans = F.expr("array_sort(concat(" + ", ".join(_spans(k) for k in KINDS) + "))")
    hashed = F.expr("transform(s, x -> struct(x.s as s, x.r as r, x.e as e, x.k as k, sha2(x.v, 256) as h, length(x.v) as n, size(array_distinct(split(x.v, ''))) as d))")
    return written(rows.select("row", "id", "owner", spans.alias("s")).withColumn("s", hashed), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Each candidate's uses, distinct repositories (documents) and distinct owners.

    Repositories and owners are made distinct by the shuffle on (value, repository) and (value, owner), so a value that a third of all
    rows hold is spread.
    """
    one = found.select(F.explode("s").alias("x"), F.col("id").alias("repo"), "owner").select("x.h", "repo", "owner")
    return one.groupBy("h").agg(F.count("*").alias("uses"), F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))


def _copied(owners: int, repos: int):
    """Widely copied: held by several owners, or by so many repositories that one owner's live credential is unlikely."""
    return (F.col("owners") >= owners) | (F.col("repos") >= repos)


def secrets(docs: DataFrame, copied: int = 3, copied_repos: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, owners, repos.

    A value found with at least ``copied`` owners or in at least ``copied_repos`` repositories is a copied example, any other that looks random
    (8 or more distinct characters) is live; ``owners`` and ``repos`` are the largest numbers of owners and repositories of a value of the document. A null text counts as empty. Null owners are no owner, null
    repositories no repository; repeated rows of a document are one repository. Other columns are ignored.
    """
    found = candidates(docs, id_col, text_col, owner_col)
    held = found.select("row", F.explode("s").alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.d").alias("d"))
    judged = (
        held.join(ownership(found), "h")
        .groupBy("row").agg(
            F.count(F.when(~_copied(copied, copied_repos) & (F.col("d") >= 8), 1)).alias("n_live"), F.count(F.when(_copied(copied, copied_repos), 1)).alias("n_copied"),
            F.max("owners").alias("owners"), F.max("repos").alias("repos"),
        )
    )
    text = "concat_ws(',', transform({}, x -> concat_ws(':', x.k, x.s, x.e)))"
    out = found.select(
        "row", F.col("id").alias(id_col),
        *[F.expr(f"size(filter(s, x -> x.k = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(text.format(f"filter(s, x -> x.r < {len(BASE)})")), 256).alias("base_sha256"), F.expr(text.format("s")).alias("spans"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.join(judged, "row", "left").select(id_col, *[f"n_{k}" for k in BASE], "base_sha256", "spans", zero("n_live"), zero("n_copied"), zero("owners"), zero("repos"))


def without_secrets(docs: DataFrame, copied: int = 3, copied_repos: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """All rows and columns, with found spans of the text replaced: ``<kind>`` for live ones, ``<kind:copied>`` for widely copied values.

    Rows without a match pass in a projection; only rows with matches are written and joined with their values' verdicts. A span that
    starts inside the one before it is taken with it. Null texts stay null.
    """
    names = docs.columns
    t = F.col(f"`{text_col}`")
    any_match = F.lit(False)
    for pattern, _, _ in (BASE | ADDED).values():
        any_match = any_match | t.rlike(pattern)
    has = F.coalesce(any_match, F.lit(False))
    hits = docs.where(has).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), t.alias("t"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"),
    )
    spans = F.expr("array_sort(concat(" + ", ".join(_spans(k) for k in KINDS) + "))")
    hashed = F.expr("transform(s, x -> struct(x.s as s, x.r as r, x.e as e, x.k as k, sha2(x.v, 256) as h))")
    hits = written(hits.withColumn("s", spans).withColumn("s", hashed), "secret-rows")
    many = ownership(hits).where(_copied(copied, copied_repos)).select("h")
    known = hits.select("row", F.explode("s").alias("x")).select("row", F.col("x.h").alias("h")).distinct().join(many, "h").groupBy("row").agg(F.collect_set("h").alias("many"))
    step = (
        "(a, x) -> case when x.s < a.at then struct(greatest(a.at, x.e) as at, a.out as out) else struct(x.e as at, concat(a.out, array(concat("
        "substring(t, a.at + 1, x.s - a.at), '<', x.k, case when array_contains(many, x.h) then ':copied>' else '>' end))) as out) end"
    )
    cut = F.expr(f"transform(array({folded('s', '0', step, 'string')}), y -> concat(array_join(y.out, ''), substring(t, y.at + 1)))[0]")
    masked = hits.join(known, "row", "left").withColumn("many", F.coalesce("many", F.array().cast("array<string>"))).withColumn("new", cut)
    masked = masked.select(*[F.col("new").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in names])
    return docs.where(~has).unionAll(masked)
