"""Small tables with the awkward rows that every operator has to bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that clash with names which operators may use inside.
CLASH = ("id", "i", "k", "t", "h", "n", "s", "row", "rid", "key", "label", "size", "words")


def documents(spark, texts):
    """texts: list of texts, or of (doc_id, text)."""
    rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}", len(t or "")) for i, t in rows], SCHEMA)


def awkward(spark):
    base = "one two three four five six seven eight nine ten eleven twelve. " * 3
    rows = [(0, base), (1, base), (1, base), (2, None), (3, ""), (4, " \n\t "), (None, base + "more words"), (None, None), (5, "a"), (6, "x" * 70_000), (7, base * 200), (8, "Ünï – \U0001f600 \x00 text ▁ with  odd\r\nmarks")]
    return documents(spark, rows)


def clashing(df):
    for c in CLASH:
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df


def real(spark, sf, n=200):
    return spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id < {n}")
