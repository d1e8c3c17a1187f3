"""Benchmark decontamination: MinHash containment search for short items inside documents of any length, by size classes, then exact shingles.

An item's sketch is the ``SKETCH`` smallest hashes of its 5-word shingles (all of them if it has fewer). A document that contains 0.8 of an
item's shingles holds none of the sketch with probability 0.2 ** SKETCH, whatever the document's own size, so that one shared sketch hash
makes a candidate. Items are parted by the power of two of their size: a document is looked up only in classes whose smallest item
it can contain, and only its shingles up to the class's largest sketch hash. Candidates are then confirmed on whole shingle sets.
Only DataFrame functions; the documents' shingles are not shuffled while the sketches are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.store import unused, written

BLANK = r"[ \t\n\u000B\f\r]+"
SKETCH = 14
#: Most rows (some 40 bytes each) that are broadcast; larger tables are joined by shuffle.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingled(df: DataFrame, text: str) -> DataFrame:
    """``hs`` for ``text``: hashes of the 5-word shingles in order and with repeats; of fewer words one hash of all; empty without words.

    The words are bound as a lambda variable: a plain column could be put in place of its name inside the inner lambda, once per word.
    """
    ws = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BLANK, -1), lambda w: w != "")
    hs = F.expr(
        "transform(array(_ws), ws -> case when size(ws) = 0 then cast(array() as array<bigint>) when size(ws) < 5 then array(xxhash64(size(ws), array_join(ws, ' '))) "
        "else transform(sequence(0, size(ws) - 5), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])) end)[0]"
    )
    return df.withColumn("_ws", ws).withColumn("hs", hs).drop("_ws", text)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(docs: DataFrame, items: DataFrame, tenths: int = 8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(fp, item, n_item, n_shared) of every distinct text ``fp`` (its md5) that contains ``tenths`` tenths of an item's shingles.

    Texts and items of fewer than five words have one shingle, all their words; without words they have none and match nothing.
    """
    of_items = _shingled(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")), "t")
    of_items = written(of_items.select("item", F.array_sort(F.array_distinct("hs")).alias("hs")).where("size(hs) > 0"), "items")
    sketch = of_items.select("item", F.size("hs").alias("n_item"), F.explode(F.slice("hs", 1, SKETCH)).alias("h")).withColumn("class", F.floor(F.log2("n_item")).cast("int"))
    sketch = written(sketch, "sketches")
    n_sketch = sketch.count()
    # sketches ascend by signed hash, so the classes' largest sketch hashes bound what is looked up; a class is a row, at most 31
    bounds = sketch.groupBy("class").agg(F.min("n_item").alias("least"), F.max("h").alias("most")).collect()
    if not bounds:
        return of_items.selectExpr("'' as fp", "item", "0L as n_item", "0L as n_shared")  # it has no rows
    reach = F.greatest(F.lit(-(1 << 63)), *[F.when(F.size("hs") * 10 >= F.lit(r["least"] * tenths), F.lit(r["most"])) for r in bounds])
    own = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("fp"), F.col(text_col).alias("t"))
    near = F.expr("transform(array(struct(hs as hs, reach as reach)), x -> filter(x.hs, h -> h <= x.reach))[0]")
    looked = _shingled(own, "t").withColumn("reach", reach).select("fp", F.size("hs").alias("n_doc"), F.explode_outer(near).alias("h"))
    hits = looked.join(_small(sketch.select("h", "item", "n_item"), n_sketch), "h").where(F.col("n_doc") * 10 >= F.col("n_item") * tenths)
    pairs = written(hits.select("fp", "item").distinct(), "candidates")
    n_pairs = pairs.count()
    texts = own.join(_small(pairs.select("fp").distinct(), n_pairs), "fp", "left_semi")
    shingles = _shingled(texts, "t").select("fp", F.explode_outer("hs").alias("h")).distinct()
    wanted = pairs.join(of_items, "item").select("fp", "item", F.size("hs").cast("long").alias("n_item"), F.explode("hs").alias("h"))
    return (
        wanted.join(shingles, ["fp", "h"]).groupBy("fp", "item", "n_item").agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") * 10 >= F.col("n_item") * tenths)
    )


def contamination(docs: DataFrame, items: DataFrame, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and contained item: id, item_id, n_item (shingles of the item), n_shared.

    Null texts count as empty and contain nothing. Repeated documents give repeated rows, repeated items one. Null ids are carried. Other
    columns are ignored; an empty table of either kind gives an empty result.
    """
    found = contained(docs, items, tenths, text_col, item_col, item_text)
    own = docs.select(F.col(id_col).alias("_doc"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("fp"))
    found = found.groupBy("fp", "item").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return own.join(found, "fp").select(F.col("_doc").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared")


def without_items(docs: DataFrame, items: DataFrame, tenths: int = 8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text contains no item."""
    found = written(contained(docs, items, tenths, text_col, item_col, item_text).select("fp").distinct(), "contaminated")
    fp = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    name = unused(docs, "contaminated")
    return docs.join(_small(found.select(F.col("fp").alias(name)), found.count()), fp == F.col(name), "left_anti")
