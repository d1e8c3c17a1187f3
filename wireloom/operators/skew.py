"""Joins in which many rows of one side share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BLOCK = 1 << 16


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: str = "frame_no", how: str = "left", width: int = FRAME_BLOCK) -> DataFrame:
    """Join ``rows`` to ``table`` (one row per key) without ever forming one join group per key.

    The table is first copied to the distinct (key, block of ``by``) pairs that occur, which is at most 1/width of a hot key's rows
    when ``by`` is unique per key; the rows then join on key and block.  ``how`` may be left, inner, left_semi or left_anti.
    """
    keys = list(keys)
    block = F.floor(F.col(by) / width)
    blocks = rows.select(*keys, block.alias("__lb")).distinct()
    spread = blocks.join(table, keys)
    return rows.withColumn("__lb", block).join(spread, [*keys, "__lb"], how).drop("__lb")


def explode_buckets(df: DataFrame, start: str, end: str, width: int, out: str = "__bucket") -> DataFrame:
    """One row per ``width``-sized bucket that the half-open interval touches."""
    return df.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
