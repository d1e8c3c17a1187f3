"""Running aggregates that stay balanced when one key holds a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(pos)`` puts a whole key into one task.  Here each key is cut into blocks of ``width``
positions: block totals come from a partial aggregation, their running value from a window over the (far smaller) totals, and the
rows are only windowed inside ``(key, block)``.  ``levels=2`` scans the totals the same way once more, for keys with more than some 10^8 blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 20

_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),  # greatest() ignores NULL
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    out: str,
    fold: str = "sum",
    tie_break: Sequence[str] = (),
    width: int = DEFAULT_WIDTH,
    inclusive: bool = False,
    levels: int = 1,
) -> DataFrame:
    """Add ``out`` = fold of ``value`` over the rows of the key that come before this one (and this one when ``inclusive``).

    ``position`` is a BIGINT column; many rows may share a position only if the caller has bounded them (see ``tie_break``).
    """
    agg, combine = _FOLD[fold]
    keys = list(keys)
    blk, val, carry = f"__{out}_blk", f"__{out}_val", f"__{out}_carry"
    base = df.withColumn(blk, F.floor(F.col(position) / width).cast("bigint")).withColumn(val, value)
    totals = base.groupBy(*keys, blk).agg(agg(val).alias(val))
    if levels > 1:
        carries = running(totals, keys, blk, F.col(val), carry, fold, (), width, False, levels - 1)
    else:
        over_blocks = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        carries = totals.withColumn(carry, agg(val).over(over_blocks))
    carries = carries.select(*keys, blk, carry)
    frame_end = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, blk).orderBy(position, *tie_break).rowsBetween(Window.unboundedPreceding, frame_end)
    local = base.withColumn(val, agg(val).over(inside))
    joined = local.join(_null_safe(carries, keys), [*keys, blk], "left") if keys else local.join(carries, blk, "left")
    return joined.withColumn(out, combine(F.col(val), F.col(carry))).drop(blk, val, carry)


def _null_safe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns are expected to be non-NULL; rows with a NULL key would silently lose their carry."""
    return df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))


def running_count(df: DataFrame, keys: Sequence[str], position: str, out: str, **kw) -> DataFrame:
    """0-based ordinal of the row inside its key (``row_number() - 1``)."""
    return running(df, keys, position, F.lit(1).cast("bigint"), out, "sum", **kw)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Union of overlapping or adjacent half-open intervals per key (gaps and islands over skew-proof running maxima).

    Equal starts are collapsed first with a map-side aggregation: only the longest interval of a start can matter.
    """
    keys = list(keys)
    longest = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    marked = running(longest, keys, start, F.col(end), "__prev_end", "max", width=width)
    opened = marked.withColumn("__open", F.when(F.col("__prev_end").isNull() | (F.col(start) > F.col("__prev_end")), F.col(start)))
    islands = running(opened, keys, start, F.col("__open"), "__island", "max", width=width, inclusive=True)
    return islands.groupBy(*keys, "__island").agg(F.max(end).alias(end)).select(*keys, F.col("__island").alias(start), end)


def disjoint(ranges: Column) -> Column:
    """Union of the half-open ``{a, b}`` of a sorted array: sorted, neither overlapping nor touching."""
    first = F.struct(F.slice(ranges, 1, 0).alias("out"), F.get(ranges, F.lit(0))["a"].alias("a"), F.get(ranges, F.lit(0))["b"].alias("b"))

    def step(acc: Column, r: Column) -> Column:
        on = r["a"] <= acc["b"]
        done = F.when(on, acc["out"]).otherwise(F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))
        return F.struct(done.alias("out"), F.when(on, acc["a"]).otherwise(r["a"]).alias("a"), F.when(on, F.greatest(acc["b"], r["b"])).otherwise(r["b"]).alias("b"))

    last = lambda acc: F.array_append(acc["out"], F.struct(acc["a"].alias("a"), acc["b"].alias("b")))
    return F.when(F.size(ranges) > 1, F.aggregate(ranges, first, step, last)).otherwise(ranges)


def merged_blocks(df: DataFrame, keys: Sequence[str], start: str, end: str, block: str, width: int, out: str = "ranges") -> DataFrame:
    """``(block, keys, out)``: of the half-open intervals that begin in a block of ``width`` positions the union, as a sorted array of ``{a, b}``.

    Intervals are gathered where they arise, so one row per key and block is moved. The last of a block may reach into later blocks.
    """
    rows = df.withColumn(block, F.floor(F.col(start) / width))
    held = rows.groupBy(block, *keys).agg(F.array_sort(F.collect_set(F.struct(F.col(start).alias("a"), F.col(end).alias("b")))).alias(out))
    return held.withColumn(out, disjoint(F.col(out)))


def covering_end(points: DataFrame, keys: Sequence[str], at: str, ranges: DataFrame, start: str, end: str, out: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Add ``out``: the largest end of the ranges of the key that start at or before the point (NULL without one).

    A point is covered when ``out`` lies behind it. Points and range starts are swept together in order, block by block, so neither a
    long range nor a hot key is spread out or collected. Equal points are expected to have been made distinct.
    """
    kind, stop = f"__{out}_kind", f"__{out}_end"
    marks = ranges.select(*keys, F.col(start).alias(at), F.col(end).alias(stop), F.lit(0).alias(kind))
    rows = points.withColumns({stop: F.lit(None).cast("bigint"), kind: F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    return running(rows, keys, at, F.col(stop), out, "max", tie_break=[kind], width=width).where(F.col(kind) == 1).drop(kind, stop)


def trailing(
    df: DataFrame, keys: Sequence[str], ordinal: str, size: int, aggs: dict[str, Column], width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Aggregates over the last ``size`` rows (by dense ``ordinal``) without one task per key.

    Rows that are needed as history by the next block(s) are copied into them, windowed, and dropped again.
    """
    keys = list(keys)
    if size > width:
        width = size
    copies = F.sequence(
        F.floor(F.col(ordinal) / width).cast("bigint"), F.floor((F.col(ordinal) + size - 1) / width).cast("bigint")
    )
    spread = df.withColumn("__blk", F.explode(copies))
    w = Window.partitionBy(*keys, "__blk").orderBy(ordinal).rowsBetween(-(size - 1), 0)
    for name, agg in aggs.items():
        spread = spread.withColumn(name, agg.over(w))
    return spread.where(F.col("__blk") == F.floor(F.col(ordinal) / width)).drop("__blk")
