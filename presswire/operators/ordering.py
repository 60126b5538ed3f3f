"""Ordered work over groups of any size.

A plain window over a hot key sorts the whole group in one task. Here each
group is cut into ranges of its order column, every range is handled on its
own, and only one small row per range is combined across a group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Spark limits row_number() <= k before the shuffle up to this many rows a
# group (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000


def first_rows(df: DataFrame, keys: list, order: list, k: int = 1, rank: str | None = None, spread: str | None = None) -> DataFrame:
    """The first k rows per key.

    Spark keeps k rows a key in each task before the shuffle while k is small.
    For a larger k the rows are written once in ranges of the order and ranked
    inside those, so no task sorts a whole hot group. `spread`, a column with many
    values, orders equals, so that ranges split those too.
    """
    name = rank or "_rank"
    if k > _GROUP_LIMIT:
        order = [*order, F.col(spread)] if spread else order
        cut = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
        df = _ranked(cut, keys, order, name)
    else:
        df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    df = df.where(F.col(name) <= k)
    return df if rank else df.drop(name)


def _ranges(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width))


def number_rows(df: DataFrame, keys: list[str], position: Column, order: list, out: str, width: int = 1_000_000) -> DataFrame:
    """``row_number()`` per key, for keys of any size.

    `position` is a number that grows with `order`; rows are ranked inside
    ranges of `width` and shifted by the size of the earlier ranges.
    """
    return _ranked(df.withColumn("_range", _ranges(position, width)), keys, order, out)


def _ranked(cut: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``row_number()`` per key of rows in numbered ranges ``_range`` of the order."""
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = cut.withColumn("_local", F.row_number().over(local))
    return _with_ranges(ranked, offsets, keys).withColumn(out, F.col("_before") + F.col("_local")).drop(
        "_range", "_local", "_before"
    )


def previous_value(df: DataFrame, keys: list[str], position: Column, order: list, value: str, out: str, width: int) -> DataFrame:
    """``lag(value)`` per key, for keys of any size.

    The first row of a range takes the last value of the nearest earlier range
    that has rows. `value` must grow with `order`.
    """
    cut = df.withColumn("_range", _ranges(position, width))
    lasts = cut.groupBy(*keys, "_range").agg(F.max(value).alias("_last"))
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    carried = lasts.select(*keys, "_range", F.lag("_last").over(over_ranges).alias("_carried"))
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    lagged = cut.withColumn("_lag", F.lag(value).over(local)).withColumn("_first", F.row_number().over(local) == 1)
    joined = _with_ranges(lagged, carried, keys)
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop(
        "_range", "_lag", "_first", "_carried"
    )


def _with_ranges(rows: DataFrame, per_range: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per range back to its rows; NULL keys match each other."""
    right = per_range.select(*[F.col(k).alias(f"_r_{k}") for k in keys + ["_range"]],
                             *[c for c in per_range.columns if c not in keys + ["_range"]])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys + ["_range"]]
    return rows.join(right, on).drop(*[f"_r_{k}" for k in keys + ["_range"]])
