"""Running sums, range joins and shuffles that need no single partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.lineage import table


def prefix_sum(df: DataFrame, value: str, order: list[str], within: list[str] | None = None, into: str = "before", parts: int | None = None) -> DataFrame:
    """`df` with `into`: the sum of `value` over all rows before it in `order`, for each group of `within`.

    Two levels: rows are put in ranges of the order, the sums of the ranges (a row for each
    range and group) are added up by a window, and each range adds its own running sum. So
    neither the table nor a hot group ever has to fit a task. Ties in the order are broken
    arbitrarily but once; a null value counts as 0.
    """
    within = within or []
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*within, *order]
    spread = df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id())
    base = table(spread, "ranges")
    sums = base.groupBy("__part", *within).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__sum"))
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    own = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("__own", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(own), F.lit(0)))
    same = F.col("l.__part") == F.col("r.__part")
    for c in within:
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = local.alias("l").join(starts.alias("r"), same)
    return out.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l.__own") + F.col("r.__start")).alias(into))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, on: list[str] | None = None) -> DataFrame:
    """Points with the range low <= point < high they fall in, by an equi-join.

    Ranges are listed under each bucket as wide as the widest range that they touch (two at
    most), so a point meets only those of its bucket. Empty ranges hold nothing.
    """
    on = on or []
    solid = ranges.where(F.col(low) < F.col(high))
    width = solid.agg(F.max(F.col(high) - F.col(low))).first()[0] or 1  # one number
    slots = F.sequence(F.expr(f"`{low}` div {width}"), F.expr(f"(`{high}` - 1) div {width}"))
    right = solid.withColumn("__slot", F.explode(slots))
    left = points.withColumn("__slot", F.expr(f"`{point}` div {width}"))
    met = left.join(right, [*on, "__slot"])
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("__slot")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """`df` in an order that depends on the seed and the key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def take_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of the order."""
    return df.orderBy(*order).limit(n)


def within_budget(docs: DataFrame, budget: int, order: list[str], text: str = "text", within: list[str] | None = None) -> DataFrame:
    """docs up to and with the one that reaches `budget` bytes of UTF-8; `bytes_before` says how many came earlier."""
    sized = docs.withColumn("__bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    return prefix_sum(sized, "__bytes", order, within, "bytes_before").where(F.col("bytes_before") < budget).drop("__bytes")


def newest(files: DataFrame, n: int, within: str | None = None) -> DataFrame:
    """The n entries of (path, modified) last modified; ties go to the greater path."""
    w = (Window.partitionBy(within) if within else Window).orderBy(F.desc("modified"), F.desc("path"))
    if within is None:
        return files.orderBy(F.desc("modified"), F.desc("path")).limit(n)
    return files.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= n).drop("__row")
