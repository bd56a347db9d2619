"""Percentiles, intervals, shares and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_floor(value: str, p: float) -> Column:
    """sorted[min(n - 1, floor(n * p))]. From value counts: what is gathered are distinct values, so give integers or rounded numbers."""
    return _rank_value(value, F.least(F.col("_n") - 1, F.floor(F.col("_n") * p)))


def percentile_nearest(value: str, p: float) -> Column:
    """sorted[min(n - 1, ceil(n * p) - 1)], the nearest rank."""
    return _rank_value(value, F.least(F.col("_n") - 1, F.greatest(F.lit(0), F.ceil(F.col("_n") * p) - 1)))


def _rank_value(value: str, rank: Column) -> Column:
    return F.min(F.when(F.col("_below") > rank, F.col(value)))


def percentiles(df: DataFrame, by: list[str], value: str, **wanted: Column) -> DataFrame:
    """by, n and the wanted percentiles (percentile_floor, percentile_nearest) of value; nulls don't count.

    Counts of equal values are summed before anything is sorted, so a group costs as many rows as it has different values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    ranked = counts.withColumn("_below", F.sum("_c").over(whole.orderBy(value))).withColumn("_n", F.sum("_c").over(whole))
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *[c.alias(name) for name, c in wanted.items()])


def ci95(hits: Column, n: Column) -> tuple[Column, Column, Column]:
    """Mean of n zeros and ones of which `hits` are ones, and its 95 % interval within 0 and 1, by the sample variance; (m, m) for n = 1, zeros for n = 0."""
    h, m = hits.cast("double"), n.cast("double")
    mean = F.when(n > 0, h / m).otherwise(F.lit(0.0))
    half = F.when(n > 1, F.sqrt((m * h - h * h) / (m * (m - 1)) / m) * 1.96).otherwise(F.lit(0.0))
    return mean, F.greatest(F.lit(0.0), mean - half), F.least(F.lit(1.0), mean + half)


def time_buckets(df: DataFrame, ts: str, start: str, hours: int, n: int, *aggs: Column) -> DataFrame:
    """bucket (0 .. n-1) and aggregates of the rows within `hours` of start; buckets without rows are there too, with nulls."""
    width = hours * 3600 * 1_000_000 // n
    passed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    inside = df.withColumn("_passed", passed).filter(F.col("_passed").between(0, hours * 3600 * 1_000_000 - 1))
    filled = inside.groupBy(F.least(F.lit(n - 1), F.floor(F.col("_passed") / width)).cast("long").alias("bucket")).agg(*aggs)
    return df.sparkSession.range(n).withColumnRenamed("id", "bucket").join(filled, "bucket", "left")


def top_with_share(df: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """by, item, n, total: the k most frequent items of each group (ties: the smaller item first) and the group's size."""
    counts = df.groupBy(*by, item).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), item)))
    return ranked.filter(F.col("rank") <= k).join(counts.groupBy(*by).agg(F.sum("n").alias("total")), by)


def filled_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column, n for each of the fixed values, with 0 where there are no rows."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
