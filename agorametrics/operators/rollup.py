"""Daily rollups that batches keep current: exact counts of values.

A rollup row says how often a value occurs on a day for an account and platform. Sums, means, medians and second
moments all follow from it, and it merges by adding. A batch logs the counts of its own rows; a row that replaces
another logs the old one's value with -1, so late and changed rows are corrections, in any order. Values are
whole hundredths: sums are exact. A batch has its own folder: one that comes again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions.metric import round_dp

UNIT = 100


def _cents(value: str) -> Column:
    return F.round(F.col(value) * UNIT).cast("bigint")


def changes(old: DataFrame | None, new: DataFrame, value: str, day: Column, keys=("account_id", "platform")) -> DataFrame:
    """keys, day, cents, n that take the rows of ``old`` out and those of ``new`` in; rows without a value count nothing."""
    at = [*keys, day.alias("day"), _cents(value).alias("cents")]
    rows = new.select(*at, F.lit(1).alias("n"))
    if old is not None:
        rows = rows.unionByName(old.select(*at, F.lit(-1).alias("n")))
    counted = rows.filter(F.col("cents").isNotNull()).groupBy(*keys, "day", "cents").agg(F.sum("n").cast("bigint").alias("n"))
    return counted.filter(F.col("n") != 0)


def log_changes(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch={batch}")


def read_rollup(spark: SparkSession, path: str, keys=("account_id", "platform")) -> DataFrame:
    """keys, day, cents, n of all batches together."""
    return spark.read.parquet(path).groupBy(*keys, "day", "cents").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def compact_rollup(spark: SparkSession, path: str, folded: str, keys=("account_id", "platform")) -> None:
    """All batches as one batch of a new log, which goes on from there."""
    log_changes(read_rollup(spark, path, keys), folded, -1)


def summary(rollup: DataFrame, keys=("account_id", "platform")) -> DataFrame:
    """keys, n, mean, median, second_moment of the values; group by any of the rollup's columns, days too.

    Equal values are added up first; the places of the rest are found with windows over distinct values.
    """
    keys = list(keys)
    values = rollup.groupBy(*keys, "cents").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("cents").rowsBetween(W.unboundedPreceding, 0))
    placed = values.withColumns({"upto": upto, "all": F.sum("n").over(group)})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("cents")))

    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    return placed.groupBy(*keys).agg(
        F.max("all").alias("n"), round_dp(F.sum(F.col("cents") * F.col("n")) / F.max("all") / UNIT, 4).alias("mean"),
        round_dp((at(low) + at(high)) / 2 / UNIT, 4).alias("median"),
        round_dp(F.sum(F.col("cents") * F.col("cents") * F.col("n")) / F.max("all") / (UNIT * UNIT), 4).alias("second_moment"))
