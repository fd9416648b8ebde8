"""Ordered operations on groups of any size.

A window partitioned by account sorts all rows of an account in one task. One account may hold a
third of the table, so these operators first cut each group into slices along the order (a time
bucket, a value band, a hash prefix), work inside the slices, and carry only one small row per
slice across them. The result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Rows a slice should hold at most: a group with more gets narrower slices.
ROWS = 1_000_000


def hot_groups(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Keys of the groups of more than ``ROWS`` rows, as ``_key0`` .., and the seconds that hold ``ROWS``
    of their rows on average. At most a row for every ``ROWS`` of the input: small enough to broadcast."""
    at = F.unix_micros(F.col(ts))
    n = F.count(ts)
    span = (F.max(at) - F.min(at)) / 1e6
    hot = df.groupBy(*keys).agg(n.alias("_n"), F.greatest(F.lit(1), F.floor(span * ROWS / n)).cast("bigint").alias("_width"))
    return hot.filter(F.col("_n") > ROWS).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_width")


def with_slice(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, hot: DataFrame) -> DataFrame:
    """Add ``_slice``: the second a slice of the group's time starts at; slices ascend with time."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    width = F.least(F.coalesce("_width", F.lit(seconds)), F.lit(seconds))
    start = F.floor(F.unix_micros(F.col(ts)) / (width * 1_000_000)) * width
    return df.join(F.broadcast(hot), same, "left").withColumn("_slice", start.cast("bigint")).select(*df.columns, "_slice")


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str,
                  slice_seconds: int = 3600) -> DataFrame:
    """Add ``name``: the previous ``ts`` of the same group, null for the first row."""
    keys = list(keys)
    sliced = with_slice(df, keys, ts, slice_seconds, hot_groups(df, keys, ts))
    inside = W.partitionBy(*keys, "_slice").orderBy(ts, tie)
    rows = sliced.withColumn("_prev", F.lag(ts).over(inside))
    # one row per slice: its last timestamp, handed to the slice that follows
    ends = sliced.groupBy(*keys, "_slice").agg(F.max(ts).alias("_last"))
    ends = ends.select(
        *keys, "_slice", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice")).alias("_carried")
    )
    joined = rows.join(ends, [*keys, "_slice"], "left")
    return joined.withColumn(name, F.coalesce("_prev", "_carried")).drop("_prev", "_carried", "_slice")


def gap_hours(df: DataFrame, keys: Sequence[str], ts: str, slice_seconds: int = 3600) -> DataFrame:
    """All gaps in hours between neighbouring rows of a group, without the rows they belong to.

    Gaps inside a slice need no join; gaps between slices come from the slices' ends.
    """
    keys = list(keys)
    sliced = with_slice(df.select(*keys, ts), keys, ts, slice_seconds, hot_groups(df, keys, ts))
    inside = W.partitionBy(*keys, "_slice").orderBy(ts)
    within = sliced.select(*keys, F.lag(ts).over(inside).alias("_a"), F.col(ts).alias("_b"))
    ends = sliced.groupBy(*keys, "_slice").agg(F.min(ts).alias("_b"), F.max(ts).alias("_last"))
    between = ends.select(
        *keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice")).alias("_a"), "_b"
    )
    hours = (F.unix_micros("_b") - F.unix_micros("_a")) / F.lit(3_600_000_000.0)
    both = within.unionByName(between).filter(F.col("_a").isNotNull())
    return both.select(*keys, hours.alias("gap_hours"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact interpolated median per group: ``keys``, ``name``.

    Equal values are counted first. Counts per value band then tell in which band the middle
    rows lie, and only that band's values are ordered.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        # bands grow with the value: at most some thousands of them, whatever the data
        .withColumn("_band", (F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * 64)).cast("bigint"))
    )
    before = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    bands = (
        counted.groupBy(*keys, "_band").agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys)))
        .withColumn("_low", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_high", F.floor((F.col("_total") + 2) / 2))
        .filter((F.col("_before") < F.col("_high"))
                & (F.col("_before") + F.col("_bn") >= F.col("_low")))
        .drop("_bn", "_total")
    )
    upto = W.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        counted.join(bands, [*keys, "_band"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    holds = lambda rank: (F.col("_start") < F.col(rank)) & (F.col("_end") >= F.col(rank))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(holds("_low"), F.col("_v"))) + F.max(F.when(holds("_high"), F.col("_v")))) / 2)
        .alias(name)
    )


def rank_by_hash(df: DataFrame, keys: Sequence[str], digest: str, rank: str, size: str) -> DataFrame:
    """Row number by a hex digest and group size, for groups such as labels that are few and huge.

    The first three digits of the digest cut a group into 4096 slices that are already in order.
    """
    return rank_in_slices(df, keys, F.substring(digest, 1, 3), [F.col(digest)], rank, size)


def rank_in_slices(df: DataFrame, keys: Sequence[str], slice_: Column, order: list[Column], rank: str, size: str) -> DataFrame:
    """Row number and group size without a window over a whole group.

    ``slice_`` cuts a group into parts that ascend in the order; rows are numbered inside their part,
    behind the rows of the parts before.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias(size),
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(rank, (F.col("_offset") + F.col("_rn")).cast("bigint"))
        .drop("_slice", "_rn", "_offset")
    )


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str,
                    seen: str, value: str, name: str, max_days: int,
                    slice_seconds: int = 86400) -> DataFrame:
    """Left rows with the right value whose time is nearest, not further than ``max_days``.

    A linear as-of join: both sides are stacked, each row looks back and ahead within its slice,
    and slices pass their first and last observation on. Equally near: the earlier one. ``left``
    must hold no column called ``name``; its null times and keys stay, without a value.
    """
    keys = list(keys)
    obs = F.struct(F.col(seen).alias("t"), F.col(value).alias("v"))
    observed = right.filter(F.col(seen).isNotNull()).select(
        *keys, F.col(seen).alias("_t"), F.lit(0).alias("_side"), obs.alias("_obs")
    )
    asked = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1))
    # slices are as wide as the group's rows of both sides allow
    times = asked.select(*keys, "_t").unionByName(observed.select(*keys, "_t"))
    hot = hot_groups(times, keys, "_t")
    stacked = with_slice(asked.unionByName(observed, allowMissingColumns=True), keys, "_t", slice_seconds, hot)
    # looking ahead is looking back in the opposite order: a frame that ends at the current row
    # grows with it, one that ends at the last row is evaluated anew for every row
    order = [F.col("_t"), F.col("_side"), F.col("_obs.v")]
    back = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys, "_slice").orderBy(*[c.desc() for c in order]).rowsBetween(
        W.unboundedPreceding, 0)
    rows = (
        stacked.withColumn("_back", F.last("_obs", True).over(back))
        .withColumn("_ahead", F.last("_obs", True).over(ahead))
        .filter(F.col("_side") == 1)
    )
    ends = (
        with_slice(observed, keys, "_t", slice_seconds, hot)
        .groupBy(*keys, "_slice")
        .agg(F.min("_obs").alias("_first"), F.max("_obs").alias("_last"))
    )
    # a slice of left rows without observations still needs its neighbours' ends
    asked_slices = with_slice(asked.select(*keys, "_t"), keys, "_t", slice_seconds, hot).select(*keys, "_slice").distinct()
    frame = asked_slices.join(ends, [*keys, "_slice"], "full")
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carried = frame.select(
        *keys, "_slice", F.last("_last", True).over(earlier).alias("_carried_back"),
        F.last("_first", True).over(later).alias("_carried_ahead"),
    )
    joined = rows.join(carried, [*keys, "_slice"], "left")
    before, after = F.coalesce("_back", "_carried_back"), F.coalesce("_ahead", "_carried_ahead")
    limit = F.lit(max_days * 86_400_000_000)
    to_before = F.unix_micros("_t") - F.unix_micros(before["t"])
    to_after = F.unix_micros(after["t"]) - F.unix_micros("_t")
    use_before = before.isNotNull() & (after.isNull() | (to_before <= to_after))
    found = (
        F.when(use_before & (to_before <= limit), before["v"])
        .when(~use_before & (to_after <= limit), after["v"])
    )
    return joined.select(*left.columns, found.alias(name))
