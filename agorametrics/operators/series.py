"""Time series per account in local time, gap filling, rolling means, platform comparison."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions import metric as M
from agorametrics.functions import timeparse as T
from agorametrics.functions.metric import Metric, cents, mean_of, round_dp, select_metrics
from agorametrics.operators import kpi as K
from agorametrics.operators import posts as P
from agorametrics.operators.ordered import exact_median
from agorametrics.vocab import DISPLAY_TZ

BASELINE_DAYS = 90


def gap_fill(series: DataFrame, keys, granularity: str, values, bucket: str = "bucket") -> DataFrame:
    """Add the missing buckets between a key's first and last one, with 0.

    Each row emits itself and the empty buckets up to the next row: one window over buckets that
    are already aggregated, no join and no calendar.
    """
    keys, values = list(keys), list(values)
    following = F.lead(bucket).over(W.partitionBy(*keys).orderBy(bucket))
    step = T.step(granularity)
    filled = series.select(
        *keys, *values, F.col(bucket).alias("_start"),
        F.coalesce(following - step, F.col(bucket)).alias("_until"),
    ).select(
        *keys, *values,
        F.posexplode(F.sequence("_start", "_until", step)).alias("_pos", bucket),
    )
    zeros = [F.when(F.col("_pos") == 0, F.col(v)).otherwise(F.lit(0.0)).alias(v) for v in values]
    return filled.select(*keys, bucket, *zeros)


def sum_timeseries(df: DataFrame, value: str, granularity: str, keys=("account_id",),
                   ts: str = "published_at", tz: str = DISPLAY_TZ, fill: bool = True) -> DataFrame:
    """Sum of a count per local-time bucket; a missing value counts as 0."""
    keys = list(keys)
    sums = df.groupBy(*keys, T.bucket(F.col(ts), granularity, tz).alias("bucket")).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("_v")
    )
    series = sums.select(*keys, "bucket", round_dp("_v").alias("value"))
    return _labelled(gap_fill(series, keys, granularity, ["value"]) if fill else series, granularity)


def engagement_rate_timeseries(df: DataFrame, granularity: str, denominator: str = "reach",
                               keys=("account_id",), ts: str = "published_at",
                               tz: str = DISPLAY_TZ, fill: bool = True) -> DataFrame:
    """Pooled rate per bucket: summed engagement over the summed denominator, 0 without one.

    ``followers`` enters the denominator once per post of the bucket.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, T.bucket(F.col(ts), granularity, tz).alias("bucket")).agg(
        F.sum("engagement").alias("_e"), F.sum(denominator).alias("_d")
    )
    series = _pooled(sums, keys)
    return _labelled(gap_fill(series, keys, granularity, ["value"]) if fill else series, granularity)


def _pooled(sums: DataFrame, keys) -> DataFrame:
    raw = sums.withColumn(
        "_r", F.when(F.col("_d") > 0, F.col("_e") / F.col("_d") * 100.0).otherwise(0.0)
    )
    return raw.select(*keys, "bucket", round_dp("_r").alias("value"))


def _labelled(series: DataFrame, granularity: str) -> DataFrame:
    return series.withColumn("label", T.bucket_label(F.col("bucket"), granularity))


def rolling_mean(series: DataFrame, window: int, keys=("account_id",), value: str = "value",
                 bucket: str = "bucket", name: str = "rolling") -> DataFrame:
    """Trailing mean over ``window`` buckets of a gap-filled, rounded series; the first
    ``window - 1`` are null."""
    if window <= 1:
        return series.withColumn(name, F.col(value))
    ordered = W.partitionBy(*keys).orderBy(bucket)
    frame = ordered.rowsBetween(-(window - 1), 0)
    summed = series.withColumn("_s", F.sum(cents(F.col(value))).over(frame)).withColumn(
        "_n", F.row_number().over(ordered))
    mean = F.when(F.col("_n") >= window, F.col("_s") / 100.0 / window)
    return summed.withColumn("_m", mean).withColumn(name, round_dp("_m")).drop("_s", "_n", "_m")


def kpi_timeseries(metrics: DataFrame, metric: str = "err", granularity: str = "day",
                   rolling: int | None = None, tz: str = DISPLAY_TZ) -> DataFrame:
    """Any metric over time for every account, with an optional rolling mean.

    Rates use reach for accounts that expose it and followers otherwise; both denominators are
    summed in the one aggregation and the account's basis picks between them.
    """
    metric = metric.lower()
    if metric in K.RATE_ALIASES:
        sums = metrics.groupBy(
            "account_id", T.bucket(F.col("published_at"), granularity, tz).alias("bucket")
        ).agg(
            F.sum("engagement").alias("_e"), F.sum("reach").alias("_reach"),
            F.sum("followers").alias("_followers"),
            F.max(F.when(F.col("reach") > 0, 1).otherwise(0)).alias("_seen"),
        )
        exposes = F.max("_seen").over(W.partitionBy("account_id")) == 1
        named = sums.withColumn("name", F.when(exposes, "engagement_rate_by_reach")
                                .otherwise("engagement_rate_by_followers"))
        named = named.withColumn("_d", F.when(exposes, F.col("_reach")).otherwise(F.col("_followers")))
        keys = ["account_id", "name"]
        series = _labelled(gap_fill(_pooled(named, keys), keys, granularity, ["value"]), granularity)
    elif metric in K.COUNT_METRICS:
        series = sum_timeseries(metrics, K.COUNT_METRICS[metric], granularity, tz=tz).withColumn(
            "name", F.lit(metric))
    else:
        raise ValueError(f"unknown metric {metric!r}: use err or one of {sorted(K.COUNT_METRICS)}")
    out = ["account_id", "name", "bucket", "label", "value"]
    if rolling:
        series = rolling_mean(series, rolling)
        out.append("rolling")
    return series.select(*out)


def chart(series: DataFrame, keys=("account_id",)) -> DataFrame:
    """Labels and values of each series as two arrays, for a chart. Only at the edge: one row
    holds a whole series."""
    points = F.array_sort(F.collect_list(F.struct("bucket", "label", "value")))
    return series.groupBy(*keys).agg(points.alias("_p")).select(
        *keys, F.transform("_p", lambda p: p["label"]).alias("labels"),
        F.transform("_p", lambda p: p["value"]).alias("data"),
    )


def kpi_by_platform(facts: DataFrame, as_of, window: str = "30d") -> DataFrame:
    """Platforms side by side, each with the z-score of its current mean rate against its own
    daily means of the trailing 90 days (UTC days, both rounded as reported).

    Platforms are few and huge: everything is summed per platform and day first.
    """
    until, delta = P.moment(as_of), P.parse_window(window)
    cur_since, base_since = until - delta, until - timedelta(days=BASELINE_DAYS)
    scan = P.between(facts, "published_at", min(cur_since, base_since), until)
    cur = F.col("published_at") >= P.timestamp(cur_since)
    base = F.col("published_at") >= P.timestamp(base_since)
    has_er = F.col("er").isNotNull()
    er = cents(F.col("er"))
    daily = scan.groupBy("platform", F.to_date("published_at").alias("day")).agg(
        F.count_if(cur).alias("n"), F.sum(F.when(cur, F.col("engagement")).otherwise(0)).alias("e"),
        F.sum(F.when(cur, er)).alias("s"), F.count_if(cur & has_er).alias("ne"),
        F.count_if(cur & (F.col("er_basis") == "err")).alias("err"),
        F.count_if(cur & (F.col("er_basis") == "erf")).alias("erf"),
        F.sum(F.when(base, er)).alias("bs"), F.count_if(base & has_er).alias("bn"),
    ).withColumn("_day_raw", F.when(F.col("bn") > 0, F.col("bs") / 100.0 / F.col("bn")))
    daily = daily.withColumn("day_mean", round_dp("_day_raw"))
    totals = daily.groupBy("platform").agg(
        F.sum("n").alias("n_posts"), F.sum("e").alias("total_engagement"),
        F.sum("s").alias("_s"), F.sum("ne").alias("_ne"),
        F.sum("err").alias("_err"), F.sum("erf").alias("_erf"),
        F.avg("day_mean").alias("_mu"), F.stddev_samp("day_mean").alias("_sd"),
        F.count("day_mean").alias("_days"),
    ).filter(F.col("n_posts") > 0)
    medians = exact_median(P.between(scan, "published_at", cur_since), ["platform"], "er", "_median")
    joined = totals.join(medians, "platform", "left")
    mean = mean_of(F.col("_s") / 100.0, F.col("_ne"))
    joined = joined.withColumn("_mean", mean.value)
    keep = [
        F.col("platform"), F.col("n_posts"), F.col("total_engagement"),
        K.dominant_basis(F.col("_err"), F.col("_erf")).alias("engagement_rate_basis"),
        F.col("_mean").alias("avg_engagement_rate"), mean.reason.alias("avg_engagement_rate_reason"),
    ]
    return select_metrics(joined, keep, {
        "median_engagement_rate": Metric(
            F.col("_median"), F.when(F.col("_median").isNull(), M.INSUFFICIENT_DATA)),
        "zscore_vs_90d_baseline": M.zscore(F.col("_mean"), F.col("_mu"), F.col("_sd"), F.col("_days")),
    })


def zscore_per_key(df: DataFrame, keys, value: str = "er", ts: str = "published_at",
                   current_since=None) -> DataFrame:
    """Z-score per key of the mean of the current values against all daily means."""
    keys = list(keys)
    cur = F.col(ts) >= P.timestamp(current_since)
    daily = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(
        F.sum(cents(F.col(value))).alias("s"), F.count(value).alias("n"),
        F.sum(F.when(cur, cents(F.col(value)))).alias("cs"),
        F.count_if(cur & F.col(value).isNotNull()).alias("cn"),
    ).withColumn("_raw", F.when(F.col("n") > 0, F.col("s") / 100.0 / F.col("n")))
    daily = daily.withColumn("day_mean", round_dp("_raw"))
    agg = daily.groupBy(*keys).agg(
        F.avg("day_mean").alias("_mu"), F.stddev_samp("day_mean").alias("_sd"),
        F.count("day_mean").alias("baseline_days"), F.sum("cs").alias("_cs"), F.sum("cn").alias("_cn"),
    ).withColumn("_mean", F.when(F.col("_cn") > 0, F.col("_cs") / 100.0 / F.col("_cn")))
    agg = agg.withColumn("current_mean", round_dp("_mean"))
    z = M.zscore(F.col("current_mean"), F.col("_mu"), F.col("_sd"), F.col("baseline_days"))
    keep = [*[F.col(k) for k in keys], F.col("current_mean"), F.col("baseline_days")]
    return select_metrics(agg, keep, {"zscore": z})
