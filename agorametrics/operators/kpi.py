"""Post KPIs and account KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions import metric as M
from agorametrics.functions.metric import Metric, cents, mean_of, rate, round_dp, select_metrics
from agorametrics.operators import posts as P
from agorametrics.operators.ordered import exact_median, gap_hours

COUNT_METRICS = {
    "likes": "likes", "comments": "comments_count", "shares": "shares", "saves": "saves",
    "reach": "reach", "impressions": "impressions", "video_views": "video_views",
    "clicks": "clicks", "engagement": "engagement",
}
RATE_ALIASES = ("err", "erf", "engagement_rate", "er")


def post_kpis() -> dict[str, Metric]:
    """The ten post KPIs over the columns of the post frame."""
    c = F.col
    reach = (c("reach"), M.REACH_UNAVAILABLE)
    followers = (c("followers"), M.FOLLOWERS_UNAVAILABLE)
    impressions = (c("impressions"), M.IMPRESSIONS_UNAVAILABLE)
    clicks = ((c("clicks"), M.CLICKS_UNAVAILABLE),)
    views = ((c("video_views"), M.VIDEO_VIEWS_UNAVAILABLE),)
    return {
        "engagement_rate_by_reach": rate(c("engagement"), *reach),
        "engagement_rate_by_followers": rate(c("engagement"), *followers),
        "engagement_rate_by_impressions": rate(c("engagement"), *impressions),
        "amplification_rate": rate(c("shares"), *followers),
        "applause_rate": rate(c("likes"), *followers),
        "conversation_rate": rate(c("comments_count"), *followers),
        "save_rate": rate(c("saves"), *reach),
        "virality_rate": rate(c("shares"), *reach),
        "click_through_rate": rate(c("clicks"), *impressions, gates=clicks),
        "video_view_rate": rate(c("video_views"), *reach, gates=views),
    }


def compute_post_kpis(metrics: DataFrame, names=None, keep=("post_id",)) -> DataFrame:
    kpis = post_kpis()
    return select_metrics(metrics, [F.col(c) for c in keep], {n: kpis[n] for n in names or kpis})


def with_primary_er(metrics: DataFrame) -> DataFrame:
    """Add ``er``, ``er_basis`` and ``er_reason``: by reach, else by followers, else null with
    the reason why reach could not serve."""
    kpis = post_kpis()
    by_reach, by_followers = kpis["engagement_rate_by_reach"], kpis["engagement_rate_by_followers"]
    basis = (
        F.when(by_reach.raw.isNotNull(), "err").when(by_followers.raw.isNotNull(), "erf")
        .otherwise("none")
    )
    raw = metrics.select(
        "*", F.coalesce(by_reach.raw, by_followers.raw).alias("_raw"), basis.alias("er_basis"),
        F.when(basis == "none", by_reach.reason).alias("er_reason"),
    )
    return raw.withColumn("er", round_dp("_raw")).drop("_raw")


def engagement_velocity(posts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Share of a post's engagement that came within its first day.

    Reads snapshots taken after publication. A total that is not positive is told first; a post
    with one snapshot, or none in its first day, has ``insufficient_snapshots``.
    """
    snaps = P.with_engagement(snapshots).select("post_id", "captured_at", "engagement")
    life = posts.select("post_id", "published_at").join(snaps, "post_id").filter(
        F.col("captured_at") >= F.col("published_at")
    )
    early = F.col("captured_at") <= F.col("published_at") + F.expr("interval 24 hours")
    agg = life.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.max_by("engagement", "captured_at").alias("total_engagement"),
        F.max_by(F.when(early, F.col("engagement")), F.when(early, F.col("captured_at")))
        .alias("_first"),
    ).withColumn("first_24h_engagement", F.when(F.col("n_snapshots") >= 2, F.col("_first")))
    total, first = F.col("total_engagement"), F.col("first_24h_engagement")
    velocity = Metric(
        F.when(total > 0, first / total),
        F.when(total.isNull() | (total <= 0), M.NON_POSITIVE_DENOMINATOR)
        .when(first.isNull(), M.INSUFFICIENT_SNAPSHOTS), dp=4,
    )
    keep = [F.col(c) for c in ("post_id", "n_snapshots", "first_24h_engagement", "total_engagement")]
    return select_metrics(agg, keep, {"engagement_velocity": velocity})


# --- account level ---------------------------------------------------------------------------
def mean_metric(df: DataFrame, keys, value: str = "er", name: str = "mean") -> DataFrame:
    """Mean of 2-place values, from exact sums."""
    agg = df.groupBy(*keys).agg(F.sum(cents(F.col(value))).alias("_s"), F.count(value).alias("n"))
    mean = mean_of(F.col("_s") / 100.0, F.col("n"))
    return select_metrics(agg, [*[F.col(k) for k in keys], F.col("n")], {name: mean})


def median_metric(df: DataFrame, keys, value: str = "er", name: str = "median") -> DataFrame:
    """Exact median per key; a key with no value has ``insufficient_data``."""
    keys = list(keys)
    all_keys = df.groupBy(*keys).agg(F.count(value).alias("n"))
    joined = all_keys.join(exact_median(df, keys, value, "_median"), keys, "left")
    median = Metric(F.col("_median"), F.when(F.col("_median").isNull(), M.INSUFFICIENT_DATA))
    return select_metrics(joined, [*[F.col(k) for k in keys], F.col("n")], {name: median})


def posting_frequency(n_posts: Column, window_days: float) -> Metric:
    if window_days <= 0:
        return Metric(F.lit(None).cast("double"), F.lit(M.NON_POSITIVE_DENOMINATOR))
    return Metric(n_posts / F.lit(window_days / 7.0), F.lit(None).cast("string"))


def posting_consistency(df: DataFrame, keys=("account_id",), ts: str = "published_at") -> DataFrame:
    """Standard deviation in hours of the gaps between posts; needs three posts."""
    keys = list(keys)
    gaps = gap_hours(df, keys, ts).groupBy(*keys).agg(
        F.stddev_samp("gap_hours").alias("_std"), F.count(F.lit(1)).alias("_gaps")
    )
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"))
    joined = counts.join(gaps, keys, "left")
    metric = Metric(
        F.when(F.col("n_posts") >= 3, F.col("_std")),
        F.when(F.col("n_posts") < 3, M.INSUFFICIENT_DATA),
    )
    keep = [*[F.col(k) for k in keys], F.col("n_posts")]
    return select_metrics(joined, keep, {"posting_consistency_hours": metric})


def follower_change(follower_snapshots: DataFrame, since, until) -> DataFrame:
    """Growth rate and net change between the first and the last snapshot of a window."""
    window = P.between(follower_snapshots, "captured_at", since, until)
    agg = window.groupBy("account_id").agg(
        F.min_by("followers_count", "captured_at").alias("f_start"),
        F.max_by("followers_count", "captured_at").alias("f_end"),
    )
    start, end = F.col("f_start"), F.col("f_end")
    missing = start.isNull() | end.isNull()
    growth = Metric(
        F.when(~missing & (start > 0), (end - start) / start * 100.0),
        F.when(missing, M.INSUFFICIENT_DATA).when(start <= 0, M.NON_POSITIVE_DENOMINATOR),
    )
    net = Metric((end - start).cast("double"), F.when(missing, M.INSUFFICIENT_DATA))
    return select_metrics(agg, [F.col(c) for c in ("account_id", "f_start", "f_end")],
                          {"follower_growth_rate": growth, "net_follower_change": net})


def basis_counts() -> list[Column]:
    return [
        F.count_if(F.col("er_basis") == "err").alias("n_err"),
        F.count_if(F.col("er_basis") == "erf").alias("n_erf"),
    ]


def dominant_basis(n_err: Column, n_erf: Column) -> Column:
    """The more frequent basis; equal counts are ``err``."""
    return F.when(n_err + n_erf == 0, "none").when(n_err >= n_erf, "err").otherwise("erf")


def denominator_basis(metrics: DataFrame, keys=("account_id",)) -> DataFrame:
    """``reach`` for accounts that expose a positive reach, else ``followers``."""
    seen = F.max(F.when(F.col("reach") > 0, 1).otherwise(0))
    return metrics.groupBy(*keys).agg(
        F.when(seen == 1, "reach").otherwise("followers").alias("denominator_basis")
    )


def best_worst(metrics_er: DataFrame, keys=("account_id",)) -> DataFrame:
    """Posts with the highest and the lowest rate; equal rates: the smaller post_id."""
    scored = metrics_er.filter(F.col("er").isNotNull())
    post = F.struct("post_id", "er", "permalink")
    return scored.groupBy(*keys).agg(
        F.max_by(post, F.struct("er", -F.col("post_id"))).alias("best"),
        F.min_by(post, F.struct("er", "post_id")).alias("worst"),
    ).select(
        *keys,
        F.col("best.post_id").alias("best_post_id"), F.col("best.er").alias("best_er"),
        F.col("best.permalink").alias("best_permalink"),
        F.col("worst.post_id").alias("worst_post_id"), F.col("worst.er").alias("worst_er"),
        F.col("worst.permalink").alias("worst_permalink"),
    )


def post_facts(posts: DataFrame, snapshots: DataFrame, accounts: DataFrame,
               follower_snapshots: DataFrame | None, as_of, since, until, **scope) -> DataFrame:
    """The compact per-post frame the account KPIs are computed from. Several of them read it, so
    materialize it first when it is large."""
    frame = P.post_metrics(posts, snapshots, accounts, follower_snapshots, as_of, since, until, **scope)
    return with_primary_er(frame).select(
        "post_id", "account_id", "platform", "published_at", "content_type", "text_content",
        "permalink", "engagement", "reach", "followers", "er", "er_basis",
    )


def kpi_overview(facts: DataFrame, owners: DataFrame, as_of, window: str = "30d") -> DataFrame:
    """Headline KPIs of every account over a window, with changes against the window before.

    ``facts`` must reach two windows back; ``owners`` is one row per account with its followers
    resolved. Accounts without posts keep a row of zero counts and reasons.
    """
    until, delta = P.moment(as_of), P.parse_window(window)
    frame = P.between(facts, "published_at", until - 2 * delta, until).withColumn(
        "_cur", F.col("published_at") >= P.timestamp(until - delta)
    )
    cur, prev = F.col("_cur"), ~F.col("_cur")
    er_cents = cents(F.col("er"))
    totals = frame.groupBy("account_id").agg(
        F.count_if(cur).alias("_n"), F.count_if(prev).alias("_pn"),
        F.sum(F.when(cur, F.col("engagement")).otherwise(0)).alias("_e"),
        F.sum(F.when(prev, F.col("engagement")).otherwise(0)).alias("_pe"),
        F.sum(F.when(cur, er_cents)).alias("_s"), F.sum(F.when(prev, er_cents)).alias("_ps"),
        F.count_if(cur & F.col("er").isNotNull()).alias("_ne"),
        F.count_if(prev & F.col("er").isNotNull()).alias("_pne"),
        F.count_if(cur & (F.col("er_basis") == "err")).alias("_err"),
        F.count_if(cur & (F.col("er_basis") == "erf")).alias("_erf"),
    )
    current = frame.filter(cur)
    medians = exact_median(current, ["account_id"], "er", "_median")
    # the number of posts is among the totals already
    gaps = gap_hours(current, ["account_id"], "published_at").groupBy("account_id").agg(
        F.stddev_samp("gap_hours").alias("_std"))
    extremes = best_worst(current)
    owners = owners.select("account_id", "handle", "platform", "followers", "followers_basis")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in
            ("_n", "_pn", "_e", "_pe", "_ne", "_pne", "_err", "_erf")}
    joined = (
        owners.join(totals, "account_id", "left").join(medians, "account_id", "left")
        .join(gaps, "account_id", "left").join(extremes, "account_id", "left")
        .withColumns(zero)
    )
    mean = mean_of(F.col("_s") / 100.0, F.col("_ne"))
    prev_mean = mean_of(F.col("_ps") / 100.0, F.col("_pne"))
    with_means = joined.withColumn("_mean", mean.value).withColumn("_pmean", prev_mean.value)
    days = delta.total_seconds() / 86400.0
    keep = [
        F.col("account_id"), F.col("handle"), F.col("platform"), F.col("followers"),
        F.col("followers_basis"), F.col("_n").alias("n_posts"), F.col("_e").alias("total_engagement"),
        dominant_basis(F.col("_err"), F.col("_erf")).alias("engagement_rate_basis"),
        F.col("_mean").alias("avg_engagement_rate"),
        mean.reason.alias("avg_engagement_rate_reason"),
        *[F.col(f"{side}_{c}") for side in ("best", "worst") for c in ("post_id", "er", "permalink")],
    ]
    return select_metrics(with_means, keep, {
        "median_engagement_rate": Metric(
            F.col("_median"), F.when(F.col("_median").isNull(), M.INSUFFICIENT_DATA)),
        "posting_frequency_per_week": posting_frequency(F.col("_n"), days),
        "posting_consistency_hours": Metric(F.when(F.col("_n") >= 3, F.col("_std")),
                                            F.when(F.col("_n") < 3, M.INSUFFICIENT_DATA)),
        "total_engagement_pct": M.delta_pct(F.col("_e"), F.col("_pe")),
        "avg_engagement_rate_pct": M.delta_pct(F.col("_mean"), F.col("_pmean")),
        "n_posts_pct": M.delta_pct(F.col("_n"), F.col("_pn")),
    })


def top_posts(metrics: DataFrame, metric: str = "err", limit: int = 10,
              per_account: bool = True) -> DataFrame:
    """Best posts by a rate or a count, with all KPIs; equal scores: the smaller post_id.

    The KPIs are computed for the winners only.
    """
    metric = metric.lower()
    if metric in RATE_ALIASES:
        scored = with_primary_er(metrics).withColumn("score", F.col("er")).withColumn(
            "score_basis", F.col("er_basis"))
    elif metric in COUNT_METRICS:
        scored = metrics.withColumn("score", F.col(COUNT_METRICS[metric]).cast("double")).withColumn(
            "score_basis", F.lit(metric))
    else:
        raise ValueError(f"unknown metric {metric!r}: use err or one of {sorted(COUNT_METRICS)}")
    scored = scored.filter(F.col("score").isNotNull())
    order = [F.desc("score"), F.asc("post_id")]
    if per_account:
        ranked = scored.withColumn(
            "rank", F.row_number().over(W.partitionBy("account_id").orderBy(*order))
        ).filter(F.col("rank") <= limit)
    else:
        ranked = scored.orderBy(*order).limit(limit)
    keep = ["account_id", "post_id", "published_at", "content_type", "permalink", "score",
            "score_basis", "engagement"]
    if per_account:
        ranked = ranked.withColumn("rank", F.col("rank").cast("bigint"))
        keep.insert(1, "rank")
    return compute_post_kpis(ranked, keep=keep)
