"""Filters, joins and follower resolution: from raw tables to one row per post."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.functions.metric import parse_window
from agorametrics.functions.text import is_blank
from agorametrics.operators.ordered import nearest_in_time

FOLLOWER_MAX_AGE_DAYS = 7
METRIC_COLUMNS = (
    "likes", "comments_count", "shares", "saves", "reach", "impressions", "video_views", "clicks"
)


def timestamp(at: datetime | str) -> Column:
    return F.lit(str(at)).cast("timestamp")


def moment(at: datetime | str) -> datetime:
    return at if isinstance(at, datetime) else datetime.fromisoformat(at)


def window_filter(df: DataFrame, ts: str, as_of, window: str) -> DataFrame:
    """``as_of - window <= ts < as_of``; literal bounds on the stored column reach the scan."""
    until = moment(as_of)
    return between(df, ts, until - parse_window(window), until)


def between(df: DataFrame, ts: str, since=None, until=None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col(ts) >= timestamp(since))
    if until is not None:
        df = df.filter(F.col(ts) < timestamp(until))
    return df


def period_tag(df: DataFrame, ts: str, as_of, window: str, name: str = "period") -> DataFrame:
    """The window (``cur``) and the equally long one before it (``prev``) in a single scan."""
    until, delta = moment(as_of), parse_window(window)
    both = between(df, ts, until - 2 * delta, until)
    return both.withColumn(name, F.when(F.col(ts) >= timestamp(until - delta), "cur").otherwise("prev"))


def scope_filter(df: DataFrame, account_ids=None, platforms=None) -> DataFrame:
    if account_ids is not None:
        df = df.filter(F.col("account_id").isin(*account_ids))
    if platforms is not None:
        df = df.filter(F.col("platform").isin(*platforms))
    return df


def synthetic_filter(df: DataFrame, include_synthetic: bool = True) -> DataFrame:
    return df if include_synthetic else df.filter(~F.col("is_synthetic"))


def nonblank_text(df: DataFrame, text: str = "text_content") -> DataFrame:
    return df.filter(~is_blank(F.col(text)))


def latest_snapshot(snapshots: DataFrame, as_of=None) -> DataFrame:
    """Newest snapshot per post, in one aggregation and without a self-join.

    ``as_of`` leaves out what was captured later: a rerun finds the same rows. One ``max_by`` per column keeps the buffers fixed-width, so Spark aggregates by hash and
    combines before the shuffle. (post_id, captured_at) is a key, so all pick the same row.
    """
    if as_of is not None:
        snapshots = snapshots.filter(F.col("captured_at") <= timestamp(as_of))
    newest = [F.max_by(c, "captured_at").alias(c) for c in METRIC_COLUMNS if c in snapshots.columns]
    return snapshots.groupBy("post_id").agg(F.max("captured_at").alias("captured_at"), *newest)


def with_engagement(df: DataFrame) -> DataFrame:
    """Missing interaction counts become 0, and ``engagement`` is their sum."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("likes", "comments_count", "shares", "saves")}
    return df.withColumns(zero).withColumn(
        "engagement", F.col("likes") + F.col("comments_count") + F.col("shares") + F.col("saves")
    )


def resolve_followers(accounts: DataFrame, follower_snapshots: DataFrame, as_of) -> DataFrame:
    """One row per account: ``followers`` and ``followers_basis`` at ``as_of``.

    The last snapshot of the week before, else the account's latest count. Nothing captured after
    ``as_of`` counts.
    """
    at = moment(as_of)
    age = timedelta(days=FOLLOWER_MAX_AGE_DAYS)
    nearest = (
        follower_snapshots
        .filter((F.col("captured_at") >= timestamp(at - age)) & (F.col("captured_at") <= timestamp(at)))
        .groupBy("account_id").agg(F.max_by("followers_count", "captured_at").alias("_snapshot"))
    )
    followers = F.coalesce("_snapshot", "followers_count")
    basis = (
        F.when(F.col("_snapshot").isNotNull(), "snapshot")
        .when(F.col("followers_count").isNotNull(), "account_latest").otherwise("unavailable")
    )
    return accounts.join(nearest, "account_id", "left").select(
        *accounts.columns, followers.alias("followers"), basis.alias("followers_basis")
    )


def followers_asof_publish(posts: DataFrame, follower_snapshots: DataFrame,
                           accounts: DataFrame | None = None) -> DataFrame:
    """Posts with the follower count nearest to their own publish time, within a week."""
    out = nearest_in_time(posts, follower_snapshots, ["account_id"], "published_at", "captured_at",
                          "followers_count", "_nearest", FOLLOWER_MAX_AGE_DAYS)
    latest = F.lit(None).cast("bigint")
    if accounts is not None:
        out = out.join(accounts.select("account_id", F.col("followers_count").alias("_latest")),
                       "account_id", "left")
        latest = F.col("_latest")
    basis = (
        F.when(F.col("_nearest").isNotNull(), "snapshot")
        .when(latest.isNotNull(), "account_latest").otherwise("unavailable")
    )
    return out.select(*posts.columns, F.coalesce("_nearest", latest).alias("followers"),
                      basis.alias("followers_basis"))


def post_metrics(posts: DataFrame, snapshots: DataFrame, accounts: DataFrame,
                 follower_snapshots: DataFrame | None = None, as_of=None, since=None, until=None,
                 account_ids=None, platforms=None, include_synthetic: bool = True,
                 snapshots_follow_publish: bool = False) -> DataFrame:
    """One row per post: its newest counts, platform, engagement and followers.

    Posts without a snapshot drop out. ``accounts`` carries account_id, platform, handle and
    followers_count. All filters are on stored columns and reach the scans; with any filter on the
    posts, only snapshots of the posts left are aggregated. Snapshots after ``as_of`` don't count. A source that never
    captures a post before it is published may set ``snapshots_follow_publish``; the lower bound
    then prunes the snapshots as well.
    """
    scoped = synthetic_filter(between(posts, "published_at", since, until), include_synthetic)
    if account_ids is not None:
        scoped = scope_filter(scoped, account_ids=account_ids)
        accounts = scope_filter(accounts, account_ids=account_ids)
    if platforms is not None:
        accounts = scope_filter(accounts, platforms=platforms)
    if snapshots_follow_publish:
        snapshots = between(snapshots, "captured_at", since)
    if follower_snapshots is not None:
        owners = resolve_followers(accounts, follower_snapshots, as_of)
    else:
        owners = accounts.withColumn("followers", F.col("followers_count")).withColumn(
            "followers_basis",
            F.when(F.col("followers_count").isNotNull(), "account_latest").otherwise("unavailable"),
        )
    owners = owners.select("account_id", "platform", "handle", "followers", "followers_basis")
    if since is not None or until is not None or account_ids is not None:
        snapshots = snapshots.join(scoped.select("post_id"), "post_id", "left_semi")
    newest = latest_snapshot(snapshots, as_of)
    joined = scoped.join(newest, "post_id").join(owners, "account_id")
    return with_engagement(joined)


def post_projection(metrics: DataFrame) -> DataFrame:
    """The sixteen post columns, engagement and followers."""
    return metrics.select(
        "post_id", "account_id", "published_at", "content_type", "permalink", "text_content",
        "is_synthetic", "platform", "likes", F.col("comments_count").alias("comments"), "shares",
        "saves", "reach", "impressions", "video_views", "clicks", "engagement", "followers",
    )


def list_accounts(accounts: DataFrame, platforms: DataFrame) -> DataFrame:
    names = platforms.select(F.col("id").alias("platform_id"), F.col("name").alias("platform"))
    return (
        accounts.join(names, "platform_id")
        .select("account_id", "handle", "display_name", F.col("followers_count").alias("followers"),
                "platform")
        .orderBy("account_id")
    )
