"""Quality gates, id resolution, key upserts, cursors and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions import text as X
from agorametrics.operators import posts as P
from agorametrics.schemas import COUNT_COLUMNS, COUNT_DEFAULT_ZERO

FUTURE_TOLERANCE_MINUTES = 5
RETENTION_DAYS = 30


# --- gates -----------------------------------------------------------------------------------
def _future(ts: str, as_of) -> Column:
    return F.col(ts) > P.timestamp(P.moment(as_of) + timedelta(minutes=FUTURE_TOLERANCE_MINUTES))


def post_quality_gate(posts: DataFrame, as_of) -> DataFrame:
    """Add ``reject_reason``, null for accepted posts; the first failing rule names it."""
    reason = (
        F.when(_future("published_at", as_of), "future_timestamp")
        .when(F.col("media_count") < 0, "negative_media_count")
    )
    return posts.withColumn("reject_reason", reason)


def metric_quality_gate(snapshots: DataFrame, as_of) -> DataFrame:
    """Add ``reject_reason``: a future capture, else the first negative count."""
    reason = F.when(_future("captured_at", as_of), "future_timestamp")
    for name in COUNT_COLUMNS:
        reason = reason.when(F.col(name) < 0, f"negative_{name}")
    return snapshots.withColumn("reject_reason", reason)


def reach_anomaly_flag(snapshots: DataFrame) -> DataFrame:
    """Add ``flags``: a reach below the engagement is kept, and noted."""
    zero = [F.coalesce(F.col(c), F.lit(0)) for c in COUNT_DEFAULT_ZERO]
    engagement = zero[0] + zero[1] + zero[2] + zero[3]
    low = F.when(F.col("reach") < engagement, F.lit("reach_lt_engagement"))
    return snapshots.withColumn("flags", F.array_compact(F.array(low)))


# --- upserts ---------------------------------------------------------------------------------
UPDATES = {
    "accounts": ("handle", "display_name", "followers_count", "is_competitor"),
    "posts": ("published_at", "content_type", "text_content", "hashtags", "media_count", "permalink"),
    "comments": ("like_count", "text_content"),
    "analyses": ("language", "sentiment", "sentiment_score", "model_name", "model_version", "analyzed_at"),
}


def upsert(target: DataFrame, batch: DataFrame, keys, updates, order: str,
           overwrite_nulls: bool = True) -> DataFrame:
    """The target after a key upsert of the batch, rows of one key applied in ``order``.

    Columns in ``updates`` take the last value, all others keep the first. Both sides are stacked
    and folded in one aggregation, so a key repeated any number of times is combined before the
    shuffle. Rows with a null in the key never conflict and are appended. ``overwrite_nulls=False``
    keeps a known value where the newer one is null.
    """
    keys, columns = list(keys), target.columns
    old = target.select(*columns, F.struct(F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("pos"))
                        .alias("_at"))
    new = batch.select(*columns, F.struct(F.lit(1).alias("side"), F.col(order).cast("bigint").alias("pos"))
                       .alias("_at"))
    both = old.unionByName(new)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    folded = folded_rows(both.filter(keyed), columns, keys, updates, overwrite_nulls)
    return folded.unionByName(both.filter(~keyed).select(*columns))


def folded_rows(rows: DataFrame, columns, keys, updates, overwrite_nulls: bool = True, newest: str | None = None) -> DataFrame:
    """One row per key: columns in ``updates`` by the last value of ``_at``, a struct, all others by the first.

    ``newest`` names a column for the first field of the last ``_at``.
    """
    keys, columns = list(keys), list(columns)
    updates = [c for c in updates if c in columns and c not in keys]
    firsts = [c for c in columns if c not in keys and c not in updates]
    aggs = [F.max("_at").alias("_newest")] if newest or not (updates or firsts) else []
    if updates and overwrite_nulls:
        aggs.append(F.max_by(F.struct(*updates), "_at").alias("_last"))
    elif updates:
        aggs += [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                          F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in updates]
    if firsts:
        aggs.append(F.min_by(F.struct(*firsts), "_at").alias("_first"))
    folded = rows.groupBy(*keys).agg(*aggs)

    def pick(c: str) -> Column:
        if c in keys or (c in updates and not overwrite_nulls):
            return F.col(c)
        return F.col(f"_last.{c}" if c in updates else f"_first.{c}").alias(c)

    more = [F.col(f"_newest.{newest}").alias(newest)] if newest else []
    return folded.select(*[pick(c) for c in columns], *more)


def insert_new(target: DataFrame, batch: DataFrame, keys, order: str) -> DataFrame:
    """Batch rows whose key the target lacks, the first per key: what an append-only sink adds.

    Stored keys leave before rows are compared, so a retry compares none; both steps share one shuffle and one sort by key.
    """
    keys = list(keys)
    others = [c for c in batch.columns if c not in keys and c != order]
    new = batch.join(target.select(*keys), keys, "left_anti")
    return new.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in others])


# --- id resolution ---------------------------------------------------------------------------
def resolve_accounts(staged: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add ``account_id`` by (platform, account_external_id), null when unknown."""
    ids = accounts.select("platform", F.col("external_id").alias("account_external_id"), "account_id")
    return staged.join(ids, ["platform", "account_external_id"], "left")


def resolve_posts(staged: DataFrame, posts: DataFrame) -> DataFrame:
    """Add ``post_id`` by (account_id, post_external_id), null when unknown."""
    ids = posts.select("account_id", F.col("external_id").alias("post_external_id"), "post_id")
    return staged.join(ids, ["account_id", "post_external_id"], "left")


def skip_report(*rejected: DataFrame) -> DataFrame:
    """Counts per entity and reason of frames that have ``entity`` and ``reason``."""
    parts = [r.filter(F.col("reason").isNotNull()).groupBy("entity", "reason")
             .agg(F.count(F.lit(1)).alias("n")) for r in rejected]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def new_ids(df: DataFrame, keys, content=(), order: str = "_ord") -> Column:
    """Surrogate id of a natural key, 128 bits as text: the same key always gets the same id, on any
    executor. A row without a whole key is told apart by ``content`` and its place in ``order``."""

    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))

    whole = F.concat_ws("|", *[part(k) for k in keys])
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    more = [part(c) for c in [*content, order] if c in df.columns]
    return F.md5(F.when(keyless, F.concat_ws("|", whole, *more)).otherwise(whole))


def stage_posts(staged: DataFrame, accounts: DataFrame, as_of) -> DataFrame:
    """Gate, resolve, map and tag staged posts; ``reason`` is null on those to store."""
    gated = resolve_accounts(post_quality_gate(staged, as_of), accounts)
    reason = F.coalesce("reject_reason", F.when(F.col("account_id").isNull(), "unknown_account"))
    tags = X.extract_hashtags(F.coalesce("text_content", F.lit("")))
    if "hashtags" in staged.columns:
        tags = F.coalesce(F.col("hashtags"), tags)
    return gated.withColumns({
        "reason": reason, "content_type": X.map_content_type(F.col("content_type")), "hashtags": tags,
        "post_id": new_ids(gated, ["account_id", "external_id"], ["published_at", "text_content"]),
    }).drop("reject_reason")


def post_names(accounts: DataFrame, posts: DataFrame, named: DataFrame) -> DataFrame:
    """Add ``account_id`` and ``post_id`` to distinct names of posts (platform, account_external_id, post_external_id): what
    rows that name a post many times are joined with once."""
    return resolve_posts(resolve_accounts(named, accounts), posts)


def metrics_of(resolved: DataFrame, as_of) -> DataFrame:
    """Gate snapshots whose ids are resolved; ``reason`` is null on those to store."""
    gated = reach_anomaly_flag(metric_quality_gate(resolved, as_of))
    reason = F.coalesce("reject_reason", F.when(F.col("post_id").isNull(), "unknown_post"))
    return gated.withColumn("reason", reason).drop("reject_reason")


def stage_metrics(staged: DataFrame, accounts: DataFrame, posts: DataFrame, as_of) -> DataFrame:
    """Resolve and gate staged snapshots; ``reason`` is null on those to store."""
    return metrics_of(resolve_posts(resolve_accounts(staged, accounts), posts), as_of)


def comments_of(resolved: DataFrame) -> DataFrame:
    """Hash the authors of comments whose ids are resolved; raw author ids go no further."""
    return resolved.withColumns({
        "author_hash": X.author_hash(F.col("author_external_id")),
        "reason": F.when(F.col("post_id").isNull(), "unknown_post"),
        "comment_id": new_ids(resolved, ["post_id", "external_id"], ["published_at", "text_content"]),
    }).drop("author_external_id")


def stage_comments(staged: DataFrame, accounts: DataFrame, posts: DataFrame) -> DataFrame:
    """Resolve staged comments and hash their authors."""
    return comments_of(resolve_posts(resolve_accounts(staged, accounts), posts))


def normalize_and_store(batch: dict[str, DataFrame], tables: dict[str, DataFrame], as_of,
                        keep=lambda df, name: df) -> tuple[dict[str, DataFrame], DataFrame]:
    """Store a staged batch: accounts, then posts, then snapshots and comments, each resolving ids
    of the ones before. Returns the new tables and the report of stored and skipped rows.

    Staged frames carry ``_ord``, the order their rows arrived in. ``keep`` is called on every new
    table and staged frame that is read more than once; pass ``materialize`` on large batches.
    """
    out = dict(tables)
    accounts = batch["accounts"].withColumn("account_id", new_ids(batch["accounts"], ["platform", "external_id"]))
    out["accounts"] = keep(upsert(tables["accounts"], accounts, ["platform", "external_id"],
                                  UPDATES["accounts"], "_ord"), "accounts")
    posts = keep(stage_posts(batch["posts"], out["accounts"], as_of), "staged-posts")
    good_posts = posts.filter(F.col("reason").isNull())
    out["posts"] = keep(upsert(tables["posts"], good_posts, ["account_id", "external_id"],
                               UPDATES["posts"], "_ord"), "posts")
    metrics = keep(stage_metrics(batch["metrics"], out["accounts"], out["posts"], as_of), "staged-metrics")
    good_metrics = metrics.filter(F.col("reason").isNull())
    snapshot_columns = ["post_id", "captured_at", *COUNT_COLUMNS]
    added = keep(insert_new(tables["snapshots"], good_metrics.select(*snapshot_columns, "_ord"),
                            ["post_id", "captured_at"], "_ord"), "added-snapshots")
    out["snapshots"] = tables["snapshots"].unionByName(added.select(*tables["snapshots"].columns))
    comments = keep(stage_comments(batch["comments"], out["accounts"], out["posts"]), "staged-comments")
    good_comments = comments.filter(F.col("reason").isNull())
    out["comments"] = upsert(tables["comments"], good_comments, ["post_id", "external_id"],
                             UPDATES["comments"], "_ord")

    def counted(df: DataFrame, entity: str, reason: Column) -> DataFrame:
        return df.select(F.lit(entity).alias("entity"), reason.alias("reason"))

    stored = F.lit("stored")
    kept = skip_report(
        counted(batch["accounts"], "accounts", stored),
        counted(posts, "posts", F.coalesce("reason", stored)),
        counted(metrics, "metrics", F.col("reason")),
        counted(added, "metrics", stored),
        counted(comments, "comments", F.coalesce("reason", stored)),
    )
    n_good = good_metrics.agg(F.count(F.lit(1)).alias("a")).withColumn("b", F.lit(0).cast("bigint"))
    n_added = added.agg(F.count(F.lit(1)).alias("b")).withColumn("a", F.lit(0).cast("bigint"))
    duplicates = n_good.unionByName(n_added).agg((F.sum("a") - F.sum("b")).alias("n")).select(
        F.lit("metrics").alias("entity"), F.lit("duplicate_snapshot").alias("reason"), "n"
    ).filter(F.col("n") > 0)
    return out, kept.unionByName(duplicates)


# --- cursors, fetch cap, retention -----------------------------------------------------------
def cursor_filter(rows: DataFrame, cursors: DataFrame, keys, ts: str, as_of,
                  first_sync_days: int | None = None) -> DataFrame:
    """Rows newer than their key's cursor. Without a cursor all rows, or, where the caller gives
    ``first_sync_days``, those of that many days before ``as_of``."""
    joined = rows.join(cursors.select(*keys, "cursor_value"), list(keys), "left")
    first = F.lit(True)
    if first_sync_days is not None:
        first = F.col(ts) > P.timestamp(P.moment(as_of) - timedelta(days=first_sync_days))
    newer = F.when(F.col("cursor_value").isNull(), first).otherwise(F.col(ts) > F.col("cursor_value"))
    return joined.filter(newer).select(*rows.columns)


def advance_cursors(cursors: DataFrame, seen: DataFrame, keys, as_of) -> DataFrame:
    """Cursor table after a run at ``as_of`` over the keys in ``seen``; other cursors stay."""
    keys = list(keys)
    stacked = cursors.select(*keys, "cursor_value", F.lit(0).alias("_side")).unionByName(
        seen.select(*keys, P.timestamp(as_of).alias("cursor_value"), F.lit(1).alias("_side")))
    return stacked.groupBy(*keys).agg(F.max_by("cursor_value", "_side").alias("cursor_value"))


def comment_fetch_cap(posts: DataFrame, cap: int, keys=("account_id",)) -> DataFrame:
    """The ``cap`` newest posts per account, for a caller whose fetches are counted."""
    order = [F.desc("published_at"), F.asc("post_id")]
    ranked = posts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= cap).withColumn("rank", F.col("rank").cast("bigint"))


def retention_cutoff(as_of, days: int = RETENTION_DAYS):
    if days < 1:
        raise ValueError(f"retention must be at least 1 day, got {days}")
    return P.moment(as_of) - timedelta(days=days)


def retained(events: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    return events.filter(F.col("captured_at") >= P.timestamp(retention_cutoff(as_of, days)))


def retention_report(events: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """How many events a purge deletes and leaves, and the oldest left, in one aggregation."""
    cutoff = P.timestamp(retention_cutoff(as_of, days))
    old = F.col("captured_at") < cutoff
    return events.agg(
        F.count_if(old).alias("deleted"), F.count_if(~old).alias("remaining"),
        F.min(F.when(~old, F.col("captured_at"))).alias("oldest_remaining"))


def ingestion_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table. Counts without columns read only file footers."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
