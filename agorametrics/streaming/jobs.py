"""Incremental jobs as Structured Streaming queries over files.

Each job takes what arrived since its checkpoint (``availableNow``) and ends, the way a scheduled
sync does; with another trigger it keeps running. Upserts go to change logs: a micro-batch writes
its own folder, so a retried batch replaces what it wrote and costs no more than its own rows.
Readers fold the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agorametrics import vocab
from agorametrics.functions import timeparse as T
from agorametrics.functions.metric import parse_window, round_dp
from agorametrics.operators import ingest as I
from agorametrics.operators import sentiment as S
from agorametrics.operators.posts import moment
from agorametrics.sources import payloads
from agorametrics.sources.sinks import by_date

LANDING = (
    "source string, entity_type string, external_id string, account_external_id string, "
    "post_external_id string, payload string, captured_at timestamp"
)
_KEYS = {
    "accounts": ["platform", "external_id"],
    "posts": ["platform", "account_external_id", "external_id"],
    "snapshots": ["platform", "account_external_id", "post_external_id", "captured_at"],
    "comments": ["platform", "account_external_id", "post_external_id", "external_id"],
    "cursors": ["source", "account_external_id", "entity_type"],
}


def _log(path: str, entity: str, batch_id: int) -> str:
    return f"{path}/{entity}/batch_id={batch_id}"


def ingest_payloads(landing: DataFrame, path: str, checkpoint: str, as_of, trigger=None):
    """Landing events to change logs of accounts, posts, snapshots, comments and cursors.

    Rows the quality gates reject, and events that cannot be read, go to ``rejected`` with their
    reason.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        # read by every entity below
        batch.persist()
        events = batch.withColumn("_ord", F.unix_micros("captured_at"))
        posts = I.post_quality_gate(payloads.payload_posts(events), as_of)
        metrics = I.metric_quality_gate(payloads.payload_snapshots(events), as_of)
        metrics = metrics.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("captured_at").isNull(), "missing_capture_time")))
        ok = F.col("reject_reason").isNull()
        frames = {
            "accounts": payloads.payload_accounts(events),
            "posts": posts.filter(ok).drop("reject_reason"),
            "snapshots": metrics.filter(ok).drop("reject_reason"),
            "comments": payloads.payload_comments(events),
            "cursors": _cursors(events, as_of),
            "rejected": posts.select(F.lit("posts").alias("entity"), F.col("reject_reason").alias("reason"))
            .unionByName(metrics.select(F.lit("metrics").alias("entity"), F.col("reject_reason").alias("reason")))
            .filter(F.col("reason").isNotNull())
            .unionByName(payloads.payload_rejects(events).select("entity", "reason")),
        }
        try:
            for entity, frame in frames.items():
                frame.write.mode("overwrite").parquet(_log(path, entity, batch_id))
        finally:
            batch.unpersist()

    return (
        landing.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _cursors(events: DataFrame, as_of) -> DataFrame:
    from agorametrics.operators.posts import timestamp

    synced = events.filter(F.col("account_external_id").isNotNull()).select(
        "source", "account_external_id").distinct()
    kinds = F.array(F.lit("posts"), F.lit("comments"))
    return synced.select("source", "account_external_id", F.explode(kinds).alias("entity_type"),
                         timestamp(as_of).alias("cursor_value"), F.lit(0).cast("bigint").alias("_ord"))


def folded(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Current rows of a change log: updated columns take the last batch, the rest the first.

    Snapshots are immutable: all their columns keep the first value.
    """
    return _fold(spark.read.parquet(f"{path}/{entity}"), entity)


def compact(spark: SparkSession, path: str, entity: str, folded_path: str) -> None:
    """Write the current rows of a change log as the first batch of a new log, which readers and
    further batches go on with: a scheduled job keeps logs as short as the time between two runs."""
    rows = _fold(spark.read.parquet(f"{path}/{entity}"), entity).withColumn("_ord", F.lit(0).cast("bigint"))
    rows.write.mode("overwrite").parquet(_log(folded_path, entity, -1))


def _fold(log: DataFrame, entity: str) -> DataFrame:
    """Rows with a whole key folded, the others as they are: a comment without an id is no other comment. Rows of one batch
    and capture time are ordered by a hash of their content."""
    keys = _KEYS[entity]
    columns = [c for c in log.columns if c not in ("batch_id", "_ord")]
    updates = {"cursors": ["cursor_value"], "snapshots": []}.get(entity, list(I.UPDATES.get(entity, ())))
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    placed = log.select(*columns, F.struct("batch_id", "_ord", F.xxhash64(*columns).alias("tie")).alias("_at"))
    return I.folded_rows(placed.filter(keyed), columns, keys, updates).unionByName(log.filter(~keyed).select(*columns))


def dedupe_snapshots(snapshots: DataFrame, path: str, checkpoint: str, rejected: str, unit: str = "day", trigger=None):
    """Append snapshots whose (post_id, captured_at) the table lacks; ``_ord`` says which row of a
    batch comes first. Rows without a post or a capture time go to ``rejected`` with the reason.

    Exact however late a duplicate arrives, and without state that grows with the stream: a
    micro-batch is compared with the stored snapshots of its own capture dates only, however far
    apart these are.
    """
    spark = snapshots.sparkSession
    keys = ["post_id", "captured_at"]
    stored = _schema(snapshots, without="_ord")
    # an empty folder, so that the first batch finds a table too
    spark.createDataFrame([], stored).write.mode("overwrite").parquet(
        f"{path}/batch_id=-1/captured_date=1970-01-01")

    def store(batch: DataFrame, batch_id: int) -> None:
        start = F.to_date(F.date_trunc(unit, "captured_at"))
        reason = F.when(F.col("captured_at").isNull(), "missing_capture_time").when(F.col("post_id").isNull(), "missing_post")
        batch.withColumn("reason", reason).filter("reason is not null").write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        dated = batch.filter(reason.isNull())
        # one row per capture date of the batch: folder names
        days = [r[0] for r in dated.select(start.alias("day")).distinct().collect()]
        table = spark.read.schema(f"{stored.toDDL()}, captured_date date, batch_id bigint").parquet(path).filter(
            (F.col("batch_id") != batch_id) & F.col("captured_date").isin(days))
        new = by_date(I.insert_new(table, dated, keys, "_ord"), "captured_date", unit)
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("captured_date").parquet(
            f"{path}/batch_id={batch_id}")

    return (
        snapshots.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _schema(df: DataFrame, without: str) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != without])


def score_comments(comments: DataFrame, path: str, checkpoint: str, backend=None, trigger=None):
    """Label arriving comments and append their analyses; the checkpoint keeps each to one label."""
    scored = S.score_sentiment(comments, backend).select(
        "comment_id", "language", "sentiment", "sentiment_score", "model_name", "model_version")
    return (
        scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def count_negatives(comments: DataFrame, path: str, checkpoint: str, trigger=None):
    """Keep the daily counts current that alerts are made of. Every micro-batch logs the counts of its own rows, however late
    their days are: no watermark, no state that grows with the stream, and a retried batch replaces what it wrote."""

    def store(batch: DataFrame, batch_id: int) -> None:
        S.daily_negatives(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        comments.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_alerts(spark: SparkSession, path: str, as_of, window: str = "14d") -> DataFrame:
    """Alerts of the logged counts, the same as ``negative_alerts`` of all rows. Days are counted whole, so ``as_of`` is a
    midnight (UTC); other days than the window's are not read from the log."""
    until = moment(as_of)
    if (until.hour, until.minute, until.second, until.microsecond) != (0, 0, 0, 0):
        raise ValueError(f"alerts are made of whole days, {as_of} is inside one")
    since = until - parse_window(window)
    if since != since.replace(hour=0, minute=0, second=0, microsecond=0):
        raise ValueError(f"{window} is no number of days")
    days = spark.read.parquet(path).filter((F.col("day") >= F.lit(since.date())) & (F.col("day") < F.lit(until.date())))
    daily = days.groupBy("account_id", "day").agg(F.sum("n_comments").alias("n_comments"), F.sum("n_negative").alias("n_negative"))
    return S.alerts_of(daily)


_WINDOWS = {"hour": ("1 hour", None), "day": ("1 day", None), "week": ("7 days", "4 days")}


def timeseries(rows: DataFrame, value: str, path: str, checkpoint: str, granularity: str = "hour",
               ts: str = "published_at", tz: str = vocab.DISPLAY_TZ, trigger=None):
    """Keep sums per account and local-time bucket current.

    Every micro-batch logs the sums of its own rows, however late these are: no watermark, no state,
    no row lost. ``timeseries_state`` adds the logged parts up, ``compact_timeseries`` folds them.
    """
    width, start = _WINDOWS[granularity]
    local = rows.withColumn("_local", T.local_time(F.col(ts), tz))
    window = F.window("_local", width, width, start) if start else F.window("_local", width)

    def store(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("account_id", window.alias("_w")).agg(F.sum(value).alias("part"))
        sums.select("account_id", F.col("_w.start").alias("bucket"), "part").write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")

    return (
        local.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def timeseries_state(spark: SparkSession, path: str, granularity: str = "hour") -> DataFrame:
    sums = spark.read.parquet(path).groupBy("account_id", "bucket").agg(
        F.coalesce(F.sum("part"), F.lit(0)).cast("double").alias("_v"))
    return sums.select("account_id", "bucket", round_dp("_v").alias("value")).withColumn(
        "label", T.bucket_label(F.col("bucket"), granularity))


def compact_timeseries(spark: SparkSession, path: str, folded: str) -> None:
    """Write the sums of all logged parts as one part of a new log: what a scheduled job keeps small."""
    parts = spark.read.parquet(path).groupBy("account_id", "bucket").agg(F.sum("part").alias("part"))
    parts.write.mode("overwrite").parquet(f"{folded}/batch_id=0")
