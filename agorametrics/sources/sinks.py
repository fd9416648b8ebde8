"""Table sinks on plain files, partitioned so that a rerun replaces only what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.operators.ingest import RETENTION_DAYS, insert_new, retention_cutoff
from agorametrics.operators.posts import timestamp
from agorametrics.session import materialize


def by_date(df: DataFrame, name: str, unit: str = "day") -> DataFrame:
    """Add a date column to partition files by, and bring rows of one date together.

    Rebalancing is a hint to AQE: it merges small dates and splits a date that holds much, so a
    write makes few files and no task gets a whole hot date.
    """
    dated = df.withColumn(name, F.to_date(F.date_trunc(unit, "captured_at")))
    return dated.hint("rebalance", name)


def archive_raw(events: DataFrame, path: str, run: str) -> None:
    """Store raw payloads by capture date under the name of the run that fetched them: a retry of the
    run replaces what it wrote. The retention purge drops whole dates."""
    by_date(events, "captured_date").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "captured_date").parquet(f"{path}/run={run}")


def read_archive(spark: SparkSession, path: str, as_of=None, days: int | None = None) -> DataFrame:
    """The archive; with ``days``, what retention leaves: older dates are pruned unread."""
    events = spark.read.parquet(path).drop("run")
    if days is None:
        return events
    cutoff = retention_cutoff(as_of, days)
    return events.filter((F.col("captured_date") >= F.lit(cutoff.date()))
                         & (F.col("captured_at") >= timestamp(cutoff)))


def purge_archive(spark: SparkSession, path: str, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Delete what retention has expired and return the report of ``retention_report``.

    Expired dates are counted from file footers, and those folders are emptied that still hold rows: a
    purge costs what expired since the one before, however long the history. Only the date the cutoff falls
    into is read and rewritten, and the oldest date left is read for its earliest time.
    """
    cutoff = retention_cutoff(as_of, days)
    events = spark.read.parquet(path)
    schema = events.drop("run", "captured_date").schema
    day, old = F.col("captured_date"), F.col("captured_at") < timestamp(cutoff)
    last = F.lit(cutoff.date())
    # folders with expired rows: counts without columns come from footers, empty files give none
    held = events.filter(day <= last).groupBy(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.col("run").cast("string").alias("run"), day.alias("day")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    edge = materialize(events.filter(day == last), "retention-edge")
    gone = sum(r.n for r in held if r.day < cutoff.date())
    left = events.filter(day > last).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("day")).first()
    kept = edge.filter(~old)
    later = events.filter(day == F.lit(left.day)) if left.day else kept.limit(0)
    earliest = kept.select("captured_at").unionByName(later.select("captured_at")).agg(F.min("captured_at").alias("oldest_remaining"))
    counts = edge.agg((F.count_if(old) + gone).alias("deleted"), (F.count_if(~old) + left.n).alias("remaining"), F.lit(1).alias("one"))
    report = materialize(counts.join(earliest.withColumn("one", F.lit(1)), "one").drop("one"), "retention-report")
    empty = spark.createDataFrame([], schema).coalesce(1)
    for folder in held:
        rows = empty if folder.day < cutoff.date() else kept.filter(F.col("run").cast("string") == folder.run).select(*schema.names)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder.folder)
    return report


def append_snapshots(batch: DataFrame, path: str, order: str = "_ord", unit: str = "day", run: str = "batch") -> None:
    """Append the snapshots whose (post_id, captured_at) the table at ``path`` lacks; the first row of
    a key wins, and a retry adds nothing.

    Files are partitioned by the capture ``unit``: a day, or a month for thin histories. Only the
    partitions of the batch's own dates are read. Rows without a post or a capture time go to
    ``rejected_snapshots`` with the reason, under the name of the ``run`` that brought them: a retry of the run replaces them.
    """
    keys = ["post_id", "captured_at"]
    spark = batch.sparkSession
    stored = T.StructType([f for f in batch.schema.fields if f.name != order])
    reason = F.when(F.col("captured_at").isNull(), "missing_capture_time").when(F.col("post_id").isNull(), "missing_post")
    batch.withColumn("reason", reason).filter("reason is not null").drop(order).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{path}-rejected/run={run}")
    whole = batch.filter(reason.isNull())
    start = F.to_date(F.date_trunc(unit, "captured_at"))
    # one row per capture date: folder names
    days = [r[0] for r in whole.select(start.alias("day")).distinct().collect()]
    spark.createDataFrame([], stored).write.mode("overwrite").parquet(f"{path}/captured_date=1970-01-01")  # so that there is a table
    target = spark.read.schema(f"{stored.toDDL()}, captured_date date").parquet(path).filter(F.col("captured_date").isin(days))
    new = insert_new(target, whole, keys, order)
    by_date(new, "captured_date", unit).write.mode("append").partitionBy("captured_date").parquet(path)


def rejected_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_snapshots`` could not store, with a reason."""
    return spark.read.parquet(f"{path}-rejected")


ITEMS = 1_000  # ranked keys of a row


def recommendation_rows(ranked: DataFrame, as_of, window: str) -> DataFrame:
    """Rows per account and kind: the ranked keys as JSON payload, the top key's confidence, and the evidence.

    A row holds ``ITEMS`` keys, further ones are in rows with a higher ``part``; those have no confidence.
    """
    ranked = ranked.withColumn("part", F.coalesce(F.floor((F.col("rank") - 1) / ITEMS), F.lit(0)).cast("int"))
    item = F.struct("rank", "key", "n", "mean_er", "shrunk_score", "lift", "confidence")
    items = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), item)))
    rows = ranked.groupBy("account_id", "kind", "part").agg(
        items.alias("_items"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("confidence"),
        F.max("reason").alias("_reason"), F.max("baseline_er").alias("_baseline"),
        F.max("n_total").alias("_n"), F.max("er_basis").alias("_basis"))
    payload = F.struct(F.col("_items").alias("ranked"), F.col("_reason").alias("reason"))
    evidence = F.struct(F.col("_n").alias("n_total"), F.col("_baseline").alias("baseline_er"),
                        F.col("_basis").alias("basis"), F.lit(window).alias("window"))
    return rows.select("account_id", "kind", "part", F.to_json(payload).alias("payload"), "confidence",
                       F.to_json(evidence).alias("evidence"), timestamp(as_of).alias("generated_at"))


def append_recommendations(ranked: DataFrame, path: str, as_of, window: str) -> None:
    """Store the rows of one run, known by its date and window: a retry replaces them."""
    run = f"{as_of}-{window}".replace(" ", "T").replace(":", "")
    recommendation_rows(ranked, as_of, window).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{path}/run={run}")


def replace_topics(topics: DataFrame, stored: DataFrame | None, accounts: DataFrame, path: str,
                   window_start, window_end) -> None:
    """Replace the topics of ``accounts`` (account_id) for one window; other accounts and windows
    stay. ``stored`` is the table as it is, None on the first run.

    The window's new content is written aside first, because it is made of the folder it replaces.
    """
    start, end = F.lit(window_start).cast("date"), F.lit(window_end).cast("date")
    rows = topics
    if stored is not None:
        others = stored.filter((F.col("window_start") == start) & (F.col("window_end") == end))
        others = others.join(accounts.select("account_id").distinct(), "account_id", "left_anti")
        rows = rows.unionByName(others.select(*topics.columns))
    ready = materialize(rows, "topics")
    folder = f"{path}/window_start={window_start}/window_end={window_end}"
    ready.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
