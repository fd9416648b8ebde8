"""A staged batch into the four keyed tables, at the cost of the batch and of the files that may hold its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.operators import ingest as I
from agorametrics.schemas import COUNT_COLUMNS
from agorametrics.session import empty, materialize, scratch
from agorametrics.sources.keyed import KeyedTable

KEYS = {
    "accounts": ("platform", "external_id"), "posts": ("account_id", "external_id"),
    "snapshots": ("post_id", "captured_at"), "comments": ("post_id", "external_id"),
}


def keyed_tables(path: str) -> dict[str, KeyedTable]:
    """The tables of one store. Snapshots are immutable: the first row of a post and time stays."""
    return {name: KeyedTable(f"{path}/{name}", keys, tuple(I.UPDATES.get(name, ()))) for name, keys in KEYS.items()}


REPORT = "entity string, reason string, n bigint"
NAMES = ["platform", "account_external_id", "post_external_id"]


def store_batch(batch: dict[str, DataFrame], tables: dict[str, KeyedTable], as_of, version: int) -> DataFrame:
    """Store accounts, then posts, then snapshots and comments, each resolving ids of the ones before; the report of
    stored and skipped rows. The same batch under the same version gives the same tables and report: the report is stored
    last, so a retry of a whole batch reads it, and one of a batch that failed stores what is lacking.

    Staged frames carry ``_ord`` and are read several times: pass stored ones (``materialize``). Only table files that may hold a key the batch names are read.
    What a step stores for itself and its shuffles go when it ends, so the disk holds the tables and one step's rows.
    """
    spark = batch["accounts"].sparkSession
    reports = f"{tables['accounts'].path}/reports"
    empty(spark, REPORT).write.mode("ignore").parquet(f"{reports}/version=-1")
    done = spark.read.schema(f"{REPORT}, version bigint").parquet(reports).where(F.col("version") == version).drop("version")
    if done.limit(1).count():
        return done
    with scratch():
        parts = [_stored_accounts(batch, tables, version)]
        with scratch() as keep:
            known, named = _names(batch, tables)
            with scratch() as keep_report:
                parts.append(keep(keep_report(_stored_posts(batch, tables, known, as_of, version))))
            asked = I.resolve_accounts(named, known).select("account_id", F.col("post_external_id").alias("external_id"))
            known_posts = tables["posts"].lookup(asked, columns=[*KEYS["posts"], "post_id"])
            ids = keep(materialize(I.post_names(known, known_posts, named).select(*NAMES, "post_id"), "post-names", "zstd"))
        with scratch() as keep:
            parts.append(keep(_stored_snapshots(batch, tables, ids, as_of, version)))
        with scratch() as keep:
            parts.append(keep(_stored_comments(batch, tables, ids, version)))
        report = parts[0]
        for part in parts[1:]:
            report = report.unionByName(part)
        # one file: it is there or it isn't
        report.select("entity", "reason", "n").coalesce(1).write.mode("overwrite").parquet(f"{reports}/version={version}")
    return spark.read.schema(REPORT).parquet(f"{reports}/version={version}")


def _names(batch: dict[str, DataFrame], tables: dict[str, KeyedTable]) -> tuple[DataFrame, DataFrame]:
    """The stored accounts a batch names, and the posts its snapshots and comments name: a post's name is resolved once, however many do."""
    with scratch() as keep:
        named = batch["metrics"].select(*NAMES).unionByName(batch["comments"].select(*NAMES)).distinct()
        named = keep(materialize(named, "named-posts", "zstd"))
    with scratch() as keep:
        owners = batch["posts"].select("platform", "account_external_id").unionByName(named.select("platform", "account_external_id"))
        owners = owners.withColumnRenamed("account_external_id", "external_id")
        known = tables["accounts"].lookup(owners, columns=[*KEYS["accounts"], "account_id"])
        return keep(materialize(known, "known-accounts", "zstd")), named


def _counted(df: DataFrame, entity: str, reason: Column) -> DataFrame:
    """The report's rows of a frame."""
    return I.skip_report(df.select(F.lit(entity).alias("entity"), reason.alias("reason")))


def _stored_accounts(batch: dict[str, DataFrame], tables: dict[str, KeyedTable], version: int) -> DataFrame:
    with scratch():
        accounts = batch["accounts"].withColumn("account_id", I.new_ids(batch["accounts"], KEYS["accounts"]))
        tables["accounts"].append(accounts, version)
    return _counted(batch["accounts"], "accounts", F.lit("stored"))


def _stored_posts(batch: dict[str, DataFrame], tables: dict[str, KeyedTable], known: DataFrame, as_of, version: int) -> DataFrame:
    posts = I.stage_posts(batch["posts"], known, as_of)
    posts = materialize(posts.drop("platform", "account_external_id"), "staged-posts", "zstd")
    tables["posts"].append(posts.filter(F.col("reason").isNull()), version)
    return materialize(_counted(posts, "posts", F.coalesce("reason", F.lit("stored"))), "posts-report")


def _stored_snapshots(batch: dict[str, DataFrame], tables: dict[str, KeyedTable], ids: DataFrame, as_of, version: int) -> DataFrame:
    spark, keys = ids.sparkSession, list(KEYS["snapshots"])
    with scratch() as keep:
        metrics = I.metrics_of(batch["metrics"].join(ids, NAMES, "left"), as_of)
        undated = F.when(F.col("captured_at").isNull(), "missing_capture_time")
        metrics = metrics.select(*keys, *COUNT_COLUMNS, "_ord", F.coalesce("reason", undated).alias("reason"))
        metrics = keep(materialize(metrics, "staged-metrics", "zstd"))
    with scratch():
        tables["snapshots"].append(metrics.filter(F.col("reason").isNull()), version)
    # keys are counted where they are stored: once each, and none of them is null
    n_keys = tables["snapshots"].size(spark, version)
    added = tables["snapshots"].repeated(spark, version).select((F.lit(n_keys) - F.col("n")).alias("n"))
    added = materialize(added, "added-snapshots")  # one row
    n_good = metrics.filter(F.col("reason").isNull()).agg(F.count(F.lit(1)).alias("n"))
    twice = n_good.unionByName(added.select((-F.col("n")).alias("n"))).agg(F.sum("n").alias("n"))
    out = _counted(metrics, "metrics", F.col("reason"))
    for reason, n in (("stored", added), ("duplicate_snapshot", twice)):
        out = out.unionByName(n.filter(F.col("n") > 0).select(F.lit("metrics").alias("entity"), F.lit(reason).alias("reason"), "n"))
    return materialize(out, "metrics-report")


def _stored_comments(batch: dict[str, DataFrame], tables: dict[str, KeyedTable], ids: DataFrame, version: int) -> DataFrame:
    with scratch() as keep:
        comments = I.comments_of(batch["comments"].join(ids, NAMES, "left"))
        comments = keep(materialize(comments.drop(*NAMES), "staged-comments", "zstd"))
    tables["comments"].append(comments.filter(F.col("reason").isNull()), version)
    return materialize(_counted(comments, "comments", F.coalesce("reason", F.lit("stored"))), "comments-report")
