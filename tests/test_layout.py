"""Clustered files are read in small part, bucketed tables joined without a shuffle; rows stay the same."""

from __future__ import annotations

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agorametrics.operators import posts as P
from agorametrics.session import shared_dir
from agorametrics.sources import layout


def _posts(spark, n=40_000):
    # one account holds a third of the rows
    return spark.range(n).selectExpr(
        "id as post_id", "if(id % 3 = 0, 7L, pmod(xxhash64(id), 500)) as account_id",
        "timestamp_seconds(1700000000 + pmod(xxhash64(id, 1), 86400 * 365)) as published_at")


def _met(path, account, since, until):
    """Row groups whose statistics let an account and window through, of all."""
    met = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            a, t = (meta.row_group(g).column(names.index(c)).statistics for c in ("account_id", "published_at"))
            met += a.min <= account <= a.max and (t is None or (t.min.timestamp() < until and t.max.timestamp() >= since))
            total += 1
    return met, total


def test_an_account_and_window_read_few_files(spark):
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    path, posts = shared_dir(spark, "clustered"), _posts(spark)
    layout.write_clustered(posts, path, ["account_id", "published_at"], files=64)
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    table = spark.read.parquet(path)
    assert table.count() == posts.count() and table.columns == posts.columns
    since, until = 1710000000, 1710000000 + 86400 * 14
    for account in (7, 123, 499):
        met, total = _met(path.removeprefix("file:"), account, since, until)
        assert total >= 60 and met <= 0.15 * total
        where = f"account_id = {account} and published_at >= timestamp_seconds({since}) and published_at < timestamp_seconds({until})"
        assert sorted(map(tuple, table.where(where).collect())) == sorted(map(tuple, posts.where(where).collect()))


def test_clustered_nulls_ties_and_empty_tables(spark, table):
    rows = [(1, None, None), (2, 5, "2026-07-01 00:00:00"), (3, 5, "2026-07-01 00:00:00"), (4, None, "2026-07-02 00:00:00")]
    for some in (rows, []):
        path = shared_dir(spark, "clustered")
        layout.write_clustered(table(some, "post_id long, account_id long, published_at timestamp"), path, ["account_id", "published_at"], files=2)
        assert sorted(r.post_id for r in spark.read.parquet(path).collect()) == [r[0] for r in some]


def _shuffled_on_post(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\(post_id", plan))


def test_bucketed_posts_and_snapshots_join_without_a_shuffle(spark):
    posts = _posts(spark, 5_000)
    snapshots = spark.range(20_000).selectExpr("id % 5000 as post_id", "timestamp_seconds(1700000000 + id) as captured_at", "id % 90 as likes")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = posts.join(P.latest_snapshot(snapshots), "post_id")
        held = [layout.write_bucketed(df, shared_dir(spark, name), f"{name}_bucketed", ["post_id"], 8) for name, df in (("posts", posts), ("snaps", snapshots))]
        joined = held[0].join(P.latest_snapshot(held[1]), "post_id")
        assert _shuffled_on_post(plain) >= 1 and _shuffled_on_post(joined) == 0
        assert sorted(map(tuple, joined.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_gets_no_bucket(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("post_id"))
    with pytest.raises(layout.HotKey, match="6668 of 20000"):
        layout.write_bucketed(hot, shared_dir(spark, "hot"), "hot_bucketed", ["post_id"], 64)
