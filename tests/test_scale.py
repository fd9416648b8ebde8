"""Plans, not results: what must hold for tables that do not fit one machine."""

import re

import pytest
from pyspark.sql import functions as F

from agorametrics.operators import ingest as I
from agorametrics.operators import kpi as K
from agorametrics.operators import posts as P
from agorametrics.operators import series as SR
from agorametrics.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def stored(spark, tmp_path):
    """Posts, snapshots and accounts as files; account 0 has half of the posts."""
    n = 4000
    posts = spark.range(n).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("account_id"),
        F.expr("timestamp'2026-07-01' + make_interval(0, 0, 0, 0, 0, id)").alias("published_at"), F.lit("video").alias("content_type"),
        F.lit("#a #b").alias("text_content"), F.lit("p").alias("permalink"), (F.col("id") % 9 == 0).alias("is_synthetic"))
    snaps = posts.select("post_id", F.col("published_at").alias("captured_at"), F.lit(5).alias("likes"), F.lit(1).alias("comments_count"),
                         F.lit(1).alias("shares"), F.lit(0).alias("saves"), (F.col("post_id") % 300 + 1).alias("reach"),
                         *[F.lit(9).cast("long").alias(c) for c in ("impressions", "video_views", "clicks")])
    accounts = spark.range(52).select(F.col("id").alias("account_id"), F.lit("x").alias("platform"), F.lit("h").alias("handle"),
                                      F.lit(100).cast("long").alias("followers_count"))
    out = []
    for name, df in (("posts", posts), ("snaps", snaps), ("accounts", accounts)):
        df.write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_filters_and_columns_reach_the_scan(stored):
    frame = P.post_metrics(*stored, as_of="2026-07-03 00:00:00", since="2026-07-02 00:00:00", until="2026-07-03 00:00:00",
                           include_synthetic=False)
    df = K.with_primary_er(frame).groupBy("account_id").agg(F.avg("er"))
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    scans = [s.split("\n\n")[0] for s in re.split(r"\(\d+\) Scan parquet", text)[1:]]
    posts = next(s for s in scans if "published_at" in s)
    assert "GreaterThanOrEqual(published_at" in posts and "LessThan(published_at" in posts
    schema = re.search(r"ReadSchema: (.*)", posts).group(1)
    assert "text_content" not in schema and "permalink" not in schema
    snaps = next(s for s in scans if "captured_at" in s)
    assert "impressions" not in re.search(r"ReadSchema: (.*)", snaps).group(1)
    assert "LessThanOrEqual(captured_at" in snaps
    # only the window's posts reach the aggregation of the snapshots
    tree = text.split("\n\n")[0]
    assert "LeftSemi" in text and tree.index("LeftSemi" if "LeftSemi" in tree else "Join") < len(tree)


def test_later_snapshots_change_nothing(spark, stored):
    posts, snaps, accounts = stored
    as_of = "2026-07-02 00:00:00"
    later = snaps.withColumn("captured_at", F.lit("2026-07-09").cast("timestamp")).withColumn("likes", F.lit(999))
    rows = [P.post_metrics(posts, s, accounts, as_of=as_of, until=as_of).collect() for s in (snaps, snaps.unionByName(later))]
    assert sorted(rows[0]) == sorted(rows[1]) and rows[0]


def test_snapshots_aggregate_by_hash_and_before_the_shuffle(stored):
    text = plan(P.latest_snapshot(stored[1]))
    assert "partial_max_by" in text and "SortAggregate" not in text


def test_top_posts_cut_before_the_shuffle(stored):
    text = plan(K.top_posts(P.post_metrics(*stored)))
    assert text.index("WindowGroupLimit") and "Partial" in text
    assert "WindowGroupLimit" in plan(I.comment_fetch_cap(stored[0], 25))


def test_a_hot_account_is_split_by_the_join(spark, stored):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1B",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        df = K.mean_metric(K.with_primary_er(P.post_metrics(*stored)), ["account_id"])
        text = plan(df, run=True)
        assert "skew=true" in text
        # the aggregation behind the split join still sums per part first
        assert "partial_sum" in text
        means = {r.account_id: r.n for r in df.collect()}
        assert means[0] == 2000 and sum(means.values()) == 4000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_slices_get_their_own_shuffle(stored):
    """Partitioning by account alone must not serve a window over (account, slice)."""
    joined = P.post_metrics(*stored).repartition("account_id")
    text = plan(K.posting_consistency(joined))
    assert re.search(r"hashpartitioning\(account_id, _slice", text)
    text = plan(SR.exact_median(K.with_primary_er(joined), ["account_id"], "er", "m"))
    assert re.search(r"hashpartitioning\(account_id, er", text) and re.search(r"hashpartitioning\(account_id, _band", text)


def test_upsert_is_one_combined_aggregation(stored):
    batch = stored[0].withColumn("_ord", F.lit(1))
    text = plan(I.upsert(stored[0], batch, ["post_id"], ("content_type",), "_ord"))
    assert "Join" not in text and "partial_max_by" in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_multiplies_rows(spark, name):
    if name in ("train_sentiment", "fit_topics"):
        pytest.skip("fits a model")
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_window_frame_is_evaluated_anew_per_row(spark):
    """A frame that ends at the last row costs the square of its group."""
    text = plan(catalog.QUERIES["followers_asof_publish"](spark, SF))
    frames = re.findall(r"specifiedwindowframe\([^)]*\)[^)]*\)?", text)
    assert frames and not [f for f in frames if "unboundedfollowing" in f and "unboundedpreceding" not in f]
