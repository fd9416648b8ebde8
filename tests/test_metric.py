import random

import pytest
from pyspark.sql import functions as F

from agorametrics.functions import metric as M
from agorametrics.operators import kpi as K

POST = "post_id long, likes long, comments_count long, shares long, saves long, reach long, impressions long, " \
       "video_views long, clicks long, followers long"


def posts(table, *rows):
    from agorametrics.operators.posts import with_engagement

    return with_engagement(table([(i, *r) for i, r in enumerate(rows)], POST))


def test_rounding_is_exact(spark):
    rng = random.Random(5)
    values = [rng.uniform(-500, 500) for _ in range(20000)] + [k / 200 for k in range(-5000, 5000)]
    values += [k / 20000 for k in range(-3000, 3000)] + [2.675, 1.005, 0.125, 1.115, 5e-05, -5e-05, 0.005, -0.001]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", M.round_dp(F.col("v"), 2).alias("two"), M.round_dp(F.col("v"), 4).alias("four")).collect()
    assert [r for r in rows if r.two != round(r.v, 2) or r.four != round(r.v, 4)] == []
    assert M.round_dp(F.lit(None).cast("double")) is not None


def test_all_post_kpis(table):
    row = K.compute_post_kpis(posts(table, (80, 10, 5, 5, 1000, 1600, 400, 20, 2000))).first()
    expected = {
        "engagement_rate_by_reach": 10.0, "engagement_rate_by_followers": 5.0, "engagement_rate_by_impressions": 6.25,
        "amplification_rate": 0.25, "applause_rate": 4.0, "conversation_rate": 0.5, "save_rate": 0.5,
        "virality_rate": 0.5, "click_through_rate": 1.25, "video_view_rate": 40.0,
    }
    assert {k: row[k] for k in expected} == expected
    assert all(row[f"{k}_reason"] is None for k in expected)


@pytest.mark.parametrize("row,value,reason", [
    ((80, 10, 5, 5, None, None, None, None, None), None, "reach_unavailable"),
    ((80, 10, 5, 5, 0, None, None, None, None), None, "non_positive_denominator"),
    ((0, 0, 0, 0, 1000, None, None, None, None), 0.0, None),
    ((None, None, None, 10, 1000, None, None, None, None), 1.0, None),
])
def test_honest_null(table, row, value, reason):
    got = K.compute_post_kpis(posts(table, row), ["engagement_rate_by_reach"]).first()
    assert (got["engagement_rate_by_reach"], got["engagement_rate_by_reach_reason"]) == (value, reason)


def test_gates_come_before_denominators(table):
    got = K.compute_post_kpis(posts(table, (1, 1, 1, 1, None, None, None, None, None))).first()
    assert got["click_through_rate_reason"] == "clicks_unavailable"
    assert got["video_view_rate_reason"] == "video_views_unavailable"
    got = K.compute_post_kpis(posts(table, (1, 1, 1, 1, None, None, 5, 5, None))).first()
    assert got["click_through_rate_reason"] == "impressions_unavailable"
    assert got["video_view_rate_reason"] == "reach_unavailable"


def test_primary_rate(table):
    rows = K.with_primary_er(posts(
        table, (100, 0, 0, 0, 1000, None, None, None, 5000), (100, 0, 0, 0, None, None, None, None, 5000),
        (100, 0, 0, 0, None, None, None, None, None), (100, 0, 0, 0, 0, None, None, None, 0))).orderBy("post_id").collect()
    assert [(r.er, r.er_basis, r.er_reason) for r in rows] == [
        (10.0, "err", None), (2.0, "erf", None), (None, "none", "reach_unavailable"),
        (None, "none", "non_positive_denominator")]


def test_velocity(table):
    published = table([(1, "2026-07-01 00:00:00"), (2, "2026-07-01 00:00:00"), (3, "2026-07-01 00:00:00")],
                      "post_id long,published_at timestamp")
    snaps = table([
        (1, "2026-07-01 20:00:00", 30, 0, 0, 0), (1, "2026-07-05 00:00:00", 100, 0, 0, 0),
        (2, "2026-07-01 20:00:00", 30, 0, 0, 0), (3, "2026-07-01 10:00:00", 5, 0, 0, 0),
        (3, "2026-07-03 00:00:00", 0, 0, 0, 0)],
        "post_id long,captured_at timestamp,likes long,comments_count long,shares long,saves long")
    rows = K.engagement_velocity(published, snaps).orderBy("post_id").collect()
    assert [(r.engagement_velocity, r.engagement_velocity_reason) for r in rows] == [
        (0.3, None), (None, "insufficient_snapshots"), (None, "non_positive_denominator")]


def test_account_statistics(table):
    df = table([(1, 10.0), (1, 20.0), (1, 30.0), (1, 40.0), (2, None)], "account_id long,er double")
    medians = {r.account_id: r for r in K.median_metric(df, ["account_id"]).collect()}
    assert medians[1].median == 25.0 and medians[2].median_reason == "insufficient_data"
    means = {r.account_id: r for r in K.mean_metric(df, ["account_id"]).collect()}
    assert means[1].mean == 25.0 and means[2].mean_reason == "insufficient_data"


def test_frequency_and_consistency(table):
    one = table([(1,)], "n long")
    assert M.select_metrics(one, [], {"f": K.posting_frequency(F.lit(10), 30.0)}).first().f == 2.33
    times = [(1, "2026-07-01 00:00:00"), (1, "2026-07-02 00:00:00"), (1, "2026-07-03 00:00:00"),
             (1, "2026-07-05 00:00:00"), (2, "2026-07-01 00:00:00"), (2, "2026-07-05 00:00:00")]
    rows = {r.account_id: r for r in K.posting_consistency(
        table(times, "account_id long,published_at timestamp")).collect()}
    assert rows[1].posting_consistency_hours == 13.86
    assert rows[2].posting_consistency_hours_reason == "insufficient_data"


def test_follower_change(table):
    df = table([(1, "2026-07-01 00:00:00", 1000), (1, "2026-07-09 00:00:00", 1100), (1, "2026-07-05 00:00:00", 5),
                (2, "2026-07-02 00:00:00", 0)], "account_id long,captured_at timestamp,followers_count long")
    rows = {r.account_id: r for r in K.follower_change(df, "2026-07-01 00:00:00", "2026-07-10 00:00:00").collect()}
    assert (rows[1].follower_growth_rate, rows[1].net_follower_change) == (10.0, 100.0)
    assert rows[2].follower_growth_rate_reason == "non_positive_denominator"


def test_deltas_and_zscore(spark):
    one = spark.range(1)
    lit = lambda v: F.lit(v).cast("double")
    got = M.select_metrics(one, [], {
        "up": M.delta_pct(lit(120), lit(100)), "down": M.delta_pct(lit(80), lit(100)), "zero": M.delta_pct(lit(100), lit(0)),
        "none": M.delta_pct(lit(None), lit(1)), "z": M.zscore(lit(13), lit(10), lit(2), F.lit(3)),
        "short": M.zscore(lit(13), lit(10), lit(2), F.lit(1)), "flat": M.zscore(lit(13), lit(10), lit(0), F.lit(3)),
    }).first()
    assert (got.up, got.down, got.z) == (20.0, -20.0, 1.5)
    assert (got.zero_reason, got.none_reason) == ("non_positive_denominator", "insufficient_data")
    assert (got.short_reason, got.flat_reason) == ("insufficient_data", "non_positive_denominator")


def test_windows():
    assert M.parse_window("30d").days == 30
    assert M.parse_window(" 48H ").total_seconds() == 48 * 3600
    assert M.parse_window("12w").days == 84
    for bad in ("", "30", "30m", "d30", None):
        with pytest.raises(ValueError):
            M.parse_window(bad)


def test_unknown_metric(table):
    with pytest.raises(ValueError):
        K.top_posts(posts(table, (1, 1, 1, 1, 1, 1, 1, 1, 1)), "fame")


def test_top_posts_by_count_drops_missing_scores(table):
    df = posts(table, (1, 0, 0, 0, 5, None, None, None, None), (2, 0, 0, 0, None, None, None, None, None),
               (3, 0, 0, 0, 9, None, None, None, None))
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("published_at", "content_type", "permalink")})
    rows = K.top_posts(df.withColumn("account_id", F.lit(1)), "reach", 10).orderBy("rank").collect()
    assert [(r.post_id, r.score, r.score_basis) for r in rows] == [(2, 9.0, "reach"), (0, 5.0, "reach")]
    assert K.top_posts(df.withColumn("account_id", F.lit(1)), "reach", 1, per_account=False).count() == 1
