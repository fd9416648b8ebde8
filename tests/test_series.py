import pytest
from pyspark.sql import functions as F

from agorametrics.operators import series as S

ROWS = "account_id long,published_at timestamp,engagement long,reach long"


def values(df):
    return [(r.label, r.value) for r in df.orderBy("bucket").collect()]


def test_sums_fill_gaps(table):
    df = table([(1, "2026-07-01 10:00:00", 5, 1), (1, "2026-07-01 12:00:00", 15, 1), (1, "2026-07-03 10:00:00", 10, 1)], ROWS)
    assert values(S.sum_timeseries(df, "engagement", "day")) == [
        ("2026-07-01", 20.0), ("2026-07-02", 0.0), ("2026-07-03", 10.0)]
    assert len(values(S.sum_timeseries(df, "engagement", "day", fill=False))) == 2


def test_pooled_rate(table):
    df = table([(1, "2026-07-01 10:00:00", 60, 400), (1, "2026-07-01 12:00:00", 40, 600),
                (1, "2026-07-03 10:00:00", 30, 600), (2, "2026-07-01 10:00:00", 5, None)], ROWS)
    rows = S.engagement_rate_timeseries(df, "day")
    assert values(rows.filter("account_id = 1")) == [("2026-07-01", 10.0), ("2026-07-02", 0.0), ("2026-07-03", 5.0)]
    assert values(rows.filter("account_id = 2")) == [("2026-07-01", 0.0)]


def test_weeks_start_on_monday_and_keep_their_anchor(table):
    df = table([(1, "2026-06-17 10:00:00", 10, 1), (1, "2026-07-08 10:00:00", 10, 1)], ROWS)
    assert values(S.sum_timeseries(df, "engagement", "week")) == [
        ("2026-06-15", 10.0), ("2026-06-22", 0.0), ("2026-06-29", 0.0), ("2026-07-06", 10.0)]


def test_months(table):
    df = table([(1, "2026-05-20 10:00:00", 3, 1), (1, "2026-07-02 10:00:00", 7, 1)], ROWS)
    assert values(S.sum_timeseries(df, "engagement", "month")) == [("2026-05", 3.0), ("2026-06", 0.0), ("2026-07", 7.0)]


def test_buckets_are_local(table):
    df = table([(1, "2026-07-01 23:30:00", 3, 1)], ROWS)
    assert values(S.sum_timeseries(df, "engagement", "day")) == [("2026-07-02", 3.0)]
    assert values(S.sum_timeseries(df, "engagement", "hour")) == [("2026-07-02 00:00", 3.0)]


def test_rolling_mean(table):
    df = table([(1, i, v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0])], "account_id long,bucket long,value double")
    assert [r.rolling for r in S.rolling_mean(df, 2).orderBy("bucket").collect()] == [None, 15.0, 25.0, 35.0]
    assert [r.rolling for r in S.rolling_mean(df, 1).orderBy("bucket").collect()] == [10.0, 20.0, 30.0, 40.0]


def test_dispatcher(table):
    df = table([(1, "2026-07-01 10:00:00", 60, 400, 100), (2, "2026-07-01 10:00:00", 10, None, 100)],
               ROWS + ",followers long")
    rows = {r.account_id: (r.name, r.value) for r in S.kpi_timeseries(df, "er", "day").collect()}
    assert rows == {1: ("engagement_rate_by_reach", 15.0), 2: ("engagement_rate_by_followers", 10.0)}
    assert {r.value for r in S.kpi_timeseries(df, "engagement", "day").collect()} == {60.0, 10.0}
    with pytest.raises(ValueError):
        S.kpi_timeseries(df, "fame")
    with pytest.raises(ValueError):
        S.sum_timeseries(df, "engagement", "year")


def test_chart_contract(table):
    df = table([(1, "2026-07-01 10:00:00", 5, 1), (1, "2026-07-03 10:00:00", 10, 1)], ROWS)
    row = S.chart(S.sum_timeseries(df, "engagement", "day")).first()
    assert row.labels == ["2026-07-01", "2026-07-02", "2026-07-03"] and row.data == [5.0, 0.0, 10.0]


def test_platform_zscore(table):
    rows = [("a", f"2026-07-0{d} 10:00:00", 1, er, "err") for d, er in ((1, 8.0), (2, 10.0), (3, 12.0))]
    rows += [("b", "2026-07-03 10:00:00", 1, 5.0, "erf"), ("c", "2026-06-01 10:00:00", 1, 5.0, "err")]
    df = table(rows, "platform string,published_at timestamp,engagement long,er double,er_basis string")
    got = {r.platform: r for r in S.kpi_by_platform(df, "2026-07-04 00:00:00", "1d").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].avg_engagement_rate, got["a"].zscore_vs_90d_baseline) == (12.0, 1.0)
    assert got["b"].zscore_vs_90d_baseline_reason == "insufficient_data"
    assert got["b"].engagement_rate_basis == "erf"


def test_partitioning_does_not_matter(table):
    df = table([(i % 3, f"2026-07-{i % 28 + 1:02d} 10:00:00", i, i + 1) for i in range(200)], ROWS)
    one = S.engagement_rate_timeseries(df.coalesce(1), "week").orderBy("account_id", "bucket").collect()
    many = S.engagement_rate_timeseries(df.repartition(7, F.rand(3)), "week").orderBy("account_id", "bucket").collect()
    assert one == many
