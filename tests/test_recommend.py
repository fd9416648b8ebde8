import pytest
from pyspark.sql import functions as F

from agorametrics.operators import recommend as R

FACTS = "account_id long,published_at timestamp,content_type string,text_content string,er double,er_basis string"


def test_tiers_lift_and_shrinkage(spark):
    n = spark.createDataFrame([(8,), (7,), (4,), (3,), (2,), (1,)], "n long")
    assert [r[0] for r in n.select(R.confidence_for(F.col("n"))).collect()] == [
        "high", "medium", "medium", "low", "low", None]
    row = spark.range(1).select(
        R.lift(F.lit(6.0), F.lit(3.0)).alias("a"), R.lift(F.lit(1.5), F.lit(0.0)).alias("b"),
        R.shrunk_mean(F.lit(20.0), F.lit(2), F.lit(2.0)).alias("c")).first()
    assert row.a == 2.0 and row.b is None and round(row.c, 4) == 4.2857


def test_rank_categories(table):
    obs = [("video", 10.0), ("video", 12.0), *[("image", 2.0)] * 4, ("carousel", 8.0)]
    rows = R.rank_categories(table([(1, *o) for o in obs], "account_id long,key string,er double")).orderBy("rank").collect()
    assert [(r.key, r.n, r.mean_er, r.shrunk_score, r.lift, r.confidence) for r in rows] == [
        ("video", 2, 11.0, 7.0204, 2.03, "low"), ("image", 4, 2.0, 3.9048, 0.37, "medium")]  # (8 + 5 * 38 / 7) / 9
    assert {(r.baseline_er, r.n_total, r.reason) for r in rows} == {(5.4286, 7, None)}


@pytest.mark.parametrize("obs,reason", [
    ([("a", 1.0)], "insufficient_data"), ([("a", 0.0), ("b", 0.0)], "no_engagement_signal"),
    ([("a", 1.0), ("b", 2.0)], "insufficient_data")])
def test_reasons(table, obs, reason):
    rows = R.rank_categories(table([(1, *o) for o in obs], "account_id long,key string,er double")).collect()
    assert [(r.key, r.reason) for r in rows] == [(None, reason)]


def facts(table, rows):
    return table([(1, ts, ct, text, er, "err") for ts, ct, text, er in rows], FACTS)


def test_hashtags(table):
    df = facts(table, [("2026-07-06 10:00:00", None, "#promo big sale", 10.0), ("2026-07-06 10:00:00", None, "#promo again #PROMO", 12.0),
                       ("2026-07-06 10:00:00", None, "#boring day", 1.0)])
    rows = R.recommend_hashtags(df).collect()
    assert [(r.key, r.n, r.mean_er) for r in rows] == [("promo", 2, 11.0)]
    none = R.recommend_hashtags(facts(table, [("2026-07-06 10:00:00", None, "no tags", 5.0)])).collect()
    assert [(r.key, r.reason, r.n_total) for r in none] == [(None, "no_hashtags", 0)]


def test_best_time(table):
    # 2026-07-06 is a Monday; local time is one hour ahead
    df = facts(table, [("2026-07-06 17:00:00", None, "", 10.0), ("2026-07-06 17:20:00", None, "", 12.0),
                       ("2026-07-06 08:00:00", None, "", 2.0), ("2026-07-07 17:00:00", None, "", 3.0),
                       ("2026-07-07 17:30:00", None, "", 3.0)])
    rows = R.recommend_best_time(df).orderBy("kind", "rank").collect()
    cells = [r for r in rows if r.kind == "best_time"]
    assert (cells[0].day, cells[0].day_of_week, cells[0].hour, cells[0].n) == ("Monday", 0, 18, 2)
    assert (cells[0].shrunk_score, cells[0].lift, cells[0].confidence, cells[0].baseline_er) == (7.4286, 1.83, "low", 6.0)
    assert not [c for c in cells if c.hour == 9]
    days = [r for r in rows if r.kind == "best_time_day"]
    hours = [r for r in rows if r.kind == "best_time_hour"]
    assert days[0].day == "Monday" and hours[0].hour == 18
    # every post is in one day and in one hour, also where its cell is too thin to show
    assert sum(r.n for r in days) == sum(r.n for r in hours) == 5


def test_unknown_type_and_unresolved_rates(table):
    df = table([(1, "2026-07-06 10:00:00", None, "", 1.0, "erf"), (1, "2026-07-06 10:00:00", "", "", 3.0, "erf"),
                (2, "2026-07-06 10:00:00", "video", "", None, "none")], FACTS)
    rows = {r.account_id: r for r in R.recommend_content_types(df).collect()}
    assert (rows[1].key, rows[1].n, rows[1].er_basis) == ("unknown", 2, "erf")
    assert (rows[2].key, rows[2].reason, rows[2].er_basis) == (None, "insufficient_data", "none")


def test_top_k_is_exact_for_an_account_with_many_tags(table):
    rows = [("2026-07-06 10:00:00", None, f"#t{i}", float(i % 50)) for i in range(400)] * 2
    ranked = R.recommend_hashtags(facts(table, rows)).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 11))
    best = sorted(((i % 50, f"t{i}") for i in range(400)), key=lambda p: (-p[0], p[1]))[:10]
    assert [r.key for r in ranked] == [t for _, t in best]


def test_all_kinds_agree_with_the_single_ones(table):
    df = facts(table, [(f"2026-07-{i % 20 + 1:02d} {i % 24:02d}:00:00", f"t{i % 3}", f"#a{i % 4}", float(i % 7)) for i in range(200)])
    together = {tuple(r) for r in R.all_recommendations(df).drop("day_of_week", "day", "hour").collect()}
    apart = set()
    for part in (R.recommend_content_types(df), R.recommend_hashtags(df),
                 R.recommend_best_time(df).drop("day_of_week", "day", "hour")):
        apart |= {tuple(r) for r in part.collect()}
    assert together == apart
