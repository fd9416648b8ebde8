import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.operators import ordered as O
from agorametrics.operators import posts as P

START = datetime(2026, 1, 1)


def skewed(n=3000, seed=1):
    """(account, time, value): account 0 holds half of the rows."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.5 else rng.randrange(1, 9), str(START + timedelta(minutes=rng.randrange(60 * 24 * 20))),
             i, round(rng.uniform(-20, 400) ** 1.0, 2)) for i in range(n)]


SCHEMA = "account_id long,ts timestamp,id long,value double"


@pytest.mark.parametrize("rows", [50, O.ROWS])
@pytest.mark.parametrize("seconds", [60, 3600, 86400 * 400])
def test_previous_equals_plain_window(table, monkeypatch, seconds, rows):
    monkeypatch.setattr(O, "ROWS", rows)
    df = table(skewed(), SCHEMA)
    got = O.with_previous(df, ["account_id"], "ts", "id", "previous", seconds)
    want = df.withColumn("previous", F.lag("ts").over(W.partitionBy("account_id").orderBy("ts", "id")))
    assert {(r.id, r.previous) for r in got.collect()} == {(r.id, r.previous) for r in want.collect()}


def test_hot_groups_get_slices_by_count(table, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 100)
    df = table(skewed(), SCHEMA)
    sliced = O.with_slice(df, ["account_id"], "ts", 86400 * 400, O.hot_groups(df, ["account_id"], "ts"))
    sizes = [r.n for r in sliced.groupBy("account_id", "_slice").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200


def test_gaps_equal_plain_window(table):
    df = table(skewed(), SCHEMA)
    w = W.partitionBy("account_id").orderBy("ts", "id")
    want = df.withColumn("g", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9).filter("g is not null")
    got = O.gap_hours(df, ["account_id"], "ts", 1800)
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted((r.account_id, r.g) for r in want.select("account_id", "g").collect())


def test_median_equals_statistics(table):
    rows = skewed() + [(20, "2026-01-01 00:00:00", -1, 5.0), (21, "2026-01-01 00:00:00", -2, 1.0),
                       (21, "2026-01-01 00:00:00", -3, 1e7), (22, "2026-01-01 00:00:00", -4, None)]
    got = {r.account_id: r.m for r in O.exact_median(table(rows, SCHEMA), ["account_id"], "value", "m").collect()}
    groups = {}
    for account, _, _, value in rows:
        if value is not None:
            groups.setdefault(account, []).append(value)
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_rank_by_hash_equals_plain_window(table):
    df = table(skewed(), SCHEMA).withColumn("digest", F.md5(F.col("id").cast("string")))
    got = O.rank_by_hash(df, ["account_id"], "digest", "r", "n")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("account_id").orderBy("digest")))
    assert {(r.id, r.r) for r in got.collect()} == {(r.id, r.r) for r in want.collect()}


@pytest.mark.parametrize("rows", [10, O.ROWS])
@pytest.mark.parametrize("seconds", [3600, 86400, 86400 * 30])
def test_nearest_equals_brute_force(table, monkeypatch, seconds, rows):
    monkeypatch.setattr(O, "ROWS", rows)
    rng = random.Random(3)
    posts = [(i, rng.randrange(4), str(START + timedelta(hours=rng.randrange(24 * 60)))) for i in range(300)]
    snaps = [(a, str(START + timedelta(hours=h)), rng.randrange(1000))
             for a in range(3) for h in rng.sample(range(24 * 60), 25)]
    # one account is seen only long before, one never
    snaps = [s for s in snaps if s[0] != 2] + [(2, str(START - timedelta(days=30)), 5)]
    left = table(posts, "post_id long,account_id long,published_at timestamp")
    right = table(snaps, "account_id long,captured_at timestamp,followers_count long")
    got = {r.post_id: r.n for r in O.nearest_in_time(left, right, ["account_id"], "published_at", "captured_at",
                                                    "followers_count", "n", 7, seconds).collect()}
    for post, account, at in posts:
        t = datetime.fromisoformat(at)
        near = sorted((abs(datetime.fromisoformat(c) - t), c, f) for a, c, f in snaps
                      if a == account and abs(datetime.fromisoformat(c) - t) <= timedelta(days=7))
        assert got[post] == (near[0][2] if near else None)


def test_resolve_followers(table):
    accounts = table([(1, 50), (2, 60), (3, None)], "account_id long,followers_count long")
    snaps = table([(1, "2026-07-01 00:00:00", 1), (1, "2026-07-09 00:00:00", 2), (1, "2026-07-11 00:00:00", 3),
                   (2, "2026-06-01 00:00:00", 9)], "account_id long,captured_at timestamp,followers_count long")
    rows = {r.account_id: (r.followers, r.followers_basis)
            for r in P.resolve_followers(accounts, snaps, "2026-07-10 00:00:00").collect()}
    assert rows == {1: (2, "snapshot"), 2: (60, "account_latest"), 3: (None, "unavailable")}


def test_latest_snapshot(table):
    snaps = table([(1, "2026-07-01 00:00:00", 5, None), (1, "2026-07-03 00:00:00", 7, None), (1, "2026-07-02 00:00:00", 9, 4)],
                  "post_id long,captured_at timestamp,likes long,reach long")
    row = P.latest_snapshot(snaps).first()
    assert (row.likes, row.reach) == (7, None)
