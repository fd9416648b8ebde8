"""Rollups against the whole computation, in any order of batches."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from agorametrics.operators import rollup as R
from agorametrics.session import shared_dir

SCHEMA = "post_id long, account_id long, platform string, at timestamp, value double"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_and_replaced_rows(spark, table, seed):
    r = random.Random(seed)
    path, day = shared_dir(spark, "rollup"), F.to_date("at")
    now, batches = {}, []
    for _ in range(4):
        old, new = [], []
        for post in r.sample(range(40), 15):
            row = (post, post % 3, "fx"[post % 2], f"2026-07-0{r.randint(1, 4)} 10:00:00", r.choice([None, round(r.uniform(-5, 90), 2), 7.0]))
            if post in now:
                old.append(now[post])
            new.append(row)
            now[post] = row
        batches.append((old, new))
    order = list(range(4))
    r.shuffle(order)
    for k in order + order[:2]:  # two come again
        old, new = batches[k]
        R.log_changes(R.changes(table(old, SCHEMA), table(new, SCHEMA), "value", day), path, k)
    R.compact_rollup(spark, path, f"{path}-folded")
    for where in (path, f"{path}-folded"):
        rollup = R.read_rollup(spark, where)
        for keys in (("account_id", "platform"), ("account_id",), ("account_id", "day")):
            want = {}
            for _, account, platform, at, value in now.values():
                if value is not None:
                    key = {"account_id": account, "platform": platform, "day": at[:10]}
                    want.setdefault(tuple(key[k] for k in keys), []).append(round(value * 100))
            got = {tuple(str(x) if k == "day" else x for k, x in zip(keys, row, strict=False)): row for row in R.summary(rollup, keys).collect()}
            assert set(got) == set(want)
            for key, cents in want.items():
                row = got[key]
                assert row.n == len(cents) and row.mean == pytest.approx(sum(cents) / len(cents) / 100, abs=5.1e-5)
                assert row.median == pytest.approx(statistics.median(cents) / 100, abs=5.1e-5)
                assert row.second_moment == pytest.approx(sum(c * c for c in cents) / len(cents) / 1e4, abs=5.1e-5)


def test_an_empty_batch(spark, table):
    path = shared_dir(spark, "rollup")
    R.log_changes(R.changes(None, table([], SCHEMA), "value", F.to_date("at")), path, 0)
    assert R.summary(R.read_rollup(spark, path)).collect() == []
