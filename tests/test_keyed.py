"""Keyed tables: a batch costs its own rows, pruned reads equal whole folds, retries and failures change nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from agorametrics.session import shared_dir
from agorametrics.sources.keyed import KeyedTable

SCHEMA = "id long, part string, name string, seen long, _ord long"


@pytest.fixture
def make(spark):
    def new(**options):
        options = {"keys": ("id", "part"), "updates": ("name",), "rows": 100, **options}
        return KeyedTable(shared_dir(spark, "keyed"), **options).create(spark, "id long, part string, name string, seen long")

    return new


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def folded(batches, nulls=True):
    """The table by hand: last name, first seen."""
    held, keyless = {}, []
    for batch in batches:
        for i, part, name, seen, _ in sorted(batch, key=lambda r: r[4]):
            if i is None or part is None:
                keyless.append((i, part, name, seen))
            elif (i, part) not in held:
                held[i, part] = [i, part, name, seen]
            elif nulls or name is not None:
                held[i, part][2] = name
    return sorted([*map(tuple, held.values()), *keyless], key=str)


@pytest.mark.parametrize("nulls", [True, False])
def test_any_run_of_batches_folds_and_lookups(spark, table, make, nulls):
    r = random.Random(7)
    t = make(overwrite_nulls=nulls)
    batches = []
    for version in range(0, 10, 2):
        ids = [r.randrange(300) for _ in range(150)]
        batch = [(i if i % 50 else None, f"p{i % 2}", r.choice(["a", "b", None]), version, k) for k, i in enumerate(ids)]
        batches.append(batch)
        for _ in range(2):  # the second is a retry
            t.append(table(batch, SCHEMA), version)
        assert rows_of(t.read(spark)) == folded(batches, nulls)
        if version in (2, 6):
            assert t.compact(spark, version + 1, share=0.0)
            assert not t.compact(spark, version + 1, share=0.0)
            assert rows_of(t.read(spark)) == folded(batches, nulls)
    wanted = [(i, "p1") for i in range(1, 400, 7)]
    some = rows_of(t.lookup(spark.createDataFrame(wanted, "id long, part string")))
    assert some == [x for x in folded(batches, nulls) if (x[0], x[1]) in set(wanted)]
    before = rows_of(t.lookup(spark.createDataFrame(wanted, "id long, part string"), before=8))
    assert before == [x for x in folded(batches[:4], nulls) if (x[0], x[1]) in set(wanted)]


def test_a_batch_touches_a_small_share(spark, make):
    """10,000 keys against a table of 400,000 in 400 files: nothing of the table is read or written when they are stored, and few
    files take part in a fold."""
    t = make(keys=("id",), rows=1000)
    old = spark.range(400_000).select("id", F.lit("p").alias("part"), F.lit("old").alias("name"), F.lit(0).alias("seen"), F.lit(0).alias("_ord"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t.append(old, 0)
    base = {r.file: r.n for r in t.files(spark).collect()}
    assert sum(base.values()) == 400_000 and len(base) >= 400
    batch = spark.range(10_000).select((F.col("id") + 399_990).alias("id"), F.lit("p").alias("part"), F.lit("new").alias("name"), F.lit(1).alias("seen"), F.col("id").alias("_ord"))
    t.append(batch, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = t.files(spark)
    assert {r.file for r in files.where("level = 0").collect()} == set(base)
    assert files.where("level = 1").agg(F.sum("n")).first()[0] == 10_000
    rest, met, later = t._parts(spark, files)
    # ten keys are old; a filter errs once in a hundred keys, on one file of 400 that its range leaves
    assert 10 - 3 <= len(met) < 0.35 * len(base) and len(rest) + len(met) == len(base)
    read = t.read(spark)
    assert read.count() == 409_990 and read.where("name = 'new'").count() == 10_000 and read.where("seen = 0").count() == 400_000
    assert t.compact(spark, 2, share=0.01)
    kept = {r.file for r in t.files(spark).collect()}
    assert set(rest) <= kept and not set(met) & kept
    assert t.read(spark).where("name = 'new'").count() == 10_000
    # a single key reads one file or two
    assert t.possible(spark.createDataFrame([(5,)], "id long").select(F.xxhash64("id").alias("_h")), t.files(spark)).count() <= 2


def test_a_failed_batch_leaves_nothing(spark, table, make, monkeypatch):
    t = make()
    t.append(table([(1, "p", "a", 0, 0)], SCHEMA), 0)
    batch = table([(1, "p", "b", 1, 0), (2, "p", "c", 1, 1), (None, "p", "d", 1, 2)], SCHEMA)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_listed", fails)
        with pytest.raises(OSError):
            t.append(batch, 1)
    assert rows_of(t.read(spark)) == [(1, "p", "a", 0)]
    t.append(batch, 1)
    assert rows_of(t.read(spark)) == sorted([(1, "p", "b", 0), (2, "p", "c", 1), (None, "p", "d", 1)], key=str)
    with pytest.raises(ValueError, match="from 0"):
        t.append(batch, -1)


def test_no_updates_keeps_first_rows_and_empty_batches_pass(spark, table, make):
    t = make(updates=())
    t.append(table([], SCHEMA), 0)
    assert rows_of(t.read(spark)) == []
    assert rows_of(t.lookup(spark.createDataFrame([(1, "p")], "id long, part string"))) == []
    t.append(table([(1, "p", "a", 0, 1), (1, "p", "z", 9, 2)], SCHEMA), 1)
    t.append(table([(1, "p", "b", 1, 0)], SCHEMA), 2)
    t.append(table([], SCHEMA), 3)
    assert rows_of(t.read(spark)) == [(1, "p", "a", 0)]
    assert t.create(spark, "id long").read(spark).columns == ["id", "part", "name", "seen"]


def test_missing_rows_are_found_by_filter_and_compared_exactly(spark, table, make):
    t = make(keys=("id",), rows=50, bits=2)  # a filter that errs often
    t.append(table([(i, "p", "a", 0, 0) for i in range(0, 1000, 2)], SCHEMA), 0)
    t.append(table([(i, "p", "b", 1, 0) for i in range(1, 200, 2)], SCHEMA), 1)
    rows = [(i, "x") for i in range(0, 1500, 3)] + [(1501, "twice"), (1501, "twice"), (None, "none")]
    got = sorted((tuple(r) for r in t.missing(table(rows, "id long, note string")).collect()), key=str)
    held = {*range(0, 1000, 2), *range(1, 200, 2)}
    assert got == sorted([r for r in rows if r[0] not in held], key=str)
    assert make().missing(table(rows, "id long, note string").selectExpr("*", "'p' as part")).count() == len(rows)


def test_new_keys_read_no_history(spark, make, monkeypatch):
    t = make(keys=("id",), rows=500, bits=16)
    old = spark.range(20_000).selectExpr("id", "'p' as part", "'a' as name", "0L as seen", "0L as _ord")
    t.append(old, 0)
    read = []
    plain = KeyedTable._read
    monkeypatch.setattr(KeyedTable, "_read", lambda self, s, names, schema: read.append(len(names)) or plain(self, s, names, schema))
    assert t.missing(spark.range(50_000, 50_100).select("id")).count() == 100
    assert read == [0] or read[0] <= 0.1 * t.files(spark).count()
