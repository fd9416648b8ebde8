"""A batch into the four tables: retries cost nothing, and one that failed goes on."""

import os

import pytest
from pyspark.sql import functions as F

from agorametrics.plans import ingest_queries as Q
from agorametrics.plans.fixtures import Fixtures
from agorametrics.session import materialize, scratch, shared_root
from agorametrics.sources import keyed as K
from agorametrics.sources import store as ST
from agorametrics.sources.keyed import KeyedTable

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_retry_reads_the_report_and_a_failed_batch_goes_on(spark, monkeypatch):
    fx = Fixtures(spark, SF)
    batch, stored = Q._batch(fx), Q._store(fx, {})
    plain = KeyedTable.append

    def fails(self, rows, version, order="_ord"):
        if self.path.endswith("/comments"):
            raise OSError("lost")
        return plain(self, rows, version, order)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "append", fails)
        with pytest.raises(OSError):
            ST.store_batch(batch, stored, Q.GATE_AS_OF, 1)
    first = rows_of(ST.store_batch(batch, stored, Q.GATE_AS_OF, 1))
    assert first == rows_of(ST.store_batch(batch, Q._store(fx, {}), Q.GATE_AS_OF, 1))
    assert stored["comments"].read(spark).count() > 0

    def read(*_, **__):
        raise AssertionError("a retry of a stored batch looks nothing up")

    monkeypatch.setattr(KeyedTable, "lookup", read)
    assert rows_of(ST.store_batch(batch, stored, Q.GATE_AS_OF, 1)) == first
    with pytest.raises(AssertionError):
        ST.store_batch(batch, stored, Q.GATE_AS_OF, 2)


def test_staged_snapshots_are_made_once_for_a_batch(spark):
    fx = Fixtures(spark, SF)
    fx.keep("stg_metrics")
    plan = fx.sql(Q._METRIC_BATCH)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert fx.sql(Q._METRIC_BATCH).count() == Fixtures(spark, SF).sql(Q._METRIC_BATCH).count()
    assert fx["fx_snapshots"].agg(F.count("*")).first()[0] > 0


def test_a_batch_leaves_its_tables_alone_on_disk(spark):
    """What the steps stored for themselves is empty, what they shuffled is gone with them."""
    fx = Fixtures(spark, SF)
    root = shared_root(spark)
    before = set(os.listdir(root.removeprefix("file:")))
    with scratch():
        report = ST.store_batch(Q._batch(fx), Q._store(fx, {}), Q.GATE_AS_OF, 1)
    made = [x for x in set(os.listdir(root.removeprefix("file:"))) - before if not x.startswith("store-")]
    assert made and not [x for x in made if spark.read.parquet(f"{root}/{x}").count()]
    assert sum(r.n for r in report.collect()) > 0


def test_a_block_can_leave_a_table_to_the_one_around(spark):
    with scratch():
        with scratch() as keep:
            with scratch() as keep_inside:
                inner, left = materialize(spark.range(5), "inner"), keep(keep_inside(materialize(spark.range(7), "left")))
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert (spark.read.parquet(path).count(), left.count()) == (0, 7)
        path = left.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(path).count() == 0


def test_ids_in_hex_are_shuffled_in_half_their_bytes_and_any_text_comes_back(spark, tmp_path):
    texts = [None, "", "0", "00", "ab", "AB", "aB", "abc", "zz", "\x01ab", "\x00", "é", "ab ", "d41d8cd98f00b204e9800998ecf8427e"]
    rows = spark.createDataFrame([(t, t, i) for i, t in enumerate(texts)], "k string, v string, _ord int")
    packed = rows.select(K._pack(F.col("k")).alias("p"), "k").collect()
    assert [len(r.p) for r in packed if r.k and len(r.k) == 32] == [17] and len({bytes(r.p) for r in packed if r.k is not None}) == len(texts) - 1
    table = KeyedTable(str(tmp_path / "t"), ("k",), ("v",)).create(spark, "k string, v string")
    table.append(rows, 0)
    table.append(rows.where("k > 'a'").withColumn("v", F.concat("v", F.lit("+"))), 1)
    want = sorted(((t, t + "+" if t and t > "a" else t) for t in texts), key=str)
    assert sorted(map(tuple, table.read(spark).collect()), key=str) == want
    table.compact(spark, 2, share=0.0)
    assert sorted(map(tuple, table.read(spark).collect()), key=str) == want
    assert sorted(map(tuple, table.lookup(rows, columns=["k"]).collect())) == sorted((t,) for t in texts if t is not None)


def test_keys_of_a_version_are_counted_where_they_are_stored(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), ("v",)).create(spark, "k string, v int")
    for version, keys in enumerate((["a", "b", None], ["b", "c", "b", "d", None], ["e"])):
        table.append(spark.createDataFrame([(k, 1, i) for i, k in enumerate(keys)], "k string, v int, _ord int"), version)
    assert [(table.size(spark, v), table.repeated(spark, v).first().n) for v in range(3)] == [(2, 0), (3, 1), (1, 0)]
