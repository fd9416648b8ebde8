"""What must not depend on how a table is stored, nor grow in one task with it."""

from pyspark.sql import functions as F

from agorametrics import vocab
from agorametrics.functions import text as X
from agorametrics.operators import ingest as I
from agorametrics.operators import language as L
from agorametrics.operators import sentiment as S
from agorametrics.operators import topics as TP
from agorametrics.plans import catalog
from agorametrics.plans import ingest_queries as Q
from agorametrics.plans.fixtures import Fixtures
from agorametrics.session import configure, shared_dir
from agorametrics.sources import csv_export as C
from agorametrics.sources import layout as LY
from agorametrics.sources.keyed import KeyedTable

SF = "/root/testdata/sf0.001"


def test_streams_read_a_table_that_is_a_folder_of_files(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["stream_score_comments"](spark, str(tmp_path))
    want = S.score_sentiment(documents.select(F.col("doc_id").alias("comment_id"), F.col("text").alias("text_content")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_filters_of_files_are_not_made_in_one_task(spark, monkeypatch):
    frame, plans = type(spark.range(1)), []
    plain = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda self, n: plans.append(self._jdf.queryExecution().toString()) or plain(self, n))
    table = KeyedTable(shared_dir(spark, "keyed"), ("id",), (), rows=100).create(spark, "id long")
    table.append(spark.range(500).withColumn("_ord", F.lit(0)), 0)
    assert len(plans) == 3 and not any("FlatMapGroupsInArrow" in p for p in plans)
    assert table.lookup(spark.range(490, 510)).count() == 10


def test_files_whose_lines_are_records_are_read_once(spark, tmp_path):
    rows = [f'"Title ""a"", {i}",{i}' for i in range(500)]
    (tmp_path / "plain.csv").write_text("\n".join(["name,n", *rows]) + "\n")
    (tmp_path / "broken.csv").write_text("\n".join(["name,n", *[f'"two\nlines",{i}' for i in range(500, 700)], *rows[:5]]) + "\n")

    def read(path):
        raw, = C.read_export(spark, str(path))
        return raw, sorted((int(r.n), r.name) for r in raw.collect())

    raw, got = read(tmp_path / "plain.csv")
    assert got == [(i, f'Title "a", {i}') for i in range(500)]
    text = raw._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1 and "collect_list" not in text and "RLike" not in text
    both = got + [(i, "two\nlines") for i in range(500, 700)] + got[:5]
    assert read(tmp_path)[1] == sorted(both)


def test_exports_have_as_many_files_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(Q, "EXPORT_ROWS", 150)
    mapped = Q._export(Fixtures(spark, SF))
    places = mapped.select("_place.file").distinct().count()
    assert places > 4 and mapped.count() == spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 21 <> 0").count()


def test_texts_are_scored_without_a_table_of_their_trigrams(spark):
    texts = spark.range(50).selectExpr("id", "if(id % 2 = 0, 'the ship and the sea', 'le bateau et la mer') as t", "if(id % 2 = 0, 'en', 'fr') as lang")
    found = L.train(L.gram_counts(texts, "lang", "t")).scores(texts, "id", "t")
    aggregated = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [id#" in x]
    assert len(aggregated) == 1
    assert {(r.id, r.n_grams, r.s0 > r.s1) for r in found.collect()} == {(i, 16 if i % 2 == 0 else 15, i % 2 == 0) for i in range(50)}


def test_topics_are_fitted_to_stored_counts(table):
    rows = [(i, "ship sea harbour boat" if i % 2 else "cake sugar flour oven") for i in range(40)]
    assigned, keywords = TP.fit_topics(table(rows, "comment_id long, text_content string"), k=2, max_iter=10)
    plan = assigned._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace" not in plan and "udf" not in plan
    assert assigned.count() == 40 and keywords.count() == 2


def test_a_task_holds_a_bounded_share_of_short_rows(spark):
    fx = Fixtures(spark, SF)
    plan = fx["fx_snapshots"]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 600)" in plan
    read = spark.conf.get("spark.sql.files.maxPartitionBytes")
    configure(spark)  # long texts: the session's own sizes again
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert (read, own != read) == ("8m", True)
    assert configure(spark).conf.get("spark.sql.files.maxPartitionBytes") == own


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(LY, "BUCKET_ROWS", 300)
    dealt, plain = [], LY.write_bucketed
    monkeypatch.setattr(LY, "write_bucketed", lambda df, path, name, keys, n: dealt.append(n) or plain(df, path, name, keys, n))
    got = catalog.QUERIES["bucketed_snapshot_join"](spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_shipdate").distinct().count()
    assert dealt == [-(-n // 300)] * 2 and dealt[0] > 8
    assert got.count() == catalog.QUERIES["latest_snapshot_join"](spark, SF).count()


def test_stored_keys_leave_before_rows_are_compared(table):
    schema = "post_id long, captured_at long, likes long, _ord long"
    batch, target = table([(1, 1, 5, 2), (2, 1, 7, 1), (2, 1, 8, 0)], schema), table([(1, 1, 3, 0)], schema)
    new = I.insert_new(target, batch, ["post_id", "captured_at"], "_ord")
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftAnti") and [tuple(r) for r in new.collect()] == [(2, 1, 8)]


def test_emoji_are_counted_among_late_characters_only(spark):
    rows = [("❤ great ✨✨ 漢字 é", 3, 0), ("plain text", 0, 0), ("😡😡👎 \U0001f9ff ✌", 0, 3), ("", 0, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, up int, down int")
    up, down = (X.count_emoji(F.col("t"), m) for m in (vocab.EMOJI_POSITIVE, vocab.EMOJI_NEGATIVE))
    assert [(r.a, r.b) for r in df.select(up.alias("a"), down.alias("b")).collect()] == [r[1:] for r in rows]


def test_words_of_topics_are_counted_once(table):
    rows = [(i, i % 2, i % 3, f"harbour food{i % 4} photo{i}") for i in range(60)]
    assigned = table(rows, "comment_id long, account_id long, cluster_id long, text_content string")
    found = TP.topic_keywords(assigned, top=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # texts are cleaned and cut where the counts are stored
    kept = []
    lazy = TP.topic_keywords(assigned, top=2, keep=lambda df, name: kept.append(name) or df)
    assert kept == ["topic-word-counts"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, lazy.collect()))


def test_links_of_topics_count_no_words(spark, tmp_path, monkeypatch):
    from agorametrics.plans import catalog, text_queries

    stored = []
    real = text_queries.materialize
    monkeypatch.setattr(text_queries, "materialize", lambda df, name: stored.append(name) or real(df, name))
    catalog.QUERIES["discover_topic_links"](spark, "/root/testdata/sf0.001")
    assert stored == ["topic-input"]
