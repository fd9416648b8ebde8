"""The pipeline, stage by stage, against brute force on the small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agorametrics.llm import forest, repeats
from agorametrics.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return [{r.doc_id: r for r in d.collect()} for d in out], out


def test_stages_keep_the_columns(steps):
    _, frames = steps
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "encoding"]


def test_toxic_documents_go(spark, steps):
    rows, _ = steps
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows[0]) - set(rows[1])
    toxic = {d for d, t in labels.items() if t}
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone - toxic) <= 0.1 * len(rows[0])


def test_one_of_each_group_stays(steps):
    rows, _ = steps
    ids = sorted(rows[1])
    groups = forest.brute_force([rows[1][i].text for i in ids])
    assert set(rows[2]) == {ids[g] for _, _, g in groups}


def test_repeated_strings_are_cut(steps):
    rows, _ = steps
    assert set(rows[3]) == set(rows[2])
    ids = sorted(rows[2])
    for i, want in zip(ids, repeats.brute_force([rows[2][i].text for i in ids])):
        text = rows[3][i].text
        assert want[0] - want[1] <= len(text.encode()) <= want[0] - want[1] + 6 * want[2]
        assert rows[3][i].n_chars == len(text) if want[1] else text == rows[2][i].text


def test_contaminated_documents_go(spark, steps):
    from test_text_operators import brute_hits

    rows, _ = steps
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    ids = sorted(rows[3])
    hits = brute_hits([rows[3][i].text for i in ids], items, 10)
    assert set(rows[4]) == {i for i, h in zip(ids, hits) if not h[1]} != set(rows[3])


def test_ids_decode_to_the_text(steps):
    from test_text_operators import own_encoding

    rows, _ = steps
    own = own_encoding()
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r.intact and r.n_tokens == len(r.ids) and r.ids == own.encode_ordinary(rows[4][i].text)


def test_odd_tables_go_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, score double"
    odd = [(None, None, None, None, None, "k", 1.0), (1, "", "en", "s", 0, None, None), (1, "", "en", "s", 0, None, None),
           (2, "word " * 30000, "en", "s", 150000, "x", 0.5), (2, "other text", None, "s", 10, "x", 0.5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert docs.where(~F.col("intact")).count() == 0
        assert docs.count() == (4 if rows else 0)
