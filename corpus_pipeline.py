"""From documents to token ids: the stages of a corpus, each written as Parquet and read again.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one the ids. Every
stage works on all that the one before kept, and learns or counts on its own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametrics.llm import bpe, decontaminate, forest, repeats, samples, toxicity
from agorametrics.llm.common import fresh, stored, table
from agorametrics.session import configure


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.3 or more) go."""
    sample = stored(samples.labelled(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, toxicity.SAMPLE), "toxic-sample")
    score, spans = fresh(docs, "score", "offending")
    return toxicity.score(docs, toxicity.fit(sample), out=score, spans_out=spans).where(F.col(score) < 0.3).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return forest.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that stand elsewhere too are cut out; every document stays."""
    d, k, key, spans, kept = fresh(docs, "_d", "_k", "_key", "_spans", "_kept")
    found = repeats.Repeats(docs).spans.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spans").alias(spans))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left")
    out = repeats.cut(joined, spans=spans, out=kept, characters=True)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.col(kept).cast("string"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter item, go."""
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = decontaminate.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text's bytes again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = docs.select("doc_id", "lang", "source", "text")
    both = bpe.encode(own, path, pattern, decoded="decoded")
    intact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

# Two stages are a fitted model and graph components: no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
