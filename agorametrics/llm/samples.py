"""Bounded samples of labelled documents for the classifiers, and the folds they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorametrics.llm.common import stored


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


BYTES = 128 << 20  # of the texts a fit may read


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, most_bytes: int = BYTES) -> DataFrame:
    """text and y of at most ``most`` labelled documents outside the held-out fold, of ``most_bytes`` at most.

    These are the bounds on what a fit may read: the rows with the smallest hash of their id, up to the
    one that goes beyond the bytes. Labels other than 0 and 1 are left out; of several labels of one document
    the largest counts. Of several rows of one id the text with the smallest hash counts, so a frequent id
    weighs as one document.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # ``most`` rows of two numbers: bounded, whatever the tables hold
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = stored(found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "labelled")
    # sizes of ``most`` rows, added up in the order of the hashes
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = rows.select("doc_id", upto.alias("upto")).where(F.col("upto") <= most_bytes).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id").select("text", "y")
