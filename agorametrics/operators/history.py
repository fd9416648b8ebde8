"""Reads over stored captions, agent runs and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions.text import _strip, is_blank


def brand_context(posts: DataFrame, limit: int = 3) -> DataFrame:
    """The last captions per account as ``- text`` lines, newest first; blank ones among them are
    left out, accounts without any drop out."""
    newest = W.partitionBy("account_id").orderBy(F.desc("published_at"), F.desc("post_id"))
    last = (
        posts.filter(F.col("text_content").isNotNull())
        .withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
        .filter(~is_blank(F.col("text_content")))
    )
    # at most `limit` rows per account
    listed = F.array_sort(F.collect_list(F.struct("rank", _strip(F.col("text_content")).alias("text"))))
    return last.groupBy("account_id").agg(listed.alias("_l")).select(
        "account_id",
        F.array_join(F.transform("_l", lambda r: F.concat(F.lit("- "), r["text"])), "\n").alias("context"))


def recent_runs(runs: DataFrame, limit: int = 20, account_id=None) -> DataFrame:
    """Newest agent runs with the tool calls out of their trace."""
    if account_id is not None:
        runs = runs.filter(F.col("account_id") == account_id)
    newest = runs.orderBy(F.desc("id")).limit(limit)
    trace = F.from_json("reasoning_trace", "tool_calls array<string>")["tool_calls"]
    return newest.withColumn("trace", F.coalesce(trace, F.array().cast("array<string>"))).drop("reasoning_trace")


def attempt_depth(results: DataFrame, attempts: str = "attempts", error_chars: int | None = None) -> DataFrame:
    """One row per attempt of a call; its place in the list is the fallback depth. ``error_chars``
    cuts the error texts; by default they stay whole."""
    keep = [c for c in results.columns if c != attempts]
    rows = results.select(*keep, F.posexplode(attempts).alias("fallback_depth", "_a"))
    text = F.col("_a.error") if error_chars is None else F.substring(F.col("_a.error"), 1, error_chars)
    error = F.when(F.col("_a.error") != "", text)
    return rows.select(
        *keep, F.col("fallback_depth").cast("bigint").alias("fallback_depth"), "_a.provider", "_a.model",
        "_a.status", error.alias("error"))


def recent_llm_calls(calls: DataFrame, limit: int = 5, error_chars: int = 60) -> DataFrame:
    return calls.select(
        "id", "provider", "model", "status", "fallback_depth",
        F.substring("error", 1, error_chars).alias("error"),
    ).orderBy(F.desc("id")).limit(limit)
