"""Comment sentiment: scoring, rollups, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics import vocab
from agorametrics.functions import text as X
from agorametrics.functions.metric import round_dp
from agorametrics.operators import posts as P

ALERT_MIN_COMMENTS = 10
ALERT_SIGMA = 2.0


# --- scoring ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class Backend:
    """A classifier: ``apply(df, text)`` adds ``sentiment`` and ``sentiment_score`` for the cleaned
    text in column ``text``."""

    name: str
    version: str
    apply: Callable[[DataFrame, str], DataFrame]


def lexicon_backend() -> Backend:
    """Counts polar words and emoji with native columns. Deterministic; needs no model."""

    def apply(df: DataFrame, text: str) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

        def hits(listed) -> Column:
            found = F.size(F.filter(tokens, lambda w: w.isin(*listed)))
            return found

        def emoji(listed: str) -> Column:
            return X.count_emoji(F.col(text), listed)

        counted = df.select(
            "*", (hits(vocab.POSITIVE_WORDS) + emoji(vocab.EMOJI_POSITIVE)).alias("_up"),
            (hits(vocab.NEGATIVE_WORDS) + emoji(vocab.EMOJI_NEGATIVE)).alias("_down"),
        )
        up, down = F.col("_up"), F.col("_down")
        label = F.when(up > down, "positive").when(up < down, "negative").otherwise("neutral")
        share = F.when(up == down, 0.5).otherwise(F.greatest(up, down) / (up + down))
        return counted.withColumns(
            {"sentiment": label, "sentiment_score": round_dp(share, 4)}
        ).drop("_up", "_down")

    return Backend("lexicon", "lexicon-1.0", apply)


def model_backend(name: str, version: str,
                  load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Backend:
    """Wrap a Python model: ``load`` runs once per task and returns a function from texts to
    (class name, score) pairs. Batches arrive through Arrow."""

    @F.pandas_udf("label string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            answers = model(texts.fillna("").tolist())
            yield pd.DataFrame(answers, columns=["label", "score"])

    def apply(df: DataFrame, text: str) -> DataFrame:
        scored = df.withColumn("_answer", predict(F.col(text)))
        return scored.withColumns({
            "sentiment": X.normalize_model_label(F.col("_answer.label")),
            "sentiment_score": round_dp(F.col("_answer")["score"], 4),
        }).drop("_answer")

    return Backend(name, version, apply)


def score_sentiment(comments: DataFrame, backend: Backend | None = None,
                    specialist: Backend | None = None, text: str = "text_content") -> DataFrame:
    """Label comments: language on the raw text, class on the cleaned one.

    Dialect in Latin letters goes to ``specialist`` when there is one, and is flagged otherwise.
    """
    backend = backend or lexicon_backend()
    raw = F.coalesce(F.col(text), F.lit(""))
    routed = X.with_language(comments, text).withColumns(
        {"_clean": X.preprocess_text(raw), "emoji_polarity": X.emoji_polarity(raw)}
    )
    dialect = F.col("language") == "aeb-latn"

    def label(df: DataFrame, by: Backend) -> DataFrame:
        return by.apply(df, "_clean").withColumns(
            {"model_name": F.lit(by.name), "model_version": F.lit(by.version)})

    if specialist is None:
        out = label(routed, backend).withColumn("needs_arabizi_specialist", dialect)
    else:
        main = label(routed.filter(~dialect), backend)
        other = label(routed.filter(dialect), specialist)
        out = main.unionByName(other).withColumn("needs_arabizi_specialist", F.lit(False))
    return out.drop("_clean")


# --- joins -----------------------------------------------------------------------------------
def unlabeled_comments(comments: DataFrame, analyses: DataFrame, limit: int | None = None) -> DataFrame:
    """Comments without an analysis row; with ``limit``, the lowest ids first."""
    out = comments.join(analyses.select("comment_id"), "comment_id", "left_anti")
    return out if limit is None else out.orderBy("comment_id").limit(limit)


def labeled_rows(comments: DataFrame, analyses: DataFrame, posts: DataFrame, since=None, until=None,
                 keep_unlabeled: bool = False) -> DataFrame:
    """Comments of a window with their account and analysis; unlabeled ones kept on request,
    then without those that have no text."""
    window = P.between(comments, "published_at", since, until)
    if keep_unlabeled:
        window = P.nonblank_text(window)
    owned = window.join(posts.select("post_id", "account_id"), "post_id")
    return owned.join(analyses, "comment_id", "left" if keep_unlabeled else "inner")


# --- rollups ---------------------------------------------------------------------------------
def _label_counts(when: Column | None = None, prefix: str = "") -> list[Column]:
    def matches(label: str) -> Column:
        test = F.col("sentiment") == label
        return test if when is None else when & test

    return [F.count_if(matches(s)).alias(prefix + s) for s in vocab.SENTIMENTS]


def _distribution(counted: DataFrame, keys) -> DataFrame:
    c = {s: F.col(s) for s in vocab.SENTIMENTS}
    total = c["positive"] + c["neutral"] + c["negative"]
    shares = {f"_{s}": F.when(total > 0, c[s] / total * 100.0) for s in vocab.SENTIMENTS}
    raw = counted.withColumns(
        {"total": total, **shares, "_net": F.when(total > 0, (c["positive"] - c["negative"]) / total)})
    return raw.select(
        *keys, "total", *vocab.SENTIMENTS,
        *[round_dp(f"_{s}", 2).alias(f"{s}_pct") for s in vocab.SENTIMENTS],
        round_dp("_net", 4).alias("net_sentiment"),
    )


def sentiment_distribution(rows: DataFrame, keys=("account_id",)) -> DataFrame:
    """Counts, percentages and mean net score per key."""
    labeled = rows.filter(F.col("sentiment").isNotNull())
    return _distribution(labeled.groupBy(*keys).agg(*_label_counts()), list(keys))


def sentiment_by_language(rows: DataFrame, key: str = "account_id") -> DataFrame:
    """The distribution overall (``language`` is ``*``) and per language, in one aggregation."""
    named = rows.filter(F.col("sentiment").isNotNull()).withColumn(
        "_lang", F.coalesce("language", F.lit("unknown")))
    counted = named.groupingSets(
        [[F.col(key)], [F.col(key), F.col("_lang")]], F.col(key), F.col("_lang")
    ).agg(F.grouping("_lang").alias("_all"), *_label_counts())
    counted = counted.withColumn("language", F.when(F.col("_all") == 1, "*").otherwise(F.col("_lang")))
    return _distribution(counted, [key, "language"])


def sentiment_trend(rows: DataFrame, keys=("account_id",)) -> DataFrame:
    """Mean net score per UTC day that has labeled comments."""
    net = X.net_sentiment_score(F.col("sentiment"))
    daily = rows.filter(F.col("sentiment").isNotNull()).groupBy(
        *keys, F.to_date("published_at").alias("day")
    ).agg(F.sum(net).alias("_s"), F.count(F.lit(1)).alias("n"))
    return daily.withColumn("_m", F.col("_s") / F.col("n")).select(
        *keys, "day", "n", round_dp("_m", 4).alias("net_sentiment"))


def sentiment_deltas(rows: DataFrame, as_of, window: str = "30d", keys=("account_id",)) -> DataFrame:
    """Differences of net score and negative percentage against the window before."""
    tagged = P.period_tag(rows.filter(F.col("sentiment").isNotNull()), "published_at", as_of, window)
    counted = tagged.groupBy(*keys).agg(
        *_label_counts(F.col("period") == "cur", "cur_"), *_label_counts(F.col("period") == "prev", "prev_"))
    out = counted
    for side in ("cur", "prev"):
        c = {s: F.col(f"{side}_{s}") for s in vocab.SENTIMENTS}
        total = c["positive"] + c["neutral"] + c["negative"]
        out = out.withColumns({
            f"_{side}_net": F.when(total > 0, (c["positive"] - c["negative"]) / total),
            f"_{side}_neg": F.when(total > 0, c["negative"] / total * 100.0),
        }).withColumns({
            f"{side}_net": round_dp(f"_{side}_net", 4),
            f"{side}_negative_pct": round_dp(f"_{side}_neg", 2),
        })
    diffs = out.withColumns({
        "_dn": F.col("cur_net") - F.col("prev_net"),
        "_dp": F.col("cur_negative_pct") - F.col("prev_negative_pct"),
    })
    return diffs.select(
        *keys, "cur_net", "prev_net", "cur_negative_pct", "prev_negative_pct",
        round_dp("_dn", 4).alias("net_sentiment_delta"),
        round_dp("_dp", 4).alias("negative_pct_delta"),
    )


def negative_alerts(rows: DataFrame, as_of, window: str = "14d", keys=("account_id",)) -> DataFrame:
    """Days whose share of negative comments exceeds the mean of the daily shares by two standard
    deviations, with at least ten comments. Needs two days."""
    return alerts_of(daily_negatives(P.window_filter(rows, "published_at", as_of, window), keys), keys)


def daily_negatives(rows: DataFrame, keys=("account_id",)) -> DataFrame:
    """keys, day, n_comments, n_negative of labeled comments: counts that add up over any parts of the rows."""
    return rows.filter(F.col("sentiment").isNotNull()).groupBy(*keys, F.to_date("published_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n_comments"), F.count_if(F.col("sentiment") == "negative").alias("n_negative"))


def alerts_of(daily: DataFrame, keys=("account_id",)) -> DataFrame:
    """The alerts among the days of ``daily_negatives``."""
    daily = daily.withColumn("_share", F.col("n_negative") / F.col("n_comments"))
    daily = daily.withColumn("negative_share", round_dp("_share", 4))
    days = W.partitionBy(*keys)
    rated = daily.withColumn("_days", F.count(F.lit(1)).over(days)).withColumn(
        "_threshold",
        F.avg("negative_share").over(days) + ALERT_SIGMA * F.stddev_pop("negative_share").over(days))
    flagged = rated.filter(
        (F.col("_days") >= 2) & (F.col("negative_share") > F.col("_threshold"))
        & (F.col("n_comments") >= ALERT_MIN_COMMENTS))
    return flagged.select(*keys, "day", "negative_share", "n_comments")


def recent_negatives(rows: DataFrame, as_of, window: str = "14d", limit: int = 20,
                     keys=("account_id",)) -> DataFrame:
    """Newest negative comments per key; the same instant: the larger comment_id first."""
    negative = P.window_filter(rows, "published_at", as_of, window).filter(
        F.col("sentiment") == "negative")
    newest = W.partitionBy(*keys).orderBy(F.desc("published_at"), F.desc("comment_id"))
    return negative.withColumn("rank", F.row_number().over(newest)).filter(
        F.col("rank") <= limit
    ).select(*keys, F.col("rank").cast("bigint").alias("rank"), "comment_id", "text_content",
             "language", round_dp("sentiment_score", 4).alias("score"), "published_at")


def emoji_polarity_rollup(texts: DataFrame, keys, text: str = "text_content") -> DataFrame:
    """Mean emoji polarity per key; 4-place scores are summed as whole numbers."""
    scored = texts.withColumn("_p", X.emoji_polarity(F.coalesce(F.col(text), F.lit(""))))
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.rint(F.col("_p") * 10000.0).cast("bigint")).alias("_s"))
    return agg.withColumn("_m", F.col("_s") / 10000.0 / F.col("n_texts")).select(
        *keys, "n_texts", round_dp("_m", 4).alias("avg_emoji_polarity"))
