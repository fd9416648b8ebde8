"""Naive Bayes learnt from labelled texts: a base language detector over letter trigrams, a sentiment classifier over words.

Counts are a table (label, gram, n) that batches add to; weights are made of it, one row per trigram
with a column per label, as whole millionths of a logarithm, so that sums are exact in any order. A text's
trigrams are counted before they meet the weights. Probabilities are calibrated: trigrams of a text are no
independent witnesses, so scores count for no more than ``reach`` of them, which is chosen by the log loss of
texts the counts haven't seen.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.functions.metric import round_dp
from agorametrics.operators.sentiment import Backend

UNIT = 1_000_000
REACHES = (1, 2, 5, 10, 20, 50, 100, 1_000)


def _words(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))


def _grams(word: Column) -> Column:
    """Trigrams of a word with a blank on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(padded, i, F.lit(3))))


def _parts(counted: DataFrame, unit: str, *keys: str) -> DataFrame:
    """keys, gram, n: trigrams of counted words, or the words themselves."""
    gram = _grams(F.col("word")) if unit == "trigram" else F.col("word")
    return counted.select(*keys, "n", gram.alias("gram")).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def gram_counts(texts: DataFrame, label: str, text: str = "text_content", unit: str = "trigram") -> DataFrame:
    """label, gram, n of labelled texts; words are counted first, so a common one is cut once. With ``unit`` "word" a gram
    is a word."""
    words = texts.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), _words(F.col(text)).alias("word"))
    counted = words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    return _parts(counted, unit, "label")


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The counts of several batches together."""
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out.groupBy("label", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Detector:
    """``labels`` in order, the logarithm of a trigram nobody has seen for each, ``weights`` with a column per label."""

    labels: tuple[str, ...]
    unseen: tuple[int, ...]
    weights: DataFrame
    reach: int = REACHES[-1]
    unit: str = "trigram"

    def scores(self, texts: DataFrame, row_id: str, text: str = "text_content") -> DataFrame:
        """row_id, n_grams and the score of each label (``s0``, ``s1``, ...) of texts that have a letter."""
        words = texts.select(row_id, _words(F.col(text)).alias("word"))
        if self.unit == "trigram":
            # an alphabet bounds the trigrams: they go to the texts, and a text's sums are begun where it is read
            grams, weights = words.select(row_id, F.lit(1).cast("long").alias("n"), _grams(F.col("word")).alias("gram")), F.broadcast(self.weights)
        else:
            grams, weights = _parts(words.groupBy(row_id, "word").agg(F.count(F.lit(1)).alias("n")), self.unit, row_id), self.weights
        met = grams.join(weights, "gram", "left")
        sums = [F.sum(F.col("n") * F.coalesce(f"w{i}", F.lit(w))).alias(f"s{i}") for i, w in enumerate(self.unseen)]
        return met.groupBy(row_id).agg(F.sum("n").alias("n_grams"), *sums)

    def detect(self, texts: DataFrame, row_id: str, text: str = "text_content") -> DataFrame:
        """row_id, n_grams, base_language, base_score, base_confidence; equal scores go to the label that comes first."""
        found = self.scores(texts, row_id, text)
        best = F.greatest(*self._scores())
        name = F.lit(None).cast("string")
        for i in reversed(range(len(self.labels))):
            name = F.when(F.col(f"s{i}") == best, self.labels[i]).otherwise(name)
        return found.select(row_id, "n_grams", name.alias("base_language"), best.alias("base_score"), self.probability(best, self.reach).alias("base_confidence"))

    def _scores(self) -> list[Column]:
        # greatest takes two columns at least
        return [F.col(f"s{i}") for i in range(len(self.labels))] * (2 if len(self.labels) == 1 else 1)

    def probability(self, score: Column, reach: int) -> Column:
        """How likely a label of this score is, when ``reach`` trigrams count in full."""
        scale = F.least(F.lit(1.0), F.lit(float(reach)) / F.col("n_grams")) / UNIT
        best = F.greatest(*self._scores())
        total = sum((F.exp((F.col(f"s{i}") - best) * scale) for i in range(len(self.labels))), F.lit(0.0))
        return F.exp((score - best) * scale) / total


def train(counts: DataFrame, unit: str = "trigram") -> Detector:
    """Weights of a table of counts, one added to each. A row per label comes to the driver."""
    sizes = counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy("label").collect()
    kinds = counts.agg(F.count_distinct("gram").alias("n")).first().n
    labels = tuple(r.label for r in sizes)
    wide = counts.groupBy("gram").agg(*[F.sum(F.when(F.col("label") == name, F.col("n"))).alias(f"n{i}") for i, name in enumerate(labels)])

    def weight(n: Column, size: int) -> Column:
        return F.round(F.log((F.coalesce(n, F.lit(0)) + 1) / F.lit(float(size + kinds))) * UNIT).cast("long")

    weights = wide.select("gram", *[weight(F.col(f"n{i}"), r.n).alias(f"w{i}") for i, r in enumerate(sizes)])
    unseen = counts.sparkSession.range(1).select(*[weight(F.lit(0), r.n) for r in sizes]).first()
    return Detector(labels, tuple(unseen), weights, unit=unit)


def calibrate(detector: Detector, texts: DataFrame, row_id: str, label: str, text: str = "text_content") -> Detector:
    """The detector with the reach of the least log loss on labelled texts that its counts haven't seen."""
    found = detector.scores(texts, row_id, text).join(texts.select(row_id, F.col(label).alias("_true")), row_id)
    score = F.lit(None).cast("long")
    for i, name in enumerate(detector.labels):
        score = F.when(F.col("_true") == name, F.col(f"s{i}")).otherwise(score)
    losses = found.filter(F.col("_true").isin(*detector.labels)).agg(
        *[F.avg(-F.log(F.greatest(detector.probability(score, r), F.lit(1e-12)))).alias(str(r)) for r in REACHES]).first()
    if losses[0] is None:
        return detector
    best = min(REACHES, key=lambda r: (losses[str(r)], r))
    return replace(detector, reach=best)


def classifier(detector: Detector, row_id: str, name: str = "naive-bayes", version: str = "1.0") -> Backend:
    """Counts of labelled comments as a sentiment backend; a text without a known part is neutral at 0.5."""

    def apply(df: DataFrame, text: str) -> DataFrame:
        told = detector.detect(df, row_id, text).select(row_id, "base_language", "base_confidence")
        joined = df.join(told, row_id, "left")
        return joined.select(
            *[df[c] if c != row_id else F.col(row_id) for c in df.columns], F.coalesce("base_language", F.lit("neutral")).alias("sentiment"),
            round_dp(F.coalesce("base_confidence", F.lit(0.5)), 4).alias("sentiment_score"))

    return Backend(name, version, apply)
