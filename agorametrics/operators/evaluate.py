"""Classifier evaluation tables, class weights, stratified split, and the Spark ML classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.functions.metric import round_dp
from agorametrics.operators.ordered import rank_by_hash
from agorametrics.vocab import SENTIMENTS


def confusion_matrix(pairs: DataFrame, labels=SENTIMENTS, truth: str = "y_true",
                     pred: str = "y_pred") -> DataFrame:
    """Counts for every (true, predicted) pair of labels, zeros included. One row of conditional
    counts, unfolded; labels outside the set are ignored."""
    cells = {(t, p): f"_c{i}_{j}" for i, t in enumerate(labels) for j, p in enumerate(labels)}
    counts = pairs.agg(*[
        F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(name)
        for (t, p), name in cells.items()
    ])
    rows = [F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"),
                     F.col(name).alias("n")) for (t, p), name in cells.items()]
    return counts.select(F.inline(F.array(*rows)))


def _label_tallies(label: str, i: int, truth: str, pred: str) -> list[Column]:
    # a missing prediction counts as a wrong one
    is_true = F.coalesce(F.col(truth) == label, F.lit(False))
    is_pred = F.coalesce(F.col(pred) == label, F.lit(False))
    return [
        F.count_if(is_true & is_pred).alias(f"_tp{i}"),
        F.count_if(~is_true & is_pred).alias(f"_fp{i}"),
        F.count_if(is_true & ~is_pred).alias(f"_fn{i}"),
    ]


def _class_rows(df: DataFrame, keys, labels, truth, pred) -> DataFrame:
    """Rounded precision, recall and F1 per key and label from one aggregation."""
    tallies = [c for i, label in enumerate(labels) for c in _label_tallies(label, i, truth, pred)]
    counts = df.groupBy(*keys).agg(
        *tallies, F.count_if(F.col(truth) == F.col(pred)).alias("_hits"),
        F.count(F.lit(1)).alias("_rows"))
    rows = [F.struct(F.lit(label).alias("label"), F.col(f"_tp{i}").alias("tp"),
                     F.col(f"_fp{i}").alias("fp"), F.col(f"_fn{i}").alias("fn"))
            for i, label in enumerate(labels)]
    flat = counts.select(*keys, "_hits", "_rows", F.inline(F.array(*rows)))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = flat.withColumns({"_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn)})
    rated = rated.withColumn("_f", ratio(2.0 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    return rated.select(
        *keys, "label", round_dp("_p", 4).alias("precision"),
        round_dp("_r", 4).alias("recall"), round_dp("_f", 4).alias("f1"),
        (tp + fn).alias("support"), "_hits", "_rows")


def per_class_metrics(pairs: DataFrame, labels=SENTIMENTS, truth: str = "y_true",
                      pred: str = "y_pred") -> DataFrame:
    return _class_rows(pairs, [], labels, truth, pred).drop("_hits", "_rows")


def macro_f1_accuracy(pairs: DataFrame, keys=(), labels=SENTIMENTS, truth: str = "y_true",
                      pred: str = "y_pred") -> DataFrame:
    """Mean of the rounded class F1, share of hits, and support; per key if given."""
    keys = list(keys)
    rows = _class_rows(pairs, keys, labels, truth, pred)
    # rounded F1 as whole ten-thousandths: the sum does not depend on the order
    agg = rows.groupBy(*keys).agg(
        F.sum(F.rint(F.col("f1") * 10000.0).cast("bigint")).alias("_f"),
        F.max("_hits").alias("_h"), F.max("_rows").alias("support"))
    n = F.col("support")
    raw = agg.withColumns({"_m": F.col("_f") / 10000.0 / len(labels),
                           "_a": F.when(n > 0, F.col("_h") / n).otherwise(0.0)})
    return raw.select(*keys, round_dp("_m", 4).alias("macro_f1"),
                      round_dp("_a", 4).alias("accuracy"), "support")


def per_language_f1(pairs: DataFrame, language: str = "language", **names) -> DataFrame:
    return macro_f1_accuracy(pairs, [language], **names)


def eval_summary(pairs: DataFrame, labels=SENTIMENTS, truth: str = "y_true",
                 pred: str = "y_pred") -> DataFrame:
    """Everything as (section, label, other, value) rows, all from the one confusion table.

    Truths and predictions outside the label set still count as misses, so they are kept as
    ``None`` cells of that table.
    """
    inside = lambda c: F.when(F.col(c).isin(*labels), F.col(c))
    pairs = pairs.select(inside(truth).alias("t"), inside(pred).alias("p"),
                         F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).alias("hit"))
    counts = pairs.agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("hit").alias("_hits"),
        *[c for i, label in enumerate(labels) for c in _label_tallies(label, i, "t", "p")],
        *[F.count_if((F.col("t") == a) & (F.col("p") == b)).alias(f"_c{i}_{j}")
          for i, a in enumerate(labels) for j, b in enumerate(labels)],
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    out = counts
    for i, _ in enumerate(labels):
        tp, fp, fn = F.col(f"_tp{i}"), F.col(f"_fp{i}"), F.col(f"_fn{i}")
        out = out.withColumns({f"_p{i}": ratio(tp, tp + fp), f"_r{i}": ratio(tp, tp + fn)})
        p, r = F.col(f"_p{i}"), F.col(f"_r{i}")
        out = out.withColumn(f"_f{i}", ratio(2.0 * p * r, p + r))
        out = out.withColumns({n: round_dp(n, 4) for n in (f"_p{i}", f"_r{i}", f"_f{i}")})
    total = F.lit(0)
    for i, _ in enumerate(labels):
        total = total + F.rint(F.col(f"_f{i}") * 10000.0).cast("bigint")
    out = out.withColumns({"_macro": total / 10000.0 / len(labels),
                           "_acc": ratio(F.col("_hits"), F.col("_rows"))})
    out = out.withColumns({n: round_dp(n, 4) for n in ("_macro", "_acc")})

    def row(section, label, other, value) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(label).cast("string").alias("label"),
                        F.lit(other).cast("string").alias("other"),
                        F.col(value).cast("double").alias("value")) if isinstance(value, str) else (
            F.struct(F.lit(section).alias("section"), F.lit(label).cast("string").alias("label"),
                     F.lit(other).cast("string").alias("other"), value.cast("double").alias("value")))

    rows = [row("accuracy", None, None, "_acc"), row("macro_f1", None, None, "_macro")]
    for i, label in enumerate(labels):
        rows += [row("precision", label, None, f"_p{i}"), row("recall", label, None, f"_r{i}"),
                 row("f1", label, None, f"_f{i}"),
                 row("support", label, None, F.col(f"_tp{i}") + F.col(f"_fn{i}"))]
        rows += [row("confusion", label, b, f"_c{i}_{j}") for j, b in enumerate(labels)]
    return out.select(F.inline(F.array(*rows)))


def class_weights(df: DataFrame, label: str = "label", classes=SENTIMENTS) -> DataFrame:
    """total / (present classes * count) per class; an absent class weighs 1."""
    counts = df.agg(*[F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(classes)])
    total = present = F.lit(0)
    for i, _ in enumerate(classes):
        total = total + F.col(f"_n{i}")
        present = present + F.when(F.col(f"_n{i}") > 0, 1).otherwise(0)
    rows = [F.struct(F.lit(c).alias("label"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(classes)]
    flat = counts.select(total.alias("_t"), present.alias("_k"), F.inline(F.array(*rows)))
    raw = flat.withColumn("_w", F.when(F.col("n") > 0, F.col("_t") / (F.col("_k") * F.col("n")))
                          .otherwise(1.0))
    return raw.select("label", "n", round_dp("_w", 4).alias("weight"))


def stratified_split(rows: DataFrame, label: str, row_id: str, ratios=(0.7, 0.1, 0.2),
                     seed: int = 42) -> DataFrame:
    """Add ``split`` (train, val, test): each label keeps its proportions, counts are rounded
    down for train and val. Rows are shuffled by a seeded hash of their id, so the same input and
    seed give the same split on any partitioning."""
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"the shares of the splits add up to {sum(ratios)}, not to 1")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    ranked = rank_by_hash(rows.withColumn("_digest", digest), [label], "_digest", "_rank", "_size")
    n_train = F.floor(F.col("_size") * F.lit(float(ratios[0])))
    n_val = F.floor(F.col("_size") * F.lit(float(ratios[1])))
    split = (
        F.when(F.col("_rank") <= n_train, "train")
        .when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    )
    return ranked.select(*rows.columns, split.alias("split"))


def train_sentiment(rows: DataFrame, text: str = "text_content", label: str = "label",
                    row_id: str = "comment_id", seed: int = 42, features: int = 1 << 16,
                    max_iter: int = 20):
    """Fit a weighted logistic regression on the train split.

    Returns the fitted pipeline model and the test split with ``y_true`` and ``y_pred``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    split = stratified_split(rows, label, row_id, seed=seed)
    train = split.filter(F.col("split") == "train")
    weights = class_weights(train, label).select(F.col("label").alias(label), "weight")
    code = F.lit(None).cast("double")
    for i, name in enumerate(SENTIMENTS):
        code = F.when(F.col(label) == name, float(i)).otherwise(code)
    # three rows of weights
    weighted = train.join(F.broadcast(weights), label).withColumn("_code", code)
    model = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_code", weightCol="weight",
                           predictionCol="_pred", maxIter=max_iter, regParam=0.01,
                           family="multinomial"),
    ]).fit(weighted)
    return model, predict(model, split.filter(F.col("split") == "test")).withColumnRenamed(label, "y_true")


def predict(model, rows: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SENTIMENTS])
    scored = model.transform(rows)
    return scored.select(*rows.columns, F.get(names, F.col("_pred").cast("int")).alias("y_pred"))


def ml_backend(model, name: str = "spark-ml-logreg", version: str = "1.0", text: str = "text_content"):
    """The fitted classifier as a sentiment backend."""
    from pyspark.ml.functions import vector_to_array

    from agorametrics.operators.sentiment import Backend

    def apply(df: DataFrame, column: str) -> DataFrame:
        given = df.withColumn("_kept", F.col(text)) if text in df.columns else df
        scored = model.transform(given.withColumn(text, F.col(column)))
        names = F.array(*[F.lit(s) for s in SENTIMENTS])
        out = scored.withColumns({
            "sentiment": F.get(names, F.col("_pred").cast("int")),
            "sentiment_score": round_dp(F.array_max(vector_to_array("probability")), 4),
        })
        if text in df.columns:
            out = out.withColumn(text, F.col("_kept"))
        return out.select(*df.columns, "sentiment", "sentiment_score")

    return Backend(name, version, apply)
