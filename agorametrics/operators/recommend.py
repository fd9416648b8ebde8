"""Posting recommendations with their evidence: content types, hashtags, times.

A post contributes observations ``(kind, key, er)``: its content type, each of its hashtags, its
local weekday and hour. They are summed per account, kind and key in one aggregation, which all
kinds share; everything after it works on those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics import vocab
from agorametrics.functions import metric as M
from agorametrics.functions import timeparse as T
from agorametrics.functions.metric import cents, round_dp
from agorametrics.functions.text import extract_hashtag_names
from agorametrics.operators.kpi import dominant_basis
from agorametrics.operators.ordered import rank_in_slices
from agorametrics.session import materialize

MIN_N = 2
SHRINKAGE = 5.0
# kind -> (smallest sample that is shown, how many are shown)
RULES = {
    "content_type": (MIN_N, None),
    "hashtags": (MIN_N, 10),
    "best_time": (MIN_N, 5),
    "best_time_day": (1, 7),
    "best_time_hour": (1, 24),
}
_MARGINALS = ("best_time_day", "best_time_hour")


def confidence_for(n: Column) -> Column:
    return F.when(n >= 8, "high").when(n >= 4, "medium").when(n >= 2, "low")


def lift(value: Column, baseline: Column) -> Column:
    """How many times the baseline; null when the baseline is not positive."""
    return round_dp(F.when(baseline > 0, value / baseline), 2)


def shrunk_mean(total: Column, n: Column, baseline: Column, k: float = SHRINKAGE) -> Column:
    """Mean pulled towards the baseline, the more the smaller the sample; not rounded."""
    return (total + F.lit(k) * baseline) / (n + F.lit(k))


def observations(facts: DataFrame, kinds, tz: str = vocab.DISPLAY_TZ) -> DataFrame:
    """One row per observation of a post frame (account_id, er, er_basis, published_at,
    content_type, text_content): ``entry`` is ``kind|key``, one text to group and shuffle by.

    A post whose rate did not resolve keeps its rows, with null. Local time and tags are computed
    once per post, in a projection of their own.
    """
    derived, entries, listed = {}, [_entry("post", F.lit(""))], []
    if "content_type" in kinds:
        name = F.when(F.col("content_type") != "", F.col("content_type"))
        entries.append(_entry("content_type", F.coalesce(name, F.lit("unknown"))))
    if "best_time" in kinds:
        derived["_dow"] = T.local_dow(F.col("published_at"), tz).cast("string")
        derived["_hour"] = F.lpad(T.local_hour(F.col("published_at"), tz).cast("string"), 2, "0")
        entries += [_entry("best_time", F.concat_ws(":", "_dow", "_hour")),
                    _entry("best_time_day", F.col("_dow")), _entry("best_time_hour", F.col("_hour"))]
    if "hashtags" in kinds:
        derived["_tags"] = extract_hashtag_names(F.col("text_content"))
        listed.append(F.transform("_tags", lambda t: _entry("hashtags", t)))
    kept = ["account_id", "er", "er_basis", *(["content_type"] if "content_type" in kinds else [])]
    base = facts.select(*kept, *[c.alias(n) for n, c in derived.items()])
    unfolded = F.concat(F.array(*entries), *listed) if listed else F.array(*entries)
    return base.select("account_id", "er", "er_basis", F.explode(unfolded).alias("entry"))


def _entry(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), key)


def rank_observations(obs: DataFrame, kinds, k: float = SHRINKAGE, rules=None) -> DataFrame:
    """Ranked keys per account and kind, or one row with the reason why there is none.

    The baseline is the mean over the kind's observations, the lift divides the 4-place mean by
    it, ties in the score go to the smaller key. The sums per key are written once, so the posts
    are read once although baselines, reasons and scores all start from them.
    """
    rules = {**RULES, **(rules or {})}
    sums = obs.groupBy("account_id", "entry").agg(
        F.sum(cents(F.col("er"))).alias("s"), F.count("er").alias("n"),
        F.count_if(F.col("er_basis") == "err").alias("n_err"),
        F.count_if(F.col("er_basis") == "erf").alias("n_erf"),
    )
    sums = materialize(sums.select(
        "account_id", F.substring_index("entry", "|", 1).alias("kind"),
        F.expr("substring(entry, instr(entry, '|') + 1)").alias("key"), "s", "n", "n_err", "n_erf",
    ), "observation-sums")
    minimum = F.col("kind")
    min_n = F.lit(None)
    for kind, (least, _) in rules.items():
        min_n = F.when(minimum == kind, least).otherwise(min_n)

    per_kind = sums.groupBy("account_id", "kind").agg(
        F.sum("n").alias("n_total"), F.sum("s").alias("_s"),
        F.count_if(F.col("n") >= min_n).alias("_shown"),
        F.sum("n_err").alias("_err"), F.sum("n_erf").alias("_erf"),
    )
    # every account that has posts gets every kind, also those it has no observation for
    wanted = F.array(*[F.lit(kind) for kind in kinds])
    asked = (
        per_kind.filter(F.col("kind") == "post")
        .select("account_id", dominant_basis(F.col("_err"), F.col("_erf")).alias("er_basis"),
                F.explode(wanted).alias("kind"))
        .join(per_kind.drop("_err", "_erf"), ["account_id", "kind"], "left")
        .fillna(0, ["n_total", "_shown"])
    )
    mean = F.col("_s") / 100.0 / F.col("n_total")
    few = F.col("n_total") < MIN_N
    no_tags = (F.col("kind") == "hashtags") & (F.col("n_total") == 0)
    totals = asked.withColumn("_base", F.when(~few, mean)).select(
        "account_id", "kind", "er_basis", "n_total", "_base",
        round_dp("_base", 4).alias("baseline_er"),
        F.when(no_tags, M.NO_HASHTAGS).when(few, M.INSUFFICIENT_DATA)
        .when(F.col("_base") <= 0, M.NO_ENGAGEMENT_SIGNAL)
        .when(F.col("_shown") == 0, M.INSUFFICIENT_DATA).alias("reason"),
    )
    scored = (
        sums.filter(F.col("n") >= min_n)
        .join(totals.filter(F.col("reason").isNull()), ["account_id", "kind"])
        .withColumn("_mean", F.col("s") / 100.0 / F.col("n"))
        .withColumn("_shrunk", shrunk_mean(F.col("s") / 100.0, F.col("n"), F.col("_base"), k))
        .withColumn("mean_er", round_dp("_mean", 4))
        .withColumn("shrunk_score", round_dp("_shrunk", 4))
    )
    columns = ["account_id", "kind", "er_basis", "rank", "key", "n", "mean_er", "shrunk_score",
               "lift", "confidence", "baseline_er", "n_total", "reason"]
    ranked = _top_by_score(scored, {kind: rules[kind][1] for kind in kinds}).withColumn(
        "lift", lift(F.col("mean_er"), F.col("_base"))
    ).withColumn("confidence", confidence_for(F.col("n")))
    # marginals only accompany the cells; their lack is told by the cells' row
    empty = totals.filter(F.col("reason").isNotNull() & ~F.col("kind").isin(*_MARGINALS))
    nulls = {"rank": "bigint", "key": "string", "n": "bigint", "mean_er": "double",
             "shrunk_score": "double", "lift": "double", "confidence": "string"}
    empty = empty.withColumns({c: F.lit(None).cast(t) for c, t in nulls.items()})
    return ranked.select(*columns).unionByName(empty.select(*columns))


def _top_by_score(scored: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """First keys per account and kind, as many as the kind's limit, or all.

    An account may use any number of hashtags or types. With a limit, each of as many parts as there
    are shuffle partitions first names its own best; limits are literals, so that Spark cuts before it
    sorts. Without one, keys are ranked inside bands of a hundredth of the score.
    """
    order = [F.desc("shrunk_score"), F.asc("key")]
    salt = F.pmod(F.xxhash64("key"), F.lit(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    part = W.partitionBy("account_id", "kind", "_salt").orderBy(*order)
    whole = W.partitionBy("account_id", "kind").orderBy(*order)
    out = None
    for limit in sorted({n for n in limits.values() if n is not None}):
        own = scored.filter(F.col("kind").isin([k for k, n in limits.items() if n == limit]))
        local = own.withColumn("_salt", salt).withColumn("_local", F.row_number().over(part)).filter(F.col("_local") <= limit)
        final = local.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= limit)
        final = final.withColumn("rank", F.col("rank").cast("bigint")).drop("_salt", "_local")
        out = final if out is None else out.unionByName(final)
    open_ = [k for k, n in limits.items() if n is None]
    if open_:
        own = scored.filter(F.col("kind").isin(open_))
        final = rank_in_slices(own, ["account_id", "kind"], -F.floor(F.col("shrunk_score") * 100), order, "rank", "_size").drop("_size")
        out = final if out is None else out.unionByName(final)
    return out


def rank_categories(obs: DataFrame, min_n: int = MIN_N, top_k: int | None = None,
                    k: float = SHRINKAGE) -> DataFrame:
    """Rank any keys: ``obs`` is (account_id, key, er) with 2-place rates."""
    key = F.coalesce(F.col("key").cast("string"), F.lit("unknown"))
    entries = F.array(_entry("post", F.lit("")), _entry("category", key))
    stacked = obs.select("account_id", "er", F.lit("err").alias("er_basis"), F.explode(entries).alias("entry"))
    return rank_observations(stacked, ["category"], k, {"category": (min_n, top_k)}).drop(
        "kind", "er_basis")


def recommend_content_types(facts: DataFrame) -> DataFrame:
    return rank_observations(observations(facts, ["content_type"]), ["content_type"])


def recommend_hashtags(facts: DataFrame, top_k: int = 10) -> DataFrame:
    obs = observations(facts, ["hashtags"])
    return rank_observations(obs, ["hashtags"], rules={"hashtags": (MIN_N, top_k)})


def recommend_best_time(facts: DataFrame, tz: str = vocab.DISPLAY_TZ, top_k: int = 5) -> DataFrame:
    """Best (weekday, hour) cells and both marginals, in local time."""
    kinds = ["best_time", "best_time_day", "best_time_hour"]
    ranked = rank_observations(observations(facts, kinds, tz), kinds,
                               rules={"best_time": (MIN_N, top_k)})
    return with_time_columns(ranked)


def with_time_columns(ranked: DataFrame) -> DataFrame:
    """Weekday, its name and hour out of the key of time kinds."""
    kind, key = F.col("kind"), F.col("key")
    dow = F.when(kind.isin("best_time", "best_time_day"), F.split_part(key, F.lit(":"), F.lit(1)))
    hour = F.when(kind == "best_time", F.split_part(key, F.lit(":"), F.lit(2))).when(
        kind == "best_time_hour", key)
    names = F.array(*[F.lit(d) for d in vocab.DAY_NAMES])
    return ranked.withColumns({
        "day_of_week": dow.cast("bigint"),
        "day": F.get(names, dow.cast("int")),
        "hour": hour.cast("bigint"),
    })


def all_recommendations(facts: DataFrame, tz: str = vocab.DISPLAY_TZ) -> DataFrame:
    """All kinds from one scan and one aggregation."""
    kinds = list(RULES)
    return with_time_columns(rank_observations(observations(facts, kinds, tz), kinds))
