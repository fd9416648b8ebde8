"""Topics: clustering prepared comments, keywords, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agorametrics.functions.metric import INSUFFICIENT_DATA, round_dp
from agorametrics.functions.text import label_from_keywords, net_sentiment_score, preprocess_text
from agorametrics.operators import density
from agorametrics.operators.posts import nonblank_text, window_filter
from agorametrics.session import materialize

MIN_DOCS = 20
MIN_TOPIC_SIZE = 3
TOP_KEYWORDS = 8
OUTLIER = -1
VOCABULARY = 1 << 18


def usable_clusters(assigned: DataFrame, keys=("account_id",), min_docs: int = MIN_DOCS,
                    min_size: int = MIN_TOPIC_SIZE) -> DataFrame:
    """Cluster sizes without the outliers and the too small ones; a key with fewer than
    ``min_docs`` documents gets one row with the reason instead."""
    keys = list(keys)
    sizes = assigned.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    docs = sizes.groupBy(*keys).agg(F.sum("size").alias("n_docs"))
    kept = (
        sizes.filter((F.col("cluster_id") != OUTLIER) & (F.col("size") >= min_size))
        .join(docs.filter(F.col("n_docs") >= min_docs), keys)
        .withColumn("reason", F.lit(None).cast("string"))
    )
    refused = docs.filter(F.col("n_docs") < min_docs).select(
        *keys, F.lit(None).cast("bigint").alias("cluster_id"), F.lit(None).cast("bigint").alias("size"),
        "n_docs", F.lit(INSUFFICIENT_DATA).alias("reason"))
    return kept.select(*keys, "cluster_id", "size", "n_docs", "reason").unionByName(refused)


def topic_rollup(assigned: DataFrame, keywords: DataFrame | None = None, keys=("account_id",),
                 min_docs: int = MIN_DOCS, min_size: int = MIN_TOPIC_SIZE) -> DataFrame:
    """Per key and usable cluster: size, mean net sentiment over labeled comments, how many are
    labeled, and keywords with their label. Unusable clusters drop out; a key with fewer than
    ``min_docs`` documents gets one row with the reason instead."""
    keys = list(keys)
    net = net_sentiment_score(F.col("sentiment"))
    rolled = assigned.groupBy(*keys, "cluster_id").agg(
        F.count(F.lit(1)).alias("comment_count"), F.sum(net).alias("_s"),
        F.count(net).alias("n_labeled"))
    docs = rolled.groupBy(*keys).agg(F.sum("comment_count").alias("_docs"))
    enough = docs.filter(F.col("_docs") >= min_docs)
    refused = docs.filter(F.col("_docs") < min_docs).select(
        *keys, *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster_id", "bigint"), ("comment_count", "bigint"), ("n_labeled", "bigint"), ("avg_sentiment", "double"))],
        F.lit(INSUFFICIENT_DATA).alias("reason"))
    kept = rolled.filter(
        (F.col("cluster_id") != OUTLIER) & (F.col("comment_count") >= min_size)
    ).join(enough, keys)
    raw = kept.withColumn("_m", F.when(F.col("n_labeled") > 0, F.col("_s") / F.col("n_labeled")))
    out = raw.select(*keys, "cluster_id", "comment_count", "n_labeled",
                     round_dp("_m", 4).alias("avg_sentiment"), F.lit(None).cast("string").alias("reason"))
    out = out.unionByName(refused)
    if keywords is None:
        return out
    named = out.join(keywords, [c for c in [*keys, "cluster_id"] if c in keywords.columns], "left")
    return named.withColumn("label", label_from_keywords(
        F.coalesce("keywords", F.array().cast("array<string>"))))


def topic_comment_link(analyses: DataFrame, assigned: DataFrame, usable: DataFrame) -> DataFrame:
    """Analyses with the number of the usable cluster their comment fell in; others keep the
    topic they had."""
    kept = usable.filter(F.col("cluster_id").isNotNull()).select("account_id", "cluster_id")
    links = assigned.join(kept, ["account_id", "cluster_id"], "left_semi").select(
        "comment_id", F.col("cluster_id").cast("bigint").alias("_new"))
    had = F.col("topic_id") if "topic_id" in analyses.columns else F.lit(None).cast("bigint")
    columns = [c for c in analyses.columns if c != "topic_id"]
    return analyses.join(links, "comment_id", "left").select(
        *columns, F.coalesce("_new", had).alias("topic_id"))


def list_topics(topics: DataFrame, limit: int = 50, keys=("account_id",)) -> DataFrame:
    """The ``limit`` largest stored topics per key; rows without a topic are left out."""
    order = [F.col("comment_count").desc_nulls_last(), F.col("cluster_id").asc()]
    topics = topics.filter(F.col("cluster_id").isNotNull())
    ranked = topics.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit).withColumn(
        "rank", F.col("rank").cast("bigint"))


def topic_keywords(assigned: DataFrame, keys=("account_id",), text: str = "text_content", top: int = TOP_KEYWORDS,
                   keep=materialize) -> DataFrame:
    """The ``top`` words of every cluster of a key, by class-based TF-IDF: a word's share of the
    cluster's words, times ln(1 + mean words of a cluster / uses of the word in all clusters of the
    key). Outliers have no keywords. Ties go by the word. ``keep`` is called on the counts, which several steps read."""
    keys = list(keys)
    words = F.explode(F.regexp_extract_all(F.lower(preprocess_text(F.col(text))), F.lit(r"\p{L}[\p{L}\p{N}]+"), 0)).alias("word")
    used = assigned.filter(F.col("cluster_id") != OUTLIER).select(*keys, "cluster_id", words)
    # counted before the shuffle; everything after works on the counts, without cleaning the texts again
    counts = keep(used.groupBy(*keys, "cluster_id", "word").agg(F.count(F.lit(1)).alias("n")), "topic-word-counts")
    sizes = counts.groupBy(*keys, "cluster_id").agg(F.sum("n").alias("size"))
    means = sizes.groupBy(*keys).agg((F.sum("size") / F.count(F.lit(1))).alias("mean"))
    everywhere = counts.groupBy(*keys, "word").agg(F.sum("n").alias("uses"))
    scored = counts.join(everywhere, [*keys, "word"]).join(sizes, [*keys, "cluster_id"]).join(means, keys)
    scored = scored.withColumn("score", F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("uses")))
    ranked = scored.withColumn("rank", F.row_number().over(
        W.partitionBy(*keys, "cluster_id").orderBy(F.desc("score"), F.asc("word")))).filter(F.col("rank") <= top)
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))  # ``top`` words
    return ranked.groupBy(*keys, "cluster_id").agg(F.transform(listed, lambda w: w["word"]).alias("keywords"))


def discover_topics(comments: DataFrame, as_of, window: str, cluster, keep=lambda df, name: df,
                    min_docs: int = MIN_DOCS, min_size: int = MIN_TOPIC_SIZE) -> tuple[DataFrame, DataFrame]:
    """Topics of the window's comments per account, and the comments with their topic.

    Blank texts are left out, comments without a sentiment stay. ``cluster`` gives comments a
    ``cluster_id``, such as the first result of ``fit_topics``. Accounts with too few texts get one row
    with reason and number. ``keep`` is called on the clustered comments (``topic-input``) and on their words' counts
    (``topic-word-counts``, which only the topics need): several steps read either.
    """
    inside = nonblank_text(window_filter(comments, "published_at", as_of, window))
    assigned = keep(cluster(inside), "topic-input")
    usable = usable_clusters(assigned, min_docs=min_docs, min_size=min_size)
    rolled = topic_rollup(assigned, topic_keywords(assigned, keep=keep), min_docs=min_docs, min_size=min_size)
    sizes = usable.select("account_id", "cluster_id", "n_docs").withColumnsRenamed({"account_id": "_a", "cluster_id": "_c"})
    topics = rolled.join(sizes, (F.col("account_id") == F.col("_a")) & F.col("cluster_id").eqNullSafe(F.col("_c"))).drop("_a", "_c")
    linked = assigned.select("comment_id", "account_id")
    return topics, topic_comment_link(linked, assigned.select("comment_id", "account_id", "cluster_id"), usable)


def density_topics(comments: DataFrame, vectors: DataFrame, min_size: int = MIN_TOPIC_SIZE, row_id: str = "comment_id", vector: str = "vector", **options) -> DataFrame:
    """Comments with ``cluster_id`` by the density of their vectors (``row_id``, ``vector``): a cluster is named by its smallest
    id; outliers, and comments without a vector, are -1."""
    own = vectors.join(comments.select(row_id), row_id, "left_semi").filter(F.col(vector).isNotNull())
    found = density.clusters(own, min_size, row_id=row_id, vector=vector, **options)
    placed = comments.join(found.withColumnRenamed("id", "_id"), comments[row_id] == F.col("_id"), "left")
    return placed.select(*[comments[c] for c in comments.columns], F.coalesce("cluster_id", F.lit(OUTLIER)).cast("bigint").alias("cluster_id"))


def fit_topics(comments: DataFrame, k: int = 10, text: str = "text_content", seed: int = 42,
               min_weight: float = 0.3, vocabulary: int = VOCABULARY, max_iter: int = 10):
    """Cluster comments by their words: one topic model over all accounts.

    A document belongs to its heaviest topic; below ``min_weight`` it is an outlier. Returns the
    comments with ``cluster_id``, and ``cluster_id, keywords``. Texts are cleaned and cut once; every iteration reads the stored
    counts of all comments.
    ``vocabulary`` bounds the words the model knows, the most frequent ones (its tables grow with k times
    the words, and they pass through the driver); rarer ones tell no topic apart. ``density_topics`` has no such bound. Comments of the same seed and order give the same topics.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    prepared = comments.withColumn("_clean", preprocess_text(F.col(text)))
    tokenizer = RegexTokenizer(inputCol="_clean", outputCol="_words", pattern=r"\p{L}[\p{L}\p{N}]+", gaps=False)
    words = materialize(tokenizer.transform(prepared).drop("_clean"), "topic-words")
    counter = CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary).fit(words)
    counts = materialize(counter.transform(words).drop("_words"), "topic-counts")
    lda = LDA(featuresCol="_counts", topicDistributionCol="_weights", k=k, seed=seed,
              maxIter=max_iter, optimizer="online", subsamplingRate=1.0).fit(counts)
    placed = lda.transform(counts).withColumn("_w", vector_to_array("_weights"))
    heaviest = F.array_max("_w")
    cluster = F.when(heaviest < min_weight, OUTLIER).otherwise(F.array_position("_w", heaviest) - 1)
    assigned = placed.withColumn("cluster_id", cluster.cast("bigint"))
    # k rows of eight words each
    terms = counter.vocabulary
    named = [(int(r["topic"]), [terms[i] for i in r["termIndices"]])
             for r in lda.describeTopics(TOP_KEYWORDS).collect()]
    keywords = comments.sparkSession.createDataFrame(named, "cluster_id bigint, keywords array<string>")
    return materialize(assigned.select(*comments.columns, "cluster_id"), "topics"), keywords
