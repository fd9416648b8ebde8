import pytest
from pyspark.sql import functions as F

from agorametrics.operators import evaluate as E
from agorametrics.operators import sentiment as S
from agorametrics.operators import topics as TP

ROWS = "comment_id long,account_id long,published_at timestamp,language string,sentiment string,sentiment_score double,text_content string"
AS_OF = "2026-07-15 00:00:00"


def rows(table, listed):
    return table([(i, 1, f"2026-07-{day:02d} 10:00:00", lang, s, 0.91234, f"c{i}") for i, (day, lang, s) in enumerate(listed)], ROWS)


def test_distribution_and_language(table):
    df = rows(table, [(1, "fr", "positive"), (1, None, "positive"), (2, "fr", "negative"), (2, "fr", None)])
    row = S.sentiment_distribution(df).first()
    assert (row.total, row.positive, row.negative, row.positive_pct, row.net_sentiment) == (3, 2, 1, 66.67, 0.3333)
    parts = {r.language: r.total for r in S.sentiment_by_language(df).collect()}
    assert parts == {"*": 3, "fr": 2, "unknown": 1}


def test_trend_and_deltas(table):
    df = rows(table, [(1, "fr", "negative"), (10, "fr", "positive"), (10, "fr", "negative"), (12, "fr", "positive")])
    trend = {str(r.day): r.net_sentiment for r in S.sentiment_trend(df).collect()}
    assert trend == {"2026-07-01": -1.0, "2026-07-10": 0.0, "2026-07-12": 1.0}
    row = S.sentiment_deltas(df, AS_OF, "5d").first()
    assert (row.cur_net, row.prev_net, row.net_sentiment_delta) == (0.3333, None, None)
    row = S.sentiment_deltas(df, "2026-07-15 00:00:00", "8d").first()
    assert (row.net_sentiment_delta, row.negative_pct_delta) == (1.3333, -66.67)


def test_alerts_need_a_spike_and_ten_comments(table):
    calm = [(d, "fr", "positive") for d in range(2, 12) for _ in range(3)]
    spike = [(12, "fr", "negative")] * 10
    got = S.negative_alerts(rows(table, calm + spike), AS_OF).collect()
    assert [(str(r.day), r.negative_share, r.n_comments) for r in got] == [("2026-07-12", 1.0, 10)]
    assert S.negative_alerts(rows(table, calm + spike[:9]), AS_OF).count() == 0
    assert S.negative_alerts(rows(table, spike), AS_OF).count() == 0


def test_alerts_of_a_stream_in_any_cut(spark, table):
    """Batches in any order and cut give the alerts of all rows, however late a day's comments come."""
    import random

    from agorametrics.session import shared_dir
    from agorametrics.streaming import jobs as J

    r = random.Random(5)
    every = [(i, r.randint(1, 2), f"2026-07-{r.randint(3, 15):02d} {r.randint(0, 23):02d}:00:00", r.choice(["positive", "neutral", "positive", "negative", None])) for i in range(400)]
    every += [(1000 + i, 1, "2026-07-09 05:00:00", "negative") for i in range(60)]
    schema = "comment_id long, account_id long, published_at timestamp, sentiment string"
    want = sorted(map(tuple, S.negative_alerts(table(every, schema), "2026-07-15 00:00:00").collect()))
    assert want
    for cuts in (1, 3):
        root = shared_dir(spark, "alerts")
        r.shuffle(every)
        for k in range(cuts):
            table(every[k::cuts], schema).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(table([], schema).schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
            J.count_negatives(stream, f"{root}/log", f"{root}/ck").awaitTermination()
        assert sorted(map(tuple, J.current_alerts(spark, f"{root}/log", "2026-07-15 00:00:00").collect())) == want
    with pytest.raises(ValueError, match="inside one"):
        J.current_alerts(spark, f"{root}/log", "2026-07-15 08:00:00")


def test_recent_negatives(table):
    df = rows(table, [(2, "fr", "negative"), (9, "fr", "negative"), (9, "fr", "negative"), (10, "fr", "positive")])
    got = S.recent_negatives(df, AS_OF, "14d", 2).orderBy("rank").collect()
    assert [(r.comment_id, r.score) for r in got] == [(2, 0.9123), (1, 0.9123)]


def stub(name, answer):
    def load():
        return lambda texts: [(answer, 0.87654321)] * len(texts)

    return S.model_backend(name, "9", load)


def test_scoring_routes_dialect(table):
    df = table([(1, "mrigel yesser, labes"), (2, "This is a very good map"), (3, None)], "comment_id long,text_content string")
    main = S.score_sentiment(df, stub("main", "LABEL_2"))
    got = {r.comment_id: r for r in main.collect()}
    assert got[1].needs_arabizi_specialist and not got[2].needs_arabizi_specialist
    assert {r.sentiment for r in got.values()} == {"positive"} and got[1].sentiment_score == 0.8765
    both = {r.comment_id: r for r in S.score_sentiment(df, stub("main", "pos"), stub("special", "neg")).collect()}
    assert (both[1].model_name, both[1].sentiment, both[1].needs_arabizi_specialist) == ("special", "negative", False)
    assert (both[2].model_name, both[3].model_name, len(both)) == ("main", "main", 3)


def test_lexicon_backend(table):
    df = table([(1, "awful 😡"), (2, "great 😍 love"), (3, "table"), (4, "good bad")], "comment_id long,text_content string")
    got = {r.comment_id: (r.sentiment, r.sentiment_score) for r in S.score_sentiment(df).collect()}
    assert got == {1: ("negative", 1.0), 2: ("positive", 1.0), 3: ("neutral", 0.5), 4: ("neutral", 0.5)}


def test_unlabeled_and_joins(table):
    comments = table([(1, 7, "2026-07-01 10:00:00", "a"), (2, 7, "2026-07-02 10:00:00", " "), (3, 7, "2026-07-03 10:00:00", "c")],
                     "comment_id long,post_id long,published_at timestamp,text_content string")
    analyses = table([(1, "positive")], "comment_id long,sentiment string")
    posts = table([(7, 70)], "post_id long,account_id long")
    assert {r.comment_id for r in S.unlabeled_comments(comments, analyses).collect()} == {2, 3}
    assert [r.comment_id for r in S.unlabeled_comments(comments, analyses, limit=1).collect()] == [2]
    kept = S.labeled_rows(comments, analyses, posts, keep_unlabeled=True).collect()
    assert {(r.comment_id, r.sentiment, r.account_id) for r in kept} == {(1, "positive", 70), (3, None, 70)}
    assert S.labeled_rows(comments, analyses, posts).count() == 1


def test_evaluation(table):
    pairs = table([("positive", "positive"), ("positive", "negative"), ("negative", "negative"), ("negative", "negative"),
                   ("neutral", "neutral")], "y_true string,y_pred string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.per_class_metrics(pairs).collect()}
    assert got["positive"] == (1.0, 0.5, 0.6667, 2) and got["negative"][2] == 0.8
    row = E.macro_f1_accuracy(pairs).first()
    assert (row.macro_f1, row.accuracy, row.support) == (0.8222, 0.8, 5)
    cells = {(r.true_label, r.predicted_label): r.n for r in E.confusion_matrix(pairs).collect()}
    assert len(cells) == 9 and cells["positive", "negative"] == 1 and cells["neutral", "positive"] == 0
    summary = {(r.section, r.label, r.other): r.value for r in E.eval_summary(pairs).collect()}
    assert len(summary) == 23 and summary["macro_f1", None, None] == 0.8222 and summary["confusion", "positive", "negative"] == 1.0


def test_evaluation_ignores_strange_labels_but_counts_misses(table):
    pairs = table([("positive", "strange"), ("strange", "positive"), ("positive", "positive"), ("positive", None)],
                  "y_true string,y_pred string")
    got = {r.label: (r.precision, r.recall, r.support) for r in E.per_class_metrics(pairs).collect()}
    assert got["positive"] == (0.5, 0.3333, 3)
    summary = {(r.section, r.label): r.value for r in E.eval_summary(pairs).filter("other is null").collect()}
    assert (summary["precision", "positive"], summary["support", "positive"]) == (0.5, 3.0)


def test_weights(table):
    df = table([("positive",)] * 8 + [("negative",)] * 2, "label string")
    assert {r.label: r.weight for r in E.class_weights(df).collect()} == {"positive": 0.625, "negative": 2.5, "neutral": 1.0}
    assert {r.weight for r in E.class_weights(df.filter("false")).collect()} == {1.0}


def test_split_keeps_proportions_on_any_partitioning(table):
    df = table([(i, "positive" if i < 10 else "negative") for i in range(20)], "id long,label string")
    split = E.stratified_split(df, "label", "id")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(lab, part): n for lab in ("positive", "negative") for part, n in (("train", 7), ("val", 1), ("test", 2))}
    again = E.stratified_split(df.repartition(5, F.rand(1)), "label", "id")
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in again.collect()}
    other = E.stratified_split(df, "label", "id", seed=7)
    assert {tuple(r) for r in split.collect()} != {tuple(r) for r in other.collect()}


def test_training_learns(table):
    df = table([(i, ["great love", "bad hate", "table chair"][i % 3] + f" w{i % 5}", ["positive", "negative", "neutral"][i % 3])
                for i in range(150)], "comment_id long,text_content string,label string")
    model, scored = E.train_sentiment(df, features=1 << 10, max_iter=20)
    assert E.macro_f1_accuracy(scored).first().accuracy == 1.0
    labels = S.score_sentiment(df.drop("label"), E.ml_backend(model)).select("comment_id", "sentiment").collect()
    assert len(labels) == 150 and {r.sentiment for r in labels} == {"positive", "neutral", "negative"}


def assigned(table, listed):
    return table([(i, a, c, s) for i, (a, c, s) in enumerate(listed)], "comment_id long,account_id long,cluster_id long,sentiment string")


def test_topics(table):
    big = [(1, 0, "positive")] * 10 + [(1, 1, None)] * 8 + [(1, 2, "negative")] * 2 + [(1, -1, "negative")] * 5
    small = [(2, 0, "positive")] * 5
    df = assigned(table, big + small)
    usable = {(r.account_id, r.cluster_id, r.size, r.reason) for r in TP.usable_clusters(df).collect()}
    assert usable == {(1, 0, 10, None), (1, 1, 8, None), (2, None, None, "insufficient_data")}
    keywords = table([(0, ["a", "b", "c", "d"]), (1, [])], "cluster_id long,keywords array<string>")
    rolled = {r.cluster_id: r for r in TP.topic_rollup(df, keywords).collect()}
    assert (rolled[0].label, rolled[0].avg_sentiment, rolled[0].n_labeled) == ("a / b / c", 1.0, 10)
    assert (rolled[1].label, rolled[1].avg_sentiment, rolled[1].n_labeled) == ("unlabeled", None, 0)
    assert [r.cluster_id for r in TP.list_topics(TP.topic_rollup(df), 1).collect()] == [0]
    analyses = df.select("comment_id", "sentiment").withColumn("topic_id", F.lit(99).cast("long"))
    linked = TP.topic_comment_link(analyses, df, TP.usable_clusters(df))
    assert {r.topic_id: r["count"] for r in linked.groupBy("topic_id").count().collect()} == {0: 10, 1: 8, 99: 12}


def test_fit_topics_invariants(table):
    texts = [["pizza cheese oven", "goal match player", "song guitar drum"][i % 3] for i in range(90)]
    df = table([(i, 1, t, "positive") for i, t in enumerate(texts)], "comment_id long,account_id long,text_content string,sentiment string")
    got, keywords = TP.fit_topics(df, k=3, max_iter=20)
    rows = got.collect()
    assert len(rows) == 90 and {r.cluster_id for r in rows} <= {-1, 0, 1, 2}
    assert all(len(r.keywords) <= 8 for r in keywords.collect())
    sizes = TP.topic_rollup(got, keywords).collect()
    assert all(r.comment_count >= 3 for r in sizes)
