"""The base language detector against the same sums by hand."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from agorametrics.functions import text as X
from agorametrics.operators import language as L

WORDS = {
    "fr": "le la les des une pour dans avec sur mais nous vous être avoir très bien merci beaucoup".split(),
    "en": "the and for with this that have from they would there their what about which when".split(),
    "es": "el los las para con por una pero nosotros usted muy bien gracias mucho está ñandú".split(),
}


def texts_of(seed, n, size=12):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, lang, " ".join(r.choice(WORDS[lang]).capitalize() for _ in range(r.randint(1, size))) + r.choice(["", "!", " 12"])))
    return rows


def grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        out.update(padded[i:i + 3] for i in range(len(word)))
    return out


def brute(rows, text):
    """Scores of a text by label, in millionths."""
    counts = {}
    for _, lang, t in rows:
        counts.setdefault(lang, Counter()).update(grams(t))
    kinds = len(set().union(*counts.values()))
    return {lang: sum(n * round(math.log((c[g] + 1) / (c.total() + kinds)) * 1_000_000) for g, n in grams(text).items()) for lang, c in sorted(counts.items())}


SCHEMA = "id long, lang string, t string"


@pytest.fixture
def detector(table):
    return L.train(L.gram_counts(table(texts_of(1, 200), SCHEMA), "lang", "t"))


def test_scores_equal_the_sums_by_hand(table, detector):
    rows = texts_of(2, 30) + [(100, None, None), (101, None, "12 !"), (102, None, "日本語"), (103, None, "a"), (104, None, "x" * 5000)]
    got = {r.id: r for r in detector.scores(table(rows, SCHEMA), "id", "t").collect()}
    assert set(got) == {r[0] for r in rows} - {100, 101}
    for i, _, t in rows:
        if i in got:
            want = brute(texts_of(1, 200), t)
            assert [got[i][f"s{k}"] for k in range(3)] == list(want.values()) and got[i].n_grams == grams(t).total()


def test_batches_of_counts_merge(table):
    rows = texts_of(1, 200)
    parts = [L.gram_counts(table(rows[k::3], SCHEMA), "lang", "t") for k in range(3)]
    whole = L.gram_counts(table(rows, SCHEMA), "lang", "t")
    assert sorted(map(tuple, L.merge_counts(*parts).collect())) == sorted(map(tuple, whole.collect()))


def test_unseen_texts_are_told_and_probabilities_are_calibrated(table, detector):
    held = texts_of(3, 150)
    told = {r.id: r for r in detector.detect(table(held, SCHEMA), "id", "t").collect()}
    right = sum(told[i].base_language == lang for i, lang, _ in held)
    assert right >= 0.9 * len(held)
    calibrated = L.calibrate(detector, table(texts_of(4, 200), SCHEMA), "id", "lang", "t")

    def loss(d):
        found = d.detect(table(held, SCHEMA), "id", "t").collect()
        return -sum(math.log(max(1e-12, r.base_confidence if r.base_language == held[r.id][1] else (1 - r.base_confidence) / 2)) for r in found)

    assert calibrated.reach in L.REACHES and loss(calibrated) <= loss(L.Detector(detector.labels, detector.unseen, detector.weights, 1_000)) + 1e-6
    assert all(1 / 3 - 1e-9 <= r.base_confidence <= 1 for r in told.values())


def test_routes_of_the_base_detector(table):
    rows = [(1, "bonjour tout", "fr", 0.93333), (2, "hola amigo", "es", 0.9), (3, "nothing known", None, None), (4, "مرحبا", "en", 0.9),
            (5, "barcha barcha behi", "en", 0.9), (6, "", "en", 0.9), (7, "hello 3aslema friend", "en", 0.5)]
    df = table(rows, "id long, t string, b string, c double")
    got = {r.id: (r.language, r.language_confidence, r.language_method) for r in X.with_language(df, "t", base_language="b", base_confidence="c").collect()}
    plain = {r.id: (r.language, r.language_confidence, r.language_method) for r in X.with_language(df, "t").collect()}
    assert got[1] == ("fr", 0.9333, "base_detector") and got[2] == ("other", 0.9, "base_detector")
    assert all(got[i] == plain[i] for i in (3, 4, 5, 6))
    assert got[7][2] in ("arabizi_rule",)


def test_one_label_and_no_texts(table):
    one = L.train(L.gram_counts(table([(1, "fr", "bonjour")], SCHEMA), "lang", "t"))
    assert [tuple(r)[2:3] + tuple(r)[4:] for r in one.detect(table([(1, None, "salut")], SCHEMA), "id", "t").collect()] == [("fr", 1.0)]
    assert one.detect(table([], SCHEMA), "id", "t").collect() == []
    assert L.calibrate(one, table([], SCHEMA), "id", "lang", "t").reach == L.REACHES[-1]


def test_a_classifier_over_words_as_a_sentiment_backend(table):
    from agorametrics.operators import sentiment as S

    known = table([(1, "positive", "good fine day"), (2, "negative", "bad awful day"), (3, "positive", "fine good"), (4, "negative", "bad bad")], SCHEMA)
    model = L.train(L.gram_counts(known, "lang", "t", unit="word"), unit="word")
    comments = table([(1, "fine!"), (2, "AWFUL thing"), (3, "12 ?"), (4, None), (5, "day")], "comment_id long, text_content string")
    rows = {r.comment_id: r for r in S.score_sentiment(comments, L.classifier(model, "comment_id")).collect()}
    assert [rows[i].sentiment for i in range(1, 6)] == ["positive", "negative", "neutral", "neutral", "negative"]
    assert rows[3].sentiment_score == 0.5 and 0.5 < rows[1].sentiment_score < 1 and {r.model_name for r in rows.values()} == {"naive-bayes"}
