import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from agorametrics.functions import text as X
from agorametrics.functions import timeparse as T


@pytest.fixture
def apply(spark):
    def run(fn, *texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i long, t string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]

    return run


def test_hashtags(apply):
    assert apply(X.extract_hashtag_names, "Love #Tunisia and #tunisia #Foot!", None, "none", "#تونس test", "#café_1") == [
        ["tunisia", "foot"], [], [], ["تونس"], ["café_1"]]
    assert apply(X.extract_hashtags, "Soldes #Promo #promo #نجاح", "") == [["#promo", "#نجاح"], []]


def test_content_types(apply):
    assert apply(X.map_content_type, "IMAGE", "Reels", " album ", "Weird Type", "", None, "youtube#video") == [
        "photo", "reel", "carousel", "weird type", None, None, "video"]


def test_author_hash(apply):
    assert apply(X.author_hash, "u1", "", None) == [hashlib.sha256(b"u1").hexdigest(), None, None]


def test_masks(apply):
    assert apply(X.mask_mentions_urls, "hey @ali see https://x.com now", "visit www.site.tn") == [
        "hey @user see http now", "visit http"]


def test_repeats(apply):
    assert apply(X.collapse_repeats, "barchaaaa", "cool!!!!", "ok", "😍😍😍😍", "a\n\n\n\nb") == [
        "barchaa", "cool!!", "ok", "😍😍", "a\n\n\n\nb"]


def test_arabic(apply):
    assert apply(X.normalize_arabic, "أهلا", "إسلام", "جميلَة") == ["اهلا", "اسلام", "جميله"]


def test_emoji(apply):
    assert apply(X.emoji_polarity, "great 😍😍", "awful 😡", "hmm 🤔", "no emoji", "😍😡", "❤️") == [
        1.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    assert apply(X.extract_emojis, "love it 😍🔥", "plain") == [["😍", "🔥"], []]


def test_preprocess(apply):
    assert apply(X.preprocess_text, "@ali barchaaaa!!! 😍 https://x.com", "", "   ", None) == [
        "@user barchaa!! 😍 http", "", "", ""]
    assert apply(lambda t: X.preprocess_text(t, for_model=False), "@ali  x") == ["@ali x"]


def test_nfc_is_complete(apply):
    texts = ["café", "déjà", "plain", "مَّ", " x", "Å", "ệ", "가", "가", "😍"]
    assert apply(X.nfc, *texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_white_space(apply):
    assert apply(X.squeeze_whitespace, " a  b\tc\x1cd ") == ["a b c d"]
    assert apply(X.strip_zero_width, "a​b﻿⁦") == ["ab"]
    assert apply(X.is_blank, " 　", "x", None) == [True, False, True]


def test_language(spark):
    texts = {
        "tawa nheb el photo hedhi barcha, 3aychek": ("aeb-latn", "arabizi_rule"), "mrigel yesser, labes": ("aeb-latn", "arabizi_rule"),
        "chnowa hedha, el colis mouch 3adi": ("aeb-latn", "arabizi_rule"), "aslema sahbi kifach": ("aeb-latn", "arabizi_rule"),
        "الصورة واضحة جدا اليوم": ("ar", "script"), "Merci pour la commande, vous avez bien fait": ("fr", "heuristic"),
        "This is the map for the harbour, and it was very good": ("en", "heuristic"), "": ("other", "heuristic"),
        "   ": ("other", "heuristic"), "the book has 12 maps and 3 notes for you": ("en", "heuristic"), "12345 !!": ("other", "heuristic"),
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = {r.t: r for r in X.with_language(df, "t").collect()}
    assert {t: (rows[t].language, rows[t].language_method) for t in texts} == texts
    assert rows[None].language == "other" and rows[""].language_confidence == 0.0
    assert all(0.0 <= r.language_confidence <= 1.0 for r in rows.values())


def test_signal_counts_repeats_and_odd_letters(apply):
    # one hit, the same word twice, digits as letters, the Kelvin sign as k, a dotless i inside a word
    assert apply(X.arabizi_signal, "labes", "labes labes", "x7y", "Kifach", "bıarka", "") == [
        0.6, 1.0, 0.5, 0.6, 0.0, 0.0]


def test_labels(spark, apply):
    assert apply(X.normalize_dataset_label, " POS ", "-1", "mixed", "what", None) == ["positive", "negative", "neutral", None, None]
    assert apply(X.normalize_model_label, "LABEL_2", "neg") == ["positive", "negative"]
    with pytest.raises(Exception, match="unmappable"):
        apply(X.normalize_model_label, "LABEL_9")
    keywords = spark.createDataFrame([(["a", " ", "b ", "c", "d"],), ([],), (None,)], "k array<string>")
    assert [r[0] for r in keywords.select(X.label_from_keywords(F.col("k"))).collect()] == ["a / b / c", "unlabeled", "unlabeled"]


def test_trace_is_cut(apply):
    assert apply(lambda t: X.truncate_trace(t)[0], "x" * 2001, "y" * 2000) == ["x" * 2000 + "...", "y" * 2000]


@pytest.mark.parametrize("reply,n,expected", [
    ('["a", "b", "c"]', None, ["a", "b", "c"]), ('```json\n["x", "y"]\n```', None, ["x", "y"]),
    ('{"variants": ["p", "q"]}', None, ["p", "q"]), ("1. First option\n2) Second option\n- Third option", None,
                                                   ["First option", "Second option", "Third option"]),
    ('["a", "a", "b", "c"]', None, ["a", "b", "c"]), ('["a", "b", "c"]', 2, ["a", "b"]), ("", None, []),
    ('Here you go: ["k", "l"] bye', None, ["k", "l"]), ('["a", 7, null, " "]', None, ["a"]),
    ('{"other": ["p"]}', None, ["p"]), ('{"options": [], "results": ["r"]}', None, []), ('"quoted"\n\n* star', None, ["quoted", "star"]),
])
def test_replies(apply, reply, n, expected):
    assert apply(lambda t: X.parse_variants(t, n), reply) == [expected]


def test_times(apply):
    iso = [str(v) if v else None for v in apply(
        T.parse_iso_dt, "2026-07-01T10:00:00Z", "2026-07-01T10:00:00+0000", "2026-07-01T10:00:00+02:00", "2026-07-01T10:00:00",
        "2026-07-01", "nope", "2026-13-01T00:00:00Z", None, "12:30")]
    assert iso == ["2026-07-01 10:00:00", "2026-07-01 10:00:00", "2026-07-01 08:00:00", "2026-07-01 10:00:00",
                   "2026-07-01 00:00:00", None, None, None, None]
    local = [str(v) if v else None for v in apply(
        T.parse_timestamp_local, "2026-07-03 19:30:00", "2026-07-03T19:30:00Z", "2026-07-03T19:30:00+0300", "7/3/2026 9:05",
        "2026-07-03", "bad")]
    assert local == ["2026-07-03 18:30:00", "2026-07-03 19:30:00", "2026-07-03 16:30:00", "2026-07-03 08:05:00",
                     "2026-07-02 23:00:00", None]


def test_numbers(apply):
    assert apply(T.to_int, "12", "12.7", "-3.9", " 42 ", "1e3", "abc", "", None, "9007199254740993", "nan", "5d") == [
        12, 12, -3, 42, 1000, None, None, None, 9007199254740993, None, None]
    assert apply(T.iso_duration_seconds, "PT5M30S", "PT45S", "PT1H", "PT", "P1D", "", None) == [330, 45, 3600, None, None, None, None]


def test_local_day(spark):
    df = spark.createDataFrame([("2026-07-05 23:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert tuple(df.select(T.local_dow(F.col("t")), T.local_hour(F.col("t"))).first()) == (0, 0)


def test_cleaning_equals_its_steps(apply):
    rng = random.Random(5)
    signs = ["a", "aaa", "  ", " ", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u2028", "\u3000", "é", "e\u0301", "a\u0323", "\u05ff", "\u0600", "\u0622",
             "\u0627\u0653", "\u0640", "\u064b", "\u200b", "\u200f", "\ufeff", "\u2066", "😍", "😍😍😍", "http", "ht\u200btp", "://", "s://x.y", "www.", "@", "@é_1", "\n\n\n"]
    texts = ["".join(rng.choices(signs[:n], k=rng.randint(0, 12))) for n in (9, 16, len(signs)) for _ in range(300)] + [None, "", " "]

    def steps(text, for_model=True):
        out = X.strip_zero_width(X.nfc(text))
        out = X.mask_mentions_urls(out) if for_model else out
        out = F.regexp_replace(X.normalize_arabic(X.collapse_repeats(out)), rf"[{X.WS}]+", " ")
        return F.coalesce(F.trim(out), F.lit(""))

    assert apply(X.preprocess_text, *texts) == apply(steps, *texts)
    assert apply(lambda t: X.preprocess_text(t, for_model=False), *texts) == apply(lambda t: steps(t, False), *texts)


def test_low_texts_need_no_skipped_step():
    named = [*X.vocab.ARABIC_FROM, *map(chr, [*range(0x64B, 0x653), 0x670, 0x640, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF])]
    made = {c for low in map(chr, range(0x600)) for c in unicodedata.normalize("NFC", low)}
    assert all(ord(c) >= 0x600 and ord(unicodedata.normalize("NFD", c)[0]) >= 0x600 for c in named) and not made & set(named)
    low, other = re.compile(X._LOW.replace(r"\x{0}", r"\x00").replace(r"\x{5ff}", "\u05ff").replace(r"\z", r"\Z")), "é\n"
    assert low.match("") and low.match(other) and not any(low.match(other + c) for c in named)
