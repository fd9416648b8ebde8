"""Text columns: hashtags, cleaning, emoji polarity, language routing, reply parsing.

Everything is a native column expression but Unicode NFC, for which Spark has no function.
Character classes are spelled out because Java's ``\\w`` and ``\\s`` are ASCII only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from agorametrics import vocab
from agorametrics.functions.metric import round_dp

# Unicode white space, and word characters without combining marks
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

_ZERO_WIDTH = vocab.ZERO_WIDTH_RANGE
_DIACRITICS = vocab.DIACRITICS_RANGE
_EMOJI = vocab.EMOJI_RANGE
_ARABIC = vocab.ARABIC_RANGE
# Texts without any character that Arabic normalization or the removal of zero-width characters looks for, also after NFC.
# One greedy run: a search for the opposite makes the patterns behind it several times slower.
_LOW = r"\A[\x{0}-\x{5ff}]*+\z"
# All of WS but the blank; nested, so that most letters are told by two ranges
_OTHER_WS = r"\t-\r\x1c-\x1f[\x85-\x{3000}&&[" + WS + "]]"
# Characters that can neither compose, decompose nor be reordered under NFC; the run of the commonest first, by one range
_NFC_SAFE = (
    r"^[\x{0}-\x{2ff}]*+[\x{0}-\x{2ff}\x{621}-\x{64a}\x{660}-\x{66f}\x{671}-\x{6d3}\x{2010}-\x{2027}"
    r"\x{2030}-\x{205e}\x{2600}-\x{27bf}\x{1f300}-\x{1faff}]*$"
)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return text.isNull() | ~text.rlike(rf"[^{WS}]")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


# --- hashtags, content types, authors ---------------------------------------------------------
def extract_hashtags(text: Column) -> Column:
    """Lower-cased unique tags in order of appearance, ``#`` kept."""
    tags = F.regexp_extract_all(text, F.lit(rf"#[{WORD}\x{{600}}-\x{{6ff}}]+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(tags, F.lower)), _no_strings())


def extract_hashtag_names(text: Column) -> Column:
    """Lower-cased unique tag names in order of appearance, without ``#``."""
    tags = F.regexp_extract_all(text, F.lit(rf"#([{WORD}]+)"), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(tags, F.lower)), _no_strings())


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def map_content_type(raw: Column) -> Column:
    """Canonical type by exact, then lower-cased name; an unknown one passes in lower case."""
    key = _strip(raw)
    lower = F.lower(key)
    table = vocab.CONTENT_TYPE_MAP
    return F.coalesce(_lookup(key, table), _lookup(lower, table), F.when(lower != "", lower))


def author_hash(author_id: Column) -> Column:
    return F.when(author_id != "", F.sha2(author_id, 256))


# --- cleaning -------------------------------------------------------------------------------
def mask_mentions_urls(text: Column) -> Column:
    masked = F.regexp_replace(text, rf"https?://[^{WS}]+|www\.[^{WS}]+", "http")
    return F.regexp_replace(masked, rf"@[{WORD}]+", "@user")


def collapse_repeats(text: Column) -> Column:
    """Three or more of a character in a row become two."""
    return F.regexp_replace(text, r"([^\n])\1{2,}", "$1$1")


def normalize_arabic(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, _DIACRITICS, ""), vocab.ARABIC_FROM, vocab.ARABIC_TO)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, _ZERO_WIDTH, "")


def squeeze_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf" [{WS}]+|[{_OTHER_WS}][{WS}]*", " "))  # single blanks stay


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC form. Only texts that NFC could change are sent to Python."""
    return F.coalesce(_nfc(F.when(~text.rlike(_NFC_SAFE), text)), text)


def preprocess_text(text: Column, for_model: bool = True) -> Column:
    """The cleaning every model sees; emoji stay. Null becomes the empty text.

    Texts of low characters, nearly all in Latin letters, skip the steps that cannot change them.
    """
    low = composed = nfc(text)
    high = strip_zero_width(composed)
    if for_model:
        may_mask = low.contains("http") | low.contains("www.") | low.contains("@")
        low = F.when(may_mask, mask_mentions_urls(low)).otherwise(low)
        high = mask_mentions_urls(high)
    out = F.when(text.rlike(_LOW), collapse_repeats(low)).otherwise(normalize_arabic(collapse_repeats(high)))
    return F.coalesce(squeeze_whitespace(out), F.lit(""))


# --- emoji ----------------------------------------------------------------------------------
def extract_emojis(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_EMOJI), F.lit(0))


def count_chars(text: Column, members: str) -> Column:
    """How many characters of a class a text has: what is left without all others. Cheaper than
    ``regexp_count``, which builds an array of the matches."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


_BEFORE_EMOJI = ord(min(vocab.EMOJI_POSITIVE + vocab.EMOJI_NEUTRAL + vocab.EMOJI_NEGATIVE)) - 1


def count_emoji(text: Column, members: str) -> Column:
    """How many of the listed emoji a text has. Characters before the first scored one, nearly all, go by one plain range,
    which several counts of a projection share."""
    return count_chars(F.regexp_replace(text, rf"[\x{{0}}-\x{{{_BEFORE_EMOJI:x}}}]+", ""), members)


def emoji_polarity(text: Column) -> Column:
    """Mean polarity of the scored emoji, 0 when there is none."""
    up = count_emoji(text, vocab.EMOJI_POSITIVE)
    flat = count_emoji(text, vocab.EMOJI_NEUTRAL)
    down = count_emoji(text, vocab.EMOJI_NEGATIVE)
    n = up + flat + down
    return F.when(n > 0, round_dp((up - down) / n, 4)).otherwise(0.0)


# --- language -------------------------------------------------------------------------------
# A case-insensitive [a-z] also matches these letters. They are replaced so that the patterns can
# do with ASCII classes, which are several times faster; no listed word has an x.
_ODD_LETTERS, _STAND_INS = "\u0130\u0131\u017f\u212a", "xxxk"
_INTRAWORD = vocab.INTRAWORD_DIGITS


def _folded(text: Column) -> Column:
    return F.lower(F.translate(text, _ODD_LETTERS, _STAND_INS))


def _split_words(folded: Column) -> Column:
    return F.split(folded, "[^a-z0-9]+")


def words(text: Column) -> Column:
    """Runs of Latin letters and digits, lower-cased; an empty one may lead or end the list."""
    return _split_words(_folded(text))


def _listed(found: Column, names) -> Column:
    """How many distinct words are in a list."""
    return F.size(F.array_intersect(found, F.array(*[F.lit(n) for n in names])))


def script_counts(text: Column) -> tuple[Column, Column]:
    arabic = F.length(text) - F.length(F.regexp_replace(text, f"[{_ARABIC}]+", ""))
    return arabic, count_chars(text, "a-zA-Z")


def with_script_ratios(df, text: str):
    """Add ``arabic_ratio`` and ``latin_ratio``, the shares among both scripts' letters; 0 when
    there are none. Letters are counted in a projection of their own, once per text."""
    arabic, latin = script_counts(F.col(text))
    counted = df.select("*", arabic.alias("_ar"), latin.alias("_la"))
    total = F.col("_ar") + F.col("_la")
    return counted.select(*df.columns, *[
        F.when(total > 0, F.col(c) / total).otherwise(0.0).alias(name)
        for c, name in (("_ar", "arabic_ratio"), ("_la", "latin_ratio"))])


def _signal(folded: Column, found: Column) -> Column:
    distinct = _listed(found, vocab.TUNISIAN_WORDS)
    # two hits are already the full signal; one word may still occur more than once
    repeats = F.size(F.filter(found, lambda w: w.isin(*vocab.TUNISIAN_WORDS)))
    hits = F.when(distinct == 1, repeats).otherwise(distinct)
    # every match is two characters long
    inside = (F.length(folded) - F.length(F.regexp_replace(folded, _INTRAWORD, ""))) / 2
    return F.least(F.lit(1.0), hits * 0.6 + inside * 0.5)


def arabizi_signal(text: Column) -> Column:
    """Strength in [0, 1] of dialect words and digits used as letters."""
    return round_dp(_signal(_folded(text), words(text)), 4)


def _hints(text: Column, found: Column) -> tuple[Column, Column]:
    accent = F.when(text.rlike(f"[{vocab.FRENCH_ACCENTS}]"), 1).otherwise(0)
    return _listed(found, vocab.FRENCH_HINTS) + accent, _listed(found, vocab.ENGLISH_HINTS)


def hint_counts(text: Column) -> tuple[Column, Column]:
    """Distinct French hint words (one more for an accent) and English hint words."""
    return _hints(text, words(text))


def with_language(df, text: str, prefix: str = "", base_language: str | None = None, base_confidence: str | None = None):
    """Add ``language``, ``language_confidence`` and ``language_method``.

    Rules in order: blank, Arabic script, dialect in Latin letters, the base detector, and a weak
    dialect signal that turns an uncertain answer. The base detector's answer is read from two columns, of which any
    other language than fr, en and ar is ``other``; where there is none, hint words answer. Folding, splitting and counting are projections
    of their own, so that each regex runs once per text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    arabic, latin = script_counts(F.col("_t"))
    folded = df.select("*", t.alias("_t"), _folded(t).alias("_low"))
    split = folded.select("*", arabic.alias("_ar"), _split_words(F.col("_low")).alias("_w"))
    french, english = _hints(F.col("_t"), F.col("_w"))
    # without Arabic letters it only matters whether there are Latin ones
    any_latin = F.when(F.col("_t").rlike("[a-zA-Z]"), 1).otherwise(0)
    counted = split.select(
        *df.columns, is_blank(F.col("_t")).alias("_blank"), "_ar",
        F.when(F.col("_ar") > 0, latin).otherwise(any_latin).alias("_la"),
        _signal(F.col("_low"), F.col("_w")).alias("_raw"), french.alias("_fr"), english.alias("_en"),
    ).withColumn("_sig", round_dp("_raw", 4))
    ar, la, sig, fr, en = (F.col(c) for c in ("_ar", "_la", "_sig", "_fr", "_en"))
    total = ar + la
    arabic_ratio = F.when(total > 0, ar / total).otherwise(0.0)
    base = F.when((fr == 0) & (en == 0), "other").when(fr >= en, "fr").otherwise("en")
    base_conf = F.when((fr == 0) & (en == 0), 0.3).otherwise(0.5)
    detector = "heuristic"
    if base_language:
        told = F.col(base_language)
        base = F.when(told.isin("fr", "en", "ar"), told).when(told.isNotNull(), "other").otherwise(base)
        base_conf = F.when(told.isNotNull(), round_dp(base_confidence, 4)).otherwise(base_conf)
        detector = F.when(told.isNotNull(), "base_detector").otherwise("heuristic")
    is_ar = (arabic_ratio >= 0.4) & (ar >= la)
    weak = (sig > 0) & base.isin("other", "en") & (base_conf < 0.8)

    def route(blank, script, strong, nudged, detector, nothing) -> Column:
        return (
            F.when(F.col("_blank"), blank).when(is_ar, script)
            .when((la > 0) & (sig >= 0.5), strong).when((la > 0) & weak, nudged)
            .when(la > 0, detector).otherwise(nothing)
        )

    lit = F.lit
    return counted.select(
        *[F.col(c) for c in df.columns],
        route(lit("other"), lit("ar"), lit("aeb-latn"), lit("aeb-latn"), base, lit("other"))
        .alias(f"{prefix}language"),
        round_dp(route(lit(0.0), 0.6 + 0.4 * arabic_ratio, F.least(lit(0.99), 0.6 + sig * 0.3),
                       0.55 + sig * 0.2, base_conf, lit(0.3)), 4)
        .alias(f"{prefix}language_confidence"),
        route(lit("heuristic"), lit("script"), lit("arabizi_rule"), lit("arabizi_rule"),
              lit(detector) if isinstance(detector, str) else detector, lit("heuristic")).alias(f"{prefix}language_method"),
    )


# --- labels ---------------------------------------------------------------------------------
def normalize_model_label(raw: Column) -> Column:
    """Class name of a model to one of the three labels; an unknown name is an error."""
    found = _lookup(F.lower(_strip(raw)), vocab.MODEL_LABELS)
    message = F.concat(F.lit("unmappable sentiment label: "), F.coalesce(raw, F.lit("null")))
    return F.coalesce(found, F.raise_error(message).cast("string"))


def normalize_dataset_label(raw: Column) -> Column:
    """Label spelling of a data set to one of the three labels, null when unknown."""
    return _lookup(F.lower(_strip(raw.cast("string"))), vocab.DATASET_LABELS)


def net_sentiment_score(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "neutral", 0).when(label == "negative", -1)


def label_from_keywords(keywords: Column, max_words: int = 3) -> Column:
    trimmed = F.filter(F.transform(keywords, _strip), lambda w: w != "")
    named = F.concat_ws(" / ", F.slice(trimmed, 1, max_words))
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise("unlabeled")


def truncate_trace(text: Column, limit: int = 2000) -> tuple[Column, Column]:
    """Text cut at ``limit`` characters and whether it was cut."""
    cut = F.length(text) > limit
    return F.when(cut, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text), cut


# --- model replies --------------------------------------------------------------------------
def _json_strings(text: Column) -> Column:
    """Strings of a JSON array, or of the first array found under a known key; null when the text
    is not such JSON."""
    doc = F.try_parse_json(text)
    paths = ("$", "$.variants", "$.captions", "$.options", "$.results")
    items = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in paths])
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def _reply_lines(text: Column) -> Column:
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")

    def clean(line: Column) -> Column:
        bare = F.regexp_replace(line, rf"^[{WS}]*(?:[0-9]+[.)]|[-*•])[{WS}]*", "")
        return F.regexp_replace(_strip(bare), '^"+|"+$', "")

    return F.transform(lines, clean)


def parse_variants(text: Column, n: int | None = None) -> Column:
    """Captions in a model reply: JSON, a fenced block, the outermost brackets, else its lines."""
    fenced = F.regexp_substr(text, F.lit(r"(?s)```(?:json)?\s*.*?```"))
    inner = F.regexp_replace(fenced, r"(?s)^```(?:json)?\s*|```$", "")
    bracketed = F.regexp_substr(text, F.lit(r"(?s)\[.*\]"))
    found = F.coalesce(
        _json_strings(text), _json_strings(inner), _json_strings(bracketed), _reply_lines(text)
    )
    cleaned = F.array_distinct(F.filter(F.transform(found, _strip), lambda s: s != ""))
    out = cleaned if n is None else F.slice(cleaned, 1, n)
    return F.when(F.coalesce(text, F.lit("")) == "", _no_strings()).otherwise(out)
