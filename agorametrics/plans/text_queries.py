"""Scalar text and time functions, sentiment rollups, evaluation (sections 2.5 and 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agorametrics import vocab
from agorametrics.functions import text as X
from agorametrics.functions import timeparse as T
from agorametrics.functions.metric import round_dp
from agorametrics.operators import density
from agorametrics.operators import evaluate as E
from agorametrics.operators import language as L
from agorametrics.operators import posts as P
from agorametrics.operators import sentiment as S
from agorametrics.operators import topics as TP
from agorametrics.plans.fixtures import EVENTS_AS_OF, TEXTS
from agorametrics.plans.post_queries import ASSIGNED
from agorametrics.plans.registry import bounds, isum, query, rd
from agorametrics.session import materialize

E_UNTIL, E_SINCE, E_PREV = bounds(EVENTS_AS_OF, "14d")
# letters a case-insensitive [a-z] matches
LATIN = r"a-zA-Z\x{130}\x{131}\x{17f}\x{212a}"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def text_query(name: str, oracle: str | None, source: str = TEXTS):
    """A query over all texts; the oracle gives the select list for a text ``t``."""
    sql = None if oracle is None else f"select text_id, {oracle} from (select text_id, text_content as t from ({source}))"

    def register(fn):
        @query(name, sql)
        def _(fx):
            return fx.sql(source).select("text_id", *fn(F.col("text_content")))

        return fn

    return register


def _ordered_distinct(expr: str) -> str:
    """First occurrences in order; DuckDB's list_distinct does not keep the order."""
    return (f"array_to_string(list_filter({expr}, lambda x, i: list_position({expr}, x) = i), ' ')")


@text_query("extract_hashtags", _ordered_distinct(
    r"list_transform(regexp_extract_all(t, '#[\p{L}\p{N}_\x{600}-\x{6ff}]+'), lambda x: lower(x))") + " as hashtags")
def _(t):
    return [F.array_join(X.extract_hashtags(t), " ").alias("hashtags")]


@text_query("extract_hashtag_names", _ordered_distinct(
    r"list_transform(regexp_extract_all(t, '#([\p{L}\p{N}_]+)', 1), lambda x: lower(x))") + " as hashtags")
def _(t):
    return [F.array_join(X.extract_hashtag_names(t), " ").alias("hashtags")]


_TYPE_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.CONTENT_TYPE_MAP.items()) + "}"
_MAPPED = (f"coalesce({_TYPE_MAP}[trim(content_type)], {_TYPE_MAP}[lower(trim(content_type))], "
           "nullif(lower(trim(content_type)), ''))")


@query("map_content_type", f"select external_id, content_type as raw, {_MAPPED} as content_type from stg_posts")
def _(fx):
    return fx["stg_posts"].select("external_id", F.col("content_type").alias("raw"),
                                  X.map_content_type(F.col("content_type")).alias("content_type"))


@query("vocabulary_map_join", f"select {_MAPPED} as content_type, count(*) as n from stg_posts group by 1")
def _(fx):
    return fx["stg_posts"].groupBy(X.map_content_type(F.col("content_type")).alias("content_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("author_hash", """select cast(_ord as bigint) as ord, case when author_external_id <> '' then sha256(author_external_id) end
 as author_hash from stg_comments""")
def _(fx):
    return fx["stg_comments"].select(F.col("_ord").alias("ord"),
                                     X.author_hash(F.col("author_external_id")).alias("author_hash"))


_WS = X.WS
def _mask(t: str) -> str:
    return (rf"regexp_replace(regexp_replace({t}, 'https?://[^{_WS}]+|www\.[^{_WS}]+', 'http', 'g'), "
            r"'@[\p{L}\p{N}_]+', '@user', 'g')")


def _arabic(t: str) -> str:
    return (rf"translate(regexp_replace({t}, '[\x{{64b}}-\x{{652}}\x{{670}}\x{{640}}]', '', 'g'), "
            f"'{vocab.ARABIC_FROM}', '{vocab.ARABIC_TO}')")


@text_query("mask_mentions_urls", _mask("t") + " as masked")
def _(t):
    return [X.mask_mentions_urls(t).alias("masked")]


def collapse_sql(source: str, row_id: str) -> str:
    """CTE ``collapsed`` (row id, t): each character beside its two predecessors, kept unless all
    three are the same and no line break."""
    return rf"""chars as (select {row_id}, regexp_extract_all(t, '(?s).') as c from {source}),
 beside as (select {row_id}, list_zip(c, list_concat([''], c), list_concat(['', ''], c)) as z from chars),
 collapsed as (select {row_id}, array_to_string(list_transform(list_filter(z,
   lambda x: x[1] is not null and not (x[1] = x[2] and x[1] = x[3] and x[1] <> chr(10))), lambda x: x[1]), '') as t from beside)"""


def clean_sql(source: str, row_id: str) -> str:
    """CTE ``cleaned`` (row id, t): the whole cleaning, step by step."""
    strip = r"regexp_replace(nfc_normalize(t), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g')"
    return rf"""masked as (select {row_id}, {_mask(strip)} as t from {source}), {collapse_sql('masked', row_id)},
 cleaned as (select {row_id}, trim(regexp_replace({_arabic('t')}, '[{_WS}]+', ' ', 'g'), ' ') as t from collapsed)"""


_TEXT_SOURCE = f"src as (select text_id, text_content as t from ({TEXTS}))"


@query("collapse_repeats", f"with {_TEXT_SOURCE}, {collapse_sql('src', 'text_id')} select text_id, t as collapsed from collapsed")
def _(fx):
    return fx.sql(TEXTS).select("text_id", X.collapse_repeats(F.col("text_content")).alias("collapsed"))


@text_query("normalize_arabic", _arabic("t") + " as normalized")
def _(t):
    return [X.normalize_arabic(t).alias("normalized")]


@text_query("strip_zero_width",
            r"regexp_replace(t, '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g') as stripped",
            # marks planted between and after the words
            "select text_id, concat(replace(text_content, ' ', concat(' ', chr_mark)), chr_mark) as text_content from "
            "(select *, '\u200b\u202e\u2066\ufeff' as chr_mark from (" + TEXTS + "))")
def _(t):
    return [X.strip_zero_width(t).alias("stripped")]


@text_query("squeeze_whitespace", f"trim(regexp_replace(t, '[{_WS}]+', ' ', 'g'), ' ') as squeezed")
def _(t):
    return [X.squeeze_whitespace(t).alias("squeezed")]


_UP, _FLAT, _DOWN = (f"length(regexp_replace(t, '[^{e}]', '', 'g'))" for e in (
    vocab.EMOJI_POSITIVE, vocab.EMOJI_NEUTRAL, vocab.EMOJI_NEGATIVE))
_POLARITY = f"case when {_UP} + {_FLAT} + {_DOWN} > 0 then {rd(f'({_UP} - {_DOWN}) / ({_UP} + {_FLAT} + {_DOWN})', 4)} else 0 end"


@text_query("emoji_polarity", _POLARITY + r""" as polarity,
 cast(length(regexp_replace(t, '[^\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f000}-\x{1f0ff}]', '', 'g')) as bigint) as n_emoji""")
def _(t):
    return [X.emoji_polarity(t).alias("polarity"), F.size(X.extract_emojis(t)).alias("n_emoji")]


@query("emoji_polarity_rollup", f"""with p as (select text_id % 12 as pool, {_POLARITY} as polarity
  from (select text_id, text_content as t from ({TEXTS})))
 select pool, count(*) as n_texts, {rd('sum(cast(round(polarity * 10000) as bigint)) / 10000.0 / count(*)', 4)} as avg_emoji_polarity
 from p group by 1""")
def _(fx):
    pooled = fx.sql(TEXTS).withColumn("pool", F.col("text_id") % 12)
    return S.emoji_polarity_rollup(pooled, ["pool"])


@query("preprocess_text", f"with {_TEXT_SOURCE}, {clean_sql('src', 'text_id')} select text_id, t as clean from cleaned")
def _(fx):
    return fx.sql(TEXTS).select("text_id", X.preprocess_text(F.col("text_content")).alias("clean"))


_AR = r"len(regexp_extract_all(t, '[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}]'))"
_LA = "len(regexp_extract_all(t, '[a-zA-Z]'))"


@query("script_ratios", f"""select text_id, case when {_AR} + {_LA} > 0 then {rd(f'{_AR} / ({_AR} + {_LA})', 4)} else 0 end as arabic_ratio,
 case when {_AR} + {_LA} > 0 then {rd(f'{_LA} / ({_AR} + {_LA})', 4)} else 0 end as latin_ratio
 from (select text_id, text_content as t from ({TEXTS}))""")
def _(fx):
    rated = X.with_script_ratios(fx.sql(TEXTS), "text_content")
    return rated.select("text_id", *[round_dp(c, 4).alias(c) for c in ("arabic_ratio", "latin_ratio")])


_WORDS = rf"list_transform(regexp_extract_all(t, '[{LATIN}0-9]+'), lambda w: lower(w))"
_SIGNAL = rd(f"least(1.0::double, len(list_filter({_WORDS}, lambda w: list_contains({_list(vocab.TUNISIAN_WORDS)}, w))) * 0.6::double "
             rf"+ len(regexp_extract_all(t, '[{LATIN}][235679]|[235679][{LATIN}]')) * 0.5::double)", 4)
_FR = (f"len(list_filter(list_distinct({_WORDS}), lambda w: list_contains({_list(vocab.FRENCH_HINTS)}, w))) + "
       f"case when regexp_matches(t, '[{vocab.FRENCH_ACCENTS}]') then 1 else 0 end")
_EN = f"len(list_filter(list_distinct({_WORDS}), lambda w: list_contains({_list(vocab.ENGLISH_HINTS)}, w)))"


@text_query("arabizi_signal", _SIGNAL + " as signal")
def _(t):
    return [X.arabizi_signal(t).alias("signal")]


@text_query("heuristic_language", f"""cast({_FR} as bigint) as french, cast({_EN} as bigint) as english,
 case when {_FR} = 0 and {_EN} = 0 then 'other' when {_FR} >= {_EN} then 'fr' else 'en' end as language""")
def _(t):
    fr, en = X.hint_counts(t)
    name = F.when((fr == 0) & (en == 0), "other").when(fr >= en, "fr").otherwise("en")
    return [fr.alias("french"), en.alias("english"), name.alias("language")]


def detect_sql(source: str, row_id: str) -> str:
    """CTE ``detected``: language, confidence and method per text of ``source`` (row id, t)."""
    return rf"""feat as (select {row_id}, t, not regexp_matches(t, '[^{_WS}]') as blank, {_AR} as ar, {_LA} as la,
  {_SIGNAL} as sig, {_FR} as fr, {_EN} as en from {source}),
 detected as (select {row_id}, t,
  case when blank then 'other' when ar + la > 0 and ar / (ar + la) >= 0.4::double and ar >= la then 'ar'
   when la > 0 and sig >= 0.5 then 'aeb-latn'
   when la > 0 and sig > 0 and (en > fr or (fr = 0 and en = 0)) then 'aeb-latn'
   when la > 0 and fr = 0 and en = 0 then 'other' when la > 0 and fr >= en then 'fr' when la > 0 then 'en' else 'other' end as language,
  {rd('''case when blank then 0.0::double when ar + la > 0 and ar / (ar + la) >= 0.4::double and ar >= la then 0.6::double + 0.4::double * (ar / (ar + la))
   when la > 0 and sig >= 0.5 then least(0.99::double, 0.6::double + sig * 0.3::double)
   when la > 0 and sig > 0 and (en > fr or (fr = 0 and en = 0)) then 0.55::double + sig * 0.2::double
   when la > 0 and (fr > 0 or en > 0) then 0.5::double else 0.3::double end''', 4)} as language_confidence,
  case when blank then 'heuristic' when ar + la > 0 and ar / (ar + la) >= 0.4::double and ar >= la then 'script'
   when la > 0 and sig > 0 and (sig >= 0.5 or en > fr or (fr = 0 and en = 0)) then 'arabizi_rule' else 'heuristic' end as language_method
  from feat)"""


@query("detect_language", f"""with src as (select text_id, text_content as t from ({TEXTS})), {detect_sql('src', 'text_id')}
 select text_id, language, language_confidence, language_method from detected""")
def _(fx):
    return X.with_language(fx.sql(TEXTS), "text_content").drop("text_content")


# --- the base detector: learnt on four fifths of the documents, judged on the rest -------------
_GRAM_SQL = f"""texts as (select doc_id, lang, coalesce(text, '') as t, doc_id % 5 = 1 as held_out from documents),
 words as (select doc_id, lang, held_out, word, count(*) as n from (
  select doc_id, lang, held_out, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) as word from texts) group by all),
 grams as (select doc_id, lang, held_out, gram, sum(n) as n from (
  select doc_id, lang, held_out, n, unnest(list_transform(range(1, length(word) + 1), lambda i: (' ' || word || ' ')[i:i + 2])) as gram from words) group by all),
 counts as (select lang as label, gram, cast(sum(n) as bigint) as n from grams where not held_out and lang is not null group by 1, 2),
 sizes as (select label, sum(n) as size, (select count(distinct gram) from counts) as kinds from counts group by 1),
 scored as (select doc_id, s.label, cast(sum(g.n * cast(round(ln((coalesce(c.n, 0) + 1) / cast(size + kinds as double)) * 1000000) as bigint)) as bigint) as score,
   cast(sum(g.n) as bigint) as n_grams
  from grams g join sizes s on true left join counts c on c.label = s.label and c.gram = g.gram where held_out group by 1, 2),
 told as (select doc_id, n_grams, label as base_language, score from scored qualify row_number() over (partition by doc_id order by score desc, label) = 1)"""


def _detector(fx) -> tuple[L.Detector, DataFrame]:
    docs = fx.table("documents")
    held_out = F.col("doc_id") % 5 == 1
    return L.train(materialize(L.gram_counts(docs.filter(~held_out), "lang", "text"), "gram-counts")), docs.filter(held_out)


@query("language_gram_counts", f"with {_GRAM_SQL} select * from counts")
def _(fx):
    return L.gram_counts(fx.table("documents").filter(F.col("doc_id") % 5 != 1), "lang", "text")


@query("base_language", f"with {_GRAM_SQL} select * from told")
def _(fx):
    detector, held_out = _detector(fx)
    return detector.detect(held_out, "doc_id", "text").select("doc_id", "n_grams", "base_language", F.col("base_score").alias("score"))


@query("base_language_accuracy", f"""with {_GRAM_SQL}, src as (select doc_id, t from texts where held_out), {detect_sql('src', 'doc_id')}
 select t.lang, count(*) as n, count(*) filter (told.base_language = t.lang) as hits, count(*) filter (language = t.lang) as hint_hits
 from texts t left join told on told.doc_id = t.doc_id left join detected d on d.doc_id = t.doc_id where t.held_out and t.lang is not null group by 1""")
def _(fx):
    detector, held_out = _detector(fx)
    told = detector.detect(held_out, "doc_id", "text").select("doc_id", "base_language")
    both = X.with_language(held_out, "text").join(told, "doc_id", "left").filter(F.col("lang").isNotNull())
    return both.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("base_language") == F.col("lang")).alias("hits"),
        F.count_if(F.col("language") == F.col("lang")).alias("hint_hits"))


def scored_sql(source: str, row_id: str) -> str:
    """CTE ``scored``: language, sentiment and score per text of ``source`` (row id, t)."""
    return rf"""{detect_sql(source, row_id)},
 {clean_sql(source, row_id)},
 w as (select d.*, c.t as clean, regexp_extract_all(lower(c.t), '[\p{{L}}\p{{N}}]+') as tok from detected d join cleaned c using ({row_id})),
 n as (select *, len(list_filter(tok, lambda x: list_contains({_list(vocab.POSITIVE_WORDS)}, x)))
   + length(regexp_replace(clean, '[^{vocab.EMOJI_POSITIVE}]', '', 'g')) as up,
  len(list_filter(tok, lambda x: list_contains({_list(vocab.NEGATIVE_WORDS)}, x)))
   + length(regexp_replace(clean, '[^{vocab.EMOJI_NEGATIVE}]', '', 'g')) as down from w),
 scored as (select {row_id}, language, language_confidence, language_method, {_POLARITY} as emoji_polarity,
  case when up > down then 'positive' when up < down then 'negative' else 'neutral' end as sentiment,
  case when up = down then 0.5::double else {rd('greatest(up, down) / (up + down)', 4)} end as sentiment_score,
  'lexicon' as model_name, 'lexicon-1.0' as model_version, language = 'aeb-latn' as needs_arabizi_specialist from n)"""


@query("score_sentiment", f"""with src as (select text_id, coalesce(text_content, '') as t from ({TEXTS})), {scored_sql('src', 'text_id')}
 select * from scored""")
def _(fx):
    return S.score_sentiment(fx.sql(TEXTS)).drop("text_content")


_LABEL_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.DATASET_LABELS.items()) + "}"
_RAW_LABELS = """select comment_id, case comment_id % 9 when 0 then ' POS ' when 1 then 'Neg' when 2 then '2' when 3 then '-1'
 when 4 then 'mixed' when 5 then 'unheard' when 6 then null when 7 then 'LABEL_2' else sentiment end as raw from fx_day_sentiment"""


@query("normalize_sentiment_label", f"select comment_id, {_LABEL_MAP}[lower(trim(raw))] as label from ({_RAW_LABELS})")
def _(fx):
    return fx.sql(_RAW_LABELS).select("comment_id", X.normalize_dataset_label(F.col("raw")).alias("label"))


@query("net_sentiment_score", """select comment_id, cast(case sentiment when 'positive' then 1 when 'neutral' then 0
 when 'negative' then -1 end as bigint) as net from fx_day_sentiment""")
def _(fx):
    return fx["fx_day_sentiment"].select("comment_id", X.net_sentiment_score(F.col("sentiment")).alias("net"))


# keywords out of the documents' own words, blanks among them
_KEYWORDS = "select doc_id, concat(source, ',  ,', lang, ',', source, 'x,', lang) as joined from documents"


@query("label_from_keywords", f"""select doc_id, array_to_string(list_filter(string_split(joined, ','), lambda w: trim(w) <> '')[1:3], ' / ')
 as label from ({_KEYWORDS})""")
def _(fx):
    return fx.sql(_KEYWORDS).select("doc_id", X.label_from_keywords(F.split("joined", ",")).alias("label"))


@query("truncate_trace", """select doc_id, case when length(text) > 2000 then left(text, 2000) || '...' else text end as trace,
 length(text) > 2000 as truncated from documents""")
def _(fx):
    cut, flag = X.truncate_trace(F.col("text"))
    return fx.table("documents").select("doc_id", cut.alias("trace"), flag.alias("truncated"))


@query("round_dp", f"select comment_id, {rd('sentiment_score * 1.005::double', 2)} as two, {rd('sentiment_score / 7', 4)} as four from fx_day_sentiment")
def _(fx):
    s = F.col("sentiment_score")
    return fx["fx_day_sentiment"].select("comment_id", round_dp(s * 1.005, 2).alias("two"), round_dp(s / 7, 4).alias("four"))


# model replies in all the shapes seen, around words of the documents
_REPLIES = """select doc_id, case doc_id % 6
 when 0 then concat('["', lang, '", "', source, '", "', lang, '", 7]')
 when 1 then concat('```json\n["', source, ' one", "two"]\n```')
 when 2 then concat('{"captions": ["', source, '", "b"]}')
 when 3 then concat('Sure! Here: ["', source, '", "x"] enjoy')
 when 4 then concat('1. First ', source, '\n2) "Second"\n- Third\n\n* Third')
 else '' end as reply from documents"""


@query("parse_variants", f"""select doc_id, case doc_id % 6 when 0 then lang || '|' || source when 1 then source || ' one|two'
 when 2 then source || '|b' when 3 then source || '|x' when 4 then 'First ' || source || '|Second|Third' else '' end as variants
 from documents""")
def _(fx):
    replies = fx.sql(_REPLIES)
    return replies.select("doc_id", F.array_join(X.parse_variants(F.col("reply")), "|").alias("variants"))


# --- time and number texts -------------------------------------------------------------------
_STAMPS = """select event_id, case event_id % 7 when 0 then concat('2024-01-0', cast(event_id % 9 + 1 as string), 'T10:00:00Z')
 when 1 then concat('2024-01-0', cast(event_id % 9 + 1 as string), 'T23:30:00+0300') when 2 then '2024-02-30T00:00:00Z'
 when 3 then concat('2024-01-1', cast(event_id % 10 as string), ' 08:15:00') when 4 then concat('2024-03-1', cast(event_id % 10 as string))
 when 5 then 'soon' else concat('2024-01-0', cast(event_id % 9 + 1 as string), 'T10:00:00.250000-05:00') end as stamp from events"""
_STAMP_UTC = """case event_id % 7 when 0 then try_cast(replace(stamp, 'Z', '') as timestamp)
 when 1 then try_cast(left(stamp, 19) as timestamp) - interval 3 hour when 3 then {naive} when 4 then {naive}
 when 6 then try_cast(left(stamp, 26) as timestamp) + interval 5 hour end"""


@query("parse_iso_dt", f"""select event_id, {_STAMP_UTC.format(naive='try_cast(stamp as timestamp)')} as parsed
 from ({_STAMPS})""")
def _(fx):
    return fx.sql(_STAMPS).select("event_id", T.parse_iso_dt(F.col("stamp")).alias("parsed"))


_TUNIS = "timezone('UTC', timezone('Africa/Tunis', try_cast(stamp as timestamp)))"


@query("parse_timestamp_local", f"""select event_id, {_STAMP_UTC.format(naive=_TUNIS)} as parsed from ({_STAMPS})""")
def _(fx):
    return fx.sql(_STAMPS).select("event_id", T.parse_timestamp_local(F.col("stamp")).alias("parsed"))


_NUMBERS = """select event_id, case event_id % 8 when 0 then cast(event_id as string) when 1 then concat(cast(event_id as string), '.7')
 when 2 then concat('-', cast(event_id as string), '.9') when 3 then 'abc' when 4 then '' when 5 then '1.5e3' when 6 then ' 42 '
 else null end as raw from events"""


@query("to_int", f"select event_id, cast(trunc(try_cast(nullif(trim(raw), '') as double)) as bigint) as parsed from ({_NUMBERS})")
def _(fx):
    return fx.sql(_NUMBERS).select("event_id", T.to_int(F.col("raw")).alias("parsed"))


_DURATIONS = """select event_id, case event_id % 6 when 0 then concat('PT', cast(event_id % 60 as string), 'S')
 when 1 then concat('PT', cast(event_id % 9 as string), 'M30S') when 2 then 'PT2H' when 3 then 'PT' when 4 then 'P1D'
 else concat('PT1H', cast(event_id % 60 as string), 'M', cast(event_id % 59 as string), 'S') end as duration from events"""


@query("iso_duration_seconds", f"""select event_id, case event_id % 6 when 0 then event_id % 60 when 1 then event_id % 9 * 60 + 30
 when 2 then 7200 when 5 then 3600 + event_id % 60 * 60 + event_id % 59 end as seconds from ({_DURATIONS})""")
def _(fx):
    return fx.sql(_DURATIONS).select("event_id", T.iso_duration_seconds(F.col("duration")).alias("seconds"))


_LOCAL = "timezone('Africa/Tunis', timezone('UTC', published_at))"


@query("local_dow_hour", f"""select post_id, cast(isodow({_LOCAL}) - 1 as bigint) as day_of_week, cast(hour({_LOCAL}) as bigint) as hour
 from fx_timed_posts""")
def _(fx):
    return fx["fx_timed_posts"].select("post_id", T.local_dow(F.col("published_at")).alias("day_of_week"),
                                       T.local_hour(F.col("published_at")).alias("hour"))


# --- sentiment rollups -----------------------------------------------------------------------
_NET = "case sentiment when 'positive' then 1 when 'negative' then -1 else 0 end"


def _dist(keys: str, source: str) -> str:
    c = {s: f"count(*) filter (sentiment = '{s}')" for s in vocab.SENTIMENTS}
    pct = ", ".join(f"{rd(f'{n} / count(*) * 100')} as {s}_pct" for s, n in c.items())
    counts = ", ".join(f"{n} as {s}" for s, n in c.items())
    return (f"select {keys}, count(*) as total, {counts}, {pct}, "
            f"{rd(f'sum({_NET}) / count(*)', 4)} as net_sentiment from {source} group by all")


@query("sentiment_distribution", _dist("account_id", "fx_day_sentiment"))
def _(fx):
    return S.sentiment_distribution(fx["fx_day_sentiment"])


@query("sentiment_by_language", _dist("account_id, '*' as language", "fx_day_sentiment") + " union all "
       + _dist("account_id, coalesce(language, 'unknown') as language", "fx_day_sentiment"))
def _(fx):
    return S.sentiment_by_language(fx["fx_day_sentiment"])


@query("sentiment_trend", f"""select account_id, cast(published_at as date) as day, count(*) as n,
 {rd(f'sum({_NET}) / count(*)', 4)} as net_sentiment from fx_day_sentiment group by 1, 2""")
def _(fx):
    return S.sentiment_trend(fx["fx_day_sentiment"])


def _side(name: str, low: str, high: str) -> str:
    return f"""{name} as (select account_id, {rd(f'sum({_NET}) / count(*)', 4)} as net,
  {rd("count(*) filter (sentiment = 'negative') / count(*) * 100")} as neg from fx_day_sentiment
  where published_at >= {low} and published_at < {high} group by 1)"""


@query("sentiment_deltas", f"""with {_side('c', E_SINCE, E_UNTIL)}, {_side('p', E_PREV, E_SINCE)}
 select account_id, c.net as cur_net, p.net as prev_net, c.neg as cur_negative_pct, p.neg as prev_negative_pct,
  {rd('c.net - p.net', 4)} as net_sentiment_delta, {rd('c.neg - p.neg', 4)} as negative_pct_delta
 from c full join p using (account_id)""")
def _(fx):
    return S.sentiment_deltas(fx["fx_day_sentiment"], EVENTS_AS_OF, "14d")


_A_UNTIL, _A_SINCE, _ = bounds(EVENTS_AS_OF, "30d")


NEGATIVE_ALERTS = f"""with d as (select account_id, cast(published_at as date) as day, count(*) as n_comments,
  {rd("count(*) filter (sentiment = 'negative') / count(*)", 4)} as negative_share from fx_day_sentiment
  where published_at >= {_A_SINCE} and published_at < {_A_UNTIL} group by 1, 2),
 t as (select account_id, avg(negative_share) + 2 * stddev_pop(negative_share) as threshold from d group by 1 having count(*) >= 2)
 select d.account_id, d.day, d.negative_share, d.n_comments from d join t on t.account_id = d.account_id
 where negative_share > threshold and n_comments >= 10"""


@query("negative_alerts", NEGATIVE_ALERTS)
def _(fx):
    return S.negative_alerts(fx["fx_day_sentiment"], EVENTS_AS_OF, "30d")


@query("recent_negatives", f"""select account_id, row_number() over (partition by account_id order by published_at desc, comment_id desc) as rank,
 comment_id, text_content, language, {rd('sentiment_score', 4)} as score, published_at from fx_day_sentiment
 where sentiment = 'negative' and published_at >= {E_SINCE} and published_at < {E_UNTIL} qualify rank <= 20""")
def _(fx):
    return S.recent_negatives(fx["fx_day_sentiment"], EVENTS_AS_OF, "14d", 20)


# --- topics ----------------------------------------------------------------------------------
_ROLLUP = f"""rolled as (select account_id, cluster_id, count(*) as comment_count, count(sentiment) as n_labeled,
  case when count(sentiment) > 0 then {rd(f"sum({_NET}) filter (sentiment is not null) / count(sentiment)", 4)} end as avg_sentiment,
  sum(count(*)) over (partition by account_id) as docs from assigned group by 1, 2),
 topics as (select account_id, cluster_id, comment_count, n_labeled, avg_sentiment from rolled
  where docs >= 20 and cluster_id <> -1 and comment_count >= 3)"""


# account 9 has only the first comments: too few for topics
_FEW = f"{ASSIGNED} union all select comment_id, cast(9 as bigint) as account_id, published_at, text_content, language, sentiment, cluster_id from ({ASSIGNED}) x where comment_id < 10"


@query("topic_rollup", f"""with assigned as ({_FEW}), {_ROLLUP} select *, cast(null as varchar) as reason from topics
 union all select account_id, null, null, null, null, 'insufficient_data' from rolled group by 1 having max(docs) < 20""")
def _(fx):
    return TP.topic_rollup(fx.sql(_FEW))


@query("list_topics", f"""with assigned as ({ASSIGNED}), {_ROLLUP}
 select *, cast(null as varchar) as reason, row_number() over (partition by account_id order by comment_count desc nulls last, cluster_id) as rank
 from topics qualify rank <= 4""")
def _(fx):
    return TP.list_topics(TP.topic_rollup(fx.sql(ASSIGNED)), limit=4)


_T_UNTIL, _T_SINCE, _ = bounds(EVENTS_AS_OF, "20d")
_DISCOVERED = f"""assigned as (select * from ({_FEW}) where published_at >= {_T_SINCE} and published_at < {_T_UNTIL}
  and trim(text_content, ' ' || chr(10) || chr(9) || chr(13)) <> ''),
 {_ROLLUP},
 src as (select comment_id * 10 + account_id as text_id, text_content as t from assigned), {clean_sql('src', 'text_id')},
 words as (select account_id, cluster_id, unnest(regexp_extract_all(lower(c.t), '\\p{{L}}[\\p{{L}}\\p{{N}}]+')) as word
  from assigned a join cleaned c on c.text_id = a.comment_id * 10 + a.account_id where cluster_id <> -1),
 counts as (select account_id, cluster_id, word, count(*) as n from words group by all),
 weighed as (select account_id, cluster_id, word, n / sum(n) over (partition by account_id, cluster_id)
   * ln(1 + (select sum(n) / count(distinct cluster_id) from counts d where d.account_id = c.account_id)
    / sum(n) over (partition by account_id, word)) as score from counts c),
 best as (select account_id, cluster_id, list(word order by score desc, word) as found
  from (select * from weighed qualify row_number() over (partition by account_id, cluster_id order by score desc, word) <= 8) group by 1, 2)"""


def _discovered(fx, keep_all=materialize):
    keep = lambda df: fx.sql(_FEW).select("comment_id", "account_id", "cluster_id").join(df, ["comment_id", "account_id"])
    comments = fx.sql(_FEW).drop("cluster_id")
    return TP.discover_topics(comments, EVENTS_AS_OF, "20d", keep, keep=keep_all)


@query("discover_topics", f"""with {_DISCOVERED}
 select t.*, cast(null as varchar) as reason, array_to_string(b.found, ' ') as keywords, array_to_string(b.found[1:3], ' / ') as label,
  cast(max(r.docs) as bigint) as n_docs
 from topics t join best b using (account_id, cluster_id) join rolled r on r.account_id = t.account_id group by all
 union all select account_id, null, null, null, null, 'insufficient_data', '', 'unlabeled', cast(max(docs) as bigint) from rolled
 group by 1 having max(docs) < 20""")
def _(fx):
    topics, _ = _discovered(fx)
    return topics.withColumn("keywords", F.coalesce(F.array_join("keywords", " "), F.lit("")))


@query("discover_topic_links", f"""with {_DISCOVERED} select a.account_id, a.comment_id, t.cluster_id as topic_id
 from assigned a left join topics t on t.account_id = a.account_id and t.cluster_id = a.cluster_id""")
def _(fx):
    _, links = _discovered(fx, lambda df, name: materialize(df, name) if name == "topic-input" else df)
    return links.select("account_id", "comment_id", "topic_id")


@query("fit_topics")
def _(fx):
    comments = fx["fx_comments"].select("comment_id", "account_id", "text_content", "sentiment")
    assigned, keywords = TP.fit_topics(materialize(comments, "topic-input"), k=5, max_iter=5)
    rolled = TP.topic_rollup(assigned, keywords)
    return rolled.withColumn("keywords", F.array_join("keywords", " "))


@query("density_clusters")
def _(fx):
    rows = fx.spark.read.parquet(f"{fx.sf_dir}/embeddings.parquet").filter("vec_id is not null and embedding is not null")
    return density.clusters(rows, 8, 4, levels=6, row_id="vec_id", vector="embedding").withColumnRenamed("id", "vec_id")


@query("density_topics")
def _(fx):
    comments = materialize(fx["fx_comments"].select("comment_id", "account_id", "text_content", "sentiment"), "topic-input")
    vectors = fx.spark.read.parquet(f"{fx.sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("comment_id"), F.col("embedding").alias("vector"))
    assigned = materialize(TP.density_topics(comments, vectors, min_size=5, min_samples=3, levels=6), "density-topics")
    return TP.topic_rollup(assigned, TP.topic_keywords(assigned)).withColumn("keywords", F.array_join("keywords", " "))


# --- evaluation ------------------------------------------------------------------------------
# truth from the fixture, a rule as prediction
PAIRS = """select comment_id, language, sentiment as y_true, case when comment_id % 5 in (0, 1, 2) then sentiment
 when comment_id % 5 = 3 then 'negative' when comment_id % 35 = 4 then 'strange' else 'neutral' end as y_pred
 from (select comment_id, coalesce(language, 'unknown') as language, sentiment from fx_day_sentiment
 union all select comment_id + 1000000000, language, sentiment from fx_comments where sentiment is not null)"""
_LABELS = "(values ('positive'), ('neutral'), ('negative'))"


def class_sql(keys: str = "") -> str:
    """CTE ``cls``: rounded class metrics by joining every label with every pair."""
    k = f"{keys}, " if keys else ""
    return f"""tally as (select {k}l.label, count(*) filter (y_true = label and y_pred = label) as tp,
  count(*) filter (y_true <> label and y_pred = label) as fp, count(*) filter (y_true = label and y_pred <> label) as fn,
  count(*) filter (y_true = y_pred) as hits, count(*) as n from pairs cross join {_LABELS} l(label) group by all),
 pr as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from tally),
 cls as (select {k}label, {rd('p', 4)} as precision, {rd('r', 4)} as recall,
  case when p + r > 0 then {rd('2 * p * r / (p + r)', 4)} else 0 end as f1, tp + fn as support, hits, n from pr)"""


_CONFUSION = f"""select t.label as true_label, p.label as predicted_label, count(pairs.comment_id) as n
 from {_LABELS} t(label) cross join {_LABELS} p(label) left join pairs on y_true = t.label and y_pred = p.label group by 1, 2"""
_MACRO = rd("sum(cast(round(f1 * 10000) as bigint)) / 10000.0 / 3", 4)


@query("confusion_matrix", f"with pairs as ({PAIRS}) {_CONFUSION}")
def _(fx):
    return E.confusion_matrix(fx.sql(PAIRS))


@query("per_class_metrics", f"with pairs as ({PAIRS}), {class_sql()} select label, precision, recall, f1, support from cls")
def _(fx):
    return E.per_class_metrics(fx.sql(PAIRS))


@query("macro_f1", f"with pairs as ({PAIRS}), {class_sql()} select {_MACRO} as macro_f1 from cls")
def _(fx):
    return E.macro_f1_accuracy(fx.sql(PAIRS)).select("macro_f1")


@query("accuracy", f"with pairs as ({PAIRS}) select {rd('count(*) filter (y_true = y_pred) / count(*)', 4)} as accuracy, count(*) as support from pairs")
def _(fx):
    return E.macro_f1_accuracy(fx.sql(PAIRS)).select("accuracy", "support")


@query("per_language_f1", f"""with pairs as ({PAIRS}), {class_sql('language')} select language, {_MACRO} as macro_f1,
 {rd('max(hits) / max(n)', 4)} as accuracy, max(n) as support from cls group by 1""")
def _(fx):
    return E.per_language_f1(fx.sql(PAIRS))


@query("eval_summary", f"""with pairs as ({PAIRS}), {class_sql()}, conf as ({_CONFUSION})
 select 'macro_f1' as section, null as label, null as other, {_MACRO} as value from cls
 union all select 'accuracy', null, null, {rd('max(hits) / max(n)', 4)} from cls
 union all select 'precision', label, null, precision from cls union all select 'recall', label, null, recall from cls
 union all select 'f1', label, null, f1 from cls union all select 'support', label, null, cast(support as double) from cls
 union all select 'confusion', true_label, predicted_label, cast(n as double) from conf""")
def _(fx):
    return E.eval_summary(fx.sql(PAIRS))


@query("class_weights", f"""with pairs as ({PAIRS}), g as (select l.label, count(comment_id) as n
  from {_LABELS} l(label) left join pairs on y_true = l.label group by 1)
 select label, n, case when n > 0 then {rd('(select sum(n) from g) / ((select count(*) from g where n > 0) * n)', 4)} else 1 end as weight from g""")
def _(fx):
    return E.class_weights(fx.sql(PAIRS), "y_true")


@query("stratified_split", """with r as (select comment_id, sentiment, row_number() over (partition by sentiment
  order by md5('42|' || cast(comment_id as varchar))) as rn, count(*) over (partition by sentiment) as n from fx_day_sentiment)
 select comment_id, sentiment, case when rn <= floor(n * 0.7::double) then 'train'
  when rn <= floor(n * 0.7::double) + floor(n * 0.1::double) then 'val' else 'test' end as split from r""")
def _(fx):
    rows = fx["fx_day_sentiment"].select("comment_id", "sentiment")
    return E.stratified_split(rows, "sentiment", "comment_id")


# --- a classifier learnt from labelled comments scores the others -------------------------------
_LEARNT = f"""src as (select comment_id, coalesce(text_content, '') as t from fx_comments where sentiment is not null), {clean_sql('src', 'comment_id')},
 words as (select comment_id, word, count(*) as n from (
  select comment_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) as word from cleaned) group by 1, 2),
 counts as (select sentiment as label, word, count(*) as texts, sum(n) as n from words join fx_comments using (comment_id) where comment_id % 5 <> 2 group by 1, 2),
 sizes as (select label, sum(n) as size, (select count(distinct word) from counts) as kinds from counts group by 1),
 scores as (select comment_id, s.label, sum(w.n * cast(round(ln((coalesce(c.n, 0) + 1) / cast(size + kinds as double)) * 1000000) as bigint)) as score
  from words w join sizes s on true left join counts c on c.label = s.label and c.word = w.word where comment_id % 5 = 2 group by 1, 2),
 told as (select comment_id, label from scores qualify row_number() over (partition by comment_id order by score desc, label) = 1),
 pairs as (select comment_id, coalesce(language, 'unknown') as language, sentiment as y_true, coalesce(label, 'neutral') as y_pred
  from fx_comments left join told using (comment_id) where sentiment is not null and comment_id % 5 = 2)"""


def _model_scored(fx) -> DataFrame:
    """Analyses of held-out comments, stored as the scoring job stores them, with their true labels."""
    comments = fx["fx_comments"].filter(F.col("sentiment").isNotNull())
    held_out = F.col("comment_id") % 5 == 2
    known = comments.filter(~held_out).withColumn("clean", X.preprocess_text(F.coalesce("text_content", F.lit(""))))
    model = L.train(materialize(L.gram_counts(known, "sentiment", "clean", unit="word"), "word-counts"), unit="word")
    scored = S.score_sentiment(comments.filter(held_out).select("comment_id", "text_content"), L.classifier(model, "comment_id"))
    stored = materialize(scored.select("comment_id", "sentiment", "sentiment_score", "model_name", "model_version"), "analyses")
    return stored.select("comment_id", F.col("sentiment").alias("y_pred"), "model_name").join(
        comments.select("comment_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.col("sentiment").alias("y_true")), "comment_id")


@query("model_sentiment", f"with {_LEARNT} select comment_id, language, y_true, y_pred, 'naive-bayes' as model_name from pairs")
def _(fx):
    return _model_scored(fx)


@query("model_sentiment_f1", f"""with {_LEARNT}, {class_sql('language')} select language, {_MACRO} as macro_f1,
 {rd('max(hits) / max(n)', 4)} as accuracy, max(n) as support from cls group by 1""")
def _(fx):
    return E.per_language_f1(_model_scored(fx))


@query("train_sentiment")
def _(fx):
    rows = fx["fx_comments"].filter(F.col("sentiment").isNotNull()).select(
        "comment_id", "text_content", "language", F.col("sentiment").alias("label"))
    _, scored = E.train_sentiment(materialize(rows, "training-input"), max_iter=10, features=1 << 14)
    return E.per_language_f1(scored)
