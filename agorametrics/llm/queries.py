"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametrics.llm import align, bpe, decontaminate, forest, licenses, negatives, quality, quality_rules, repeats, samples, secret_scan, token_files, toxicity, url_filter
from agorametrics.llm.common import stored, table
from agorametrics.session import configure, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _words(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"select {key}, row_number() over () as row, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from {table}"


ORACLES["op1_decontamination"] = f"""
with d as materialized ({_words('documents', 'doc_id')}), b as materialized ({_words('benchmark', 'item_id')}),
asked as (select distinct item_id, least(10, len(words)) as size,
  array_to_string(words[i:i + least(10, len(words)) - 1], ' ') as win
 from (select *, unnest(range(1, greatest(1, len(words) - 9) + 1)) as i from b where len(words) > 0)),
sizes as (select distinct size from asked),
starts as (select row, size, i, array_to_string(words[i:i + size - 1], ' ') as win
 from (select row, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes where len(words) >= size)),
hits as (select s.row, s.i, s.size, a.item_id from starts s join asked a on a.size = s.size and a.win = s.win),
covered as (select row, count(distinct w) as n_hit
 from (select row, unnest(range(i, i + size)) as w from (select distinct row, i, size from hits)) group by row),
items as (select row, count(distinct item_id) as n_items,
  string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hits group by row)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit,
 coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from d left join covered c on c.row = d.row left join items i on i.row = d.row"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(stored(samples.labelled(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, toxicity.SAMPLE), "toxic-sample"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (samples.fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(samples.labelled(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, quality.SAMPLE))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (samples.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Names of sites whose pages make up the list of URLs.
LISTED_SITES = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(F.regexp_extract(url_filter.host_of(F.col("url")), "([^.]*)\\.example\\.[a-z]*$", 1).isin(LISTED_SITES))
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def _url_sql() -> str:
    host = "translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
    bare = "regexp_replace(host, '^(?:www|m)[.]', '')"
    query = "regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '://[^?#]*[?]([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '', 'g'), '^&', '')"
    names = ", ".join(f"'{n}'" for n in LISTED_SITES)
    cases = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        at = rule.index("/")
        cases.append((f"(host = '{rule[:at]}' or ends_with(host, '.{rule[:at]}')) and starts_with(path, '{rule[at:]}')", rule, verdict))
    return f"""with p as (select page_id, url, {host} as host, {path} as path from pages),
c as (select *, case when {bare} = '' then '' else {bare} || regexp_replace(path, '(?:/|[.]html?|/index[.]html?)$', '')
 || case when {query} <> '' then '?' || {query} else '' end end as canonical from p),
listed as (select distinct canonical from c where canonical <> '' and regexp_extract(host, '([^.]*)[.]example[.][a-z]*$', 1) in ({names})),
j as (select c.*, l.canonical is not null as listed from c left join listed l on l.canonical = c.canonical)
select page_id, host, path, case {' '.join(f"when {w} then '{r}'" for w, r, _ in cases)} end as rule,
 case {' '.join(f"when {w} then '{v}'" for w, _, v in cases)} when listed then 'block' else 'allow' end as verdict, listed from j"""


ORACLES["op2_url_filter"] = _url_sql()


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    of = {s: (what, per, unit, least) for s, (what, per, unit, least) in quality_rules.SHARES.items()}
    share = ", ".join(f"case when {per} > 0 then {what} * {unit} // {per} else 0 end as {s}" for s, (what, per, unit, _) in of.items())
    each = " union all ".join(f"select lang, source, '{s}' as share, {s} as v from s" for s in of)
    end = "case when bucket < 64 then bucket else ((bucket - (bucket // 32 - 1) * 32 + 1) << (bucket // 32 - 1)::int) - 1 end"

    def quartiles(keys: str) -> str:
        by = keys + ", " if keys else ""
        return f"""select {by}share, max(total) as n, min(case when upto * 4 >= total then {end} end) as low,
  min(case when upto * 4 >= total * 3 then {end} end) as high
 from (select *, sum(n) over (partition by {by}share order by bucket) as upto, sum(n) over (partition by {by}share) as total
  from (select {by}share, bucket, count(*) as n from buckets group by all)) group by {by}share"""

    tests = []
    for s, (_, _, _, least) in of.items():
        reach = f"{quality_rules.FENCE} * greatest(high - low, {least})"
        low = f" and v >= low - {reach}" if s == "length" else ""
        tests.append(f"when share = '{s}' then v <= high + {reach}{low}")
    return f"""
with d as materialized (select doc_id, lang, source, row_number() over () as row, coalesce(text, '') as text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
lines as (select row, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
 from (select row, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row),
wins as (select row, i, array_to_string(words[i:i + 4], ' ') as win
 from (select row, words, unnest(range(1, len(words) - 3)) as i from d where len(words) >= 6)),
twice as (select row, i from (select *, count(*) over (partition by row, win) as n from wins) where n > 1),
again as (select row, count(distinct w) as n_repeat_words from (select row, unnest(range(i, i + 5)) as w from twice) group by row),
counts as materialized (select d.row, doc_id, lang, source, cast(len(words) as bigint) as n_words,
 cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
 cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
 from d left join lines l on l.row = d.row left join again a on a.row = d.row),
s as (select *, {share} from counts),
buckets as materialized (select lang, source, share, case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::int) end as bucket from ({each})),
own as ({quartiles('lang, source')}), by_lang as ({quartiles('lang')}), whole as ({quartiles('')}),
limits as (select o.lang, o.source, o.share,
 case when o.n >= {quality_rules.FEWEST} then o.low when b.n >= {quality_rules.FEWEST} then b.low else w.low end as low,
 case when o.n >= {quality_rules.FEWEST} then o.high when b.n >= {quality_rules.FEWEST} then b.high else w.high end as high
 from own o join by_lang b on b.share = o.share and b.lang is not distinct from o.lang join whole w on w.share = o.share),
judged as (select row, bool_and(case {' '.join(tests)} end) as good
 from (select row, lang, source, unnest([{', '.join(f"'{s}'" for s in of)}]) as share, unnest([{', '.join(of)}]) as v from s) x
 join limits l using (share) where l.lang is not distinct from x.lang and l.source is not distinct from x.source group by row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and good as kept
from counts c join judged j on j.row = c.row"""


ORACLES["op7_quality_rules"] = _rules_sql()


@query
def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(table(spark, sf_dir, "documents")).drop("key", "group")


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_sentences", F.array_join("identifiers", ",").alias("sentences"), F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.licence")), ",").alias("licenses"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.tokens(spark, folder))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
with raw as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vec
 from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select * from raw where len(list_filter(vec, lambda x: abs(x) > 67108864)) = 0),
s as materialized (select a.row as a, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as other_id, b.row as b,
  cast(coalesce(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])), 0) as bigint) as score
 from v a, v b where a.vec_id % 100 = 0),
p as (select * from s where same and a <> b qualify row_number() over (partition by a order by score desc, other_id, b) <= 5),
n as (select p.a, p.b, p.anchor_id, p.other_id as positive_id, s.other_id as negative_id, p.score as positive_score, s.score as negative_score, s.b as nb
 from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(row_number() over (partition by a, b order by negative_score desc, negative_id, nb) as integer) as rank,
 negative_id, positive_score, negative_score from n
qualify row_number() over (partition by a, b order by negative_score desc, negative_id, nb) <= 5"""


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.written("base").cast("binary"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"))
