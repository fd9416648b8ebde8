"""URL verdicts: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The list becomes a Bloom filter of rows (block, four 64-bit words): all bits of a URL lie in one
block, so a URL is tested by one row. Blocks follow from the size of the list (``BITS`` bits a URL),
never from a fixed cap. Pages join the filter by block; only possible hits go on to the exact hash
join with the list, which removes the false positives. Spark's size check decides whether the filter
is broadcast; otherwise the pages are dealt by block, and AQE splits a block that is hot.

Host: what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: what follows
up to ``? #`` or the end. Null, or no ``://``: both are empty, no rule fits, and only a list that
holds such a URL could block it (it doesn't: empty canonical URLs are never listed). Repeated pages
keep their rows; repeated list rows count once; an empty list or page table gives no hit, no row.
Other columns of the pages are left aside.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16  # of the filter for each listed URL
WORDS = 4  # 64-bit words of a block
PROBES = 6  # bits a URL sets in its block

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a page suffix or a last slash, query without tracking.

    Scheme and fragment go. Empty for a URL without a host.
    """
    host = F.regexp_replace(host_of(url), "^(?:www|m)\\.", "")
    path = F.regexp_replace(path_of(url), "(?:/|\\.html?|/index\\.html?)$", "")
    query = F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(?:^|&){_TRACKING}", ""), "^&", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host == "", "").otherwise(whole)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct<size, rule, verdict>; null if none fits.

    A rule's text is a host, a slash and the rest of a path; it fits the host, its subdomains, and the
    paths that start like its own. The rules are configuration: they are part of the plan.
    """
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        good = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        fits.append(F.when(good, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """The words of the block with this key's bits set."""
    places = [F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 10 * i), F.lit(64 * WORDS)).cast("int") for i in range(PROBES)]

    def word(w: int) -> Column:
        own = [F.when(F.floor(p / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)).otherwise(F.lit(0).cast("long")) for p in places]
        out = own[0]
        for x in own[1:]:
            out = out.bitwiseOR(x)
        return out

    return [word(w) for w in range(WORDS)]


def bloom(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """block, w0 .. : the filter of the listed keys. Bits are or-ed before and after the shuffle."""
    own = listed.select(_block(F.col(key), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_bits(F.col(key)))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow",
          page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """page_id, host, path, canonical, rule, verdict, listed of every page.

    ``rules``: (verdict, rule). The longest fitting rule decides; without one a listed URL is blocked,
    any other gets ``default``.
    """
    listed = listed.select(canonical(F.col(listed_url)).alias("canonical")).where("canonical <> ''").distinct()
    blocks = max(1, listed.count() * BITS // (64 * WORDS) + 1)  # one number: the size of the list
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     F.coalesce(canonical(F.col("url")), F.lit("")).alias("canonical"))
    own = own.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("block", _block(F.col("canonical"), blocks))
    tested = own.join(bloom(listed, blocks), "block", "left")
    possible = F.lit(True)
    for i, mask in enumerate(_bits(F.col("canonical"))):
        possible = possible & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    tested = tested.withColumn("possible", F.coalesce(possible, F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])
    hits = tested.where("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(
        tested.where("not possible").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("fits.verdict", F.when(F.col("listed"), "block").otherwise(default))
    return both.select("page_id", "host", "path", "canonical", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "listed")
