"""Quality rules with thresholds that each language and source sets for itself.

One pass counts words, symbols, repeated lines and repeated windows of every whole text. The shares
made of them go into quantile sketches: counts of logarithmic buckets of whole numbers, at most one
part in 32 wide. Sketches merge by adding counts, in any order, so a source's, a language's and the
corpus's come from one aggregation, and a rerun gives the same thresholds. A hot source is added up
before it is shuffled. The cut of a share is its upper quartile plus ``FENCE`` times the distance of
the quartiles (or a least distance, so that a uniform source doesn't reject what is merely unusual);
mean word length also has a lower cut. A source with under ``FEWEST`` documents uses its language's
sketch, a small language the corpus's.

Null and empty texts count zero words and fail the base rule. Null languages and sources are groups
of their own. Repeated rows count, and are judged, each. Very long texts are counted whole; an empty
table gives no rows. Other columns are left aside.

All of it is DataFrame expressions; work on the words of one text stays inside its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import stored

FENCE = 3
FEWEST = 50
# share: what it is of, in millionths (word length: thousandths of a character); least distance of the quartiles
SHARES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, 20_000),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, 200_000),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, 100_000),
    "length": ("word_chars", "n_words", 1_000, 2_000),
}
_BLANKS = " \t\n\u000b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not wherever a lambda names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that stand twice or more.

    Hashes tell whether any window may repeat; only then are the windows themselves sorted.
    """
    places = F.sequence(F.lit(0), F.size(words) - 5)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(places, lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))

    def exact(sorted_: Column) -> Column:
        same = lambda j: F.coalesce(
            (F.get(sorted_, j)["w"] == F.get(sorted_, j - 1)["w"]) | (F.get(sorted_, j)["w"] == F.get(sorted_, j + 1)["w"]),
            F.get(sorted_, j)["w"] == F.get(sorted_, j + 1)["w"], F.get(sorted_, j)["w"] == F.get(sorted_, j - 1)["w"])
        repeated = F.transform(F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), same), lambda j: F.get(sorted_, j)["i"])
        return F.aggregate(
            F.sort_array(repeated), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
            lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(acc["upto"], i)).alias("n"), (i + 5).alias("upto")),
            lambda acc: acc["n"])

    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[at(i, k) for k in range(5)]).alias("w"), i.alias("i")))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 6, 0).otherwise(F.when(some, let(F.sort_array(windows), exact)).otherwise(0))


def base(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(whole, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.trim(x, F.lit(_BLANKS)) != "")
    size = F.length(whole)
    word_facts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    line_facts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    own = docs.select(
        *keep, word_facts.alias("_w"), line_facts.alias("_l"),
        F.length(F.translate(whole, _BLANKS, "")).alias("word_chars"),
        (size - F.length(F.translate(whole, "#*$%&|<>", ""))).alias("n_symbols"))
    return own.select(
        *keep, F.col("_w.n").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.col("_l.n").cast("long").alias("n_lines"), F.col("_l.d").cast("long").alias("n_dup_lines"), F.col("_w.r").cast("long").alias("n_repeat_words"))


def bucket(v: Column) -> Column:
    """Number of the bucket of a whole number: itself below 64, then 32 buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", v, shift)).cast("long")


def upper_end(b: Column) -> Column:
    """The largest number of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift * 32 + 1, shift) - 1


def shares(counts: DataFrame) -> DataFrame:
    """The counts with the share columns; a share of nothing is 0."""
    return counts.withColumns({
        name: F.when(F.col(of) > 0, F.floor(F.col(what) * unit / F.col(of))).otherwise(0).cast("long")
        for name, (what, of, unit, _) in SHARES.items()})


def sketch(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, share, bucket, n."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), bucket(F.col(s)).alias("bucket")) for s in SHARES])).alias("s")
    return shares(counts).select(*keys, each).select(*keys, "s.*").groupBy(*keys, "share", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, share, n, low and high quartile. A sketch has some hundred buckets at most."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys, "share")
    upto = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    end = upper_end(F.col("bucket"))
    return upto.groupBy(*keys, "share").agg(
        F.max("all").alias("n"), F.min(F.when(F.col("upto") * 4 >= F.col("all"), end)).alias("low"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, end)).alias("high"))


def thresholds(sketches: DataFrame, lang: str = "lang", source: str = "source", fewest: int = FEWEST) -> DataFrame:
    """Quartiles that hold for each (lang, source): its own, its language's or the corpus's."""
    at = F.struct("n", "low", "high")
    own = quartiles(sketches, lang, source).select(lang, source, "share", at.alias("a"))
    by_lang = quartiles(merge(sketches, lang), lang).select(F.col(lang).alias("_lang"), F.col("share").alias("_share"), at.alias("b"))
    whole = quartiles(merge(sketches)).select("share", at.alias("c"))
    both = own.join(by_lang, F.col(lang).eqNullSafe(F.col("_lang")) & (F.col("share") == F.col("_share")), "left").join(whole, "share", "left")
    pick = F.when(F.col("a.n") >= fewest, F.col("a")).when(F.col("b.n") >= fewest, F.col("b")).otherwise(F.col("c"))
    each = both.select(lang, source, "share", pick.alias("at"))
    wide = each.groupBy(lang, source).agg(*[F.max(F.when(F.col("share") == s, F.col("at"))).alias(s) for s in SHARES])
    return wide.select(lang, source, F.struct(*SHARES).alias("at"))


def verdict(limits: Column) -> Column:
    """True if no share lies beyond its cut."""
    good = []
    for name, (_, _, _, least) in SHARES.items():
        low, high = limits[name]["low"], limits[name]["high"]
        reach = FENCE * F.greatest(high - low, F.lit(least))
        good.append(F.col(name) <= high + reach)
        if name == "length":
            good.append(F.col(name) >= low - reach)
    return reduce(lambda a, b: a & b, good)


def judge(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every document."""
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = stored(base(renamed, "doc_id", "lang", "source"), "rule-counts")
    limits = thresholds(stored(sketch(counts, "lang", "source"), "rule-sketches"))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = shares(counts).join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(*counts.columns, failed.alias("base_failed"), (~failed & verdict(F.col("at"))).alias("kept"))
