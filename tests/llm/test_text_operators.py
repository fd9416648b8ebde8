"""The operators on small tables, against brute force or the libraries themselves."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agorametrics.llm import bpe, common, components, decontaminate, forest, licenses, quality, quality_rules, repeats, samples, token_files, toxicity, url_filter
from agorametrics.llm.common import release, stored

SF = "/root/testdata/sf0.01"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "Hello  world's   end.\n\n  x", "naïve café 12,345!!", "日本語 text 🙂🙂 ok", "x" * 5000,
       " \t" * 3000, "it's we'll I'D " * 400, "<|endoftext|> <|startoftext|>", "\x00 \x1c a\x1c b", "é É ÀÉ ß ſ İ"]


@pytest.fixture
def docs(spark):
    def make(texts, ids=None, **more):
        rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def prose(seed: int, n: int, words: int = 60) -> list[str]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choices(vocab, k=words)) for _ in range(n)]


def own_encoding():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- 4: byte-level BPE -----------------------------------------------------------------------
def test_bpe_equals_whole_texts_and_comes_back(docs):
    df = docs([*ODD, *ODD], ids=[i % len(ODD) for i in range(2 * len(ODD))], ids_="kept", decoded="old")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    own = own_encoding()
    assert len(out) == 2 * len(ODD) and all(r.ids_ == "kept" for r in out)
    for r in out:
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    once = bpe.encode(df, RANKS, PATTERN, decoded="decoded").collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in once) == sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in out)


def test_bpe_random_texts(docs):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab 1'\n\t 　éß日🙂.,s", k=rng.randint(0, 80))) for _ in range(300)]
    own = own_encoding()
    for r in bpe.encode(docs(texts), RANKS, PATTERN).collect():
        assert r.ids == own.encode_ordinary(r.text)


def test_bpe_empty_table_and_null_ids(empty, spark):
    assert bpe.digests(empty, RANKS, PATTERN).collect() == []
    df = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(bpe.decode(df, RANKS, PATTERN).first().decoded) == b""


# --- 6: token files --------------------------------------------------------------------------
def test_token_files(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*ODD, *prose(1, 60)]
    ids = [None if i == 3 else (7 if i in (4, 5) else 1000 - i) for i in range(len(texts))]
    folder = str(tmp_path / "tokens")
    token_files.write(docs(texts, ids=ids, part="x", offset=1), folder, WORDS)
    own = Tokenizer.from_file(WORDS)
    own.encode_special_tokens = True
    found = token_files.tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    by_id = {}
    for i, t in zip(ids, texts):
        by_id.setdefault(i, []).append(own.encode(t or "", add_special_tokens=False).ids + [1])
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids in by_id[r.doc_id]
        by_id[r.doc_id].remove(r.ids)
        start += r.n_tokens
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.checksums(token_files.tokens(spark, folder)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found}
    narrow = token_files.metadata(spark, folder)
    assert sorted(map(tuple, narrow.collect()), key=lambda r: r[1]) == [(r.doc_id, r.start, r.n_tokens) for r in found]
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString()
    some = token_files.tokens(spark, folder, 950, 970)
    assert {tuple(r) for r in some.select("doc_id", "start").collect()} == {(r.doc_id, r.start) for r in found if r.doc_id and 950 <= r.doc_id <= 970}
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,950)" in some._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("\n", "")


def test_token_files_are_laid_out_as_stated(docs, spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write(docs(prose(2, 200)), folder, WORDS)
    last = None
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".parquet")):
        meta = pq.ParquetFile(f"{folder}/{name}").metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["offset"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            low, high = columns["doc_id"].statistics.min, columns["doc_id"].statistics.max
            assert last is None or low > last
            last = high


def test_token_files_of_nothing(empty, spark, tmp_path):
    token_files.write(empty, str(tmp_path / "t"), WORDS)
    assert token_files.checksums(token_files.tokens(spark, str(tmp_path / "t"))).collect() == []


def test_token_files_are_read_without_a_shuffle_of_their_ids(docs, spark, tmp_path):
    token_files.write(docs(prose(3, 50)), str(tmp_path / "t"), WORDS)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # files too large for Spark to send about by itself
    try:
        found = token_files.checksums(token_files.tokens(spark, str(tmp_path / "t")))
        assert found.count() == 50
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_token_file_chunks_beyond_the_remembered_ones(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE", 5)
    own, plain = token_files.Chunks(WORDS), Tokenizer.from_file(WORDS)
    for words in (["one", "two", "three"], ["three", "two", "fourth", "fifth", "sixth"], ["sixth", "one", "seventh"], []):
        size, first, flat = own.table(pa.array([w.encode() for w in words], pa.binary()))
        assert [flat[f:f + n].tolist() for f, n in zip(first, size)] == [plain.encode(w, add_special_tokens=False).ids for w in words]
        assert len(own.known) <= 5 and own.flat.size == own.size.sum()


# --- 1: decontamination ----------------------------------------------------------------------
def split(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_hits(texts, items, size):
    asked = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            asked.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for t in texts:
        w, hit, who = split(t), set(), set()
        for win, own in asked.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    who |= own
        out.append((len(w), len(hit), sorted(str(i) for i in who if i is not None)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_decontamination_by_brute_force(docs, spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "B", "c,", "É", "7"], k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "...", texts_twice := "a B c, a B c, a b c"] + [texts_twice]
    items = [(i, " ".join(rng.choices(["a", "b", "c", "É", "7"], k=rng.randint(0, 9)))) for i in range(25)] + [(3, "a b c a b"), (None, "b c a b c"), (40, None), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontaminate.decontaminate(docs(texts, item_id=9, segment=1), bench, size=5)
    rows = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_hits(texts, items, 5)


def test_proximity_search_finds_phrases_with_gaps(docs, spark):
    index = stored(decontaminate.build(docs(["one two x three y four", "one two", "three four", "four three two one"])), "t")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate.search(index, items, 4).count() == 0
    near = decontaminate.search(index, items, 4, slop=2).collect()
    assert [(r.starts, r.ends, r["items"]) for r in near] == [([0], [6], ["1"])]
    assert decontaminate.search(index, items, 4, slop=1).count() == 0


def test_decontamination_of_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).collect() == []
    rows = decontaminate.decontaminate(docs(["a b", None]), none).collect()
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in rows) == [(0, 0, []), (2, 0, [])]
    assert decontaminate.decontaminate(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


# --- 2: URLs ---------------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    want = {
        "http://A.example.COM/en/5?x#y": ("a.example.com", "/en/5", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/q": ("x.www.example.com", "/en/q", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://b.net/es/?": ("b.net", "/es/", "net/es/", "block"), "x.net/es/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://a.net?u=http://b.net/es/": ("a.net", "", None, "allow"), "http://b.net#/es/": ("b.net", "", None, "allow")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("block", F.lit(1))
    none = spark.createDataFrame([], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none, rules).collect()}
    assert got == {i: w for i, w in enumerate(want.values())}


def test_listed_urls_are_blocked_exactly(spark):
    listed = [f"https://www.site{i}.org/p/{i}.html?utm_source=q" for i in range(500)] + [None, "nothing", "http://site1.org/p/1"]
    urls = [f"http://m.site{i}.org/p/{i}/#top" for i in range(1000)] * 2 + ["http://site1.org/p/1?id=3", None, "nothing"] + ["http://site2.org/p/2"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), []).collect()
    assert len(out) == len(urls)
    for r in out:
        number = re.fullmatch(r"site(\d+)\.org/p/(\d+)", r.canonical)
        assert r.listed == (r.verdict == "block") == bool(number and int(number[1]) < 500)


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    own = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    blocks = 2000 * url_filter.BITS // 256 + 1
    table = url_filter.bloom(own, blocks)
    other = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("canonical")).unionByName(own)
    tested = other.withColumn("block", url_filter._block(F.col("canonical"), blocks)).join(table, "block", "left")
    hit = F.lit(True)
    for i, mask in enumerate(url_filter._bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    counts = {r.k: r.n for r in tested.where(hit).groupBy(F.left("canonical", F.lit(1)).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert counts["k"] == 2000 and counts.get("o", 0) < 400


def test_urls_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([("http://a/b",)], "url string"), []).collect() == []


# --- 3 and 5: classifiers --------------------------------------------------------------------
def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(samples.labelled(docs, labels, "quality", 3, 1, quality.SAMPLE))
    out = quality.score(docs, model, lines="lines").join(labels, "doc_id").where(samples.fold("doc_id", 3) == 1).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in out) >= 0.98 * len(out) > 50
    assert all(0 <= r.score <= 1 and all(0 <= p <= 1 for p in r.lines) for r in out)


def test_quality_of_odd_texts(docs, empty):
    good = prose(7, 60)[:30]
    bad = [" ".join(w + "$$$" for w in t.split()) for t in prose(7, 60)[30:]]
    sample = docs([*good, *bad, None, ""]).withColumn("y", (F.col("doc_id") < 30).cast("int")).select("text", "y")
    model = quality.fit(sample)
    out = {r.doc_id: r.score for r in quality.score(docs([*ODD, good[0], bad[0], good[0]], score="old"), model).collect()}
    n = len(ODD)
    assert all(0 <= s <= 1 for s in out.values()) and out[n] > 0.9 > 0.1 > out[n + 1] and out[n] == out[n + 2]
    assert out[0] == out[1] == out[2] == out[3] == model.prior
    assert quality.score(empty, model).collect() == []
    for one in (sample.where("y = 1"), sample.limit(0)):
        single = quality.fit(one)
        want = 1.0 if one.count() else 0.5
        assert {r.score for r in quality.score(docs([None, "a b", good[0]]), single).collect()} == {want}


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(samples.labelled(docs, labels, "toxic", 4, 2, toxicity.SAMPLE))
    out = toxicity.score(docs, model).join(labels, "doc_id").where(samples.fold("doc_id", 4) == 2).collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean([p > n for p in pos for n in neg]) > 0.75 and np.mean([s < 0.3 for s in neg]) > 0.95


def test_toxic_sentences_are_located(docs, empty):
    base = prose(9, 180)
    clean = base[:120]
    foul = [t + f". {t[:20]} grumblor{t[3:6].strip()}. " + t[:100] for t in base[120:]]
    sample = docs([*clean, *foul]).withColumn("y", (F.col("doc_id") >= 120).cast("int")).select("text", "y")
    model = toxicity.fit(sample)
    text = "Éa fine start\nWhat a grumblors thing! And on"
    out = {r.doc_id: r for r in toxicity.score(docs([*ODD, text, clean[0], text], score="old", offending=1), model).collect()}
    n = len(ODD)
    assert [text.encode()[s.start:s.end].decode() for s in out[n].offending] == ["What a grumblors thing"]
    assert out[n].score > 0.5 > 0.2 > out[n + 1].score and out[n + 1].offending == [] and out[n].score == out[n + 2].score
    assert all(out[i].score == 0 for i in range(4))
    assert toxicity.score(empty, model).collect() == []
    for one, want in ((sample.where("y = 1"), 1.0), (sample.where("y = 0"), 0.0), (sample.limit(0), 0.0)):
        assert toxicity.score(docs(["a b."]), toxicity.fit(one)).first().score == pytest.approx(want, abs=1e-6)


def _features(word):
    """Features of a word, by their definition."""
    raw = word.encode()
    return {("word", raw), *(("start", raw[:k]) for k in toxicity.STARTS if len(raw) >= k),
            *(("inner", raw[i:i + toxicity.INNER]) for i in range(len(raw) - toxicity.INNER + 1) if len(raw) > toxicity.INNER)}


def test_word_features_are_what_they_are_said_to_be():
    words = ["a", "abcd", "abcdef", "abcdefg", "abcdefgabcdefg", "日本語", "日本語日本語", "donaudampfschiff", "aaaaaaaaaa", "abcdefgh1", "abcdefgh2"]
    features, first = toxicity.features_of(*common.raw(pa.array(words)))
    by_hash = {}
    for w, lo, hi in zip(words, first[:-1], first[1:], strict=True):
        assert len(set(features[lo:hi].tolist())) == hi - lo == len(_features(w))
        for v in words:
            at = words.index(v)
            both = set(features[lo:hi].tolist()) & set(features[first[at]:first[at + 1]].tolist())
            assert len(both) == len(_features(w) & _features(v))
        by_hash |= dict.fromkeys(features[lo:hi].tolist(), w)


def test_scores_equal_the_noisy_or_by_hand(docs):
    """Every sentence's logit is the sum over its words of the weights of their features; the document's score the noisy-or."""
    words = ["grumblor", "grumblors", "plain", "fine", "donaugrumblor", "日本語grumblor"]
    features, first = toxicity.features_of(*common.raw(pa.array(words)))
    keys = np.unique(features)
    weights = np.random.default_rng(1).normal(0, 1, keys.size)
    model = toxicity.Model(keys, weights, -1.5)
    of = {w: weights[np.searchsorted(keys, features[lo:hi])].sum() for w, lo, hi in zip(words, first[:-1], first[1:], strict=True)}
    texts = ["Plain fine grumblor. fine!\nGRUMBLORS plain plain?", "", None, "... !", "donaugrumblor 日本語grumblor fine. plain", "plain " * 3000 + "grumblor"]
    for r in toxicity.score(docs(texts), model).collect():
        none = 1.0
        for sentence in re.split(r"[.!?\n]", texts[r.doc_id] or ""):
            found = sentence.lower().split()
            if found:
                none *= 1 - 1 / (1 + np.exp(min(60, -(model.bias + sum(of[w] for w in found)))))
        assert r.score == pytest.approx(1 - none, abs=1e-9)


def test_words_that_differ_in_the_ninth_byte_are_told_apart(docs):
    base = prose(11, 160)
    texts = [t + (" abcdefghXtail rest" if i % 2 else " abcdefghYtail rest") for i, t in enumerate(base)]
    sample = docs(texts).withColumn("y", (F.col("doc_id") % 2).cast("int")).select("text", "y")
    model = toxicity.fit(sample)
    out = {r.doc_id: r.score for r in toxicity.score(docs(["some abcdefghXtail here", "some abcdefghYtail here", "日本語日本語abcdefghXtail"]), model).collect()}
    assert out[0] > 0.8 > 0.2 > out[1] and out[2] > 0.5


def test_the_bytes_of_a_sample_are_bounded(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('x', 1000) as text", "1 as y")
    labels = spark.range(200).selectExpr("id as doc_id", "1 as toxic")
    assert samples.labelled(docs, labels, "toxic", 4, 2, 1000, most_bytes=20_500).count() == 20
    assert samples.labelled(docs, labels, "toxic", 4, 2, 10).count() == 10


def test_samples_leave_out_the_fold_and_keep_the_bound(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('t', id) as text", "1 as y")
    labels = spark.range(200).selectExpr("if(id % 50 = 49, null, id) as doc_id", "cast(id % 3 as int) as q")
    out = samples.labelled(docs, labels.unionByName(labels), "q", 3, 1, 1000).collect()
    want = {(f"t{i}", i % 3) for i in range(200) if i % 50 != 49 and i % 3 < 2 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert samples.labelled(docs, labels, "q", 3, 1, 7).count() == 7


# --- 7: quality rules ------------------------------------------------------------------------
def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_by_brute_force(docs):
    rng = random.Random(3)
    texts = [*ODD[:8], *ODD[10:], *["".join(rng.choices(["a ", "b ", "c\n", "\t", "# ", "é<"], k=rng.randint(0, 60))) for _ in range(80)]]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality_rules.base(docs(texts), "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == [brute_counts(t) for t in texts]


def test_sketch_buckets_hold_their_numbers(spark):
    numbers = [*range(0, 3000), *[2**k + d for k in range(12, 40) for d in (-1, 0, 1)]]
    df = spark.createDataFrame([(n,) for n in numbers], "v long").withColumn("b", quality_rules.bucket(F.col("v")))
    rows = sorted((r.v, r.b, r.e) for r in df.withColumn("e", quality_rules.upper_end(F.col("b"))).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert all(v <= e <= v + max(0, v // 32) for v, _, e in rows)


def test_thresholds_follow_the_source(spark):
    def rows(source, symbols, n, lang="en"):
        return [(f"{source}{i}", lang, source, " ".join([f"word{source}{i}x{k}" + "#" * symbols for k in range(12)])) for i in range(n)]

    plain, marked = rows("plain", 0, 80), rows("marked", 6, 80)
    odd = [("odd", "en", "plain", marked[0][3]), ("lone", None, None, plain[0][3]), ("none", "en", "plain", None), ("few", "en", "plain", "a b"), ("odd", "en", "plain", marked[0][3])]
    df = spark.createDataFrame([*plain, *marked, *odd], "doc_id string, lang string, source string, text string").withColumn("kept", F.lit("x"))
    out = quality_rules.judge(df).collect()
    assert len(out) == 165
    kept = {r.doc_id: (r.base_failed, r.kept) for r in out}
    assert all(kept[d[0]] == (False, True) for d in [*plain, *marked]) and kept["odd"] == (False, False)
    assert kept["lone"] == (False, True) and kept["none"] == kept["few"] == (True, False)
    assert quality_rules.judge(df.limit(0)).collect() == []


# --- 8: near duplicates ----------------------------------------------------------------------
def near_copies(seed):
    rng = random.Random(seed)
    texts = prose(seed, 12, 80)
    for t in texts[:6]:
        for _ in range(rng.randint(1, 12)):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(50))
            texts.append(" ".join(w))
    return [*texts, texts[0].upper() + "!", "a b", "A, b", "solo", None, "", "...", "", texts[12]]


@pytest.mark.parametrize("members", [forest.MEMBERS, 2])
def test_near_duplicates_by_brute_force(docs, monkeypatch, members):
    monkeypatch.setattr(forest, "MEMBERS", members)
    monkeypatch.setattr(forest, "TILE", 4 if members == 2 else forest.TILE)
    texts = near_copies(11)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in forest.join(docs(texts, key="x", d1=3)).collect()}
    want = forest.brute_force(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 20


def test_large_sets_by_brute_force(docs, monkeypatch):
    monkeypatch.setattr(forest, "SHINGLES", 150)
    texts = near_copies(11)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in forest.join(docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == forest.brute_force(texts)


def test_tiles_are_bounded_by_shingles(spark, monkeypatch):
    """Few classes of large sets: no tile beyond the bound, each pair in one tile, equal nodes once."""
    monkeypatch.setattr(forest, "SHINGLES", 1_000)
    sizes = [(i, -i, 20 + 7 * i % 90) for i in range(60)] + [(60, -60, 2_000)]
    full = spark.createDataFrame([(a, b, b"", list(range(n))) for a, b, n in sizes], "d1 long, d2 long, label binary, shingles array<long>")
    nodes = [(a, b, n, t, 5 + t) for a, b, n in sizes for t in range(4)] + [(a, b, n, 4, 9) for a, b, n in sizes[:30]]
    tiles = {}
    for r in forest._tiles(full, spark.createDataFrame(nodes, "d1 long, d2 long, n long, tree int, node long")).collect():
        tiles.setdefault((r.tree, r.node, r.x, r.y), []).append(r)
    assert {t[:2] for t in tiles} == {(0, 5), (4, 9)}
    assert max(sum(len(r.shingles) for r in rows if r.d1 < 60) for rows in tiles.values()) <= 1_000 + 2 * 110
    pairs = [tuple(sorted((a.d1, b.d1))) for t, rows in tiles.items() if t[0] == 0 for a in rows for b in rows
             if a.left and b.right and a.d1 != b.d1 and (t[2] < t[3] or a.d1 < b.d1)]
    assert len(pairs) == len(set(pairs)) == 61 * 60 // 2


def test_one_document_of_each_group_stays(docs):
    texts = near_copies(12)
    df = docs(texts, ids=[None if i == 20 else i for i in range(len(texts))], _d="x", group="y")
    kept = forest.keep_one(df)
    assert kept.columns == df.columns
    groups = {w[2] for w in forest.brute_force(texts)}
    assert kept.count() == len(groups)
    twice = docs(["same text here to keep once"] * 3, ids=[5, 5, 5])
    assert forest.keep_one(twice).count() == 1


def test_near_duplicates_of_nothing(empty):
    assert forest.join(empty).collect() == [] and forest.keep_one(empty).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (300, 299), (299, 298), (298, 300)]
    random.Random(1).shuffle(edges)
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 298: 298, 299: 298, 300: 298}
    assert out == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 10: repeats -----------------------------------------------------------------------------
def repeated_texts():
    rng = random.Random(6)
    shared = prose(20, 3, 60)
    texts = [f"{a}{s[rng.randint(0, 60):]}{b}" for s in shared for a, b in zip(prose(21, 5, 20), prose(22, 5, 20))]
    return [*texts, texts[0], "ab" * 400, "x" * 150 + "y" * 260, "x" * 199, "é" * 120, "é" * 99 + "e" * 50, None, "", prose(23, 1)[0], texts[0]]


@pytest.mark.parametrize("hot", [repeats.HOT, 500])
def test_repeats_by_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = repeated_texts()
    ids = [None if i == 4 else i for i in range(len(texts))]
    ids[-1] = 0  # a row twice
    out = repeats.digests(docs(texts, ids=ids, key=1, at=2, spans="x")).collect()
    want = repeats.brute_force(texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in out) == sorted(
        (i if i is not None else -1, *w) for i, w in zip(ids, want))


def test_cut_keeps_characters_whole(docs):
    df = docs(["aéz", None, "日本"]).withColumn("spans", F.expr("if(text is null, null, array(named_struct('s', 0L, 'e', 2L)))"))
    out = {r.doc_id: bytes(r.kept) for r in repeats.cut(df, characters=True).collect()}
    assert out == {0: "éz".encode(), 1: b"", 2: "日本".encode()}


def test_repeats_of_nothing(empty, docs):
    assert repeats.digests(empty).collect() == []
    out = repeats.digests(docs([None, "short"])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == [
        (0, 0, 0, hashlib.sha256(b"").hexdigest()), (5, 0, 0, hashlib.sha256(b"short").hexdigest())]


def test_a_frequent_id_is_one_sample(spark, docs):
    df = docs([*[f"copy {i % 3}" for i in range(50)], "other", None], ids=[7] * 50 + [8, 9])
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, toxic int")
    rows = samples.labelled(df, labels, "toxic", 4, -1, 10).collect()
    assert sorted((r.y, (r.text or "")[:4]) for r in rows) == [(0, ""), (0, "othe"), (1, "copy")]


# --- 9: licences -----------------------------------------------------------------------------
def test_licence_scan(docs, empty):
    texts = [None, "", "Text.\nReleased under the MIT License.\nMore", "licensed under the APACHE license, version 2.0", "No licence at all.", "Released under the MIT License. " * 2]
    out = {r.doc_id: r for r in licenses.scan(docs(texts, matches="x")).collect()}
    assert [[m.licence for m in out[i].matches] for i in range(6)] == [[], [], ["MIT"], ["Apache-2.0"], [], ["MIT", "MIT"]]
    assert [out[i].n_sentences for i in range(6)] == [0, 0, 3, 1, 1, 2] and out[2].identifiers == ["mit-notice"]
    assert licenses.scan(empty).collect() == []


def test_released_tables_are_empty(spark):
    df = stored(spark.range(10), "t")
    release(df)
    assert spark.read.parquet(df.stored_at).count() == 0
