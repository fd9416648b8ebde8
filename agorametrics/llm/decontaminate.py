"""Benchmark decontamination with a positional inverted index over the training text.

The index is cut by documents: a segment holds about ``PIECE`` bytes of texts, and for each of its
terms one row with the term's positions in the segment. No term, however common, gathers the
positions of more than one segment, and building takes no shuffle. One more row per segment holds
its documents. Between two documents one position is left free, so that no phrase crosses them.

A search reads the rows of the test terms only and works segment by segment. A phrase starts from
its rarest term there: the term's positions, less its offset in the phrase, are intersected with the
next rarer term's, and so on. Proximity matches start from the rarest term too and look for the
nearest further terms on both sides. Test items come in blocks of a stated size; each block is a
bounded list that goes to the tasks, and takes one pass over the rows of its terms.

Words: A-Z lower-cased, then runs of digits, letters a-z and characters outside ASCII.
Null or empty texts have no words: such documents come back with zeros, such items match nothing.
Items without an id count for ``n_hit`` but not for ``items``; items of one id count once. Repeated
documents are rows of their own; a very long one is a segment by itself. Without items nothing is hit,
without documents there are no rows. Columns other than id and text are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.common import LOWER, PIECE, WORD, lists, long, packed, pieces, raw, release, short, spans, stored

BLOCK = 4 << 20  # bytes of test items that go to the tasks at a time

INDEX = "segment long, term binary, n long, positions binary, doc_ids array<long>, doc_words array<int>"
HITS = "segment long, doc int, starts array<int>, ends array<int>, items array<string>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words as codes, and the number of the first word of each text (one more for the end)."""
    data = LOWER[data]
    mask = WORD[data]
    starts, ends = spans(mask, offsets)
    return packed(data, mask, starts, ends).dictionary_encode(), np.searchsorted(starts, offsets)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of every word of every text; a frame to be stored."""

    def run(batches):
        schema = pa.schema([
            ("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("positions", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32()))])
        segment = TaskContext.get().partitionId() << 32
        for batch in pieces(batches):
            found, first = words(*raw(batch.column(1)))
            counts = np.diff(first)
            codes = found.indices.to_numpy().astype(np.uint64)
            at = np.arange(codes.size, dtype=np.uint64) + np.repeat(np.arange(counts.size, dtype=np.uint64), counts)
            order = np.sort(codes << np.uint64(32) | at)
            at = (order & np.uint64(0xFFFFFFFF)).astype(np.int32)
            n = np.bincount(codes.astype(np.int64), minlength=len(found.dictionary))
            begin = np.cumsum(n) - n
            steps = np.diff(at, prepend=np.int32(0))
            steps[begin] = at[begin]
            packed_, size = short(steps)
            upto = np.concatenate([[0], np.cumsum(size)])[np.append(begin, codes.size)].astype(np.int32)
            terms = len(n)
            nothing = pa.nulls(terms, pa.list_(pa.int64())), pa.nulls(terms, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(terms, segment)), found.dictionary, pa.array(n),
                pa.Array.from_buffers(pa.binary(), terms, [None, pa.py_buffer(upto), pa.py_buffer(packed_)]), *nothing], schema=schema)
            whole = np.array([0, len(counts)])
            yield pa.RecordBatch.from_arrays([
                pa.array([segment]), pa.nulls(1, pa.binary()), pa.array([codes.size]), pa.nulls(1, pa.binary()),
                lists(batch.column(0), whole), lists(pa.array(counts, pa.int32()), whole)], schema=schema)
            segment += 1

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, INDEX)


def windows(items: list[tuple], size: int) -> dict[tuple[bytes, ...], set]:
    """Windows of ``size`` words of the items, with their items; an item of fewer words is one window."""
    found: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        own = words(data, np.array([0, data.size]))[0].to_pylist()
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found.setdefault(tuple(own[i:i + size]), set()).add(item)
    return found


def exact(lists_: list[np.ndarray]) -> np.ndarray:
    """Where the terms with these positions follow each other: the start of each occurrence."""
    order = sorted(range(len(lists_)), key=lambda k: len(lists_[k]))
    at = lists_[order[0]] - order[0]
    for k in order[1:]:
        if not at.size:
            break
        there = np.searchsorted(lists_[k], at + k)
        there[there == len(lists_[k])] = 0
        at = at[lists_[k][there] == at + k]
    return at


def near(lists_: list[np.ndarray], slop: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms stand in order within one text, with ``slop`` other words between them at most.

    For each place of the rarest term the tightest match around it: starts, and lasts plus one.
    """
    k = min(range(len(lists_)), key=lambda i: len(lists_[i]))
    low = high = lists_[k]
    for own in lists_[k + 1:]:
        to = np.searchsorted(own, high, side="right")
        keep = to < len(own)
        low, high = low[keep], own[to[keep]]
    for own in reversed(lists_[:k]):
        to = np.searchsorted(own, low, side="left") - 1
        keep = to >= 0
        low, high = own[to[keep]], high[keep]
    keep = high - low < len(lists_) + slop
    low, high = low[keep], high[keep]
    keep = np.searchsorted(bounds, low, side="right") == np.searchsorted(bounds, high, side="right")
    return low[keep], high[keep] + 1


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int | None = None,
           item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Documents with an occurrence of a window of the items: where, and which items.

    ``slop`` None asks for exact phrases; a number for proximity matches with that many words more.
    Returns segment, doc (place in the segment), starts and ends (word numbers in the document, ends
    exclusive, one for each occurrence), items (sorted ids as text).
    """
    spark = index.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK
    hits = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        asked = windows([tuple(r) for r in mine.collect()], size)  # a block: about BLOCK bytes
        if not asked:
            continue
        terms = spark.createDataFrame([(x,) for x in sorted({t for w in asked for t in w})], "term binary")
        rows = index.join(terms, "term", "left_semi").unionByName(index.where("term is null"))
        found = _in_segments(rows, asked, slop)
        if blocks > 1:  # a block's plan and broadcasts end with it
            found = stored(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
    return hits if hits is not None else spark.createDataFrame([], HITS)


def _in_segments(rows: DataFrame, asked: dict[tuple[bytes, ...], set], slop: int | None) -> DataFrame:
    phrases = sorted(asked)
    shared = rows.sparkSession.sparkContext.broadcast((phrases, [sorted(i for i in asked[p] if i is not None) for p in phrases]))

    def run(group: pa.Table) -> pa.Table:
        phrases, items = shared.value
        terms = group.column("term").to_pylist()
        segment = group.column("segment")[0].as_py()
        lengths = np.array(group.column("doc_words")[terms.index(None)].as_py(), np.int64)
        bounds = np.cumsum(lengths + 1) - lengths - 1
        own = {t: np.cumsum(long(np.frombuffer(p.as_py(), np.uint8))) for t, p in zip(terms, group.column("positions"), strict=True) if t is not None}
        starts, ends, which = [], [], []
        for w, phrase in enumerate(phrases):
            if all(t in own for t in phrase):
                got = [own[t] for t in phrase]
                if slop is None:
                    low = exact(got)
                    high = low + len(phrase)
                else:
                    low, high = near(got, slop, bounds)
                if low.size:
                    starts.append(low)
                    ends.append(high)
                    which.append(np.full(low.size, w))
        out: dict[str, list] = {"segment": [], "doc": [], "starts": [], "ends": [], "items": []}
        if starts:
            low, high, w = (np.concatenate(x) for x in (starts, ends, which))
            doc = np.searchsorted(bounds, low, side="right") - 1
            order = np.argsort(doc, kind="stable")
            low, high, w, doc = low[order], high[order], w[order], doc[order]
            for part in np.split(np.arange(doc.size), np.flatnonzero(np.diff(doc)) + 1):
                d = int(doc[part[0]])
                out["segment"].append(segment)
                out["doc"].append(d)
                out["starts"].append(low[part] - bounds[d])
                out["ends"].append(high[part] - bounds[d])
                out["items"].append(sorted({i for x in np.unique(w[part]) for i in items[x]}))
        return pa.table(out, schema=pa.schema([
            ("segment", pa.int64()), ("doc", pa.int32()), ("starts", pa.list_(pa.int32())),
            ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return rows.select("segment", "term", "positions", "doc_words").groupBy("segment").applyInArrow(run, HITS)


def documents(index: DataFrame) -> DataFrame:
    """segment, doc, doc_id, n_words of every document of the index."""
    rows = index.where("term is null").select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc", "d"))
    return rows.select("segment", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words"))


def report(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Per document the words inside any occurrence, and the items that occur."""
    ordered = hits.groupBy("segment", "doc").agg(
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order of their starts: each adds the words behind the furthest end so far
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(s["starts"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["ends"]).alias("upto")),
        lambda acc: acc["n"].cast("long"))
    found = ordered.select("segment", "doc", covered.alias("n_hit"), "items")
    empty = F.array().cast("array<string>")
    return documents.join(found, ["segment", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", empty).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document."""
    index = stored(build(docs), "postings")
    hits, own = stored(search(index, benchmark, size, slop), "hits"), stored(documents(index), "indexed")
    release(index)
    return report(own, hits)
