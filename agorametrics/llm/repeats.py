"""Repeated byte strings across a corpus, found with run-length indexes of bounded size.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any text.
One index of everything can't be spread over machines, so the corpus is first cut by content:

1. Every window of ``length`` bytes elects the smallest hash of its ``GRAM``-byte strings as anchor.
   Equal windows elect equal anchors at equal distances, so only places with the same anchor hash can
   hold the same window. A place is an anchor with the run of windows that elect it and the bytes
   these cover, its context (at most ``2 * length - GRAM``). About one place in 85 bytes.
2. An anchor hash that stands once has no repeat. If all its contexts are equal, all of them repeat.
3. Other anchors' distinct contexts, in blocks of about ``BLOCK`` bytes, get a run-length index: suffixes
   are sorted per anchor, the Burrows-Wheeler transform is cut into runs, and the text places at both
   ends of each run are kept. Inside a run the longest match with a neighbour is that of the place
   before less one, so the matching statistics follow from the run ends by counting down: a match of
   ``v`` bytes at a run end marks the ``v`` bytes it covers. Repetitive contexts have few runs.
4. Marks go back from contexts to all their places, and are united per document.

An anchor with more than ``HOT`` bytes of distinct contexts isn't put into one block: its windows are
compared by a 128-bit hash each, dealt by that hash. Contexts are compared by 128 bits of hash, too.

Texts count as UTF-8 bytes; null is empty. A row is known by id and text, so repeated rows are places
of their own and each get the spans; rows that share an id but not the text are apart. A null id is
an id like others. Matches never cross texts; an empty table gives no rows. Columns other than id and
text are left aside, ``cut`` keeps them and replaces its own. Very long texts are read in parts of ``PART`` windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agorametrics.llm.common import lists, mix, pieces, put, ragged, raw, release, stored

LENGTH = 200
GRAM = 32
PART = 2 << 20  # windows that are looked at together
BLOCK = 2 << 20  # bytes of contexts in an index
HOT = 6 << 20  # bytes of contexts of one anchor that are still put into one block

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(301, 317, dtype=np.uint64)) | np.uint64(1)
SPAN = "array<struct<s:long,e:long>>"


def _joined(h: np.ndarray, size: int, level: int) -> np.ndarray:
    """Hashes of strings of twice the size."""
    out = h[:-size] * _FACTORS[level]
    out += h[size:]
    out ^= out >> np.uint64(29)
    return out


def hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of these sizes (powers of two)."""
    found, h, size, level = {}, _TABLE[data], 1, 0
    while True:
        if size in sizes:
            found[size] = h
        if size >= max(sizes) or h.size <= size:
            return {s: found.get(s, np.zeros(0, np.uint64)) for s in sizes}
        h, size, level = _joined(h, size, level), 2 * size, level + 1


def lowest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` entries."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[:key.size - (width - size)], key[width - size:]) if width > size else key


def places(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """text, start, size of the context, anchor hash, context hash of all places of these texts."""
    for lo in range(0, max(0, data.size - length + 1), PART):
        part = data[lo:lo + PART + length - 1]
        h = hashes(part, (gram, 128))
        n = part.size - length + 1
        key = h[gram] & ~np.uint64(0xFFFFFF) | np.arange(h[gram].size, dtype=np.uint64)
        anchor = (lowest(key, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(lo, lo + n), side="right") - 1
        valid = np.arange(lo + length, lo + length + n) <= offsets[text + 1]
        start = valid.copy()
        start[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
        a = np.flatnonzero(start)
        if not a.size:
            continue
        # a run ends where the next starts, or where windows stop to fit into the text
        last = np.append(a[1:], n) - 1
        bad = np.flatnonzero(~valid)
        cut = np.searchsorted(bad, a)
        last = np.minimum(last, np.append(bad, n)[cut] - 1)
        size = last - a + length
        three = [h[128][a], h[128][a + (size - 128) // 2], h[128][a + size - 128]]
        context = mix(three[0] + np.uint64(0x632BE59BD9B4E019))
        for x in (three[1], three[2], (size << 20 | anchor[a] - a).astype(np.uint64)):
            context = mix(context ^ x * _FACTORS[12])
        yield text[a], lo + a - offsets[text[a]], size, h[gram][anchor[a]], context


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, key, at, size, fp, ctx of all places of the texts in doc_id, key, text."""

    def run(batches):
        for batch in pieces(batches, most=2 * PART):
            for text, at, size, fp, ctx in places(*raw(batch.column(2)), length, gram):
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(text), batch.column(1).take(text), pa.array(at), pa.array(size.astype(np.int32)),
                     pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64))], ["doc_id", "key", "at", "size", "fp", "ctx"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, at long, size int, fp long, ctx long")


def run_ends(data: np.ndarray, first: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run-length index of contexts: for the pairs of neighbours in suffix order that stand on a run
    border and match over ``length`` bytes or more, both places and the length of the match.

    ``first``: where contexts start in ``data`` (and the end); ``group``: ascending, suffixes of
    different groups are never neighbours.
    """
    n = data.size
    size = np.diff(first)
    of = np.repeat(np.arange(size.size), size)
    left = (np.repeat(first[1:], size) - np.arange(n)).astype(np.int32)  # bytes up to the context's end
    symbol = np.concatenate([data.astype(np.int64) + 1, np.zeros(2, np.int64)])
    key = group[of] << 27 | symbol[:n] << 18
    key |= np.where(left > 1, symbol[1:n + 1], 0) << 9
    key |= np.where(left > 2, symbol[2:n + 2], 0)
    span, longest = 3, int(size.max())
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if span >= longest or new.all():
            break
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:n - span] = np.where(left[:n - span] > span, rank[span:], 0)
        key = rank * (n + 1) + ahead
        span *= 2
    # equal suffixes of several contexts: in the order of the contexts
    order = (np.sort(rank << 32 | np.arange(n)) & 0xFFFFFFFF).astype(np.int64)
    before = np.where(order > first[of[order]], symbol[order - 1], -1)  # no two starts are alike
    border = (before[1:] != before[:-1]) | (before[1:] < 0)
    border &= group[of[order[1:]]] == group[of[order[:-1]]]
    x, y = order[:-1][border], order[1:][border]
    most = np.minimum(left[x], left[y]).astype(np.int64)
    fits = most >= length
    x, y, most = x[fits], y[fits], most[fits]
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", wide, strides=(1,))
    match, open_, step = most.copy(), np.arange(x.size), 0
    while open_.size:
        open_ = open_[most[open_] > step]
        differ = eight[x[open_] + step] ^ eight[y[open_] + step]
        ended = differ != 0
        at = open_[ended]
        bits = differ[ended]
        low = bits & (~bits + np.uint64(1))
        match[at] = np.minimum(most[at], step + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        open_, step = open_[~ended], step + 8
    long_ = match >= length
    return x[long_], y[long_], match[long_]


def united(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each ``of``; ranges that touch become one."""
    if not of.size:
        return of, start, end
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(of * base + end)
    new = np.ones(of.size, dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (of[1:] * base + start[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], of.size) - 1
    return of[begin], start[begin], reach[last] - of[begin] * base


MARKS = "fp long, ctx long, s long, e long"


def _index_block(length: int):
    def run(table: pa.Table) -> pa.Table:
        fp, ctx = table.column("fp").to_numpy(), table.column("ctx").to_numpy()
        order = np.lexsort((ctx, fp))
        new = np.ones(order.size, dtype=bool)
        new[1:] = (fp[order[1:]] != fp[order[:-1]]) | (ctx[order[1:]] != ctx[order[:-1]])
        order = order[new]
        data, first = raw(table.column("bytes").combine_chunks().take(pa.array(order)))
        fp, ctx = fp[order], ctx[order]
        group = np.cumsum(np.concatenate([[0], fp[1:] != fp[:-1]])).astype(np.int64)
        x, y, match = run_ends(data, first, group, length)
        place = np.concatenate([x, y])
        of = np.searchsorted(first, place, side="right") - 1
        start = place - first[of]
        of, start, end = united(of, start, start + np.concatenate([match, match]))
        return pa.table({"fp": fp[of], "ctx": ctx[of], "s": start, "e": end})

    return run


def _window_hashes(contexts: DataFrame, length: int) -> DataFrame:
    """fp, ctx, s and a 128-bit hash of every window of these contexts."""

    def run(batches):
        for batch in pieces(batches, "bytes", PART):
            data, first = raw(batch.column(2))
            h = hashes(data, (128,))[128]
            size = np.maximum(np.diff(first) - length + 1, 0)
            at = ragged(first[:-1], size)
            of = pa.array(np.repeat(np.arange(batch.num_rows), size))
            one, two = h[at], h[at + length - 128]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(of), batch.column(1).take(of), pa.array(ragged(np.zeros(size.size, np.int64), size)),
                pa.array(mix(one ^ two * _FACTORS[13]).view(np.int64)), pa.array(mix(two ^ one * _FACTORS[14]).view(np.int64))],
                ["fp", "ctx", "s", "h1", "h2"])

    return contexts.select("fp", "ctx", "bytes").mapInArrow(run, "fp long, ctx long, s long, h1 long, h2 long")


def _context_bytes(texts: DataFrame) -> DataFrame:
    """fp, ctx, hot, bytes of the contexts that are asked of each text."""

    def run(batches):
        for batch in pieces(batches):
            data, offsets = raw(batch.column(0))
            asked = batch.column(1)
            flat = asked.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = flat.field("at").to_numpy() + offsets[row]
            size = flat.field("size").to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(upto), pa.py_buffer(data[ragged(at, size)])])
            yield pa.RecordBatch.from_arrays([flat.field("fp"), flat.field("ctx"), flat.field("hot"), out], ["fp", "ctx", "hot", "bytes"])

    return texts.mapInArrow(run, "fp long, ctx long, hot boolean, bytes binary")


class Repeats:
    """The repeated spans of a corpus.

    ``texts``: doc_id, key and text of the rows that share an anchor with any place, every such row.
    ``spans``: doc_id, key, spans (united, ascending, in bytes) of the rows that lose anything.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text"):
        if not 128 <= length <= 2 * gram + 320 or length - gram < 1:
            raise ValueError("length must lie between 128 and 2 * gram + 320")
        self.docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", _row_key("doc_id", "text"))
        own = stored(anchors(self.docs, length, gram), "anchors")
        by_fp = own.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
        # stored, so that both sides of the join are plain shuffles and a hot anchor's rows are split
        repeated = stored(by_fp.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("mixed")), "repeated-anchors")
        shared = stored(own.join(repeated, "fp"), "shared-anchors")
        release(own, repeated)
        mixed = shared.where("mixed")
        classes = mixed.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "at", "size")).alias("one"))
        classes = stored(classes.select("fp", "ctx", "n", "one.*"), "contexts")
        hot = classes.groupBy("fp").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > HOT).select("fp", F.lit(True).alias("hot"))
        asked = classes.join(hot, "fp", "left").groupBy("doc_id", "key").agg(F.collect_list(
            F.struct("fp", "ctx", F.coalesce("hot", F.lit(False)).alias("hot"), "at", "size")).alias("asked"))
        rows = shared.select("doc_id", "key").distinct().withColumnsRenamed({"doc_id": "d", "key": "k"})
        rows = rows.join(asked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left").select("d", "k", "asked")
        self.texts = stored(self.docs.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k"), "shared-texts")
        marks = self._marks(_context_bytes(self.texts.where("asked is not null").select("text", "asked")), classes, length)
        marked = mixed.join(marks, ["fp", "ctx"]).select("doc_id", "key", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))
        whole = shared.where("not mixed").select("doc_id", "key", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"))
        # equal rows of one id name the same ranges
        ranges = whole.unionByName(marked).distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        self.spans = stored(_merged(ranges), "spans")
        release(shared, classes, marks)

    @staticmethod
    def _marks(contexts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
        """fp, ctx, s, e: what repeats of each context, from its start."""
        blocks = 1 + (classes.agg(F.sum("size")).first()[0] or 0) // BLOCK  # one number
        few = contexts.where("not hot").select("fp", "ctx", "bytes", F.pmod(F.xxhash64("fp"), F.lit(blocks)).alias("block"))
        indexed = few.groupBy("block").applyInArrow(_index_block(length), MARKS)
        again = classes.where("n > 1").select("fp", "ctx", F.lit(0).cast("long").alias("s"), F.col("size").cast("long").alias("e"))
        windows = _window_hashes(contexts.where("hot").dropDuplicates(["fp", "ctx"]), length)
        twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        large = windows.join(twice, ["h1", "h2"]).select("fp", "ctx", "s", (F.col("s") + length).alias("e"))
        return stored(indexed.unionByName(again).unionByName(large), "marks")


def _merged(ranges: DataFrame) -> DataFrame:
    """The lists of ranges to their unions."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten()
            of = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            of, s, e = united(of, *(flat.field(x).to_numpy(zero_copy_only=False) for x in ("s", "e")))
            both = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["s", "e"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(both, np.searchsorted(of, np.arange(batch.num_rows + 1)))], ["doc_id", "key", "spans"])

    return ranges.select("doc_id", "key", "spans").mapInArrow(run, f"doc_id long, key long, spans {SPAN}")


def cut(rows: DataFrame, text: str = "text", spans: str = "spans", out: str = "kept", characters: bool = False) -> DataFrame:
    """``rows`` with the bytes outside the spans; ``characters`` keeps a character that isn't wholly inside."""
    kind = T.StructType([f for f in rows.schema if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in pieces(batches, text, PART):
            data, offsets = raw(batch.column(batch.schema.get_field_index(text)))
            ranges = batch.column(batch.schema.get_field_index(spans))
            flat = ranges.flatten()
            row = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            s, e = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[row] for x in ("s", "e"))
            change = np.zeros(data.size + 1, dtype=np.int32)
            np.add.at(change, s, 1)
            np.add.at(change, e, -1)
            keep = np.cumsum(change[:-1]) == 0
            if characters and data.size:
                char = np.cumsum(data & 0xC0 != 0x80) - 1  # a character stays if any of its bytes does
                keep = np.bincount(char, weights=keep)[char] > 0
            upto = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(upto), pa.py_buffer(data[keep])])
            yield put(batch, schema, **{out: kept})

    return rows.mapInArrow(run, kind)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = Repeats(docs, length)
    names = found.spans.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    changed = cut(found.texts.drop("asked").join(names, same).select("doc_id", "text", "spans")).select(
        "doc_id", size, F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    none = F.lit(0).cast("long")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    whole = found.docs.select("doc_id", "key", size, none.alias("n_removed"), none.alias("n_spans"), digest)
    return whole.join(names, same, "left_anti").drop("key").unionByName(changed)


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The digests by comparing all windows; for tests."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i:i + length]] = seen.get(d[i:i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        rest = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out
