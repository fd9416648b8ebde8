"""Token ids as Parquet files that can be read in parts.

Rows are in ascending order of id across and within files: an id's row groups and pages are found by
their statistics and page index. Token ids are a list column with a dictionary (a vocabulary fits into
one); ids, offsets and counts are delta-coded, so they cost little and are read without the tokens.
Row groups and pages have stated sizes. Column ``part`` numbers the files' ranges in order, ``offset``
counts the ids before a document in its part; with the parts' totals, which are read from the narrow
columns alone, that gives its place among all ids.

Texts are encoded whole by the tokenizers library, without special tokens; strings of these in a text
are ordinary text. The tokenizer's split never crosses white space, so each distinct part is encoded
once a batch, and common ones once a worker. Every document ends with the end id; a
null or empty text has only that. Rows of one id are ordered by text hash; equal rows are equal. Null
ids come first. Very long texts are encoded whole; an empty table gives empty files. Columns other than
id and text are left aside.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorametrics.llm.common import LOWER, lists, packed, pieces, ragged, raw, spans

ROW_GROUP = 16 << 20
PAGE = 128 << 10
CACHE = 200_000  # chunks a worker remembers
PIECE = 4 << 20  # bytes of text that are encoded together

FILE = "doc_id long, part int, offset long, n_tokens int, ids array<int>"

# Kinds of bytes: blank, letter, digit, other sign. A chunk between blanks that holds anything else
# (see ``segments``) is left to the library whole.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x09:0x0E] = _KIND[0x20] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 4  # an apostrophe may start a contraction
_MARK = "\x00"  # between chunks that are encoded together: a token of its own
_PLAIN = re.compile("[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where the parts start that the tokenizer's split makes of the texts, and these, lower-cased: chunks between blanks
    of ASCII and the letters À to ÿ are split here (letters, single digits, runs of other signs);
    chunks with anything else stay whole."""
    kind = _KIND[data]
    high = data >= 0x80
    lead = np.zeros(data.size, dtype=bool)
    if data.size:
        # letters À to ÿ are C3 and one byte; 97 and B7 behind it are signs
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    tail = np.zeros(data.size, dtype=bool)
    tail[1:] = lead[:-1]
    kind[high & (lead | tail)] = 1
    low = LOWER[data]
    low[tail & (data <= 0x9E)] += 0x20
    whole, ends = spans(kind != 0, offsets)
    left = np.unique(np.searchsorted(whole, np.flatnonzero(kind == 4), side="right")) - 1
    kind[ragged(whole[left], ends[left] - whole[left])] = 4
    new = np.empty(data.size, dtype=bool)
    if data.size:
        new[0] = True
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[offsets[(offsets > 0) & (offsets < data.size)]] = True
    first = np.flatnonzero(new)
    some = kind[first] != 0
    starts, after = first[some], np.append(first[1:], data.size)[some]
    return starts, packed(low, kind != 0, starts, after).dictionary_encode()


class Chunks:
    """Encodes what ``segments`` finds; remembers the first ``CACHE`` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xE0, 0x100)}
        self.mark = self.full.encode(_MARK, add_special_tokens=False).ids
        self.known = pa.array([], pa.binary())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _together(self, chunks: list[str]) -> list[list[int]]:
        joint = f" {_MARK} "
        out: list[list[int]] = []
        for lo in range(0, len(chunks), 500):
            some = chunks[lo:lo + 500]
            ids = np.array(self.full.encode_batch_fast([joint.join(some)], add_special_tokens=False)[0].ids)
            parts = np.split(ids, np.flatnonzero(ids == self.mark[0]))
            if len(self.mark) != 1 or len(parts) != len(some):
                out += [x.ids for x in self.full.encode_batch_fast(some, add_special_tokens=False)]
            else:
                out += [parts[0].tolist(), *(p[1:].tolist() for p in parts[1:])]
        return out

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        found: list = [None] * len(chunks)
        other = []
        merge, plain = self.full.model.tokenize, _PLAIN.fullmatch
        for i, c in enumerate(chunks):
            text = c.decode("utf-8", "replace")
            if plain(text):  # one piece of the split: straight to the merges, in the model's letters
                found[i] = [t.id for t in merge(text if text.isascii() else text.translate(self.bytes))]
            elif _MARK in text:
                found[i] = self.full.encode(text, add_special_tokens=False).ids
            else:
                other.append(i)
        for i, ids in zip(other, self._together([chunks[i].decode("utf-8", "replace") for i in other]), strict=True):
            found[i] = ids
        return found

    def table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids and first place of each of the different chunks in the flat ids, and these."""
        at = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        missing = chunks.take(pa.array(new))
        ids = self.encode(missing.to_pylist())
        size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        at[new] = self.size.size + np.arange(new.size)
        room = CACHE - self.size.size
        if room > 0 and len(missing):
            total = self.size.size + min(room, len(missing))
            self.known = pa.concat_arrays([self.known, missing[:total - self.size.size]])
            self.size, self.flat = size[:total].copy(), flat[:int(size[:total].sum())].copy()
        return size[at], (np.cumsum(size) - size)[at], flat


_workers: dict[str, Chunks] = {}  # of this process


def rows(docs: DataFrame, path: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The files' rows, in order: doc_id, part, offset, n_tokens, ids."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches):
        if path not in _workers:
            _workers[path] = Chunks(path)
        own, part, done = _workers[path], TaskContext.get().partitionId(), 0
        for batch in pieces(batches, most=PIECE):
            data, offsets = raw(batch.column(1))
            starts, chunks = segments(data, offsets)
            size, first, flat = own.table(chunks.dictionary)
            codes = chunks.indices.to_numpy()
            ids = flat[ragged(first[codes], size[codes])]
            upto = np.concatenate([[0], np.cumsum(size[codes])])[np.searchsorted(starts, offsets)]
            out = np.full(ids.size + batch.num_rows, end, np.int32)
            ends_at = upto[1:] + np.arange(batch.num_rows)
            keep = np.ones(out.size, dtype=bool)
            keep[ends_at] = False
            out[keep] = ids
            cut = np.concatenate([[0], ends_at + 1])
            n = np.diff(cut)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(n.size, part, np.int32)), pa.array(done + cut[:-1]), pa.array(n.astype(np.int32)),
                lists(pa.array(out), cut)], ["doc_id", "part", "offset", "n_tokens", "ids"])
            done += int(cut[-1])

    return ordered.mapInArrow(run, FILE)


def write(docs: DataFrame, folder: str, path: str, end: int = 1) -> None:
    """Encode and write; a rerun replaces the folder."""
    (rows(docs, path, end).write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#offset", "false").option("parquet.enable.dictionary#n_tokens", "false").parquet(folder))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, without reading tokens."""
    narrow = spark.read.schema(FILE).parquet(folder)
    return _started(narrow.select("doc_id", "part", "offset", "n_tokens"), narrow)


def tokens(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with ids in [low, high]: other pages aren't read."""
    files = spark.read.schema(FILE).parquet(folder)
    some = files
    if low is not None:
        some = some.where(F.col("doc_id") >= low)
    if high is not None:
        some = some.where(F.col("doc_id") <= high)
    return _started(some, files)


def _started(some: DataFrame, files: DataFrame) -> DataFrame:
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    joined = some.join(F.broadcast(before), "part")  # else all ids are shuffled before their sizes tell
    return joined.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *[c for c in some.columns if c == "ids"])


def checksums(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, and crc32 of the ids as little-endian 32-bit numbers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
