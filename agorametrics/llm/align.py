"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes of a text.

Both tokenizers encode a blank and the text. Each side's cumulative byte ends become a dictionary from
end to index; the intersection of the two key sets, sorted, cuts both id lists into groups, and every id
of one side of a group is linked with every one of the other. Ids that repeat inside a large group are
counted before they are multiplied, so such a group costs its distinct ids.

Texts are cut before a blank that follows a character which is surely none. No split of the byte-level
tokenizer and no piece of the other one reaches across such a place, so both have a token end there:
each distinct chunk is encoded and aligned once a piece, common ones once a worker, and the dictionaries
are made for a slab of chunks at a time, however long a text is. This holds for what the files say, and is checked
when they are loaded: with other files every text is one chunk.

How many documents hold a linked pair of ids is counted over all rows. Pairs that make up a share of at
least one in ``FREQUENT`` of all entries (so there are at most ``FREQUENT`` of them, whatever the input)
are looked up from a table every task has; all others are joined, and none of those has many rows.

Null and empty texts, and texts one tokenizer doesn't give back byte by byte, have no tokens: zeros and
an empty digest. Every row is a document of its own, also among equal rows or rows of one id; ids may
be null. Very long texts are encoded whole, chunk by chunk; a text without blanks is one chunk. An empty
table gives no rows. Columns other than id and text are left aside.
"""

from __future__ import annotations

import hashlib
import json
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.llm.bpe import safe_cuts
from agorametrics.llm.common import lists, packed, pieces, ragged, raw, release, stored

FREQUENT = 1 << 18
CACHE = 300_000  # chunks a worker remembers
SLAB = 256 << 10  # bytes that share dictionaries, or are put together at a time
JOINED = 64  # chunks encoded as one text
PIECE = 4 << 20
WIDE = 1 << 12  # links beyond which a group's ids are counted first
SHIFT = 20  # a pair of ids is one number: a's id above b's

FIRST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
GROUPS = "doc_id long, groups array<struct<a: array<int>, b: array<int>>>"

# Holds what could tell cut texts from whole ones: runs of blanks, line ends, letters of several scripts, signs.
_PROBE = " It's  a\n test:   naïve ﬁ １２ ½ café́ 　 日本語 the 12 34\t(x) \r\n  y's Straße …  ☃ end  "


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: bytes of its ids."""

    def __init__(self, parts: list[bytes]):
        if len(parts) >= 1 << SHIFT:
            raise ValueError(f"ids of {SHIFT} bits at most")
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        # ids as text with what may follow: another id of the group, the other side, the next group
        self.said = {sign: np.array([f"{i}{sign}" for i in range(len(parts))], dtype=object) for sign in ",|;"}

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.size[ids])]


class Aligned(NamedTuple):
    """Chunks: how many ids (-1 for the first side where one doesn't give the bytes back) and groups each has; then all
    ids, and how many of them each group has."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray

    def with_more(self, more: Aligned) -> Aligned:
        return Aligned(*(np.concatenate(x) for x in zip(self, more, strict=True)))

    def first(self, n: int) -> Aligned:
        counts = [x[:n].copy() for x in self[:3]]
        n_a, n_b, n_groups = (int(np.maximum(x, 0).sum()) for x in counts)
        return Aligned(*counts, self.ids_a[:n_a].copy(), self.ids_b[:n_b].copy(), self.in_a[:n_groups].copy(), self.in_b[:n_groups].copy())


class Pair:
    """The two tokenizers of a worker, and the chunks it remembers: of each its ids on both sides and its groups."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.own_a = Tokenizer.from_file(path_a)
        self.own_a.encode_special_tokens = True
        self.own_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.own_a.get_vocab(with_added_tokens=False)
        parts = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            parts[i] = bytes(letters.get(c, 0x3F) for c in token)
        self.a = Side(parts)
        names = [self.own_b.id_to_piece(i) for i in range(self.own_b.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.own_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.blank = self.own_b.piece_to_id("▁")
        self.cuttable = self._cuttable(path_a, names)
        self.known: dict[bytes, int] = {}
        self.kept = Aligned(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.int32)] * 4)

    def _cuttable(self, path_a: str, names: list[str]) -> bool:
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or any("▁" in p.lstrip("▁") for p in names):
            return False
        framed = _PROBE.encode()
        cuts = self.cuts(np.frombuffer(framed, np.uint8), np.array([0, len(framed)]))
        parts = [framed[i:j].decode() for i, j in zip(cuts, [*cuts[1:], len(framed)], strict=True)]
        whole, some = self.encode([_PROBE]), self.encode(parts)
        return all(list(chain.from_iterable(s)) == w[0] for s, w in zip(some, whole, strict=True))

    def cuts(self, framed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = safe_cuts(framed, offsets)
        return found[framed[found] == 0x20]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that start with a blank."""
        a = [x.ids for x in self.own_a.encode_batch_fast(chunks, add_special_tokens=False)]
        # the other tokenizer writes the first blank by itself, but for an empty text
        b = self.own_b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [x if c != " " else [self.blank] for x, c in zip(b, chunks, strict=True)]

    def aligned(self, chunks: list[bytes]) -> Aligned:
        # a chunk that ends in a visible sign is a place to cut after: several of them make a text
        free = [i for i, c in enumerate(chunks) if 0x21 <= c[-1] <= 0x7E] if self.cuttable else []
        count, flat = ([], []), ([], [])
        for lo in range(0, len(free), JOINED):
            some = [chunks[i] for i in free[lo:lo + JOINED]]
            whole, at = b"".join(some).decode(), np.fromiter(accumulate(map(len, some)), np.int64, len(some))
            for side, own, ids in ((0, self.a, self.own_a.encode(whole, add_special_tokens=False).ids), (1, self.b, self.own_b.encode(whole[1:]))):
                upto = np.searchsorted(np.cumsum(own.size[ids]), at, side="right")
                count[side].append(np.diff(upto, prepend=0))
                flat[side].extend(ids[:upto[-1]])
        n = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in count]
        ids = [np.array(x, np.int32) for x in flat]
        good = self.whole([chunks[i] for i in free], n, ids)
        # one that doesn't come back may have spoilt its neighbours: these are encoded alone, like the others
        ids = [x[np.repeat(good, m)] for x, m in zip(ids, n, strict=True)]
        n, order = [m[good] for m in n], np.array(free, np.int64)[good]
        rest = np.setdiff1d(np.arange(len(chunks)), order)
        bad = np.zeros(len(chunks), dtype=bool)
        if rest.size:
            texts = [chunks[i] for i in rest]
            alone = self.encode([c.decode() for c in texts])
            size = [np.fromiter(map(len, x), np.int64, rest.size) for x in alone]
            more = [np.fromiter(chain.from_iterable(x), np.int32) for x in alone]
            same = self.whole(texts, size, more)
            bad[rest] = ~same
            ids = [np.concatenate([x, y[np.repeat(same, m)]]) for x, y, m in zip(ids, more, size, strict=True)]
            n = [np.concatenate([x, np.where(same, m, 0)]) for x, m in zip(n, size, strict=True)]
        back = np.empty(len(chunks), np.int64)
        back[np.concatenate([order, rest])] = np.arange(len(chunks))
        out = [(m[back], x[ragged((np.cumsum(m) - m)[back], m[back])]) for x, m in zip(ids, n, strict=True)]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        (n_a, ids_a), (n_b, ids_b) = out
        n_groups, in_a, in_b = self.groups(np.where(bad, 0, size), ids_a, ids_b)
        return Aligned(np.where(bad, -1, n_a), n_b, n_groups, ids_a, ids_b, in_a, in_b)

    def whole(self, texts: list[bytes], counts: list[np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
        """Which texts both sides' ids give back byte by byte."""
        size, data = np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(b"".join(texts), np.uint8)
        good = np.ones(len(texts), dtype=bool)
        for own, n, of in zip((self.a, self.b), counts, ids, strict=True):
            length = _sums(own.size[of], np.concatenate([[0], np.cumsum(n)]))
            good &= length == size
            both = np.flatnonzero(length == size)
            mine = own.bytes(of)[ragged((np.cumsum(length) - length)[both], size[both])]
            theirs = data[ragged((np.cumsum(size) - size)[both], size[both])]
            good[both] &= _sums((mine != theirs).astype(np.int64), np.concatenate([[0], np.cumsum(size[both])])) == 0
        return good

    def groups(self, size: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many groups each chunk of so many bytes has, and how many ids of both sides each group has."""
        ends_a, ends_b, ends = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b]), np.cumsum(size)
        n_groups, in_a, in_b = np.zeros(size.size, np.int64), [], []
        lo = at_a = at_b = 0
        while lo < ends.size:
            # a slab ends where a chunk does
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, side="right")))
            to_a, to_b = (int(np.searchsorted(x, ends[hi - 1], side="right")) for x in (ends_a, ends_b))
            index_a = dict(zip(ends_a[at_a:to_a].tolist(), range(to_a - at_a), strict=True))
            index_b = dict(zip(ends_b[at_b:to_b].tolist(), range(to_b - at_b), strict=True))
            common = sorted(index_a.keys() & index_b.keys())
            in_a.append(np.diff(np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)) + 1, prepend=0))
            in_b.append(np.diff(np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)) + 1, prepend=0))
            chunk = lo + np.searchsorted(ends[lo:hi], np.array(common, np.int64))
            n_groups[lo:hi] = np.bincount(chunk - lo, minlength=hi - lo)
            lo, at_a, at_b = hi, to_a, to_b
        return n_groups, *(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (in_a, in_b))

    def table(self, chunks: list[bytes]) -> tuple[np.ndarray, Aligned]:
        """The place of each chunk among those of the second."""
        at = np.fromiter((self.known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if not new.size:
            return at, self.kept
        missing = [chunks[i] for i in new]
        held = self.kept.n_a.size
        both = self.kept.with_more(self.aligned(missing))
        at[new] = held + np.arange(new.size)
        room = min(CACHE - held, new.size)
        if room > 0:
            self.known.update(zip(missing, range(held, held + room), strict=False))
            self.kept = both.first(held + room)
        return at, both


_workers: dict = {}  # of this process


def worker(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Pair(path_a, path_b)
    return _workers[path_a, path_b]


def framed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, each behind a blank; an empty or null one stays empty."""
    data, offsets = raw(column)
    has = np.diff(offsets) > 0
    at = offsets + np.concatenate([[0], np.cumsum(has)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    keep = np.ones(out.size, dtype=bool)
    keep[at[:-1][has]] = False
    out[keep] = data
    return out, at


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[first[1:]] - upto[first[:-1]]


class Chunked:
    """The texts of a piece as chunks with their ids.

    A text with a chunk that doesn't come back, and any text of files that can't be cut, is a chunk as a whole.
    """

    def __init__(self, own: Pair, column: pa.Array):
        self.own = own
        data, offsets = framed(column)
        cuts = own.cuts(data, offsets) if own.cuttable and data.size else offsets[:-1][np.diff(offsets) > 0]
        while True:
            chunks = packed(data, slice(None), cuts, np.append(cuts[1:], data.size)).dictionary_encode()
            at, self.of = own.table(chunks.dictionary.to_pylist())
            codes = at[chunks.indices.to_numpy()]
            first = np.searchsorted(cuts, offsets)
            doc = np.unique(np.searchsorted(offsets, cuts[self.of.n_a[codes] < 0], side="right") - 1)
            doc = doc[first[doc + 1] - first[doc] > 1]
            if not doc.size:
                break
            drop = np.zeros(cuts.size, dtype=bool)
            drop[ragged(first[doc] + 1, first[doc + 1] - first[doc] - 1)] = True
            cuts = cuts[~drop]
        # texts that don't come back have no chunks from here on
        good = self.of.n_a[codes] >= 0
        self.codes, self.size = codes[good], np.diff(np.append(cuts, data.size))[good]
        self.doc = np.repeat(np.arange(len(column)), np.diff(first))[good]

    def slabs(self):
        """Runs of chunks: their ids on both sides, how many of them each group has, and each group's document."""
        of, ends, lo = self.of, np.cumsum(self.size), 0
        held_a = np.maximum(of.n_a, 0)
        places = [(n, np.cumsum(n) - n) for n in (held_a, of.n_b, of.n_groups)]
        while lo < ends.size:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, side="right")))
            codes = self.codes[lo:hi]
            where = [ragged(at[codes], n[codes]) for n, at in places]
            doc = np.repeat(self.doc[lo:hi], of.n_groups[codes])
            yield of.ids_a[where[0]], of.ids_b[where[1]], of.in_a[where[2]].astype(np.int64), of.in_b[where[2]].astype(np.int64), doc
            lo = hi


def links(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct document and pair of ids, as one number, and how often they are linked."""
    start_a, start_b, many = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    few = np.flatnonzero(many <= WIDE)
    group = np.repeat(few, many[few])
    place = np.arange(group.size) - np.repeat(np.cumsum(many[few]) - many[few], many[few])
    a, b = ids_a[start_a[group] + place // n_b[group]].astype(np.int64), ids_b[start_b[group] + place % n_b[group]]
    keys, times = np.unique(doc[group] << 2 * SHIFT | a << SHIFT | b, return_counts=True)
    if few.size == many.size:
        return keys, times
    parts = [(keys, times)]
    for g in np.flatnonzero(many > WIDE):
        (a, k), (b, m) = (np.unique(ids[at:at + n].astype(np.int64), return_counts=True) for ids, at, n in ((ids_a, start_a[g], n_a[g]), (ids_b, start_b[g], n_b[g])))
        parts.append(((doc[g] << 2 * SHIFT | a[:, None] << SHIFT | b).ravel(), (k[:, None] * m).ravel()))
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of equal keys."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(times, new) if new.size else times


def said(own: Pair, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of text that make up the groups one after the other, and where each group's end."""
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    out = np.empty(ids_a.size + ids_b.size, dtype=object)
    for side, ids, n, end, before, sign in ((own.a, ids_a, n_a, end_a, end_b - n_b, "|"), (own.b, ids_b, n_b, end_b, end_a, ";")):
        words = side.said[","][ids]
        words[end - 1] = side.said[sign][ids[end - 1]]
        out[np.arange(ids.size) + np.repeat(before, n)] = words
    return out, end_a + end_b


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the groups, and the distinct linked pairs of ids of every document with the number of their links."""

    def run(batches):
        own = worker(path_a, path_b)
        for batch in pieces(batches, most=PIECE):
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            digests: dict = {}
            parts = []
            for ids_a, ids_b, n_a, n_b, doc in Chunked(own, batch.column(1)).slabs():
                for row, weights in zip(counts, (n_a, n_b, np.ones(doc.size, np.int64), n_a * n_b), strict=True):
                    np.add.at(row, doc, weights)
                parts.append(links(ids_a, ids_b, n_a, n_b, doc))
                words, ends = said(own, ids_a, ids_b, n_a, n_b)
                last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
                at = 0
                for i, to in zip(doc[last].tolist(), ends[last].tolist(), strict=True):
                    digests.setdefault(i, [hashlib.sha256(), ""])
                    # the last sign is written when more follows
                    found = digests[i][1] + "".join(words[at:to].tolist())
                    digests[i][0].update(found[:-1].encode())
                    digests[i][1], at = found[-1], to
            keys, times = merged(parts)
            ends = np.searchsorted(keys >> 2 * SHIFT, np.arange(n + 1))
            hexes = [digests[i][0].hexdigest() if i in digests else "" for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(hexes, pa.string()), lists(pa.array(keys & (1 << 2 * SHIFT) - 1), ends), lists(pa.array(times), ends)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FIRST)


def groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups of every document, in order: the ids of both sides."""

    def run(batches):
        own = worker(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in pieces(batches, most=PIECE):
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for ids_a, ids_b, n_a, n_b, doc in Chunked(own, batch.column(1)).slabs():
                at = zip(np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1]), doc.tolist(), strict=True)
                for a, b, i in at:
                    out[i].append({"a": a, "b": b})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "groups"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, GROUPS)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its first id has more)."""
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.shiftright("pair", SHIFT)
    # one row for an id of the first tokenizer: bounded by its vocabulary
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scores(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    first = stored(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(first), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = -(-total // frequent)  # entries // least, at most ``frequent``, is the most pairs there can be of ``least`` entries
    known = counts.where(F.col("n") >= least).toArrow().sort_by("pair").combine_chunks()
    names, n = known["pair"].to_numpy(), known["n"].to_numpy()
    best = known["best"].to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        for batch in batches:
            pairs, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            flat, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(np.diff(pairs.offsets.to_numpy()))])
            at = np.minimum(np.searchsorted(names, flat), max(0, names.size - 1))
            there = names[at] == flat if names.size else np.zeros(flat.size, dtype=bool)
            hit = np.where(there, weight, 0)
            left = np.concatenate([[0], np.cumsum(~there)])[first]
            sums = [_sums(hit * (best[at] if names.size else 0), first), _sums(hit * (n[at] if names.size else 0), first)]
            kept = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, sums), lists(pa.array(flat[~there]), left), lists(pa.array(weight[~there]), left)],
                [*(f.name for f in batch.schema if f.name not in ("pairs", "times")), "n_best", "count_sum", "pairs", "times"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in first.schema if f.name not in ("pairs", "times")]
    scored = stored(first.mapInArrow(run, ", ".join(kept) + ", n_best long, count_sum long, pairs array<long>, times array<long>"), "scored")
    release(first)
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", "e.pairs", "e.times")
    met = rest.join(counts.where(F.col("n") < least), rest["pairs"] == F.col("pair"))
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = scored.drop("pairs", "times").join(more, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
