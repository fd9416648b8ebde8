"""Near duplicates: n-gram Jaccard join with a MinHash LSH forest and exact verification.

A text's set holds the hashes (64 bits) of its shingles of ``SHINGLE`` words; a shorter text with a
word is one shingle. Texts of equal sets, told by 128 bits, form a class; only one text of a class
goes on, so thousands of copies cost one.

Every class has a label in each of ``TREES`` tries: ``DEPTH`` MinHash values. Two classes meet in a
trie node, a prefix of their labels. All prefixes have one length, computed before any row is read: the
longest with which a pair at the threshold meets in some trie with the target recall. With the defaults
these are bands of three values. Classes that meet are linked to the smallest
of their node; components of these links are families, and a link never crosses families.

A family's sets come together in one task, where each pair that meets in any trie is compared exactly.
Pairs are counted there and never written out: a class gets its number of links and the smallest class
it is connected with. A family beyond ``MEMBERS`` or ``SHINGLES`` is verified node by node instead, in
tiles of at most ``TILE`` classes and half of ``SHINGLES`` (and one set more) a side; a pair counts in
the first trie where it meets.

Null and empty texts, and texts without a word, have no set: they are alone, with no links. Repeated
rows are members of one class. Words: see ``decontaminate``. A null id is an id like others; ids are
only reported and break ties, texts are told apart by id and text hash. Very long texts have large
sets; an empty table gives no rows. Other columns are left aside, and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorametrics.llm.common import LOWER, WORD, fresh, lists, mix, pieces, raw, release, spans, stored, word_hashes
from agorametrics.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
TREES = 16
DEPTH = 4
RECALL = 0.9999
MEMBERS = 20_000
SHINGLES = 3_000_000
TILE = 2_000

_MUL = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64))


def prefix_length(similar: float = SIMILAR, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the prefix until a pair at the threshold meets in some trie often enough."""
    length = depth
    while length > 1 and 1 - (1 - similar**length) ** trees < recall:
        length -= 1
    return length


def sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each, and where each text's start."""
    low = LOWER[data]
    starts, ends = spans(WORD[low], offsets)
    h = word_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    size = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(count.size), count)
    left = first[text + 1] - np.arange(h.size)
    wide = np.concatenate([h, np.zeros(shingle, np.uint64)])
    out = np.zeros(h.size, np.uint64)
    for k in range(shingle):  # words behind the end of the text add nothing
        out = mix(out + np.where(left > k, wide[k:k + h.size], np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15))
    keep = np.arange(h.size) - first[text] < size[text]
    out, text = out[keep], text[keep]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(out.size, dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.searchsorted(text[new], np.arange(count.size + 1))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, d1, d2 (digest of the set), n (its size; 0: no digest), label (MinHash values)."""

    def run(batches):
        kind = pa.binary(4 * TREES * DEPTH)
        for batch in pieces(batches):
            values, first = sets(*raw(batch.column(2)), shingle)
            n = np.diff(first)
            rows = np.flatnonzero(n)
            at = first[:-1][rows]
            d1 = d2 = np.zeros(0, np.uint64)
            label = np.zeros((rows.size, TREES * DEPTH), dtype=">u4")
            if rows.size:
                d1 = mix(np.add.reduceat(mix(values ^ _ADD[0]), at) ^ n[rows].astype(np.uint64))
                d2 = mix(np.add.reduceat(mix(values ^ _ADD[1]), at) + n[rows].astype(np.uint64))
                for k in range(TREES * DEPTH):
                    label[:, k] = np.minimum.reduceat((values * _MUL[k] + _ADD[k]) >> np.uint64(32), at)
            back = np.full(n.size, -1)
            back[rows] = np.arange(rows.size)
            take = pa.array(back, mask=back < 0)
            labels = pa.Array.from_buffers(kind, rows.size, [None, pa.py_buffer(label.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(d1.view(np.int64)).take(take), pa.array(d2.view(np.int64)).take(take),
                 pa.array(n.astype(np.int64)), labels.cast(pa.binary()).take(take)], ["doc_id", "key", "d1", "d2", "n", "label"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, d1 long, d2 long, n long, label binary")


def with_sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """d1, d2, label, family and the set of these classes' texts."""

    def run(batches):
        for batch in pieces(batches):
            values, first = sets(*raw(batch.column(0)), shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists(pa.array(values.view(np.int64)), first)],
                                             ["d1", "d2", "label", "family", "large", "shingles"])

    return rows.select("text", "d1", "d2", "label", "family", "large").mapInArrow(
        run, "d1 long, d2 long, label binary, family long, large boolean, shingles array<long>")


PARTS = "d1 long, d2 long, n_links long, r1 long, r2 long"


def _linked(length: int, similar: float):
    """Verify the pairs of a group: counts of links, and for each class the smallest of its component here."""

    def run(table: pa.Table) -> pa.Table:
        d1, d2 = table.column("d1").to_numpy(), table.column("d2").to_numpy()
        order = np.lexsort((d2, d1))
        d1, d2 = d1[order], d2[order]
        shingles = table.column("shingles").combine_chunks().take(pa.array(order))
        label = np.frombuffer(b"".join(table.column("label").take(pa.array(order)).to_pylist()), ">u4").reshape(-1, TREES, DEPTH)[:, :, :length]
        meet = np.zeros(label.shape[:2], np.uint64)
        for k in range(length):
            meet = mix(meet * np.uint64(31) + label[:, :, k].astype(np.uint64))
        tree = table.column("tree").to_numpy()[0]
        left, right = (table.column(x).to_numpy(zero_copy_only=False)[order] for x in ("left", "right"))
        flat = np.unique(shingles.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
        n = shingles.value_lengths().to_numpy().astype(np.int64)
        begin = np.cumsum(n) - n
        flag = np.zeros(int(flat.max()) + 1 if flat.size else 0, dtype=bool)
        count, root = np.zeros(n.size, np.int64), np.arange(n.size)
        for i in np.flatnonzero(left):
            # in a tile of one block only pairs (i, j > i); in one of two blocks left with right
            other = right.copy()
            other[:i + 1] &= ~left[:i + 1]
            same = meet == meet[i]
            if tree >= 0:
                other &= same[:, tree] & ~same[:, :tree].any(1)
            else:
                other &= same.any(1)
            j = np.flatnonzero(other & (np.minimum(n, n[i]) >= similar * np.maximum(n, n[i])))
            if not j.size:
                continue
            own = flat[begin[i]:begin[i] + n[i]]
            flag[own] = True
            for lo in range(0, j.size, 2_000):  # partners at a time: bounded memory
                some = j[lo:lo + 2_000]
                at = np.repeat(begin[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n[some].sum())
                both = np.add.reduceat(flag[flat[at]], np.cumsum(n[some]) - n[some], dtype=np.int64)
                good = some[both >= similar * (n[some] + n[i] - both) - 1e-9]
                if good.size:
                    count[i] += good.size
                    count[good] += 1
                    roots = np.unique(np.append(root[good], root[i]))
                    if roots.size > 1:
                        root[np.isin(root, roots[1:])] = roots[0]
            flag[own] = False
        return pa.table({"d1": d1, "d2": d2, "n_links": count, "r1": d1[root], "r2": d2[root]})

    return run


def join(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, recall: float = RECALL,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, class_id, n_links, group_id, group of every row.

    class_id: smallest id among texts of equal sets; n_links: other classes at least ``similar``;
    group_id: smallest id among the classes connected by links; group: their name, whatever the ids.
    """
    length = prefix_length(similar, recall)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    own = stored(signatures(docs, shingle), "signatures")
    classes = stored(own.where("n > 0").groupBy("d1", "d2", "n", "label").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "key")).alias("one")), "classes")

    slots = F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("label", 4 * DEPTH * t + 1, 4 * length)).alias("node"))
        for t in range(TREES)])).alias("s")
    slots = stored(classes.select("d1", "d2", slots).select("d1", "d2", "s.*"), "slots")
    nodes = slots.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("m"), F.min("d1").alias("b")).where("m > 1")
    met = stored(slots.join(nodes, ["tree", "node"]), "met")
    release(slots)
    family = components(met.select(F.col("d1").alias("a"), "b")).select(F.col("node").alias("d1"), F.col("root").alias("family"))
    members = stored(classes.join(family, "d1"), "members")
    large = members.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).select(
        "family", ((F.col("c") > MEMBERS) | (F.col("s") > SHINGLES)).alias("large"))
    wanted = members.join(large, "family").select("d1", "d2", "n", "label", "family", "large", "one.*").withColumnsRenamed({"doc_id": "d", "key": "k"})
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    sets_ = stored(with_sets(texts, shingle), "sets")
    full = sets_.dropDuplicates(["d1", "d2"])

    check = _linked(length, similar)
    yes = F.lit(True)
    small = full.where("not large").select("d1", "d2", "label", "shingles", "family", F.lit(-1).alias("tree"), yes.alias("left"), yes.alias("right"))
    parts = small.groupBy("family").applyInArrow(check, PARTS)
    nodes_of = stored(wanted.where("large").select("d1", "d2", "n").join(met, ["d1", "d2"]).select("d1", "d2", "n", "tree", "node"), "large-nodes")
    parts = parts.unionByName(_tiles(full.where("large"), nodes_of).groupBy("tree", "node", "x", "y").applyInArrow(check, PARTS))
    parts = stored(parts, "link-parts")
    release(met, sets_, nodes_of)
    # families are whole already; tiles of a large one still have to be put together
    in_large = parts.join(wanted.where("large").select("d1", "d2"), ["d1", "d2"], "left_semi")
    name = lambda a, b: F.concat_ws(":", F.col(a), F.col(b))
    joined = components(in_large.select(name("d1", "d2").alias("a"), name("r1", "r2").alias("b")))
    links = parts.groupBy("d1", "d2").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("r1", "r2")).alias("r"))
    links = links.join(joined.withColumnRenamed("node", "me"), name("d1", "d2") == F.col("me"), "left")
    links = links.select("d1", "d2", "n_links", F.coalesce("root", F.concat_ws(":", "r.r1", "r.r2")).alias("root"))
    known = classes.select("d1", "d2", "class_id").join(links, ["d1", "d2"], "left").select(
        "d1", "d2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", name("d1", "d2")).alias("root"))
    known = stored(known, "class-links")
    release(parts, members, classes)
    groups = known.groupBy("root").agg(F.min("class_id").alias("group_id"))
    known = known.join(groups, "root").withColumnRenamed("root", "group")
    alone = own.where("n = 0").select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"),
        F.concat_ws(":", F.lit("row"), F.col("doc_id"), F.col("key")).alias("group"))
    return own.where("n > 0").join(known, ["d1", "d2"]).select(*alone.columns).unionByName(alone)


def _tiles(full: DataFrame, own: DataFrame) -> DataFrame:
    """Each class of a large family in the tiles of its nodes: blocks x <= y of a node meet in one tile.

    ``own``: d1, d2, n, tree, node of these classes. A block has at most ``TILE`` classes, and shingles up
    to half of ``SHINGLES`` and one set more. A node of the same classes as one of a smaller trie is left
    out: its pairs have met.
    """
    same = own.groupBy("tree", "node").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("d1", "d2")).alias("h1"), F.bit_xor(F.xxhash64("d2", "d1")).alias("h2"))
    first = same.groupBy("m", "h1", "h2").agg(F.min(F.struct("tree", "node")).alias("f")).select("f.*", "m")
    # hash parts of about TILE classes are cut by running sums: no window holds a whole node
    part = F.pmod(F.xxhash64("d2", "d1"), F.ceil(F.col("m") / TILE)).alias("part")
    own = own.join(first, ["tree", "node"]).select("d1", "d2", "n", "tree", "node", part)
    w = Window.partitionBy("tree", "node", "part").orderBy("d1", "d2")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.floor(before / (SHINGLES / 2)) + F.floor((F.row_number().over(w) - 1) / TILE)
    own = own.withColumn("cut", cut)
    each = Window.partitionBy("tree", "node")
    numbers = own.select("tree", "node", "part", "cut").distinct().select(
        "*", (F.row_number().over(each.orderBy("part", "cut")) - 1).alias("block"), F.count(F.lit(1)).over(each).cast("int").alias("blocks"))
    own = full.join(own.join(numbers, ["tree", "node", "part", "cut"]), ["d1", "d2"])
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = F.least("block", "with"), F.greatest("block", "with")
    return own.select("d1", "d2", "label", "shingles", "tree", "node", x.alias("x"), y.alias("y"),
                      (F.col("block") == x).alias("left"), (F.col("block") == y).alias("right"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` (doc_id, text, others) with one row of each group of near duplicates: the smallest id.

    Texts without a word all stay, but rows that share id and text count as copies.
    """
    found = stored(join(docs, similar), "near-duplicates")
    # the text of the smallest id; its hash breaks ties between rows of one id
    d, k, key = fresh(docs, "_d", "_k", "_key")
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("one")).select(F.col("one.doc_id").alias(d), F.col("one.key").alias(k))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    kept = keyed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)))
    return kept.dropDuplicates([d, k]).select(*docs.columns)


def brute_force(texts: list[str | None], similar: float = SIMILAR, shingle: int = SHINGLE) -> list[tuple[int, int, int]]:
    """class, links and group of each text (numbers of texts), comparing all pairs; for tests."""
    import re

    found = []
    for t in texts:
        words = re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        found.append(frozenset(tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else None)
    first = {}
    for i, s in enumerate(found):
        first.setdefault(s if s is not None else i, i)
    cls = [first[s if s is not None else i] for i, s in enumerate(found)]
    reps = sorted({c for c in cls if found[c] is not None})
    links, root = dict.fromkeys(cls, 0), {c: c for c in cls}
    for a, i in enumerate(reps):
        for j in reps[a + 1:]:
            both = len(found[i] & found[j])
            if both and both >= similar * (len(found[i]) + len(found[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    return [(c, links[c], root[c]) for c in cls]
