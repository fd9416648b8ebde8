"""Hard negatives by exact search in a multiway hyperplane tree over the vectors.

A node of the tree has up to ``FAN`` split points; a vector belongs to the nearest of them, so bisecting
hyperplanes part the subtrees. For each two split points a node keeps the range of distances from the
one to all vectors of the other's subtree. A query asks for the vectors whose inner product with an
anchor lies in a window. With the range of the subtree's norms the window is an annulus of distances
around the anchor; a subtree is passed over where, for some split point, what its distance range and the
anchor's distance to that point allow doesn't meet the annulus. Leaves that are left are searched whole.

Split points are chosen on the driver from ``SAMPLE`` rows; every row is put into a leaf and counted in
the ranges. The sample also gives a first lower bound of each anchor's scores, which narrows its window.
Leaves are cut into blocks of about ``BLOCK`` rows and the anchors that ask a leaf into chunks, dealt by
hash: a task holds one block and streams a chunk's anchors, also where a third of all vectors are equal.
The results are exact and don't depend on the sample.

Components become floor(``scale`` * x). Rows with a null id, label or vector, a null or non-finite
component, or one beyond 2**26 after scaling (an inner product over 2,048 dimensions then fits a long)
take no part. Missing components of a shorter vector count as 0. Equal rows and rows of one id are rows
of their own: another row of an anchor's id may be its positive. Ties go to the smaller id. An empty
table, or one without anchors, gives no rows. Columns other than id, vector and label are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorametrics.llm.common import release, stored

SAMPLE = 8192
FAN = 8
BLOCK = 2048
AT_ONCE = 256  # anchors compared with a block at a time
LARGEST = 1 << 26

RANGES = "node int, i int, j int, low double, high double, small double, large double, n long"


def prepared(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda v: F.coalesce(F.isnotnull(v) & ~F.isnan(v) & (F.abs(v * float(scale)) <= float(LARGEST)), F.lit(False)))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(fits).select(
        "vec_id", "label", F.transform("x", lambda v: F.floor(v * float(scale)).cast("int")).alias("vec"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both, as doubles where these hold them and else as long."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * d >= 1 << 53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


@dataclass
class Node:
    points: np.ndarray  # the split points
    children: list[int]  # below 0: leaf -1 - child
    low: np.ndarray = field(default=None)  # [i, j]: least distance from split point i to the subtree of j
    high: np.ndarray = field(default=None)
    small: np.ndarray = field(default=None)  # [j]: range of the squared lengths in the subtree of j
    large: np.ndarray = field(default=None)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int

    def descend(self, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
        """Leaf of each vector; ``ranges`` takes the least and largest distances met on the way."""
        leaf = np.zeros(len(x), np.int64)
        norms = (x * x).sum(axis=1)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            k, rows = todo.pop()
            if not rows.size:
                continue
            node = self.nodes[k]
            far = np.sqrt(np.maximum(norms[rows, None] + (node.points**2).sum(axis=1) - 2.0 * products(x[rows], node.points), 0))
            near = far.argmin(axis=1)
            for j, child in enumerate(node.children):
                mine = near == j
                if not mine.any():
                    continue
                if ranges is not None:
                    new = [far[mine].min(axis=0), far[mine].max(axis=0), norms[rows[mine]].min(), norms[rows[mine]].max(), int(mine.sum())]
                    old = ranges.get((k, j))
                    ranges[k, j] = new if old is None else [
                        np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]), old[4] + new[4]]
                if child < 0:
                    leaf[rows[mine]] = -1 - child
                else:
                    todo.append((child, rows[mine]))
        return leaf

    def meets(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves may hold scores from ``low`` to ``high`` (windows of an anchor side by side): anchors x leaves."""
        out = np.zeros((len(x), self.leaves), dtype=bool)
        if not self.nodes:
            out[:] = True
            return out
        norms = (x * x).sum(axis=1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            far = np.sqrt(np.maximum(norms[rows, None] + (node.points**2).sum(axis=1) - 2.0 * products(x[rows], node.points), 0))
            # a subtree without rows has empty ranges, which meet nothing
            slack = 1e-6 * (1 + far.max(initial=0) + np.sqrt(np.maximum(node.large, 0)).max(initial=0))
            # every split point says how near and how far the subtree's vectors can be
            nearest = np.maximum(far[:, :, None] - node.high, node.low - far[:, :, None]).max(axis=1) - slack
            farthest = (far[:, :, None] + node.high).min(axis=1) + slack
            alive = np.zeros(nearest.shape, dtype=bool)
            for w in range(low.shape[1]):
                inner = norms[rows, None] + node.small - 2.0 * high[rows, w, None]
                outer = norms[rows, None] + node.large - 2.0 * low[rows, w, None]
                alive |= (low[rows, w] <= high[rows, w])[:, None] & (outer >= -slack) & (nearest**2 * (nearest > 0) <= np.maximum(outer, 0) + slack) & (farthest**2 >= inner - slack)
            alive &= node.large >= node.small
            for j, child in enumerate(node.children):
                some = rows[alive[:, j]]
                if child < 0:
                    out[some, -1 - child] = True
                elif some.size:
                    todo.append((child, some))
        return out


def split_points(x: np.ndarray, fan: int) -> np.ndarray:
    """Up to ``fan`` vectors of ``x``, each the farthest from those before; fewer where vectors are equal."""
    chosen = [int((((x - x.mean(axis=0)) ** 2).sum(axis=1)).argmax())]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < fan and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def plant(x: np.ndarray, rows: int, fan: int = FAN, leaf: int = BLOCK) -> Tree:
    """A tree from sample vectors ``x`` that stand for ``rows`` rows, split while a node stands for more than ``leaf``."""
    tree = Tree([], 0)

    def grow(some: np.ndarray) -> int:
        points = split_points(some, fan) if len(some) * rows > leaf * len(x) and len(some) >= 2 * fan else None
        if points is None or len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        k = len(tree.nodes)
        tree.nodes.append(Node(points, []))
        near = ((some**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2.0 * some @ points.T).argmin(axis=1)
        for j in range(len(points)):
            tree.nodes[k].children.append(grow(some[near == j]))
        return k

    if grow(x) < 0:
        tree.leaves = 1
    return tree


class Index:
    """Every row in its leaf, and the tree with ranges over all rows."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, block: int = BLOCK):
        self.block = block
        total = rows.count()
        # the rows with the smallest hashes: at most ``sample``
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
        self.known = {"vec_id": some["vec_id"].to_numpy(), "label": some["label"].to_numpy(), "x": matrix(some["vec"].combine_chunks())}
        tree = self.tree = plant(self.known["x"], total, fan, block) if total else Tree([], 1)

        def place(batches):
            for batch in batches:
                leaf = tree.descend(matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

        placed = rows.mapInArrow(place, "vec_id long, label long, vec array<int>, leaf int")
        self.rows = stored(placed.withColumn("row", F.monotonically_increasing_id()), "vectors")

        def measure(batches):
            met: dict = {}
            for batch in batches:
                tree.descend(matrix(batch.column(0)), met)
            out = [(k, i, j, lo, hi, small, large, n) for (k, j), (low, high, small, large, n) in met.items() for i, (lo, hi) in enumerate(zip(low, high, strict=True))]
            names = [c.split()[0] for c in RANGES.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names)

        found = self.rows.select("vec").mapInArrow(measure, RANGES).groupBy("node", "i", "j").agg(
            F.min("low"), F.max("high"), F.min("small"), F.max("large"), F.sum("n")).collect()  # bounded by the tree's size
        for node in tree.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.small, node.large = np.full(m, np.inf), np.full(m, -np.inf)
        self.sizes = np.zeros(tree.leaves, np.int64)
        if not tree.nodes:
            self.sizes[0] = total
        for k, i, j, low, high, small, large, n in found:
            node = tree.nodes[k]
            node.low[i, j], node.high[i, j], node.small[j], node.large[j] = low, high, small, large
            if node.children[j] < 0:
                self.sizes[-1 - node.children[j]] = n

    def search(self, asked: DataFrame, kernel, schema: str) -> DataFrame:
        """Bring each anchor (row, vec, leaves, ...) to the blocks of its leaves; ``kernel(block, anchors)`` yields rows."""
        spark, block = asked.sparkSession, self.block
        often = dict(asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())  # a row a leaf
        info = [(leaf, max(1, -(-int(self.sizes[leaf]) // block)), -(-n // block)) for leaf, n in often.items()]
        leaves = F.broadcast(spark.createDataFrame(info, "leaf int, blocks int, chunks int"))
        names = [c for c in asked.columns if c != "leaves"]
        kept = [f for f in self.rows.schema if f.name != "leaf"]
        key = ["leaf", "block", "chunk"]
        own = self.rows.join(leaves, "leaf").select(
            "leaf", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.lit(False).alias("asks"), *[f.name for f in kept], *[F.lit(None).cast(asked.schema[n].dataType).alias(n) for n in names if n not in self.rows.columns])
        theirs = asked.withColumn("leaf", F.explode("leaves")).join(leaves, "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk"),
            F.lit(True).alias("asks"), *[f.name for f in kept], *[n for n in names if n not in self.rows.columns])
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(b * c for _, b, c in info) // 64)
        dealt = own.unionByName(theirs).repartition(tasks, *key).sortWithinPartitions(*key, "asks")

        def run(batches):
            held, at, parts = None, None, []
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
                asks = batch.column(3).to_numpy(zero_copy_only=False)
                new = (keys[:, 1:] != keys[:, :-1]).any(axis=0) | (asks[1:] != asks[:-1])
                edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if hi == lo:
                        continue
                    now = tuple(keys[:, lo])
                    if now != at:
                        held, at, parts = None, now, []
                    part = batch.slice(lo, hi - lo)
                    if not asks[lo]:
                        parts.append(part)
                        continue
                    if not parts:
                        continue
                    if held is None:
                        held = Block(pa.Table.from_batches(parts))
                    for first in range(0, part.num_rows, AT_ONCE):
                        yield from kernel(held, part.slice(first, AT_ONCE))

        return dealt.mapInArrow(run, schema)


class Block:
    """Rows of a leaf in the order of their ids."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("vec_id").combine_chunks()
        self.vec_id, self.label, self.row = (table[c].to_numpy() for c in ("vec_id", "label", "row"))
        self.x = matrix(table["vec"].combine_chunks())

    def best(self, scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and row of the ``most`` highest allowed scores of each anchor, smaller ids first among equals."""
        if not allowed.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(allowed.any(axis=1))
        scores, allowed = scores[some], allowed[some]
        n = scores.shape[1]
        top = min(most, n)
        if np.abs(scores).max(initial=0) < (1 << 52) // n:
            # one number for score and place, so that no two are equal
            rank = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -np.inf)
            at = np.argpartition(-rank, top - 1, axis=1)[:, :top]
        else:
            order = np.argsort(-scores.astype(np.int64), axis=1, kind="stable")
            free = np.take_along_axis(allowed, order, axis=1)
            first = np.argsort(~free, axis=1, kind="stable")[:, :top]
            at = np.take_along_axis(order, first, axis=1)
        good = np.take_along_axis(allowed, at, axis=1)
        return np.repeat(some, good.sum(axis=1)), at[good]


def _highest(scores: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """The score that ``most`` allowed ones reach, for each anchor; minus infinity where there are fewer."""
    if scores.shape[1] < most:
        return np.full(len(scores), -np.inf)
    return np.partition(np.where(allowed, scores, -np.inf), -most, axis=1)[:, -most]


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, sample: int = SAMPLE, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``vec_id``. Positives of an anchor are the ``positives`` other rows of
    its label with the highest scores, negatives of both the ``negatives`` highest rows of other labels
    with ``low`` to ``high`` percent of the positive's score.
    """
    taking_part = stored(prepared(rows, vec_id, vector, label, scale), "whole-vectors")
    index = Index(taking_part, sample, fan, block)
    release(taking_part)
    tree, known = index.tree, index.known

    def ask_positives(batches):
        for batch in batches:
            x, ids, labels = matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            other = (known["label"] == labels[:, None]) & (known["vec_id"] != ids[:, None])
            least = _highest(products(x, known["x"]), other, positives)
            leaves = tree.meets(x, least[:, None], np.full((len(x), 1), np.inf))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(least), pa.array([np.flatnonzero(m).astype(np.int32) for m in leaves], pa.list_(pa.int32()))],
                ["row", "vec", "vec_id", "label", "least", "leaves"])

    def take_positives(held, part):
        x, ids, labels, row, least = matrix(part["vec"]), part["vec_id"].to_numpy(), part["label"].to_numpy(), part["row"].to_numpy(), part["least"].to_numpy()
        scores = products(x, held.x)
        who, what = held.best(scores, (held.label == labels[:, None]) & (held.row != row[:, None]) & (scores >= least[:, None]), positives)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[who]), pa.array(held.vec_id[what]), pa.array(scores[who, what].astype(np.int64))], ["row", "positive_id", "score"])

    chosen = index.rows.where(anchors).select("row", "vec", "vec_id", "label")
    asked = stored(chosen.mapInArrow(ask_positives, "row long, vec array<int>, vec_id long, label long, least double, leaves array<int>"), "anchors")
    near = index.search(asked, take_positives, "row long, positive_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id")
    top = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    each = top.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "score"))).alias("p"))  # at most ``positives``

    def ask_negatives(batches):
        for batch in batches:
            x, labels = matrix(batch.column(1)), batch.column(3).to_numpy()
            scores = batch.column(5).to_pylist()
            least, upto = np.full((len(x), positives), np.inf), np.full((len(x), positives), -np.inf)
            for i, some in enumerate(scores):
                for w, score in enumerate(some):
                    least[i, w], upto[i, w] = -(-score * low // 100), score * high // 100
            exact = (np.abs(least) < 1 << 53) & (np.abs(upto) < 1 << 53)
            least, upto = np.where(exact, least, np.nextafter(least, -np.inf)), np.where(exact, upto, np.nextafter(upto, np.inf))
            sampled, other = products(x, known["x"]), known["label"] != labels[:, None]
            for w in range(positives):
                within = other & (sampled >= least[:, w, None]) & (sampled <= upto[:, w, None])
                least[:, w] = np.where(exact[:, w], np.maximum(least[:, w], _highest(sampled, within, negatives)), least[:, w])
            leaves = tree.meets(x, least, upto)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(least), pa.list_(pa.float64())), pa.array([np.flatnonzero(m).astype(np.int32) for m in leaves], pa.list_(pa.int32()))],
                ["row", "vec", "vec_id", "label", "positive_id", "positive_score", "least", "leaves"])

    def take_negatives(held, part):
        x, ids, labels, row = matrix(part["vec"]), part["vec_id"].to_numpy(), part["label"].to_numpy(), part["row"].to_numpy()
        lists = {c: part[c].to_pylist() for c in ("positive_id", "positive_score", "least")}
        scores = products(x, held.x)
        other = held.label != labels[:, None]
        for w in range(positives):
            has = np.array([len(p) > w for p in lists["positive_id"]])
            if not has.any():
                break
            positive, reached, least = (np.array([p[w] if h else 0 for p, h in zip(lists[c], has, strict=True)]) for c in ("positive_id", "positive_score", "least"))
            s, r = scores, reached
            if max(low, high, 100) * max(np.abs(scores).max(initial=0), np.abs(reached).max(initial=0)) >= 1 << 53:
                s, r = scores.astype(object), reached.astype(object)
            window = (100 * s >= (low * r)[:, None]) & (100 * s <= (high * r)[:, None])
            who, what = held.best(scores, other & has[:, None] & (scores >= least[:, None]) & window.astype(bool), negatives)
            yield pa.RecordBatch.from_arrays([
                pa.array(row[who]), pa.array(np.full(who.size, w, np.int32)), pa.array(ids[who]), pa.array(positive[who].astype(np.int64)),
                pa.array(held.vec_id[what]), pa.array(reached[who].astype(np.int64)), pa.array(scores[who, what].astype(np.int64)),
            ], ["row", "k", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    pairs = asked.select("row", "vec", "vec_id", "label").join(each, "row").select(
        "row", "vec", "vec_id", "label", F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    asked_next = stored(pairs.mapInArrow(
        ask_negatives, "row long, vec array<int>, vec_id long, label long, positive_id array<long>, positive_score array<long>, least array<double>, leaves array<int>"), "pairs")
    hard = index.search(
        asked_next, take_negatives, "row long, k int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("row", "k").orderBy(F.col("negative_score").desc(), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
