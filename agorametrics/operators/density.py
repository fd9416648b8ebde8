"""Density clusters of vectors: nearest neighbours, mutual reachability, a spanning forest, the most stable clusters.

Neighbours are looked for along random lines: in each of ``tables`` orders (signs of random hyperplanes, then
place on a random line) a vector is compared with those within half a ``window``. Orders are cut by
range, so the densest spot of all is as many windows as it needs, and no task holds more than one.

The distance of two neighbours is their mutual reachability: the largest of their distance and their distances
to their ``min_samples``-th nearest other vector. Rounds of Boruvka keep the edges of a minimum spanning
forest. Its edges join components level by level, from near to far; ``levels`` quantiles of their lengths are the
levels, or all lengths if there are fewer. A component of ``min_size`` vectors is a cluster, two clusters
that join make a new one. A cluster's stability is the sum over its vectors of 1/length at which they leave
it, less 1/length at which it joins another. Clusters are chosen from the leaves up where they are more stable than
those below them together; the cluster of all vectors is none. All others are outliers, cluster -1.

Ids must be whole and unique; vectors have one length. Everything is exact when ``window`` holds all vectors
twice, and up to the neighbours that no order shows beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorametrics.operators.graph import components
from agorametrics.session import materialize

OUTLIER = -1
LEAST = 1e-6  # lengths below count as this


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def neighbours(points: DataFrame, k: int, row_id: str = "id", vector: str = "vector", tables: int = 8, bits: int = 4, window: int = 512, seed: int = 42) -> DataFrame:
    """id, other, d: the ``k`` nearest of the vectors met in any order, smaller ids first among equals."""
    half = window // 2

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            random = np.random.default_rng(seed)
            for t in range(tables):
                planes, line = random.normal(size=(x.shape[1], bits)), random.normal(size=x.shape[1])
                code = ((x @ planes > 0) << np.arange(bits)).sum(axis=1) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(x @ line), batch.column(0), batch.column(1)],
                    ["t", "code", "at", "id", "vector"])

    def compare(batches):
        """Each row against those up to half a window before and behind it in its order."""
        held: list[tuple] = []

        def met(parts, first):
            """Rows from ``first`` on against all of a run, the nearest of each."""
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            norms = (x * x).sum(axis=1)
            for lo in range(first, len(ids), half):
                own = slice(lo, min(lo + half, len(ids)))
                near = slice(max(0, lo - half), min(lo + 2 * half, len(ids)))
                d = np.maximum(norms[own, None] + norms[near] - 2 * x[own] @ x[near].T, 0)
                place = np.arange(own.start, own.stop)[:, None] - np.arange(near.start, near.stop)
                # equal vectors are at no distance, whatever rounding says
                d[(x[own][:, :1] == x[near][:, 0]) & (d < 1e-9 * (1 + norms[own, None]))] = 0
                d[(np.abs(place) > half) | (place == 0)] = np.inf
                order = np.lexsort((np.broadcast_to(ids[near], d.shape), d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, axis=1)
                good = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[own], good.sum(axis=1))), pa.array(ids[near][order][good]), pa.array(np.sqrt(best[good]))], ["id", "other", "d"])

        def run(parts, before):
            return met(parts, before)

        table, before = None, 0
        for batch in batches:
            t = batch.column(0).to_numpy()
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), batch.num_rows]), strict=True):
                if hi == lo:
                    continue
                if t[lo] != table:
                    if held:
                        yield from run(held, before)
                    table, held, before = t[lo], [], 0
                held.append((batch.column(3).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(4).slice(lo, hi - lo))))
                total = sum(len(p[0]) for p in held)
                if total >= 8 * half:
                    # all but the last half window can be finished; what is kept is compared with what comes
                    ids, x = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
                    done = total - half
                    for part in met([(ids, x)], before):
                        keep = np.isin(part.column(0).to_numpy(), ids[:done])
                        yield part.filter(pa.array(keep))
                    held, before = [(ids[max(0, done - half):], x[max(0, done - half):])], min(half, done)
        if held:
            yield from run(held, before)

    own = points.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    ordered = own.mapInArrow(place, "t int, code long, at double, id long, vector array<double>").repartitionByRange("t", "code", "at").sortWithinPartitions("t", "code", "at", "id")
    pairs = ordered.mapInArrow(compare, "id long, other long, d double").groupBy("id", "other").agg(F.min("d").alias("d"))
    order = Window.partitionBy("id").orderBy("d", "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reachability(near: DataFrame, min_samples: int) -> DataFrame:
    """a, b, w (a < b): mutual reachability of neighbours; a vector with fewer than ``min_samples`` has none."""
    core = near.where(F.col("rank") == min_samples).select("id", F.col("d").alias("core"))
    both = near.join(core, "id").join(core.select(F.col("id").alias("other"), F.col("core").alias("core_b")), "other")
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest("d", "core", "core_b").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges a, b, w of a minimum spanning forest; equal weights go by their ends."""
    open_edges = materialize(edges.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "open-edges")
    parts = []
    while open_edges.limit(1).count():
        edge = F.struct("w", "a", "b", "ca", "cb").alias("e")
        sides = open_edges.select(F.col("ca").alias("c"), edge).unionByName(open_edges.select(F.col("cb").alias("c"), edge))
        chosen = materialize(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen-edges")
        parts.append(chosen.select("a", "b", "w"))
        root = components(chosen, "ca", "cb")
        open_edges = materialize(_moved(open_edges, root).where("ca <> cb"), "open-edges")
    out = edges.limit(0).select("a", "b", "w")
    for part in parts:
        out = out.unionByName(part)
    return out


def _moved(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Edges with the components their ends are in now."""
    for end in ("ca", "cb"):
        named = root.select(F.col("node").alias(end), F.col("root").alias("_r"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    return edges


def level_lengths(forest: DataFrame, levels: int) -> list[float]:
    """At most ``levels`` lengths, ascending, the longest edge's among them."""
    few = [r.w for r in forest.select("w").distinct().orderBy("w").limit(levels + 1).collect()]
    if len(few) <= levels:
        return few
    shares = [(i + 1) / levels for i in range(levels - 1)]
    cuts = forest.agg(F.percentile_approx("w", shares, 100_000).alias("q"), F.max("w").alias("top")).first()
    return sorted({*cuts.q, cuts.top})


def clusters(points: DataFrame, min_size: int = 10, min_samples: int = 5, levels: int = 16, row_id: str = "id", vector: str = "vector", **options) -> DataFrame:
    """id, cluster_id of all points: the smallest id of the cluster, or -1."""
    near = materialize(neighbours(points, max(min_samples, 1), row_id, vector, **options), "neighbours")
    forest = materialize(spanning_forest(reachability(near, min_samples)), "forest")
    return label(points.select(F.col(row_id).cast("long").alias("id")), forest, level_lengths(forest, levels), min_size)


def label(ids: DataFrame, forest: DataFrame, lengths: list[float], min_size: int) -> DataFrame:
    """id, cluster_id by the stability of the clusters the levels of a forest make."""
    spark = ids.sparkSession
    # vectors that are in no cluster yet; components of more than one vector, and their cluster once they have one
    loose = materialize(ids.withColumn("c", F.col("id")), "loose")
    parts = spark.createDataFrame([], "c long, s long, k string, ks long, sum double")
    edges = materialize(forest.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "forest-edges")
    closed, firsts = [], []
    for n, length in enumerate(lengths):
        now = edges.where(F.col("w") <= length)
        density = 1 / max(length, LEAST)
        root = materialize(components(now, "ca", "cb"), "roots")
        # every joined component with its size and cluster; one of a single vector is in no table
        old = root.join(parts, root["node"] == parts["c"], "left").select(
            "node", "root", F.coalesce("s", F.lit(1)).alias("s"), "k", "ks", "sum")
        joined = materialize(old.groupBy("root").agg(
            F.sum("s").alias("s"), F.count("k").alias("n"), F.max("k").alias("k"), F.max("ks").alias("ks"), F.max("sum").alias("sum")), "joined")
        fresh_name = F.concat_ws(":", F.lit(n), F.col("root"))
        stays, born = F.col("n") == 1, (F.col("n") != 1) & (F.col("s") >= min_size)
        new = joined.select(
            F.col("root").alias("c"), "s", F.when(stays, F.col("k")).when(born, fresh_name).alias("k"),
            F.when(stays | born, F.col("s")).alias("ks"),
            F.when(stays, F.col("sum") + (F.col("s") - F.col("ks")) * density).when(born, F.col("s") * density).alias("sum"))
        ended = old.where("k is not null").join(joined.where("n > 1").select("root"), "root").select(
            "k", F.concat_ws(":", F.lit(n), F.col("root")).alias("parent"), (F.col("sum") - F.col("ks") * density).alias("stability"))
        closed.append(materialize(ended, "ended"))
        kept = parts.join(root.select(F.col("node").alias("c")), "c", "left_anti")
        parts = materialize(kept.unionByName(new), "parts")
        # a vector belongs to the cluster it is in first
        placed = materialize(loose.join(root, loose["c"] == root["node"], "left").select("id", F.coalesce("root", "c").alias("c")).join(
            parts.select("c", "k"), "c", "left"), "placed")
        firsts.append(placed.where("k is not null").select("id", "k"))
        loose = placed.where("k is null").select("id", "c")
        edges = materialize(_moved(edges.where(F.col("w") > length), root), "forest-edges")
    if not closed:
        return ids.select("id", F.lit(OUTLIER).cast("long").alias("cluster_id"))
    tops = parts.where("k is not null").select("k", F.lit(None).cast("string").alias("parent"), F.col("sum").alias("stability"))
    tree = materialize(_all(closed).unionByName(tops), "cluster-tree")
    chosen = _chosen(tree)
    found = _all(firsts).join(chosen, "k").select("id", "pick")
    names = found.groupBy("pick").agg(F.min("id").alias("cluster_id"))
    labelled = found.join(names, "pick").select("id", "cluster_id")
    return ids.join(labelled, "id", "left").select("id", F.coalesce("cluster_id", F.lit(OUTLIER)).cast("long").alias("cluster_id"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _chosen(tree: DataFrame) -> DataFrame:
    """k, pick: the chosen cluster each cluster is part of; clusters above the chosen ones have none.

    The number in front of a cluster's name is the level that made it: children come before their parents.
    """
    born = F.split("k", ":")[0].cast("int")
    tree = tree.withColumn("born", born)
    single = tree.where("parent is null").limit(2).count() < 2  # one top is the cluster of all, and none
    worth = tree.limit(0).select("k", F.col("stability").alias("value"), F.lit(True).alias("own"))
    for n in sorted(r.born for r in tree.select("born").distinct().collect()):  # levels
        mine = tree.where(F.col("born") == n)
        below = worth.join(tree.select("k", "parent"), "k").where("parent is not null").groupBy(F.col("parent").alias("k")).agg(F.sum("value").alias("below"))
        own = F.col("stability") >= F.coalesce("below", F.lit(float("-inf")))
        if single:
            own = own & F.col("parent").isNotNull()
        worth = materialize(worth.unionByName(mine.join(below, "k", "left").select(
            "k", F.when(own, F.col("stability")).otherwise(F.coalesce("below", F.lit(0.0))).alias("value"), own.alias("own"))), "worth")
    # from the tops down: what a chosen cluster holds is part of it
    marked = worth.join(tree.select("k", "parent", "born"), "k")
    out = materialize(marked.where("parent is null").select("k", F.when(F.col("own"), F.col("k")).alias("pick")), "picks")
    level = out
    while True:
        level = materialize(marked.join(level.select(F.col("k").alias("parent"), F.col("pick").alias("above")), "parent").select(
            "k", F.coalesce("above", F.when(F.col("own"), F.col("k"))).alias("pick")), "picks")
        if not level.limit(1).count():
            return out.where("pick is not null")
        out = out.unionByName(level)
