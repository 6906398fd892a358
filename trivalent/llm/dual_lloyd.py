"""Centroid clustering: exact Lloyd rounds by dual traversal of a cover tree over vectors and a tree over centroids.

Vectors become whole numbers (floor(scale * x)) and are dealt into blocks of BLOCK as they are
read, without a shuffle. Each block gets a cover tree, built once and stored: nested levels with
halving radii, points in leaf order, every node with the true radius of what lies below it. A
round plants a tree over the centroids in each task and walks both down together. A pair of
nodes goes when no centroid below can be nearest to any vector below, by the distance of the centres and
both radii against the best upper bound of the vector node; a vector node with one centroid left
takes it whole, its sum read from prefix sums. Pairs of leaves are compared exactly, in
64-bit whole numbers; ties go to the smaller centroid. Bounds are taken in double precision with
a margin and only drop what lies strictly beyond it.

A round sends one row of sums a block and centroid to be added up; the driver holds the centroids
(clusters * dimension numbers), which is all that is sent to tasks.

Cases: vectors of another dimension, null ones and those with null or non-finite components are
left out; fewer vectors than clusters give as many clusters as there are vectors; rows that repeat a
vec_id are separate vectors (as seeds in the order of their components); rows without
vec_id are clustered, but are no seeds while others are there; an empty table gives no rows;
label and other columns aren't read. Whole numbers beyond 2**27 would overflow exact
distances and raise an error.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.cover_tree import _flat
from trivalent.llm.shared import materialize
from trivalent.llm.words import ragged

BLOCK = 4096
#: Largest whole number of a component: 64 squared differences of twice that stay below 2**63.
LARGEST = 1 << 27
#: Pairs of nodes whose distances are taken at a time.
CHUNK = 1 << 15
SLACK = 1e-9


def squared(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of a[i] and b[j]."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), CHUNK):
        gap = a[i[at : at + CHUNK]] - b[j[at : at + CHUNK]]
        out[at : at + CHUNK] = np.einsum("ij,ij->i", gap, gap)
    return out


class Tree:
    """Levels of nodes over points in leaf order: node n of level k covers points lo[k][n] to hi[k][n], its centre is the first of them.

    The last level is the points. Centres of one parent are farther apart than the level's radius, which halves from level to level.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        whole = np.zeros(1, np.int64), np.array([len(points)])
        self.levels = [(*whole, self._radius(*whole))]
        radius = self.levels[0][2][0] / 2
        while self.levels[-1][2].max() > 0 and len(self.levels) < 12:
            self._split(radius)
            radius /= 2
        at = np.arange(len(points))
        self.levels.append((at, at + 1, np.zeros(len(points))))
        # A node's centre may have changed as deeper levels put its points in another order.
        self.levels = [(lo, hi, self._radius(lo, hi)) for lo, hi, _ in self.levels]
        self.children = [(np.searchsorted(below[0], lo), np.searchsorted(below[0], hi)) for (lo, hi, _), below in zip(self.levels, self.levels[1:])]

    def _radius(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        gaps = squared(self.points, np.arange(len(self.points)), self.points, np.repeat(lo, hi - lo))
        return np.sqrt(np.maximum.reduceat(gaps, lo).astype(float)) * (1 + SLACK)

    def _split(self, radius: float) -> None:
        begins = []
        for lo, hi, wide in zip(*(x.tolist() for x in self.levels[-1])):
            if wide <= radius:
                begins.append(lo)
                continue
            own = self._cover(lo, hi, radius)
            turn = lo + np.argsort(own, kind="stable")
            self.points[lo:hi], self.order[lo:hi] = self.points[turn], self.order[turn]
            begins += (lo + np.searchsorted(np.sort(own), np.arange(own.max() + 1))).tolist()
        lo = np.array(begins)
        hi = np.r_[lo[1:], len(self.points)]
        self.levels.append((lo, hi, self._radius(lo, hi)))

    def _cover(self, lo: int, hi: int, radius: float) -> np.ndarray:
        """Balls of points lo to hi: each point's ball, by the first centre within radius."""
        own, left, number = np.full(hi - lo, -1), np.arange(hi - lo), 0
        part = self.points[lo:hi].astype(np.float64)
        norms = np.einsum("ij,ij->i", part, part)
        while len(left):
            c = left[0]
            near = norms[left] + norms[c] - 2 * (part[left] @ part[c]) <= radius * radius
            near[0] = True
            own[left[near]] = number
            left, number = left[~near], number + 1
        return own


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid of each of the tree's points, in its order, and the number of exact comparisons made."""
    other = Tree(centroids.copy())
    label = np.full(len(tree.points), -1)
    at, to = 0, 0
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    compared = 0
    while len(i):
        last = at == len(tree.levels) - 1 and to == len(other.levels) - 1
        (lo, hi, r), (clo, _, cr) = tree.levels[at], other.levels[to]
        far = squared(tree.points, lo[i], other.points, clo[j])
        if last:
            # i is in order: each point's least distance, then the smallest centroid that has it.
            compared += len(i)
            number = other.order[clo[j]]
            order = np.lexsort((number, far, i))
            first = order[np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])]
            label[lo[i[first]]] = number[first]
            break
        gap = np.sqrt(far.astype(float))
        begin = np.flatnonzero(np.r_[True, np.diff(i) != 0])
        runs = np.diff(np.r_[begin, len(i)])
        # Every vector below i has a centroid (the centre of j's node) within this bound.
        best = np.repeat(np.minimum.reduceat(gap + r[i], begin), runs)
        keep = gap - r[i] - cr[j] <= best + SLACK * (1 + best)
        i, j = i[keep], j[keep]
        if to == len(other.levels) - 1:
            begin = np.flatnonzero(np.r_[True, np.diff(i) != 0])
            alone = np.diff(np.r_[begin, len(i)]) == 1
            done = begin[alone]
            sizes = hi[i[done]] - lo[i[done]]
            label[ragged(lo[i[done]], sizes)] = np.repeat(other.order[clo[j[done]]], sizes)
            open_ = np.ones(len(i), bool)
            open_[done] = False
            i, j = i[open_], j[open_]
        # Down one level on both sides where there is one; i stays in order.
        if at < len(tree.levels) - 1:
            first, end = (x[i] for x in tree.children[at])
            n = end - first
            i, j, at = ragged(first, n), np.repeat(j, n), at + 1
        if to < len(other.levels) - 1:
            first, end = (x[j] for x in other.children[to])
            n = end - first
            i, j, to = np.repeat(i, n), ragged(first, n), to + 1
        turn = np.argsort(i, kind="stable")
        i, j = i[turn], j[turn]
    return label, compared


def _whole(vector: str, size: int, scale: int) -> F.Column:
    valid = f"{vector} is not null and size({vector}) = {size} and forall({vector}, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
    return F.expr(f"case when {valid} then transform({vector}, v -> floor({scale} * v)) end")


def _planted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors as trees; batches are joined until a block is full."""

    def planted(rows: pa.Table) -> pa.RecordBatch:
        tree = Tree(np.asarray(_flat(rows["v"]).flatten(), np.int64).reshape(-1, size).copy())
        ids = _flat(rows["vec_id"]).take(pa.array(tree.order)).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((tree, ids), 5)], pa.binary())], ["tree"])

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            held, n = [*held, part], n + part.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield planted(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
    if n:
        yield planted(pa.Table.from_batches(held))


def kmeans(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    read = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v"))
    kept = read.withColumn("v", _whole("v", size, scale)).where("v is not null")
    fits = F.expr(f"assert_true(forall(v, x -> abs(x) <= {LARGEST}), 'components beyond 2**27 do not fit exact distances')").isNull()
    kept = materialize(kept.where(fits).select("vec_id", F.col("v").cast("array<long>").alias("v")), "vectors")
    ranked = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters)
    centroids = np.array([r["v"] for r in ranked.select("v").collect()], np.int64).reshape(-1, size)  # a row a cluster
    trees = materialize(kept.mapInArrow(lambda batches: _planted(batches, size), "tree binary"), "trees")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("tree"):
                tree = pickle.loads(blob.as_py())[0]
                label, _ = assign(tree, centroids)
                total = np.r_[np.zeros((1, size), np.int64), np.cumsum(tree.points, 0)]
                begin = np.flatnonzero(np.r_[True, np.diff(label) != 0])
                end = np.r_[begin[1:], len(label)]
                sums, counts = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
                np.add.at(sums, label[begin], total[end] - total[begin])
                np.add.at(counts, label[begin], end - begin)
                some = np.flatnonzero(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(sums[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(some), lists, pa.array(counts[some])], ["cluster", "sums", "n"])

    for _ in range(rounds if len(centroids) else 0):
        parts = trees.mapInArrow(summed, "cluster long, sums array<long>, n long")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[c].cast("decimal(20,0)")).alias(f"s{c}") for c in range(size)))
        moved = centroids.copy()
        for row in added.collect():  # a row a cluster
            moved[row["cluster"]] = [int(Decimal(row[f"s{c}"])) // row["n"] for c in range(size)]
        centroids = moved

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("tree"):
                tree, ids = pickle.loads(blob.as_py())
                label, _ = assign(tree, centroids)
                far = squared(tree.points, np.arange(len(label)), centroids, label)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label.astype(np.int32)), pa.array(far), pa.array([digests[c] for c in label.tolist()], pa.string())], ["vec_id", "cluster", "distance", "centroid_sha256"])

    found = materialize(trees.mapInArrow(assigned, "vec_id long, cluster int, distance long, centroid_sha256 string"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    inertia = vectors.sparkSession.createDataFrame([(c, d) for c, d in sums.items()], "cluster int, cluster_inertia long")
    return found.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
