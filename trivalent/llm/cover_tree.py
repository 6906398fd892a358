"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Distances are chords of the unit sphere, for which the triangle inequality holds:
cosine >= c is a chord of at most sqrt(2 - 2c). Vectors are dealt into blocks by space: each
goes to the nearest pivot (pivots are farthest-first centres of a bounded sample), and a
cell of more than a block's vectors is cut into shells by the distance from its pivot. A
vector's block follows from its components alone, in whole numbers, so that equal vectors
meet in one block, where they become one class. Each block gets a cover tree, built once and
stored: nested sets of centres with radii RADII, halving from level to level, every node with
the true radius of what lies below it. Two trees are traversed together: a pair of nodes is
dropped when its centres are farther apart than both radii and the threshold, counted whole
when all below them must link, and opened otherwise. Before that, trees whose balls are too
far apart are dropped, and so are nodes by their angles to the other tree's middle: a link of
x and y takes y within the threshold of x's own angle to x's middle, and x likewise.
Single precision serves only to drop pairs, with a margin; links are decided in double precision.

Every tree meets every other where it was written: a task holds the trees of one file and lets
its share of all trees pass by, so that no tree is shuffled. What a task writes are link counts
and a spanning forest of its links, not the links themselves, so dense groups don't multiply
rows. The time spent on reading and on pairs of blocks grows with the square of the input.
A block holds at most about BLOCK_BYTES of vectors, a file about FILE_BYTES; what the driver
holds is pivots, and marks and counts of their cells.

Cases: a null vector, one with a null or non-finite component, or of length zero links
with nothing (n_links 0, its own component, kept); vectors of different dimension don't
link; rows that repeat a vec_id are separate vectors that share one result row each; a null
vec_id links with nothing; an empty table gives no rows; label and other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.components import connected_components
from trivalent.llm.shared import join_unique, materialize, release_memory
from trivalent.llm.words import ragged

RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Bytes of vectors (in double precision) of a block, of a file of blocks.
BLOCK_BYTES, FILE_BYTES = 8 << 20, 64 << 20
#: Files of blocks at least, and the least and most shares of the blocks that pass by each file.
FILES, SHARES = 3, (3, 16)
#: Bytes of an Arrow batch while blocks pass by.
BATCH_BYTES = 16 << 20
#: Marks of the distances in a cell; its shells are made of them.
MARKS = 64
#: Rows of the sample that pivots come from, and the most pivots, for each dimension of more than a block's vectors.
SAMPLE, PIVOTS = 4096, 1024
MARGIN = 1e-3
#: Node pairs that are opened at a time, and parts of a tree by angle that meet part by part.
FRONTIER, PARTS = 1 << 18, 8
#: Pairs of points of two nodes that may meet at once.
LOOSE = 2048
#: Times the nodes of the top that the level may have at which a traversal begins.
DEEPER = 8


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first centres of unit vectors."""
    if not len(sample):
        return sample
    chosen, far = [0], 2 - 2 * sample @ sample[0]
    while len(chosen) < min(count, len(sample)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[chosen]


def cover(small: np.ndarray, radius: float) -> np.ndarray:
    """For each point the number of a ball that holds it; the balls' centres are farther apart than radius."""
    least = np.float32(1 - radius * radius / 2)
    owner, centres = np.empty(len(small), np.int64), np.zeros(0, np.int64)
    for at in range(0, len(small), 1024):
        part = np.arange(at, min(at + 1024, len(small)))
        best, which = np.full(len(part), -2, np.float32), np.zeros(len(part), np.int64)
        for c in range(0, len(centres), 4096):
            near = small[part] @ small[centres[c : c + 4096]].T
            top = near.argmax(1)
            value = near[np.arange(len(part)), top]
            better = value > best
            best[better], which[better] = value[better], c + top[better]
        owner[part] = which
        rest = part[best < least]
        near = small[rest] @ small[rest].T >= least
        free, new = np.ones(len(rest), bool), []
        for i in range(len(rest)):
            if free[i]:
                taken = free & near[i]
                taken[i] = True
                owner[rest[taken]] = len(centres) + len(new)
                new.append(rest[i])
                free &= ~taken
        centres = np.concatenate([centres, np.array(new, np.int64)])
    return owner


class Tree:
    """A cover tree over vectors, points in the order of its leaves; level k's nodes cover ranges of points."""

    def __init__(self, scaled: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        """scaled: rows of a largest component of about 1."""
        units = units_of(scaled)
        node = cover(units.astype(np.float32), RADII[0])
        order = np.argsort(node, kind="stable")
        self.units, self.order, node = units[order], order, node[order]
        self.lo, self.hi, self.radius = [], [], []
        self._level(node)
        for radius in RADII[1:]:
            node = self._split(node, radius)
            self._level(node)
        self.middle, self.reach = self.ball()
        self.scaled, self.ids, self.weights = scaled[self.order], ids[self.order], weights[self.order]

    def _level(self, node: np.ndarray) -> None:
        """A level whose nodes are runs of equal numbers; a node's centre is its first point."""
        lo = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        hi = np.r_[lo[1:], len(node)]
        gaps = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.units, np.repeat(self.units[lo], hi - lo, 0))))
        self.lo.append(lo), self.hi.append(hi), self.radius.append(np.maximum.reduceat(gaps, lo) + 1e-9)

    def _split(self, node: np.ndarray, radius: float) -> np.ndarray:
        """The next level: nodes wider than radius are covered anew by balls of it, their points put in that order."""
        inner = np.zeros(len(node), np.int64)
        for i in np.flatnonzero(self.radius[-1] > radius).tolist():
            a, b = self.lo[-1][i], self.hi[-1][i]
            own = cover(self.units[a:b].astype(np.float32), radius)
            order = np.argsort(own, kind="stable")
            self.units[a:b], self.order[a:b], inner[a:b] = self.units[a:b][order], self.order[a:b][order], own[order]
            self._tighten(a, b)
        number = np.repeat(np.arange(len(self.lo[-1])), self.hi[-1] - self.lo[-1])
        return np.cumsum(np.r_[0, (number[1:] != number[:-1]) | (inner[1:] != inner[:-1])])

    def _tighten(self, a: int, b: int) -> None:
        """The first points of the nodes above that hold points a to b may be others now: their radii are taken again."""
        for lo, hi, radius in zip(self.lo, self.hi, self.radius):
            i = int(np.searchsorted(lo, a, "right")) - 1
            if lo[i] == a:
                gaps = 2 - 2 * self.units[lo[i] : hi[i]] @ self.units[lo[i]]
                radius[i] = np.sqrt(max(0.0, float(gaps.max()))) + 1e-9

    def ball(self) -> tuple[np.ndarray, float]:
        """A centre (of length one) and the radius about it that holds all points."""
        middle = self.units.mean(0)
        size = np.sqrt(middle @ middle)
        middle = middle / size if size > 1e-6 else self.units[0]
        return middle, float(np.sqrt(np.maximum(0, 2 - 2 * self.units @ middle).max())) + 1e-9

    def packed(self) -> bytes:
        """The vectors as they are, and levels by their differences, which compress well."""
        levels = [np.diff(np.r_[lo, len(self.ids)]).astype(np.uint32) for lo in self.lo]
        levels = zstandard.compress(pickle.dumps((levels, [np.nextafter(r.astype(np.float32), np.float32(9)) for r in self.radius]), 5), 1)
        return pickle.dumps((self.scaled, self.ids, self.weights, self.middle, self.reach, levels), 5)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        self = cls.__new__(cls)
        self.scaled, self.ids, self.weights, self.middle, self.reach, levels = pickle.loads(data)
        widths, self.radius = pickle.loads(zstandard.decompress(levels))
        n = len(self.ids)
        # Level k's node i covers the points from at[k][i] to at[k][i + 1] and has the next level's nodes from into[k][i] to into[k][i + 1].
        self.at = [np.r_[0, np.cumsum(w)].astype(np.int32) for w in widths] + [np.arange(n + 1, dtype=np.int32)]
        self.into = [np.searchsorted(below, at).astype(np.int32) for at, below in zip(self.at, self.at[1:])]
        self.total = np.r_[0, np.cumsum(self.weights)]
        # Where a traversal begins: the deepest level of so few more nodes than the top that products of all its
        # pairs take no longer than opening those of the top one by one; its balls are smaller.
        self.start = max(k for k in range(len(RADII)) if len(widths[k]) <= DEEPER * len(widths[0]))
        self._begin = {}
        return self

    def units_at(self, points: np.ndarray) -> np.ndarray:
        return units_of(self.scaled[points])

    def small(self, points: np.ndarray) -> np.ndarray:
        """Unit vectors in single precision."""
        rows = self.scaled[points].astype(np.float32, copy=False)
        return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]

    def begin(self, k: int) -> tuple[np.ndarray, ...]:
        """Of level k by the angle of a node's farthest point from the middle: nodes, centres in single precision, angular radii, those angles."""
        if k not in self._begin:
            small = self.small(self.at[k][:-1])
            wide = 2 * np.arcsin(np.minimum(1, self.radius[k] / 2))
            far = angles(small, self.middle) + wide
            by = np.argsort(far, kind="stable").astype(np.int32)
            self._begin[k] = by, small[by], wide[by], far[by]
        return self._begin[k]


def angles(small: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(small @ middle.astype(np.float32), -1, 1))


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Points x and y are joined: all points joined get the label of the least of them."""
    while True:
        p, q = label[x], label[y]
        low = np.minimum(p, q)
        if (p == q).all():
            return
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Links:
    """Link counts and joined points of a pair of trees; numbers of the second follow those of the first."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.same = a, b, a is b
        self.shift = 0 if self.same else len(a.ids)
        self.added, self.more = np.zeros(self.shift + len(b.ids) + 1, np.int64), np.zeros(self.shift + len(b.ids), np.int64)
        self.label = np.arange(self.shift + len(b.ids))

    def whole(self, k: int, i: np.ndarray, j: np.ndarray) -> None:
        """All points below node i of a link with all below node j of b."""
        a, b = self.a, self.b
        ai, ah, bi, bh = (x.astype(np.int64) for x in (a.at[k][i], a.at[k][i + 1], b.at[k][j], b.at[k][j + 1]))
        np.add.at(self.added, ai, b.total[bh] - b.total[bi])
        np.add.at(self.added, ah, b.total[bi] - b.total[bh])
        other = ~(self.same & (i == j))
        np.add.at(self.added, self.shift + bi[other], (a.total[ah] - a.total[ai])[other])
        np.add.at(self.added, self.shift + bh[other], (a.total[ai] - a.total[ah])[other])
        join(self.label, np.repeat(ai, ah - ai), ragged(ai, ah - ai))
        join(self.label, np.repeat(ai, bh - bi), self.shift + ragged(bi, bh - bi))

    def open(self, k: int, i: np.ndarray, j: np.ndarray, chord: float, cosine: float) -> None:
        a, b = self.a, self.b
        if k == len(RADII):
            hit = np.einsum("ij,ij->i", a.units_at(i), b.units_at(j)) >= cosine
            if hit.any():
                self.whole(k, i[hit], j[hit])
            return
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.units_at(a.at[k][i]), b.units_at(b.at[k][j]))))
        reach = a.radius[k][i].astype(np.float64) + b.radius[k][j]
        inside = np.where(self.same & (i == j), 2 * a.radius[k][i].astype(np.float64), gap + reach) <= chord - 1e-9
        if inside.any():
            self.whole(k, i[inside], j[inside])
        keep = ~inside & (gap <= reach + chord + 1e-9)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        points, others = (t.at[k][x + 1].astype(np.int64) - t.at[k][x] for t, x in ((a, i), (b, j)))
        below, beside = (t.into[k][x + 1].astype(np.int64) - t.into[k][x] for t, x in ((a, i), (b, j)))
        sizes = below * beside
        # Balls of many points that the next level hardly gathers meet point by point.
        loose = (points * others >= LOOSE) & (2 * sizes > points * others)
        for x, y in zip(i[loose].tolist(), j[loose].tolist()):
            p, q = np.arange(a.at[k][x], a.at[k][x + 1]), np.arange(b.at[k][y], b.at[k][y + 1])
            ca, cb = a.small(p), b.small(q)
            for at in range(0, len(p), 512):
                for of in range(0, len(q), 4096):
                    self.points(p[at : at + 512], q[of : of + 4096], ca[at : at + 512] @ cb[of : of + 4096].T, cosine)
        i, j, sizes, beside = i[~loose], j[~loose], sizes[~loose], beside[~loose]
        if not len(i):
            return
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(sizes) // FRONTIER)) + 1):
            p, q, n = i[part], j[part], sizes[part]
            wide = np.repeat(beside[part], n)
            at = ragged(np.zeros(len(n), np.int64), n)
            x, y = np.repeat(a.into[k][p], n) + at // wide, np.repeat(b.into[k][q], n) + at % wide
            if self.same:
                once = (np.repeat(p != q, n)) | (x <= y)
                x, y = x[once], y[once]
            self.open(k + 1, x, y, chord, cosine)

    def run(self, cosine: float) -> None:
        """The traversal, from pairs of nodes that single precision can't drop."""
        a, b, chord = self.a, self.b, float(np.sqrt(2 - 2 * cosine))
        # Products in single precision err by less than their number of terms times its step, small angles by the root of that.
        angle = float(np.arccos(cosine)) + MARGIN + 2 * float(np.sqrt(2 * 6e-8 * a.scaled.shape[1]))
        k = min(a.start, b.start)
        (x, ca, wa, fa), (y, cb, wb, fb) = a.begin(k), b.begin(k)
        # What x links with lies within the threshold of its angle to the other middle.
        na, nb = angles(ca, b.middle) - wa - angle, angles(cb, a.middle) - wb - angle
        mine, other = np.flatnonzero(na <= fb[-1]), np.flatnonzero(nb <= fa[-1])
        single = [t.at[k][v + 1] - t.at[k][v] == 1 for t, v in ((a, x[mine]), (b, y[other]))]
        parts = [[(kind, p) for kind in (True, False) for p in np.array_split(some[own == kind], PARTS) if len(p)] for some, own in zip((mine, other), single)]
        for alone, p in parts[0]:
            for beside, q in parts[1]:
                i, j = p[na[p] <= fb[q[-1]]], q[nb[q] <= fa[p[-1]]]
                if not (len(i) and len(j)):
                    continue
                cj = cb[j].T
                for at in range(0, len(i), 512):
                    some = i[at : at + 512]
                    near = ca[some] @ cj
                    if alone and beside:
                        self.points(a.at[k][x[some]], b.at[k][y[j]], near, cosine)
                        continue
                    # No pair of these nodes is nearer than this, by their widest.
                    u, v = np.nonzero(near >= np.float32(np.cos(min(np.pi, angle + float(wa[some].max() + wb[j].max())))))
                    u, v, near = some[u], j[v], near[u, v]
                    close = near >= np.cos(np.minimum(np.pi, angle + wa[u] + wb[v]))
                    u, v = x[u[close]].astype(np.int64), y[v[close]].astype(np.int64)
                    if self.same:
                        u, v = u[u <= v], v[u <= v]
                    if len(u):
                        self.open(k, u, v, chord, cosine)

    def points(self, i: np.ndarray, j: np.ndarray, near: np.ndarray, cosine: float) -> None:
        """Points whose products in single precision are near: what these can't tell is told in double precision."""
        a, b, doubt = self.a, self.b, 6e-8 * self.a.scaled.shape[1] + 1e-6
        if near.max() < cosine - doubt:
            return
        hit = near >= np.float32(cosine - doubt)
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        hit, near, i, j = hit[np.ix_(rows, columns)], near[np.ix_(rows, columns)], i[rows], j[columns]
        p, q = np.nonzero(hit & (near <= np.float32(cosine + doubt)))
        for at in range(0, len(p), 1 << 16):
            u, v = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
            hit[u, v] = np.einsum("ij,ij->i", a.units_at(i[u]), b.units_at(j[v])) >= cosine
        if self.same:
            hit &= i[:, None] <= j[None, :]
        linked = hit.astype(np.float64)
        self.more[i] += np.rint(linked @ b.weights[j].astype(np.float64)).astype(np.int64)
        if self.same:
            linked[i[:, None] == j[None, :]] = 0
        self.more[self.shift + j] += np.rint(a.weights[i].astype(np.float64) @ linked).astype(np.int64)
        x, y = i.astype(np.int64), self.shift + j.astype(np.int64)
        while True:
            apart = hit & (self.label[x][:, None] != self.label[y][None, :])
            rows, columns = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            if not len(rows):
                return
            join(self.label, np.r_[x[rows], x[apart[:, columns].argmax(0)]], np.r_[y[apart[rows].argmax(1)], y[columns]])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every point the weight of what it links with (its own too, within one tree), and a point joined with it."""
        return np.cumsum(self.added)[:-1] + self.more, self.label


class Held:
    """The trees of a file by block and size, and what their points have linked with so far; points are numbered through."""

    def __init__(self, blocks: list[tuple[int, dict[int, Tree]]]):
        self.trees: dict[int, list[tuple[int, int, Tree]]] = {}
        first, ids = 0, []
        for block, trees in blocks:
            for size, tree in trees.items():
                self.trees.setdefault(size, []).append((block, first, tree))
                first += len(tree.ids)
                ids.append(tree.ids)
        self.ids = np.concatenate(ids)
        self.counts, self.label = np.zeros(first, np.int64), np.arange(first)

    def meet(self, block: int, trees: dict[int, Tree], cosine: float) -> Iterator[pa.RecordBatch]:
        """Links of the block that passes by: its points' counts, and for each joined point one of the file's."""
        chord = float(np.sqrt(2 - 2 * cosine))
        for size, tree in trees.items():
            counts, number = np.zeros(len(tree.ids), np.int64), np.arange(len(self.ids), len(self.ids) + len(tree.ids))
            label = None
            for other, first, own in self.trees.get(size, []):
                # Of two blocks each meets the other once, in every second pair the greater one passes by.
                if block != other and (block < other) != ((block + other) % 2 == 0):
                    continue
                if block != other and np.sqrt(max(0.0, 2 - 2 * float(tree.middle @ own.middle))) > tree.reach + own.reach + chord + 1e-6:
                    continue
                links = Links(own, own) if block == other else Links(tree, own)
                links.run(cosine)
                found, joined = links.result()
                mine = slice(first, first + len(own.ids))
                if block == other:
                    self.counts[mine] += found - own.weights
                    x = np.flatnonzero(joined != np.arange(len(joined)))
                    join(self.label if label is None else label, first + x, first + joined[x])
                elif found.any():
                    counts += found[: links.shift]
                    self.counts[mine] += found[links.shift :]
                    numbers = np.r_[number, np.arange(mine.start, mine.stop)]
                    x = np.flatnonzero(joined != np.arange(len(joined)))
                    # Its own points' numbers follow the file's, so that a joined one gets a label from the file.
                    label = np.r_[self.label, number] if label is None else label
                    join(label, numbers[x], numbers[joined[x]])
            if label is not None:
                self.label, own = label[: len(self.ids)], label[len(self.ids) :]
                linked = np.flatnonzero(counts)
                yield _links(tree.ids[linked], counts[linked], self.ids[own[linked]])

    def found(self) -> Iterator[pa.RecordBatch]:
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.ids)
        least = least[self.label]
        told = (self.counts > 0) | (least != self.ids)
        yield _links(self.ids[told], self.counts[told], least[told])


def _links(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "links", "joined"])


def _valid(vector: str):
    return F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists({vector}, v -> v <> 0)")


def units_of(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; the rows' largest components are about 1."""
    rows = rows.astype(np.float64, copy=False)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of a list column's lists (without nulls), their places, and their values as rows."""
    flat, sizes = column.flatten(), np.diff(np.asarray(column.offsets))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat if len(rows) == len(sizes) else column.take(pa.array(rows)).flatten()
        yield size, rows, np.asarray(values).reshape(len(rows), size)


def digests_of(rows: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(x, digest_size=16).digest() for x in np.ascontiguousarray(rows)]


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """digest, least id, number and components of each distinct row, the components scaled by a power of two to about 1."""
    digests = digests_of(rows)
    place = {d: i for i, d in enumerate(dict.fromkeys(digests))}
    weights = np.ones(len(rows), np.int64)
    if len(place) < len(rows):
        of = np.array([place[d] for d in digests])
        least, weights = np.full(len(place), np.iinfo(np.int64).max), np.bincount(of)
        np.minimum.at(least, of, ids)
        ids, rows, digests = least, rows[np.unique(of, return_index=True)[1]], list(place)
    return digests, ids, weights, np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


class Cells:
    """Pivots of one dimension. Products are of whole numbers that single precision holds exactly: a vector's cell and distance don't depend on what stands beside it."""

    def __init__(self, pivots: np.ndarray):
        self.steps = max(1, int(np.sqrt((1 << 24) / pivots.shape[1])))
        self.pivots, self.sizes = self._whole(pivots)
        self.marks: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}

    def _whole(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.rint(rows / np.abs(rows).max(1, keepdims=True) * self.steps).astype(np.float32)
        return whole, np.sqrt(np.einsum("ij,ij->i", whole, whole, dtype=np.float64))

    def of(self, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, sizes = self._whole(scaled)
        cell, near = np.zeros(len(whole), np.int64), np.full(len(whole), -np.inf)
        for at in range(0, len(self.pivots), 256):
            part = (whole @ self.pivots[at : at + 256].T).astype(np.float64) / self.sizes[at : at + 256]
            top = part.argmax(1)
            value = part[np.arange(len(top)), top]
            better = value > near
            cell[better], near[better] = at + top[better], value[better]
        return cell, np.sqrt(np.maximum(0, 2 - 2 * near / sizes))

    def deal(self, loads: list, room: int, base: int) -> int:
        """loads: cell, distinct vectors and MARKS - 1 quantiles of their distances. Each cell gets shells, and blocks in them; the number after the last."""
        for cell, number, marks in loads:
            shells, marks = min(-(-number // room), MARKS), np.array(marks)
            # Equal shares of the vectors lie between marks; those at equal marks stand in the first one's shell, and the last share may, too.
            shares = np.r_[np.searchsorted(marks, marks), np.searchsorted(marks, marks[-1]), MARKS - 1]
            held = np.bincount(shares * shells // MARKS, minlength=shells) / MARKS
            blocks = np.maximum(1, np.ceil(held * number / room)).astype(np.int64)
            self.marks[cell] = (base, shells, marks, blocks)
            base += int(blocks.sum())
        return base

    def blocks(self, scaled: np.ndarray, digests: list[bytes]) -> np.ndarray:
        cell, gap = self.of(scaled)
        hashed = np.frombuffer(b"".join(digests), np.uint64)[::2]
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell).tolist():
            rows = np.flatnonzero(cell == c)
            base, shells, marks, blocks = self.marks[c]
            shell = np.searchsorted(marks, gap[rows]) * shells // MARKS
            out[rows] = base + np.r_[0, np.cumsum(blocks)][shell] + (hashed[rows] % blocks[shell].astype(np.uint64)).astype(np.int64)
        return out


def _flat(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.select(vector_column).dtypes[0][1] == "array<float>" else "array<double>"
    component = np.float32 if kind == "array<float>" else np.float64
    every = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast(kind).alias("v"))
    usable = every.where(_valid("v") & F.col("vec_id").isNotNull())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(np.asarray(batch.column("usable")))
            digests, sizes = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            for size, rows, values in by_size(batch.column("v").take(pa.array(known))):
                sizes[known[rows]] = size
                for row, digest in zip(known[rows].tolist(), digests_of(values)):
                    digests[row] = digest
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(sizes)], ["vec_id", "digest", "size"])

    marked = every.withColumn("usable", _valid("v") & F.col("vec_id").isNotNull())
    rows = materialize(marked.mapInArrow(mark, "vec_id long, digest binary, size int"), "digests")

    # Dimensions of more than a block's vectors get pivots; there is at most one such dimension for each block of vectors.
    room = lambda size: max(1, BLOCK_BYTES // (8 * size))
    known = rows.where("digest is not null").groupBy("size").agg(F.approx_count_distinct("digest").alias("n"))
    bytes_of, full = F.col("n") * 8 * F.col("size"), F.col("n") > F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size"))))
    known = materialize(known, "sizes")
    wide = [(r["size"], r["n"]) for r in known.where(full).collect()]
    narrow = known.where(~full).agg(F.sum(bytes_of)).first()[0] or 0
    cells: dict[int, Cells] = {}

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values in by_size(batch.column("v")):
                digests, _, _, scaled = distinct(np.asarray(batch.column("vec_id")), values)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), binaries(scaled)], ["digest", "v"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            for size, rows, values in by_size(batch.column("v")):
                if size in cells:
                    digests, _, _, scaled = distinct(ids[rows], values)
                    cell, gap = cells[size].of(scaled)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), size, np.int32)), pa.array(digests, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(gap)], ["size", "digest", "cell", "gap"])

    base, total = -(-narrow // BLOCK_BYTES), narrow
    bundles = max(1, base)
    if wide:
        for size, n in wide:
            # Copies of a vector stand side by side: twice as many rows leave enough distinct ones.
            some = usable.where(F.size("v") == size).mapInArrow(samples, "digest binary, v binary").orderBy("digest").limit(2 * SAMPLE).toArrow()
            some = list(dict(zip(some["digest"].to_pylist(), some["v"].to_pylist())).values())[:SAMPLE]
            units = units_of(np.frombuffer(b"".join(some), component).reshape(len(some), size))
            cells[size] = Cells(pivots_of(units, min(PIVOTS, -(-2 * n * 8 * size // BLOCK_BYTES))))
        found = usable.where(F.size("v").isin([size for size, _ in wide])).mapInArrow(places, "size int, digest binary, cell int, gap double")
        loads = found.groupBy("size", "cell").agg(F.approx_count_distinct("digest").alias("n"), F.percentile_approx("gap", F.lit([i / MARKS for i in range(1, MARKS)]), 10_000).alias("marks")).collect()
        for size, n in wide:
            base = cells[size].deal(sorted((r["cell"], r["n"], r["marks"]) for r in loads if r["size"] == size), room(size), base)
            total += n * 8 * size
    blocks = max(1, base)
    files = min(blocks, max(FILES, -(-total // FILE_BYTES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            for size, rows, values in by_size(batch.column("v")):
                digests, least, weights, scaled = distinct(ids[rows], values)
                block = cells[size].blocks(scaled, digests) if size in cells else np.full(len(least), size * 2654435761 // 256 % bundles)
                yield pa.RecordBatch.from_arrays([pa.array((block * files // blocks).astype(np.int32)), pa.array(block), pa.array(np.full(len(least), size, np.int32)), pa.array(digests, pa.binary()), pa.array(least), pa.array(weights), binaries(scaled)], ["file", "block", "size", "digest", "id", "weight", "v"])

    def plant(part: pa.Table) -> pa.Table:
        sizes, digests = np.asarray(part["size"]), part["digest"].to_pylist()
        place = {d: i for i, d in enumerate(dict.fromkeys(digests))}
        of = np.array([place[d] for d in digests])
        weights, least = np.zeros(len(place), np.int64), np.full(len(place), np.iinfo(np.int64).max)
        np.add.at(weights, of, np.asarray(part["weight"]))
        np.minimum.at(least, of, np.asarray(part["id"]))
        first = np.unique(of, return_index=True)[1]
        sizes, vectors, trees = sizes[first], part["v"].take(pa.array(first)), {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            values = b"".join(vectors.take(pa.array(own)).to_pylist())
            trees[size] = Tree(np.frombuffer(values, component).reshape(len(own), size), least[own], weights[own]).packed()
        members = pickle.dumps((b"".join(place), least, weights), 5)
        return pa.table({"block": part["block"].slice(0, 1), "data": pa.array([pickle.dumps(trees, 5)], pa.binary()), "members": pa.array([members], pa.binary())})

    dealt = usable.mapInArrow(deal, "file int, block long, size int, digest binary, id long, weight long, v binary").repartitionById(files, "file")
    trees = materialize(dealt.groupBy("file", "block").applyInArrow(plant, "block long, data binary, members binary"), "trees", "uncompressed")

    def unpack(data: bytes) -> dict[int, Tree]:
        return {size: Tree.unpacked(tree) for size, tree in pickle.loads(data).items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held, first, own = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                block, data, place, beside, kept = (batch.column(c)[row].as_py() for c in ("block", "data", "place", "beside", "kept"))
                if place == 0:
                    first = (block, data) if data is not None else first
                    own.append((beside, unpack(kept)))
                    continue
                if held is None:
                    held, own = Held(own), []
                    release_memory()
                    yield from held.meet(first[0], unpack(first[1]), cosine)
                    first = None
                yield from held.meet(block, unpack(data), cosine)
            del batch
        if held is None and own:
            held = Held(own)
            yield from held.meet(first[0], unpack(first[1]), cosine)
        if held is not None:
            yield from held.found()
        held = first = None
        own.clear()
        release_memory()

    # Each task reads the trees of a file and its share of all trees where they were written. Those of the file go to Python
    # with the first tree that passes by, and what passes by with the first of the file.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    passing = trees.select("block", "data").coalesce(min(max(files, SHARES[0]), SHARES[1])).withColumn("place", place)
    beside = trees.select(F.col("block").alias("beside"), F.col("data").alias("kept")).withColumn("at", place)
    meets = passing.hint("shuffle_replicate_nl").crossJoin(beside).where("place = 0 or at = 0")
    meets = meets.select("block", F.when(F.col("at") == 0, F.col("data")).alias("data"), "place", "beside", F.when(F.col("place") == 0, F.col("kept")).alias("kept"))
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.files.maxPartitionBytes": 1 << 30, "spark.sql.files.openCostInBytes": 1 << 30}  # a file is a partition
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        met = materialize(meets.mapInArrow(meet, "id long, links long, joined long"), "met")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("members"):
                digests, ids, weights = pickle.loads(data.as_py())
                yield pa.RecordBatch.from_arrays([binaries(np.frombuffer(digests, np.uint8).reshape(-1, 16)), pa.array(ids), pa.array(weights)], ["digest", "id", "weight"])

    classes = trees.select("members").mapInArrow(members, "digest binary, id long, weight long")
    joined = connected_components(met.select(F.col("id").alias("a"), F.col("joined").alias("b")))
    found = met.groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.join(found, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    facts = facts.select("digest", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = join_unique(rows.where("digest is not null").select("vec_id", "digest"), facts, "digest", "weight").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
