"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles; two link when 100 * |A and B| >= threshold * |A or B|.
All order their shingles alike: by a frequency class, then by hash. The class comes from a
table of 2**SKETCH_BITS counters over all shingles of the corpus (a fixed 1 MiB when
broadcast), so shingles that many documents share come last. If
A and B link, the first n - t + l shingles of each (n the set's size, t the least overlap it
needs) have l in common. l is 1 where the prefix is expected to meet few candidates and grows,
with the prefix, by the estimated number of candidates, which is what its shingles' counters
hold beyond the mean; a pair must share min(l, l') of its prefixes' shingles before it is verified.

Steps, all of them Spark jobs over the whole table:

1. count shingles into the sketch;
2. per document its set's size and digest, and once per task and distinct set its prefix,
   packed by bucket of shingle; copies have one digest and are one class from here on. What
   the counters show as very frequent is dealt over several buckets by class;
3. per bucket the classes that share a prefix shingle; each such group has the class of the
   smallest document as its hub, and groups of the same classes are merged;
4. verify every class against the one hub with which it shares most, and take components of
   the links found;
5. in groups that still hold several components, bring classes of different components
   together in blocks of at most about 2 * BLOCK texts, and there verify every pair that
   shares enough prefix shingles.

So no pair is left out unless links already join it, and a group of k near copies costs
about k verifications instead of k * k. Sets are compared by 64-bit shingle hashes. The number
of buckets and of parts follows from counted shingles, so that a task holds a bounded share.

Cases: null text, empty text and text without words have an empty set and link with
nothing (component_id = doc_id); with fewer words than a shingle takes, the whole sequence
is the only shingle; rows that repeat a doc_id are kept and each has the component of its
own text; rows of a null doc_id link with nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zlib
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.components import connected_components
from trivalent.llm.shared import batch_rows, materialize, release_memory, shuffle_partitions
from trivalent.llm.words import buffer_of, hash_shingles, hash_words, mix, words_of

#: Counters of the sketch, as a power of two.
SKETCH_BITS = 20
SEGMENT = 1 << 16
#: Classes of one cluster that a block holds.
BLOCK = 256
#: Expected candidates of a prefix for each shingle that a pair must share, and the most of them, as a share of the set.
COST, MOST_SHARED = 4, 10
#: Bits of the filter that says which documents' texts a step needs; a fixed 8 MiB when broadcast.
FILTER_BITS = 26
FILTER_SEGMENT = 1 << 19
#: Prefix entries that a task holds before it sends them on, that a bucket gets, and that a frequent shingle has in one bucket.
HELD, BUCKET, HOT = 2_000_000, 1_500_000, 500_000
#: Shingles of the texts that a part verifies, about.
PART = 1_500_000
#: Bits of a shingle's hash that name it in a prefix.
NAME_BITS = 48


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, repeated ones too, and each text's first place."""
    raw, offsets = buffer_of(column, lower=True)
    starts, ends, first = words_of(raw, offsets)
    return hash_shingles(hash_words(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64), first, size)


def distinct_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    h, first = shingle_sets(column, size)
    at = first.tolist()
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:])]


SURVEY = "doc_id long, n long, digest long, segment int, kind string, counts binary"
SURVEY_NAMES = [field.split()[0] for field in SURVEY.split(", ")]


def _survey(size: int, bits: int = SKETCH_BITS):
    """Per document its set's size and digest; per task what it adds to the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for whole in batches:
            for batch in batch_rows(whole, "text"):
                sets = distinct_sets(batch.column("text"), size)
                cells, times = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True) if sets else (np.zeros(0, np.uint64), 0)
                counts[cells.astype(np.int64)] += times
                none = [pa.nulls(len(sets), kind) for kind in (pa.int32(), pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([digest_of(s) if len(s) else None for s in sets], pa.int64()), *none], SURVEY_NAMES)
        if counts.any():
            kind = np.uint8 if counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.int64
            parts = [zlib.compress(counts[i : i + SEGMENT].astype(kind).tobytes(), 1) for i in range(0, len(counts), SEGMENT)]
            none = [pa.nulls(len(parts), pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int32()), pa.array([np.dtype(kind).str] * len(parts)), pa.array(parts, pa.binary())], SURVEY_NAMES)
        release_memory()

    return run


def _add_counts(part: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), k).astype(np.int64) for c, k in zip(part["counts"].to_pylist(), part["kind"].to_pylist()))
    return pa.table({"segment": part["segment"].slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes())], pa.binary())})


def sketch_of(survey: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The sketch over the whole corpus; what comes to the driver is 2**bits counters whatever the input's size."""
    sketch = np.zeros(1 << bits, np.int64)
    for row in survey.where("segment is not null").select("segment", "kind", "counts").groupBy("segment").applyInArrow(_add_counts, "segment int, counts binary").collect():
        sketch[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return sketch


class Order:
    """Frequency classes of the sketch's cells, a byte each: a class is a quarter of a doubling; what can't be told from a mean cell is class 0."""

    def __init__(self, sketch: np.ndarray):
        self.bits, self.hot = int(len(sketch)).bit_length() - 1, HOT
        self.mean = float(sketch.mean())
        self.floor = self.mean + 6 * np.sqrt(self.mean) + 1
        self.classes = np.clip(np.ceil(4 * np.log2(np.maximum(sketch / self.floor, 1))), 0, 255).astype(np.uint8)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Order and identity of shingles in one number."""
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.classes[cell].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))

    def often(self, classes: np.ndarray) -> np.ndarray:
        """About how many documents hold a shingle of a class: what its cell has beyond the mean, 1 where that is noise."""
        return np.where(classes > 0, self.floor * 2 ** (classes / 4.0) - self.mean, 1.0)

    def prefix(self, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
        """The prefix of a set given by its ascending keys, and the number of its shingles that a candidate must share."""
        n = len(keys)
        needed = -(-threshold * n // 100)
        base = n - needed + 1
        cost = float(self.often((keys[:base] >> np.uint64(56)).astype(np.int64)).sum())
        shared = int(min(max(1, cost / COST), max(1, n // MOST_SHARED), needed, 65_535))
        return keys[: base - 1 + shared], shared

    def salts(self, names: np.ndarray) -> np.ndarray:
        """Over how many buckets the entries of a shingle are dealt."""
        classes = self.classes[(names >> np.uint64(NAME_BITS - self.bits)).astype(np.int64)]
        return np.where(classes > 0, np.ceil(self.often(classes) / self.hot), 1).astype(np.int64)


def name_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << 56) - 1)) >> np.uint64(56 - NAME_BITS)


def _prefixes(order, size: int, threshold: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, held, count = order.value, set(), [], 0
        for whole in batches:
            for batch in batch_rows(whole, "text"):
                for u, doc in zip(distinct_sets(batch.column("text"), size), batch.column("doc_id").to_pylist()):
                    digest = digest_of(u) if len(u) and doc is not None else None
                    if digest is not None and digest not in seen:
                        seen.add(digest)
                        keys, shared = own.prefix(np.sort(own.keys(u)), threshold)
                        held.append((keys, digest, shared, len(u), doc))
                        count += len(keys)
                if count > HELD:
                    yield _blocks(held, buckets, own)
                    held, count = [], 0
        if held:
            yield _blocks(held, buckets, own)
        del seen, held
        release_memory()

    return run


def _blocks(held: list, buckets: int, own: Order) -> pa.RecordBatch:
    """Prefix entries by bucket; in a bucket each class once, with a document, its size and its number of shingles to share, then its shingles' names."""
    lengths = np.array([len(x[0]) for x in held])
    names = name_of(np.concatenate([x[0] for x in held]))
    c = np.array([x[1] for x in held], np.int64)
    who = np.repeat(np.arange(len(held)), lengths)
    salt = mix(c.astype(np.uint64))[who] % own.salts(names).astype(np.uint64)
    bucket = ((mix(names * np.uint64(0x9E3779B97F4A7C15)) + salt) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((who, bucket))
    names, who, bucket = names[by], who[by], bucket[by]
    run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])
    sizes, of, home = np.diff(np.r_[run, len(names)]), who[run], bucket[run]
    shared, n, d = np.array([x[2] for x in held], np.uint16), np.array([x[3] for x in held], np.uint32), np.array([x[4] for x in held], np.int64)
    six = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    parts = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(run)]):
        x, y = run[a], run[b] if b < len(run) else len(names)
        parts.append(b"".join([(b - a).to_bytes(8, "little"), c[of[a:b]].tobytes(), d[of[a:b]].tobytes(), n[of[a:b]].tobytes(), sizes[a:b].astype(np.uint32).tobytes(), shared[of[a:b]].tobytes(), six[x:y].tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array(home[first], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "block"])


def _entries(block: bytes) -> tuple[np.ndarray, ...]:
    """Name, class, document, size and number to share of every entry of a block."""
    m, at, columns = int.from_bytes(block[:8], "little"), 8, []
    for kind in (np.int64, np.int64, np.uint32, np.uint32, np.uint16):
        columns.append(np.frombuffer(block, kind, m, at))
        at += m * np.dtype(kind).itemsize
    c, d, n, sizes, shared = columns
    names = np.zeros((int(sizes.sum()), 8), np.uint8)
    names[:, :6] = np.frombuffer(block, np.uint8, 6 * len(names), at).reshape(-1, 6)
    return names.view("<u8")[:, 0], *(np.repeat(x, sizes) for x in (c, d, n, shared))


GROUPS = "gid long, sign long, weight long, hub long, least long, many int, members binary"
MEMBER = np.dtype([("c", "<i8"), ("n", "<u4"), ("l", "<u2")])


def _groups(order):
    """Groups of classes that share a prefix shingle of this bucket, packed. Groups of the same members are one, with their number as weight."""

    def run(part: pa.Table) -> pa.Table:
        names, c, d, n, shared = (np.concatenate(x) for x in zip(*(_entries(b) for b in part["block"].to_pylist())))
        by = np.lexsort((d, c, names))
        by = by[np.r_[True, (names[by][1:] != names[by][:-1]) | (c[by][1:] != c[by][:-1])]]
        by = by[np.lexsort((d[by], names[by]))]
        names = names[by]
        members = np.zeros(len(by), MEMBER)
        members["c"], members["n"], members["l"] = c[by], n[by], shared[by]
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        sizes = np.diff(np.r_[starts, len(names)])
        signs = np.add.reduceat(mix(members["c"].astype(np.uint64)), starts).view(np.int64)
        salts = order.value.salts(names[starts])
        # A frequent shingle's parts, one in each of its buckets, keep their own name.
        alike = signs.view(np.uint64) ^ np.where(salts > 1, mix(names[starts] + np.uint64(1)), np.uint64(0))
        _, once, of, merged = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
        rows = np.sort(once[(sizes[once] > 1) | (salts[once] > 1)])
        at = rows.tolist()
        packed = [members[starts[i] : starts[i] + sizes[i]].tobytes() for i in at]
        first, least = members["c"][starts[rows]], d[by][starts[rows]]
        columns = [pa.array(names[starts[rows]].astype(np.int64)), pa.array(signs[rows]), pa.array(merged[of[rows]].astype(np.int64)), pa.array(first), pa.array(least), pa.array(salts[rows].astype(np.int32)), pa.array(packed, pa.binary())]
        return pa.table(columns, [f.split()[0] for f in GROUPS.split(", ")])

    return run


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * overlap >= threshold * (a + b - overlap)


NEAR = "c long, hub long, weight long, least long"


def _near(threshold: int):
    """Of each group its members of a size that can link with the hub; rows of one class and hub are added up as far as a batch holds them."""

    def summed(found: list) -> pa.RecordBatch:
        c, hub, weight, least = np.concatenate(found, axis=1)
        by = np.lexsort((hub, c))
        c, hub, weight, least = c[by], hub[by], weight[by], least[by]
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (hub[1:] != hub[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c[starts], hub[starts], np.add.reduceat(weight, starts), least[starts])], ["c", "hub", "weight", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for batch in batches:
            for weight, data in zip(batch.column("weight").to_pylist(), batch.column("members").to_pylist()):
                m = np.frombuffer(data, MEMBER)
                n, own = m["n"].astype(np.int64), int(m["n"][0])
                near = np.flatnonzero((100 * n >= threshold * own) & (100 * own >= threshold * n))[1:]
                found.append(np.stack([m["c"][near], np.full(len(near), m["c"][0]), np.full(len(near), weight), np.minimum(m["l"][near], m["l"][0]).astype(np.int64)]))
                count += len(near)
                if count > HELD // 4:
                    yield summed(found)
                    found, count = [], 0
        if count:
            yield summed(found)
        release_memory()

    return run


MEMBERS = "gid long, least long, weight long, c long, n long, l long"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of a group."""
    for whole in batches:
        for part in batch_rows(whole, "members"):
            members = [np.frombuffer(data, MEMBER) for data in part.column("members").to_pylist()]
            sizes, every = [len(m) for m in members], np.concatenate(members)
            columns = [np.repeat(np.asarray(part.column(name)), sizes) for name in ("gid", "least", "weight")]
            for at in range(0, len(every), 1 << 17):
                stop = at + (1 << 17)
                yield pa.RecordBatch.from_arrays([pa.array(x[at:stop]) for x in columns] + [pa.array(every[name][at:stop].astype(np.int64)) for name in ("c", "n", "l")], [f.split()[0] for f in MEMBERS.split(", ")])
    release_memory()


class _Texts:
    """Shingle sets of a table's texts."""

    def __init__(self, column: pa.ChunkedArray, size: int):
        unpack, self.sets = zstandard.ZstdDecompressor().decompress, []
        texts = column.to_pylist()
        for at in range(0, len(texts), 256):
            self.sets += distinct_sets(pa.array([unpack(t).decode() for t in texts[at : at + 256]], pa.large_string()), size)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.digests = np.array([digest_of(s) if len(s) else 0 for s in self.sets], np.int64)


def digest_of(distinct: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(distinct) - (1 << 63)


def _runs(rows: np.ndarray, *columns: np.ndarray) -> Iterator[np.ndarray]:
    """Those rows, by groups of equal values of the columns."""
    if not len(rows):
        return
    by = rows[np.lexsort([c[rows] for c in columns[::-1]])]
    new = np.zeros(len(by), bool)
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    yield from np.split(by, np.flatnonzero(new))


#: Members of one group that are compared in one piece.
PIECE = 1024
#: Buckets over which the pairs of two labels are spread.
SPREAD = 4
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("p", "<i8"), ("q", "<i8"), ("w", "<u4"), ("l", "<u4")])
MEETINGS = "bucket int, block binary"


def _meetings(threshold: int, buckets: int, part: pa.Table) -> pa.Table:
    """Pairs of a group's classes that are of different components and of sizes that can link, packed by bucket of pair.

    All groups of one smallest document and one pair of pieces are in one part, where what two
    classes share is added up in a table of bounded size. Rows: gid, least, lo, hi, side, weight, c, n, l, component, label.
    """
    gid, least, lo, hi, side, weight, c, n, shared, component, label = (np.asarray(part[x]) for x in ("gid", "least", "lo", "hi", "side", "weight", "c", "n", "l", "component", "label"))
    out: dict[str, list] = {"bucket": [], "block": []}
    for rows in _runs(np.arange(len(gid)), least, lo, hi):
        same = lo[rows[0]] == hi[rows[0]]
        left, right = rows[side[rows] == lo[rows[0]]], rows[side[rows] == hi[rows[0]]]
        for x in _pieces(left, c):
            for y in _pieces(right, c):
                pairs = _counted(x, y, gid, weight, c)
                if same:
                    pairs = tuple(p[c[pairs[0]] < c[pairs[1]]] for p in pairs)
                u, v, w = pairs
                meet = (component[u] != component[v]) & (100 * n[u] >= threshold * n[v]) & (100 * n[v] >= threshold * n[u])
                _deal(u[meet], v[meet], w[meet], c, label, shared, buckets, out)
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.binary())})


def _pieces(rows: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """The rows by at most 2 * PIECE classes each."""
    if len(rows):
        rows = rows[np.argsort(c[rows], kind="stable")]
        number = np.cumsum(np.r_[0, c[rows][1:] != c[rows][:-1]])
        yield from np.split(rows, np.flatnonzero(np.diff(number // (2 * PIECE))) + 1)


def _counted(x: np.ndarray, y: np.ndarray, gid: np.ndarray, weight: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each of two classes that share a group, and the weight of what they share."""
    left, u, at = np.unique(c[x], return_index=True, return_inverse=True)
    right, v, to = np.unique(c[y], return_index=True, return_inverse=True)
    total = np.zeros((len(left), len(right)), np.uint32)
    by, other = np.argsort(gid[x], kind="stable"), np.argsort(gid[y], kind="stable")
    names, starts = np.unique(gid[x][by], return_index=True)
    first, last = np.searchsorted(gid[y][other], names, "left"), np.searchsorted(gid[y][other], names, "right")
    for a, b, s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], first.tolist(), last.tolist()):
        if e > s:
            total[np.ix_(at[by[a:b]], to[other[s:e]])] += np.uint32(weight[x[by[a]]])
    i, j = np.nonzero(total)
    return x[u[i]], y[v[j]], total[i, j]


def _deal(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, label: np.ndarray, shared: np.ndarray, buckets: int, out: dict[str, list]) -> None:
    """Packs pairs by bucket. All rows of a pair of labels meet in SPREAD buckets, so that a class leaves each of them once however many pairs it has."""
    swap = c[u] > c[v]
    u, v = np.where(swap, v, u), np.where(swap, u, v)
    pairs = np.zeros(len(u), PAIR)
    pairs["a"], pairs["b"], pairs["p"], pairs["q"], pairs["w"], pairs["l"] = c[u], c[v], label[u], label[v], w, np.minimum(shared[u], shared[v])
    lo, hi = np.minimum(pairs["p"], pairs["q"]).astype(np.uint64), np.maximum(pairs["p"], pairs["q"]).astype(np.uint64)
    bucket = ((mix(lo ^ (hi << np.uint64(1))) + mix(pairs["a"].astype(np.uint64)) % np.uint64(SPREAD)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[by], bucket[by]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(by) else by
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)]):
        out["bucket"].append(int(bucket[a]))
        out["block"].append(_packed_pairs(pairs[a:b]))


def _packed_pairs(pairs: np.ndarray) -> bytes:
    """Pairs a column at a time, which compresses better than row by row."""
    return zstandard.compress(b"".join(pairs[name].tobytes() for name in PAIR.names), 1)


def _unpacked_pairs(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    pairs, at = np.zeros(len(raw) // PAIR.itemsize, PAIR), 0
    for name in PAIR.names:
        pairs[name] = np.frombuffer(raw, PAIR[name], len(pairs), at)
        at += len(pairs) * PAIR[name].itemsize
    return pairs


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One row per pair, weights added up."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    starts = np.flatnonzero(np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])])
    out = pairs[starts]
    out["w"] = np.add.reduceat(pairs["w"], starts)
    return out


ENDS = "p long, q long, label long, c long"


def _participants(part: pa.Table) -> pa.Table:
    """Of the pairs that share enough prefix shingles, each class once per pair of labels."""
    pairs = _summed(np.concatenate([_unpacked_pairs(b) for b in part["block"].to_pylist()]))
    pairs = pairs[pairs["w"] + 1 >= pairs["l"]]  # one less: two shingles may share their name
    p, q = np.minimum(pairs["p"], pairs["q"]), np.maximum(pairs["p"], pairs["q"])
    every = np.unique(np.concatenate([np.stack([p, q, pairs["p"], pairs["a"]], 1), np.stack([p, q, pairs["q"], pairs["b"]], 1)]), axis=0)
    return pa.table({name.split()[0]: pa.array(np.ascontiguousarray(every[:, i])) for i, name in enumerate(ENDS.split(", "))})


def _bit_places(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64((1 << FILTER_BITS) - 1)
    return np.stack([h & low, (h >> np.uint64(32)) & low]).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for batch in batches:
        places = np.unique(_bit_places(np.asarray(batch.column("d"))))
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    parts = bits.reshape(-1, FILTER_SEGMENT)
    used = np.flatnonzero(parts.any(1)).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], ["segment", "bits"])


def _join_marks(part: pa.Table) -> pa.Table:
    total = np.zeros(FILTER_SEGMENT, np.uint8)
    for bits in part["bits"].to_pylist():
        total |= np.frombuffer(zlib.decompress(bits), np.uint8)
    return pa.table({"segment": part["segment"].slice(0, 1), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def only_needed(texts: DataFrame, needed: DataFrame) -> tuple[DataFrame, object]:
    """Rows of texts (doc_id, text) whose doc_id needed (d) may hold, texts compressed, so that few others are shuffled
    for the join that follows; and the broadcast filter, to be destroyed when that is done.

    The filter is of fixed size: with very many needed documents it lets more of the
    others pass, which costs a longer shuffle and no row.
    """
    bits = np.zeros((1 << (FILTER_BITS - 3)) // FILTER_SEGMENT * FILTER_SEGMENT, np.uint8)
    for row in needed.select("d").mapInArrow(_mark, "segment int, bits binary").groupBy("segment").applyInArrow(_join_marks, "segment int, bits binary").collect():
        bits[row["segment"] * FILTER_SEGMENT : (row["segment"] + 1) * FILTER_SEGMENT] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    known = texts.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = known.value, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            places = _bit_places(np.asarray(batch.column("doc_id")))
            some = batch.filter(pa.array(((own[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(0)))
            for part in batch_rows(some, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], ["d", "text"])

    return texts.where("doc_id is not null").mapInArrow(keep, "d long, text binary"), known


LINKS = "a long, b long"


def _verify_hubs(size: int, threshold: int, part: pa.Table) -> pa.Table:
    """Links of hubs with the classes of their groups; rows: hub, salt, c, text.

    A row whose text isn't of class c (its doc_id has several texts) doesn't count.
    """
    texts = _Texts(part["text"], size)
    hub, salt, c = (np.asarray(part[x]) for x in ("hub", "salt", "c"))
    found = []
    for rows in _runs(np.flatnonzero(texts.digests == c), hub, salt):
        own = next(i for i in rows.tolist() if c[i] == hub[i])
        reference = texts.sets[own]
        for i in rows.tolist():
            if c[i] != hub[i]:
                s = texts.sets[i]
                at = np.searchsorted(reference, s)
                at[at == len(reference)] = 0
                overlap = int((reference[at] == s).sum())
                if linked(overlap, len(s), len(reference), threshold):
                    found.append((int(hub[i]), int(c[i])))
    return _pairs(found)


def _pairs(found: list) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _verify_blocks(order, size: int, threshold: int, part: pa.Table) -> pa.Table:
    """Links between classes of two labels (or within one) of different components; rows: p, q, label, c, component, text.

    Of the links of a pair of labels a spanning forest over their components is passed on: a link between components
    that others have joined already tells nothing more.
    """
    texts, own, found = _Texts(part["text"], size), order.value, []
    prefixes = [own.prefix(np.sort(own.keys(s)), threshold) for s in texts.sets]
    shared = np.array([x[1] for x in prefixes])
    p, q, label, c, component = (np.asarray(part[x]) for x in ("p", "q", "label", "c", "component"))
    for rows in _runs(np.flatnonzero(texts.digests == c), p, q):
        left = rows[label[rows] == p[rows]]
        right = rows[label[rows] == q[rows]]
        if not len(left) or not len(right):
            continue
        vocabulary, of = np.unique(np.concatenate([texts.sets[i] for i in right.tolist()]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(texts.sizes[right])[:-1]])
        heads, head_of = np.unique(np.concatenate([prefixes[i][0] for i in right.tolist()]), return_inverse=True)
        head_starts = np.concatenate([[0], np.cumsum([len(prefixes[i][0]) for i in right.tolist()])[:-1]]).astype(np.int64)
        _, tree = np.unique(component[np.concatenate([left, right])], return_inverse=True)
        tree_of, trees = dict(zip(np.concatenate([left, right]).tolist(), tree.tolist())), tree[len(left) :].copy()
        root = np.arange(int(tree.max()) + 1)  # of each component its representative, always up to date
        for i in left.tolist():
            ok = (root[trees] != root[tree_of[i]]) & (texts.sizes[right] * 100 >= threshold * texts.sizes[i]) & (texts.sizes[i] * 100 >= threshold * texts.sizes[right])
            if p[i] == q[i]:
                ok &= c[right] > c[i]
            if not ok.any():
                continue
            meets = np.add.reduceat(np.isin(heads, prefixes[i][0], assume_unique=True)[head_of].astype(np.int64), head_starts)
            ok &= meets >= np.minimum(shared[right], shared[i])
            if not ok.any():
                continue
            overlap = np.add.reduceat(np.isin(vocabulary, texts.sets[i], assume_unique=True)[of].astype(np.int64), starts)
            ok &= linked(overlap, texts.sizes[right], texts.sizes[i], threshold)
            for j in right[ok].tolist():
                a, b = root[tree_of[i]], root[tree_of[j]]
                if a != b:
                    root[root == b] = a
                    found.append((int(c[i]), int(c[j])))
    return _pairs(found)


def jaccard_components(docs: DataFrame, threshold: int = 80, size: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    survey = materialize(texts.mapInArrow(_survey(size), SURVEY), "survey")
    order = spark.sparkContext.broadcast(Order(sketch_of(survey)))
    sets = survey.where("segment is null").select("doc_id", "n", "digest")
    classes = materialize(sets.where("digest is not null and doc_id is not null").groupBy(F.col("digest").alias("c")).agg(F.min("doc_id").alias("d"), F.min("n").alias("n")), "classes")
    # A prefix is 100 - threshold to 110 - threshold of a hundred shingles, and one.
    entries = classes.agg(F.sum(F.col("n") * (100 - threshold + 100 // MOST_SHARED) / 100 + 1)).first()[0] or 0
    buckets = max(12, int(entries // BUCKET) + 1)
    packed = texts.mapInArrow(_prefixes(order, size, threshold, buckets), "bucket int, block binary")
    # Groups of the same members are one across buckets too; their weights add up.
    whole = packed.groupBy("bucket").applyInArrow(_groups(order), GROUPS)
    key = F.when(F.col("many") > 1, F.col("gid")).otherwise(0)
    groups = materialize(whole.groupBy("sign", key.alias("own")).agg(F.min("gid").alias("gid"), F.sum("weight").alias("weight"), F.first("hub").alias("hub"), F.min("least").alias("least"), F.max("many").alias("many"), F.first("members").alias("members")).drop("own", "sign"), "groups")

    def parts_of(members: DataFrame) -> int:
        """Parts, so that one holds about PART shingles."""
        return max(shuffle_partitions(spark), int((members.agg(F.sum("n")).first()[0] or 0) // PART) + 1)

    def verified(members: DataFrame, check, *keys: str) -> DataFrame:
        """Links that check finds in the texts of members (c and other columns), dealt by keys."""
        members = materialize(members.join(classes, "c"), "members")
        filtered, known = only_needed(texts, members.select("d").distinct())
        dealt = members.join(filtered, "d").withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts_of(members))).cast("int"))
        links = materialize(dealt.groupBy("part").applyInArrow(check, LINKS), "links")
        known.destroy()
        return links

    def check_hubs(part: pa.Table) -> pa.Table:
        return _verify_hubs(size, threshold, part)

    def check_blocks(part: pa.Table) -> pa.Table:
        return _verify_blocks(order, size, threshold, part)

    # Step 4: every class and the hub with which it shares most; the hubs of a frequent shingle's parts and the least of them.
    frequent = groups.where("many > 1").select("gid", "hub", "least")
    tops = frequent.groupBy("gid").agg(F.min_by("hub", F.struct("least", "hub")).alias("top"))
    bridges = frequent.join(tops, "gid").where("hub <> top").groupBy(F.col("hub").alias("c"), F.col("top").alias("hub")).agg(F.count("*").alias("weight"))
    near = groups.select("weight", "members").mapInArrow(_near(threshold), NEAR).groupBy("c", "hub").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"))
    # What a class shares with a hub is counted only where that is the group's hub: half of what a pair must share is enough here.
    near = near.where("2 * weight >= least")
    best = near.groupBy("c").agg(F.max(F.struct("weight", "hub")).alias("best")).select("c", "best.hub")
    near = materialize(best.union(bridges.select("c", "hub")).distinct(), "near")
    loads = near.groupBy("hub").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("salts"))
    others = near.join(loads, "hub").select("hub", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int").alias("salt"), "c")
    hubs = loads.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("c"))
    links = verified(others.unionByName(hubs), check_hubs, "hub", "salt")
    joined = connected_components(links)

    # Step 5: groups that still hold several components.
    def placed_in(members: DataFrame) -> DataFrame:
        return members.join(joined.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))

    wanted = placed_in(groups.select("gid", "least", "weight", "members").mapInArrow(_unpacked, MEMBERS).select("gid", "c"))
    mixed = wanted.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("gid", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    still = materialize(groups.join(mixed, "gid"), "open")
    tops = still.groupBy("gid").agg(F.min("least").alias("top"))
    pieces = still.join(tops, "gid").groupBy("top").agg(F.max("pieces").alias("pieces"))
    member = placed_in(still.join(tops, "gid").select("gid", F.col("top").alias("least"), "weight", "members").mapInArrow(_unpacked, MEMBERS))
    member = materialize(member, "open")
    cluster = member.groupBy("c", "component").agg(F.min("least").alias("cluster"))
    big = cluster.groupBy("cluster", "component").agg(F.count("*").alias("alike"))
    rest = big.groupBy("cluster").agg(F.coalesce(F.sum(F.when(F.col("alike") < BLOCK // 2, F.col("alike"))), F.lit(0)).alias("mixed"))
    tag = F.when(F.col("alike") >= BLOCK // 2, F.col("component"))
    chunks = F.ceil(F.when(tag.isNotNull(), F.col("alike")).otherwise(F.col("mixed")) / BLOCK)
    labels = materialize(
        cluster.join(big, ["cluster", "component"]).join(rest, "cluster").select("c", "component", tag.alias("tag"), F.xxhash64("cluster", F.coalesce(tag, F.lit(0)), F.pmod(F.xxhash64("c"), chunks)).alias("label")),
        "labels",
    )
    blocks = max(shuffle_partitions(spark), int(member.count() // BUCKET) + 1)

    def meet(part: pa.Table) -> pa.Table:
        return _meetings(threshold, blocks, part)

    placed = member.join(labels.select("c", "label"), "c").join(pieces.withColumnRenamed("top", "least"), "least").withColumn("side", F.pmod(F.xxhash64("c"), F.col("pieces")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    placed = placed.select("gid", "least", "lo", "hi", "side", "weight", "c", "n", "l", "component", "label", F.pmod(F.xxhash64("least", "lo", "hi"), F.lit(blocks)).cast("int").alias("part"))
    ends = placed.groupBy("part").applyInArrow(meet, MEETINGS).groupBy("bucket").applyInArrow(_participants, ENDS).distinct()
    more = verified(ends.join(labels.select("c", "component"), "c"), check_blocks, "p", "q")
    order.destroy()
    joined = connected_components(links.unionByName(more))

    named = classes.select(F.col("c").alias("digest"), F.col("d").alias("least")).join(joined.select(F.col("node").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = named.join(names, "component").select("digest", "component_id")
    return sets.join(of_set, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
