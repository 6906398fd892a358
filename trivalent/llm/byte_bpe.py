"""Byte-level BPE encoding and decoding with a segment tree.

A piece of text is a row of byte positions. The tree's leaves hold, for each live
position, the rank of the pair it forms with its next live neighbour; an inner node
holds the least rank below it and, among equal ranks, the leftmost position. The root
thus names the next merge; a merge updates two or three leaves and their ancestors.

Short pieces are merged many at a time, one tree per row of a numpy array; long ones
go through the same tree one by one. Every distinct piece is encoded once per worker
while a bounded cache holds it.

Cases: null text counts as empty; empty text has no tokens and the SHA-256 of nothing;
a lone surrogate cannot occur (Spark strings are UTF-8); repeated rows give repeated
results; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trivalent.llm.shared import batch_rows, release_memory, text_or_empty

NONE = np.int32(2**31 - 1)
#: Pieces of up to so many bytes are merged in numpy rows, longer ones one by one.
LANE_BYTES = 64
#: Distinct pieces that a Python worker keeps.
CACHE_PIECES, CACHE_CHARS = 400_000, 8_000_000


class Vocabulary:
    """Ranks of a tiktoken file: token bytes by id, ids by bytes, and the rank of every mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


def merge_one(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one piece through one segment tree."""
    n = len(piece)
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    if n == 1:
        return ids
    none, pairs = int(NONE), vocabulary.pairs
    size = 1 << (n - 1).bit_length()
    tree = [(none, size)] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = (pairs.get((ids[i] << 32) | ids[i + 1], none), i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        node = size + i
        tree[node] = (rank, i)
        node >>= 1
        while node:
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1

    while tree[1][0] != none:
        rank, i = tree[1]
        j = after[i]
        ids[i] = rank
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        ids[j] = -1
        put(i, pairs.get((rank << 32) | ids[k], none) if k < n else none)
        if before[i] >= 0:
            put(before[i], pairs.get((ids[before[i]] << 32) | rank, none))
    return [x for x in ids if x >= 0]


def merge_lanes(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Packed ids of pieces of at most LANE_BYTES bytes, a segment tree for each row of an array."""
    out = [b""] * len(pieces)
    lengths = np.array([len(p) for p in pieces])
    widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
    for width in np.unique(widths).tolist():
        for chosen in np.array_split(np.flatnonzero(widths == width), max(1, int((widths == width).sum()) * width // (1 << 16))):
            _lanes(chosen, pieces, lengths, width, vocabulary, out)
    return out


def _lanes(chosen, pieces, lengths, width, vocabulary, out) -> None:
    rows, n = len(chosen), lengths[chosen]
    raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in chosen.tolist()), np.uint8).reshape(rows, width)
    ids = vocabulary.byte_ids[raw]
    places = np.arange(width)
    ids[places >= n[:, None]] = -1
    live = (places < n[:, None] - 1)[:, : width - 1]
    rank = np.full((rows, width), NONE, np.int32)
    rank[:, : width - 1][live] = vocabulary.ranks_of(ids[:, :-1][live], ids[:, 1:][live])
    # A node is rank * width + position, so that the least value is the least rank and then the leftmost position.
    tree = np.full((rows, 2 * width), int(NONE) * width, np.int64)
    tree[:, width:] = rank.astype(np.int64) * width + places
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    after, before = np.broadcast_to(places + 1, (rows, width)).copy(), np.broadcast_to(places - 1, (rows, width)).copy()
    end = int(NONE) * width

    def put(r, i, ranks) -> None:
        node = i + width
        tree[r, node] = ranks.astype(np.int64) * width + i
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            node = node >> 1

    r = np.flatnonzero(tree[:, 1] < end)
    while len(r):
        root = tree[r, 1]
        i, merged = root % width, root // width
        j = after[r, i]
        k = after[r, j]
        ids[r, i] = merged
        ids[r, j] = -1
        after[r, i] = k
        inside = k < n[r]
        before[r[inside], k[inside]] = i[inside]
        put(r, j, np.full(len(r), NONE, np.int32))
        right = np.full(len(r), NONE, np.int32)
        right[inside] = vocabulary.ranks_of(merged[inside], ids[r[inside], k[inside]])
        put(r, i, right)
        p = before[r, i]
        has = p >= 0
        put(r[has], p[has], vocabulary.ranks_of(ids[r[has], p[has]], merged[has]))
        r = r[tree[r, 1] < end]
    packed, kept = ids.astype("<u4"), ids >= 0
    counts = kept.sum(1)
    flat, ends = packed[kept].tobytes(), np.cumsum(counts) * 4
    for i, start, stop in zip(chosen.tolist(), (ends - counts * 4).tolist(), ends.tolist()):
        out[i] = flat[start:stop]


class Codec:
    """Encodes texts to ids packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        fresh = [p for p in pieces if p not in self.cache]
        coming = sum(map(len, fresh))
        if len(self.cache) + len(fresh) > CACHE_PIECES or self.held + coming > CACHE_CHARS:
            self.cache.clear()
            self.held, fresh, coming = 0, pieces, sum(map(len, pieces))
        self.held += coming
        whole, short, long = self.vocabulary.ids, [], []
        for piece in fresh:
            data = piece.encode()
            known = whole.get(data)
            if known is not None:
                self.cache[piece] = known.to_bytes(4, "little")
            elif len(data) <= LANE_BYTES:
                short.append((piece, data))
            else:
                long.append((piece, data))
        for (piece, _), ids in zip(short, merge_lanes([d for _, d in short], self.vocabulary)):
            self.cache[piece] = ids
        for piece, data in long:
            self.cache[piece] = np.array(merge_one(data, self.vocabulary), "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        pieces = [self.split(t) for t in texts]
        distinct = set().union(*pieces)
        self.learn(distinct)
        of = self.cache.__getitem__
        for p in pieces:
            yield b"".join(map(of, p))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids as array<int>.

    docs needs id_column and text_column alone; whatever else it holds is not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in batch_rows(whole, "text"):
                packed = list(own.encode(text_or_empty(batch.column("text"))))
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed]),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        release_memory()

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, schema)
