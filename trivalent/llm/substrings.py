"""Substring dedup: words under a window of 13 that also starts in a document of smaller doc_id go.

Rabin-Karp hashes of every window come from prefix sums of word hashes times powers of an odd
base, modulo 2**64, for all words of many texts at once. They are counted in Spark by hash: each
part of the documents (rows of about PART_BYTES of text, stored compressed) sends every bucket of
hashes one packed row, sorted hashes with the smallest doc_id that has each here; a bucket finds
the smallest doc_id of all parts and answers each part with one bit a hash: a smaller document
elsewhere has it, or not. A part joins the answers with its texts; within it smaller documents are
told apart directly. Repeated windows merge into maximal removal intervals of words, which `kept`
cuts out.

A window is compared by 64 bits of one polynomial and CHECK more of another (80 bits in all): of n
different windows about n*n / 2**81 pairs would clash. A passage that all documents share is
one entry a part. A part and a bucket hold about a million windows, and a part at least one
document; a task needs about 100 bytes a word of its largest document. With more than a few
thousand buckets packed rows get small, and the shuffle approaches a row a window.

Cases: null and empty texts have no words (kept text '', whose hash is that of no bytes); texts of
fewer than 13 words lose nothing; rows that repeat a doc_id are judged each by its own text, and
don't remove from each other; rows without doc_id neither lose words nor cause it; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm import words
from trivalent.llm.shared import batch_rows, materialize, release_memory

WINDOW = 13
#: Bytes of text of a part, and windows of a bucket.
PART_BYTES, BUCKET = 6 << 20, 1 << 20
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NOBODY = np.iinfo(np.int64).max
PARTS = "part long, windows long, ids binary, texts binary"


def rolled(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of `size` numbers: sum of hashes[i + k] * base ** -(k + 1), mixed."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    down = np.cumprod(np.full(len(hashes), inverse))
    sums = np.r_[np.uint64(0), np.cumsum(hashes * down)]
    up = np.r_[np.uint64(1), np.cumprod(np.full(len(hashes) - size, base))]
    return words.mix((sums[size:] - sums[:-size]) * up)


def _runs(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs of hash and check stand together, by hash, and where each new pair begins."""
    order = np.argsort(hashes, kind="stable")
    same = np.r_[False, np.diff(hashes[order]) == 0]
    if (same[1:] & (np.diff(checks[order]) != 0)).any():  # one hash with several checks, hardly ever so
        order = np.lexsort((checks, hashes))
        same = np.r_[False, (np.diff(hashes[order]) == 0) & (np.diff(checks[order]) == 0)]
    return order, ~same


class Part:
    """Words and windows of some documents. Windows that cross from one document into the next don't count."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, size: int):
        self.raw, offsets = words.buffer_of(texts)
        self.starts, self.ends, self.first = words.words_of(self.raw, offsets)
        self.ids, self.size = ids, size
        own = words.hash_words(self.raw, self.starts, self.ends)
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        self.at = words.ragged(self.first[:-1], counts)  # first words of windows
        self.doc = np.repeat(np.arange(len(ids)), counts)
        known = ids[self.doc] != NOBODY
        self.at, self.doc = self.at[known], self.doc[known]
        first, check = rolled(own, size, BASES[0]), rolled(own, size, BASES[1])
        self.hash, self.check = first[self.at], (check[self.at] >> np.uint64(48)).astype(np.uint16)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, their checks and least doc_ids, and the entry of each window."""
        if not len(self.hash):
            none = np.zeros(0, np.int64)
            return self.hash, self.check, none, none
        order, new = _runs(self.hash, self.check)
        h, c, at = self.hash[order], self.check[order], np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return h[at], c[at], np.minimum.reduceat(self.ids[self.doc][order], at), which

    def removed(self, elsewhere: np.ndarray, least: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each word whether a removed window covers it: the union of windows, by their ends."""
        bad = self.at[elsewhere[which] | (least[which] < self.ids[self.doc])]
        step = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(step, bad, 1)
        np.add.at(step, bad + self.size, -1)
        return np.cumsum(step[:-1]) > 0

    def counts(self, gone: np.ndarray) -> np.ndarray:
        """Removed words of each document."""
        return np.diff(np.r_[0, np.cumsum(gone)][self.first])

    def intervals(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) words of the maximal runs of removed words, within one document."""
        edge = np.zeros(len(gone) + 1, bool)
        edge[self.first] = True
        begins = gone & (~np.r_[False, gone[:-1]] | edge[:-1])
        ends = gone & (~np.r_[gone[1:], False] | edge[1:])
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def kept(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All kept words, a space behind each, and where each document's begin (one more at the end)."""
        stay = np.flatnonzero(~gone)
        sizes = self.ends[stay] - self.starts[stay]
        to = np.r_[0, np.cumsum(sizes + 1)]
        out = np.empty(to[-1], np.uint8)
        # With its next byte a word is one run of bytes; the space then overwrites that byte.
        for lo in range(0, len(stay), 1 << 18):
            hi = min(lo + (1 << 18), len(stay))
            out[to[lo] : to[hi]] = self.raw[words.ragged(self.starts[stay[lo:hi]], sizes[lo:hi] + 1)]
        out[to[1:] - 1] = 0x20
        return out, to[np.searchsorted(stay, self.first)]


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _columns(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of unsigned 64-bit numbers, byte by byte, so that high bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _numbers(data: bytes, count: int, width: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, count * width).reshape(width, count).T
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1


def pack(hashes: np.ndarray, checks: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted hashes as gaps, checks, doc_ids from the smallest one."""
    gaps = np.diff(hashes, prepend=hashes[:1])
    low = least.min()
    ids = (least - low).astype(np.uint64)
    head = np.array([len(hashes), int(hashes[0]), int(low) & 0xFFFFFFFFFFFFFFFF, _width(gaps), _width(ids)], np.uint64)
    return _packed(head, _columns(gaps, int(head[3])), checks, _columns(ids, int(head[4])))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, first, low, wide, narrow = (int(x) for x in np.frombuffer(data, np.uint64, 5))
    at = 40
    gaps = _numbers(data[at : at + n * wide], n, wide)
    at += n * wide
    checks = np.frombuffer(data, np.uint16, n, at)
    ids = _numbers(data[at + 2 * n : at + 2 * n + n * narrow], n, narrow)
    return np.cumsum(np.r_[np.uint64(first), gaps[1:]]), checks, (ids + np.uint64(low)).view(np.int64)


def _stored(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents as parts: doc_ids and texts, compressed, with the number of windows. Parts are named by their content."""
    squeeze = zstandard.ZstdCompressor(level=3)
    seen = 0
    for batch in batches:
        for rows in batch_rows(batch, "text", PART_BYTES):
            ids = np.asarray(rows.column("doc_id").fill_null(NOBODY), np.int64)
            raw, offsets = words.buffer_of(rows.column("text"))
            first = words.words_of(raw, offsets)[2]
            windows = int(np.maximum(np.diff(first) - size + 1, 0).sum())
            sizes = np.diff(offsets).astype(np.int64)
            texts = squeeze.compress(raw[:-8].tobytes())
            head = squeeze.compress(ids.tobytes() + sizes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([windows], pa.int64()), pa.array([head], pa.binary()), pa.array([texts], pa.binary())], ["part", "windows", "ids", "texts"])
            seen += 1
    release_memory()


def _opened(head: bytes, texts: bytes, size: int) -> Part:
    head = np.frombuffer(zstandard.ZstdDecompressor().decompress(head), np.int64)
    ids, sizes = head[: len(head) // 2], head[len(head) // 2 :]
    offsets = np.r_[0, np.cumsum(sizes)]
    data = zstandard.ZstdDecompressor().decompress(texts) if offsets[-1] else b""
    return Part(pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), ids, size)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's hashes begin among sorted ones (one more at the end): buckets are equal ranges of hashes."""
    bounds = [(b << 64) // buckets for b in range(1, buckets)]
    return np.r_[0, np.searchsorted(hashes, np.array(bounds, np.uint64)), len(hashes)]


def repeated(docs: DataFrame, use, schema: str, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What `use` makes of every part and the words to remove from it: (Part, gone) -> Arrow batches of schema."""
    read = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    stored = read.mapInArrow(lambda batches: _stored(batches, size), PARTS)
    # A part's number is taken once, as it is written: the task's own count, beside the task's number.
    stored = materialize(stored.withColumn("part", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("part")), "parts")
    total = stored.agg(F.sum("windows")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, head, texts in zip(batch.column("part").to_pylist(), batch.column("ids"), batch.column("texts")):
                hashes, checks, least, _ = _opened(head.as_py(), texts.as_py(), size).entries()
                cuts = _cuts(hashes, buckets)
                used = np.flatnonzero(np.diff(cuts))
                rows = [pack(hashes[a:b], checks[a:b], least[a:b]) for a, b in zip(cuts[used].tolist(), cuts[used + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(np.full(len(used), number, np.int64)), pa.array(rows, pa.binary())], ["bucket", "part", "entries"])
        release_memory()

    def answered(rows: pa.Table) -> pa.Table:
        opened = [unpack(x) for x in rows["entries"].to_pylist()]
        hashes, checks, least = (np.concatenate([o[i] for o in opened]) for i in range(3))
        order, new = _runs(hashes, checks)
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        smaller = np.empty(len(order), bool)
        smaller[order] = lowest < least[order]
        ends = np.cumsum([len(o[0]) for o in opened])
        bits = [zlib.compress(np.packbits(s).tobytes(), 1) for s in np.split(smaller, ends[:-1])]
        return pa.table({"part": rows["part"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})

    answers = stored.select("part", "ids", "texts").mapInArrow(sent, "bucket long, part long, entries binary").groupBy("bucket").applyInArrow(answered, "part long, bucket long, bits binary")
    answers = materialize(answers, "answers").groupBy("part").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    joined = stored.select("part", "ids", "texts").join(answers, "part", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, texts, told in zip(batch.column("ids"), batch.column("texts"), batch.column("answers")):
                part = _opened(head.as_py(), texts.as_py(), size)
                hashes, _, least, which = part.entries()
                cuts = _cuts(hashes, buckets)
                elsewhere = np.zeros(len(hashes), bool)
                for x in told.as_py() or []:
                    a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
                    elsewhere[a:b] = np.unpackbits(np.frombuffer(zlib.decompress(x["bits"]), np.uint8), count=b - a).view(bool)
                yield use(part, part.removed(elsewhere, least, which))
        release_memory()

    return joined.mapInArrow(cut, schema)


def _ids(part: Part) -> pa.Array:
    return pa.array(part.ids, pa.int64(), mask=part.ids == NOBODY)


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left, words joined by one space), spans (removed runs of words, end exclusive)."""

    def use(part: Part, gone: np.ndarray) -> pa.RecordBatch:
        out, at = part.kept(gone)
        texts = [out[a : max(a, b - 1)].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        begins, ends = part.intervals(gone)
        owner = np.searchsorted(part.first, begins, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begins - part.first[owner]), pa.array(ends - part.first[owner])], ["start", "stop"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part.ids) + 1)).astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([_ids(part), pa.array(np.diff(part.first)), pa.array(part.counts(gone)), pa.array(texts, pa.string()), lists], ["doc_id", "n_words", "n_removed", "text", "spans"])

    return repeated(docs, use, "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:long,stop:long>>", size, id_column, text_column)


def repeat_digests(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def use(part: Part, gone: np.ndarray) -> pa.RecordBatch:
        out, at = part.kept(gone)
        digests = [hashlib.sha256(out[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([_ids(part), pa.array(np.diff(part.first)), pa.array(part.counts(gone)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs, use, "doc_id long, n_words long, n_removed long, kept_sha256 string", size)
