"""Sum-of-squares packing of token sequences.

A document's ids are cut into pieces of at most `capacity` tokens; the pieces are dealt
evenly over shards by a hash, and each shard places its pieces one by one. With N(g) open
sequences of residual gap g, a piece of size s goes into the sequence (open or new) after
which the sum of N(g)**2 over all gaps is smallest; among equals into the smallest gap.
Pieces are placed in descending size, as all are known beforehand; the sum of squares
keeps the gaps varied, so that the many small pieces close them.

A shard holds about `shard_pieces` pieces whatever the input's size, so a task's work
is bounded; each shard can leave a few sequences open, which is the price of not passing
all pieces through one task. A row's place in the written pieces takes part in the
hash, so that repeated documents don't fill one shard.

Cases: null or empty text is one piece of the end id alone; repeated rows are packed
each on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.shared import batch_rows, materialize, release_memory
from trivalent.llm.word_ids import word_ids

#: Distinct words that a worker keeps: fewer than the token store's, since packing follows other stages in the same workers.
KEPT_WORDS = 300_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer, KEPT_WORDS)
        for whole in batches:
            for batch in batch_rows(whole, "text", 4 << 20):
                ids, first = encoder.encode(batch.column("text"))
                sizes = np.diff(first) + 1
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                length = np.minimum(capacity, sizes[row] - piece * capacity)
                packed, end = memoryview(ids.astype("<u4").tobytes()), end_id.to_bytes(4, "little")
                crcs = []
                for r, p, n in zip(row.tolist(), piece.tolist(), length.tolist()):
                    begin = int(first[r]) + p * capacity
                    stop = begin + n
                    crc = zlib.crc32(packed[4 * begin : 4 * min(stop, int(first[r + 1]))])
                    crcs.append(zlib.crc32(end, crc) if stop > first[r + 1] else crc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crcs, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        release_memory()

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence's number and its place there."""
    order = np.argsort(-sizes, kind="stable")
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    counts = np.zeros(capacity + 1, np.int64)  # N(g) of open sequences; full and empty ones are not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, never = 0, np.iinfo(np.int64).max
    for i in order.tolist():
        s = int(sizes[i])
        best = -1
        if s < capacity:
            # Twice the half growth of the sum when a gap g becomes g - s; g = s closes the sequence.
            growth = counts[: capacity - s] - counts[s:capacity] + 1
            growth = 2 * growth
            growth[0] = 1 - 2 * counts[s]
            growth[counts[s:capacity] == 0] = never
            at = int(growth.argmin())
            if growth[at] <= 2 * counts[capacity - s] + 1 and growth[at] != never:
                best = at + s
        if best < 0:
            number, gap = used, capacity
            used += 1
        else:
            number, gap = stacks[best].pop(), best
            counts[best] -= 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(number)
    return sequence, offset


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, shard_pieces: int = 60_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id, id_column, text_column), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset = sum_of_squares(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = sequence + (shard["shard"].to_numpy(np.int64) << 32)
        shard["offset"] = offset
        return shard.drop(columns="shard")

    # A number of its own for each row of the written pieces, so that repeated rows are spread as well; which pieces share a shard is free.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
