"""Content-addressed store of token-id streams.

write_store tokenises documents, cuts each id stream where a rolling hash of the last
WINDOW ids says so, stores every distinct chunk once under the BLAKE2 digest of its
ids, and keeps a recipe (the digests in order) per document, in ascending doc_id order.
A Merkle tree over the recipes, of fan-out FAN, gives each recipe file's root and, over
these, the root of the store.

Files below the store's folder, all Parquet: `chunks` (digest, n_ids, payload: zstd of
little-endian unsigned 32-bit ids), `recipes` (row_id, part, doc_id, n_tokens, start,
chunks), `manifest` (part, rows, tokens, root).

Chunks do not cross documents, so equal documents share all chunks, and a task sends
each chunk's payload to the shuffle once however often it meets it.

Cases: null or empty text is a document of the end id alone; repeated rows are stored
as documents of their own, ordered by (doc_id, digests); a null doc_id sorts first;
an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivalent.llm.shared import batch_rows, release_memory, shuffle_partitions
from trivalent.llm.word_ids import word_ids

WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
FAN = 256
#: Chunk digests that a task remembers as sent.
SENT = 500_000
MULTIPLIER = 0x9E3779B97F4A7C15


def rolling_cuts(ids: np.ndarray) -> np.ndarray:
    """For each place, whether the rolling hash of the WINDOW ids up to it asks for a cut behind it."""
    x = ids.astype(np.uint64) + np.uint64(1)
    h = (x ^ (x << np.uint64(17))) * np.uint64(MULTIPLIER)
    power, span = MULTIPLIER, 1
    while span < WINDOW:
        h[span:] = h[span:] + h[:-span] * np.uint64(power)
        power, span = power * power % 2**64, span * 2
    return (h >> np.uint64(64 - CUT_BITS)) == 0


def chunk_ends(cuts: np.ndarray, length: int) -> list[int]:
    """Ends of the chunks of one stream; cuts: places behind which the hash asks for a cut, ascending."""
    ends, start = [], 0
    for end in (cuts + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST and end < length:
            ends.append(start := end)
    while length - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, length]


def _cut_batches(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent, pack = word_ids(path), set(), zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in batch_rows(whole, "text", 4 << 20):
                ids, first = encoder.encode(batch.column("text"))
                asked = np.flatnonzero(rolling_cuts(ids)) if len(ids) else np.zeros(0, np.int64)
                packed = ids.astype("<u4").tobytes()
                at = np.searchsorted(asked, first).tolist()
                keys, docs, counts, lists, payloads = [], [], [], [], []
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    begin, n = int(first[i]), int(first[i + 1] - first[i])
                    stream = packed[4 * begin : 4 * (begin + n)] + end_id.to_bytes(4, "little")
                    digests, start = [], 0
                    for stop in chunk_ends(asked[at[i] : at[i + 1]] - begin, n + 1):
                        chunk = stream[4 * start : 4 * stop]
                        digest = hashlib.blake2b(chunk, digest_size=16).digest()
                        digests.append(digest)
                        if digest not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                            keys.append(digest), docs.append(None), counts.append(stop - start), lists.append(None), payloads.append(pack(chunk))
                        start = stop
                    keys.append(hashlib.blake2b(b"doc" + str(doc).encode() + b"".join(digests), digest_size=16).digest())
                    docs.append(doc), counts.append(n + 1), lists.append(digests), payloads.append(None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(payloads, pa.binary())],
                    ["key", "doc_id", "n", "digests", "payload"],
                )
        release_memory()

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Writes the store and returns the hexadecimal root of its Merkle tree."""
    spark = docs.sparkSession
    cut = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(
        _cut_batches(tokenizer, end_id), "key binary, doc_id long, n long, digests array<binary>, payload binary"
    )
    # One shuffle serves both: chunks meet by digest, recipes are spread by a digest of their own.
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col("payload").isNull()))
    kept = cut.withColumn("nth", F.when(F.col("payload").isNotNull(), first).otherwise(1)).where("nth = 1")
    kept.select("key", "doc_id", "n", "digests", "payload", F.when(F.col("payload").isNull(), "recipe").otherwise("chunk").alias("kind")).write.option("compression", "uncompressed").partitionBy("kind").parquet(f"{folder}/pieces")
    recipes = spark.read.schema("key binary, doc_id long, n long, digests array<binary>, payload binary, kind string").parquet(f"{folder}/pieces").where("kind = 'recipe'")
    ordered = recipes.repartitionByRange(shuffle_partitions(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered.select(F.monotonically_increasing_id().alias("row_id"), F.spark_partition_id().alias("part"), "doc_id", F.col("n").alias("n_tokens"), F.col("digests").alias("chunks")).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    roots = merkle(recipes_of(spark, folder))
    roots.write.parquet(f"{folder}/manifest")
    return root_of(spark.read.schema(roots.schema).parquet(f"{folder}/manifest"))


def recipes_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("row_id long, part int, doc_id long, n_tokens long, chunks array<binary>").parquet(f"{folder}/recipes")


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    pieces = spark.read.schema("key binary, doc_id long, n long, digests array<binary>, payload binary, kind string").parquet(f"{folder}/pieces")
    return pieces.where("kind = 'chunk'").select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), "payload")


def merkle(recipes: DataFrame) -> DataFrame:
    """part, rows, tokens, root: a tree of fan-out FAN over each part's recipes, in row order."""
    level = recipes.select(
        "part",
        (F.col("row_id") % (1 << 33)).alias("place"),
        F.lit(1).cast("long").alias("rows"),
        F.col("n_tokens").alias("tokens"),
        F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n_tokens", F.concat_ws(",", F.transform("chunks", F.hex))), 256).alias("root"),
    )
    for _ in range(3):
        level = level.groupBy("part", F.floor(F.col("place") / FAN).alias("place")).agg(
            F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("place", "root"))).alias("below")
        )
        level = level.select("part", "place", "rows", "tokens", F.sha2(F.concat_ws("", F.transform("below", lambda x: x["root"])), 256).alias("root"))
    top = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: x["root"])), 256)
    return level.groupBy("part").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), top.alias("root"))


def root_of(manifest: DataFrame) -> str:
    """Root of the roots; as many rows as there are recipe files come to the driver."""
    return hashlib.sha256("".join(r["root"] for r in sorted(manifest.select("part", "root").collect(), key=lambda r: r["part"])).encode()).hexdigest()


def verify_store(spark: SparkSession, folder: str, root: str) -> None:
    """Raises if the recipes, read back, don't lead to the manifest's roots and to root."""
    manifest = spark.read.schema("part int, rows long, tokens long, root string").parquet(f"{folder}/manifest")
    again = merkle(recipes_of(spark, folder))
    if again.exceptAll(manifest).limit(1).count() or manifest.exceptAll(again).limit(1).count() or root_of(manifest) != root:
        raise ValueError("the recipes don't match the Merkle manifest")


def _checked(payload: bytes | None, digest: bytes, unpack) -> bytes:
    if payload is None:
        raise ValueError(f"chunk {digest.hex()} is lost")
    ids = unpack(payload, max_output_size=4 * MOST)
    if hashlib.blake2b(ids, digest_size=16).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} doesn't match its digest")
    return ids


def _chunk_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        digests = batch.column("digest").to_pylist()
        ids = [_checked(p, d, unpack) for p, d in zip(batch.column("payload").to_pylist(), digests)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["digest", "n", "crc"])


def shift_tables() -> np.ndarray:
    """[bit, byte, value]: what 2**bit zero bytes behind it make of a CRC-32, a byte of it at a time."""

    def apply(columns: list[int], x: int) -> int:
        out = 0
        for bit in range(32):
            if x >> bit & 1:
                out ^= columns[bit]
        return out

    step = [0xEDB88320, *(1 << n for n in range(31))]  # one zero bit
    tables = np.zeros((24, 4, 256), np.uint32)
    for _ in range(3):  # eight zero bits
        step = [apply(step, x) for x in step]
    for bit in range(24):
        tables[bit] = [[apply(step, v << 8 * byte) for v in range(256)] for byte in range(4)]
        step = [apply(step, x) for x in step]
    return tables


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of parts from the parts' own CRCs and sizes in bytes (below 2**24)."""
    runs, out = np.diff(first), np.zeros(len(first) - 1, np.uint32)
    for nth in range(int(runs.max(initial=0))):
        who = np.flatnonzero(runs > nth)
        part, crc = first[who] + nth, out[who]
        for bit in range(24):
            hit = np.flatnonzero(sizes[part] >> bit & 1)
            if len(hit):
                x = crc[hit]
                crc[hit] = tables[bit, 0, x & 255] ^ tables[bit, 1, x >> 8 & 255] ^ tables[bit, 2, x >> 16 & 255] ^ tables[bit, 3, x >> 24]
        out[who] = crc ^ crcs[part].astype(np.uint32)
    return out


def _document_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = shift_tables()
    for batch in batches:
        parts = batch.column("parts")
        first = np.asarray(parts.offsets, np.int64)
        flat = parts.values
        crcs, sizes = np.asarray(flat.field("crc"), np.int64), 4 * np.asarray(flat.field("n"), np.int64)
        tokens = np.diff(np.r_[0, np.cumsum(sizes // 4)][first])
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.diff(first)), pa.array(tokens), pa.array(joined_crc(crcs, sizes, first, tables).astype(np.int64))], ["row_id", "n_parts", "n_ids", "crc"])


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the stored files: each chunk is read once, checked against
    its digest and counted; a document's CRC is composed of its chunks' CRCs along the recipe. A document
    whose recipe names a chunk that isn't stored, or whose chunks don't add up to its tokens, raises an error."""
    recipes = recipes_of(spark, folder)
    facts = chunks_of(spark, folder).mapInArrow(_chunk_facts, "digest binary, n long, crc long")
    used = recipes.select("row_id", F.posexplode("chunks").alias("pos", "digest"))
    parts = used.join(facts, "digest").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
    crcs = parts.mapInArrow(_document_crcs, "row_id long, n_parts long, n_ids long, crc long")
    placed = with_starts(spark, folder, recipes.withColumn("n_chunks", F.size("chunks")).drop("chunks")).join(crcs, "row_id", "left")
    whole = (F.col("n_parts") == F.col("n_chunks")) & (F.col("n_ids") == F.col("n_tokens"))
    lost = F.raise_error(F.concat(F.lit("chunks are lost of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without doc_id")))).cast("long")
    return placed.select("doc_id", "start", "n_tokens", F.when(F.coalesce(whole, F.lit(False)), F.col("crc")).otherwise(lost).alias("ids_crc32"))


def with_starts(spark: SparkSession, folder: str, recipes: DataFrame) -> DataFrame:
    """Recipes with start: the tokens of all documents before. Sums per recipe file (a row each) meet in the manifest."""
    manifest = spark.read.schema("part int, rows long, tokens long, root string").parquet(f"{folder}/manifest")
    before, total = [], 0
    for r in sorted(manifest.select("part", "tokens").collect(), key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["tokens"]
    offsets = spark.createDataFrame(before, "part int, before long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row_id")) - F.col("n_tokens")
    return recipes.withColumn("within", within).join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("within"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: every document put together again from its chunks; a lost chunk raises an error."""
    used = recipes_of(spark, folder).select("row_id", "doc_id", "n_tokens", F.posexplode("chunks").alias("pos", "digest"))
    joined = used.join(chunks_of(spark, folder), "digest", "left").groupBy("row_id", "doc_id", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [np.frombuffer(b"".join(_checked(p["payload"], p["digest"], unpack) for p in parts), "<i4") for parts in batch.column("parts").to_pylist()]
            if [len(x) for x in ids] != batch.column("n_tokens").to_pylist():
                raise ValueError("chunks don't add up to a document's tokens")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return joined.mapInArrow(run, "doc_id long, ids array<int>")
