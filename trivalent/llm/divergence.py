"""Source divergence audit: how the words of each source stand apart from its language and from the other sources.

Terms are counted in one pass: a task gathers (language, term) with the number of documents
and the occurrences by source, and passes on one row a term (or several, each time
FLUSH entries are held). Terms in fewer documents than `least` go right after the only shuffle
of all terms; the others are counted by group. A term's share p is an integer of parts in 10**9,
smoothed by SMOOTH: p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)).

Pairs of sources are sparse. A term that a group lacks has the group's baseline share, so
  sum |p_a - p_b| over all V terms = V * D + sum over a's terms (|p_a - base_b| - D)
    + sum over b's terms (|base_a - p_b| - D)
    + sum over common terms (|p_a - p_b| - |p_a - base_b| - |base_a - p_b| + D), D = |base_a - base_b|.
The first two sums come from each group's histogram of shares, the last from terms packed by
blocks of BLOCK sources: a task adds the corrections into a matrix a pair of blocks and passes
on its sums, not a row a term and pair. Ranks of terms come by radix select (radix.py).

Within a task terms are told apart by a 64-bit hash; across tasks by their text.

Cases: null text, lang and source are read as ''; rows that repeat are documents of their own,
and doc_id isn't read; a group without terms is still a group (its terms' shares are baselines);
a language without kept terms has V = 0: pairs of value 0 and no terms; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivalent.llm import words
from trivalent.llm.radix import top_rows
from trivalent.llm.shared import batch_rows, materialize, release_memory

SCALE, SMOOTH, LEAST, RANKS = 1_000_000_000, 5, 30, 50
#: Entries (source and term) that a task holds before it passes them on, and sources of a block.
FLUSH, BLOCK = 1_500_000, 256
#: Matrices of pairs of blocks that a task holds.
MATRICES = 64
#: Bytes of terms after folding: a-z and all of a character beyond ASCII; everything else parts terms.
TERM = np.zeros(256, bool)
TERM[97:123] = TERM[128:] = True
TERMS = "lang string, term string, documents long, uses array<struct<source:string,n:long>>"


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[words.ragged(starts, sizes)] if offsets[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values))


class Tally:
    """Occurrences by group and term, documents by term; groups are numbered within the task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts, self.held = [], 0

    def add(self, text: pa.Array, lang: list[str], source: list[str]) -> None:
        raw, offsets = words.buffer_of(text, lower=True)
        starts, ends, first = words.words_of(np.where(TERM[raw], raw, np.uint8(0x20)), offsets)
        if not len(starts):
            return
        hashes, shown, which = np.unique(words.hash_words(raw, starts, ends), return_index=True, return_inverse=True)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(lang, source)], np.int64)
        docs = np.repeat(np.arange(len(group)), np.diff(first))
        pairs, n = _summed(docs * len(hashes) + which, np.ones(len(which), np.int64))
        keys, n, documents = _summed(group[pairs // len(hashes)] * len(hashes) + pairs % len(hashes), n, np.ones(len(pairs), np.int64))
        self.parts.append((_strings(raw, starts[shown], ends[shown]), hashes, keys // len(hashes), keys % len(hashes), n, documents))
        self.held += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        names = list(self.groups)
        langs = sorted({lang for lang, _ in names})
        lang_of = np.array([langs.index(lang) for lang, _ in names])
        texts = pa.chunked_array([p[0] for p in self.parts]).combine_chunks()
        hashes, shown, which = np.unique(np.concatenate([p[1] for p in self.parts]), return_index=True, return_inverse=True)
        before = np.cumsum([0, *(len(p[1]) for p in self.parts)])
        group = np.concatenate([p[2] for p in self.parts])
        term = which[np.concatenate([p[3] + at for p, at in zip(self.parts, before)])]
        v, g = len(hashes), len(names)
        key, n, documents = _summed((lang_of[group] * v + term) * g + group, np.concatenate([p[4] for p in self.parts]), np.concatenate([p[5] for p in self.parts]))
        self.clear()
        at = np.flatnonzero(np.r_[True, key[1:] // g != key[:-1] // g])
        documents = np.add.reduceat(documents, at)
        sources = pa.array([s for _, s in names], pa.string())
        for lo in range(0, len(at), 50_000):
            hi = min(lo + 50_000, len(at))
            begin, end = at[lo], at[hi] if hi < len(at) else len(key)
            uses = pa.StructArray.from_arrays([sources.take(pa.array(key[begin:end] % g)), pa.array(n[begin:end])], ["source", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[at[lo:hi] - begin, end - begin].astype(np.int32)), uses)
            lt = key[at[lo:hi]] // g
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lt // v)), texts.take(pa.array(shown[lt % v])).cast(pa.string()), pa.array(documents[lo:hi]), lists], ["lang", "term", "documents", "uses"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        for part in batch_rows(batch, "text", 8 << 20):
            tally.add(part.column("text"), part.column("lang").to_pylist(), part.column("source").to_pylist())
            if tally.held >= FLUSH or len(tally.groups) >= FLUSH:
                yield from tally.rows()
                tally.groups.clear()
    yield from tally.rows()
    release_memory()


def share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in whole numbers."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))) div cast({total} + {SMOOTH} * {terms} as decimal(20,0))")


def term_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of the terms that at least `least` documents of their language hold."""
    read = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = read.mapInArrow(_tallied, TERMS)
    # A term has at most a row a task (and flush) here, whatever its frequency.
    known = rows.withColumn("documents", F.sum("documents").over(Window.partitionBy("lang", "term"))).where(F.col("documents") >= least)
    return known.select("lang", "term", F.inline("uses")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over common terms by pair of sources: lang, i, j, x, y (places in blocks i and j), fixed."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), m in sums.items():
            x, y = np.nonzero(m)
            size = len(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.full(size, i)), pa.array(np.full(size, j)), pa.array(x), pa.array(y), pa.array(m[x, y])], ["lang", "i", "j", "x", "y", "fixed"])
        sums.clear()

    for batch in batches:
        sides = []
        for name in ("left", "right"):
            column = batch.column(name)
            entries = column.flatten()
            sides.append((np.r_[0, np.cumsum(np.asarray(column.value_lengths()))], *(np.asarray(entries.field(f)) for f in ("slot", "p", "base"))))
        (la, sa, pa_, ba), (lb, sb, pb, bb) = sides
        for r, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist())):
            if key not in sums:
                if len(sums) >= MATRICES:
                    yield from told()
                sums[key] = np.zeros((BLOCK, BLOCK), np.int64)
            a, b = slice(la[r], la[r + 1]), slice(lb[r], lb[r + 1])
            p, q, u, v = pa_[a, None], pb[None, b], ba[a, None], bb[None, b]
            sums[key][np.ix_(sa[a], sb[b])] += np.abs(p - q) - np.abs(p - v) - np.abs(u - q) + np.abs(u - v)
    yield from told()


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = materialize(term_counts(docs, least), "term-counts")
    whole = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang")), "terms")
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    groups = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "terms", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.when(F.col("terms") > 0, share("0L", "total", "terms")).otherwise(0)
    groups = materialize(groups.withColumn("base", base).withColumn("block", F.floor(place / BLOCK).cast("long")).withColumn("slot", (place % BLOCK).cast("long")), "groups")

    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "total", "terms").alias("p"), "terms", "lang_total", "base", "block", "slot")
    shares = materialize(shares, "shares")

    # Terms over-used by a group.
    over = shares.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share("n_lang", "lang_total", "terms")).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    terms = top_rows(materialize(over, "over"), ["lang", "source"], "value", "item", ranks)

    # Pairs of sources: baselines, each group's own terms against the other's baseline, common terms.
    a, b = groups.alias("a"), groups.alias("b")
    both = a.join(b, F.expr("a.lang = b.lang and a.source <> b.source"))
    gap = F.abs(F.col("a.base") - F.col("b.base"))
    pairs = both.select("a.lang", "a.source", F.col("b.source").alias("item"), ((F.col("a.terms") - F.col("a.own") - F.col("b.own")) * gap).alias("value"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    own = levels.join(groups.select("lang", F.col("source").alias("item"), "base"), "lang").where("source <> item")
    own = materialize(own.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("base"))).alias("value")), "own")
    packed = materialize(shares.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("slot", "p", "base")).alias("entries")), "packed")
    left, right = packed.select("lang", "term", F.col("block").alias("i"), F.col("entries").alias("left")), packed.select("lang", "term", F.col("block").alias("j"), F.col("entries").alias("right"))
    met = left.join(right, ["lang", "term"]).where("i <= j").select("lang", "i", "j", "left", "right")
    fixed = met.mapInArrow(_corrections, "lang string, i long, j long, x long, y long, fixed long").groupBy("lang", "i", "j", "x", "y").agg(F.sum("fixed").alias("value"))
    named = lambda column, block, slot: groups.select("lang", F.col("source").alias(column), F.col("block").alias(block), F.col("slot").alias(slot))
    fixed = materialize(fixed.join(named("source", "i", "x"), ["lang", "i", "x"]).join(named("item", "j", "y"), ["lang", "j", "y"]).where("source <> item").select("lang", "source", "item", "value", "i", "j"), "fixed")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # Within a block the matrix holds both orders of a pair, between blocks one.
    parts = pairs.unionByName(own).unionByName(turned(own)).unionByName(fixed.drop("i", "j")).unionByName(turned(fixed.where("i < j")))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return shape(pairs, "pair").unionByName(shape(terms, "term"))
