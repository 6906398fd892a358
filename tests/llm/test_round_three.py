"""Source divergence, substring dedup and centroid clustering against plain counterparts, with their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.llm import divergence, dual_lloyd, radix, substrings
from trivalent.llm import queries as llm

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(docs, least=30, ranks=50):
    """docs: (lang, source, text)."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in docs]
    rows = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in spread.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if spread[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            rows |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            rows |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:ranks], 1)}
    return rows


def test_op11(spark, sf):
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in llm.QUERIES["op11_source_divergence"](spark, sf).collect()} == plain_audit(docs)


def test_divergence_cases(spark, odd):
    """Nulls, no kept terms, groups without terms, ties among terms with long common beginnings, extra columns; several blocks of sources."""
    assert divergence.audit(odd.where("false").withColumn("source", F.lit("x"))).count() == 0
    same = "x" * 300
    rows = [("en", f"s{i % 5}", f"Word{i % 5} shared É{i % 5} {same}{i % 7} 12 a-b", 1) for i in range(70)] + [(None, None, None, 2), ("en", "empty", "", 3), ("fr", "a", "un deux", 4), ("fr", "b", "un deux un", 4)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string, term long")
    got = {tuple(r) for r in divergence.audit(docs, least=5, ranks=3).collect()}
    assert got == plain_audit([r[:3] for r in rows], 5, 3)
    assert ("fr", "a", "pair", "b", 0, 1) in got and any(r[1] == "empty" and r[2] == "pair" for r in got)


def test_divergence_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "FLUSH", 50)
    rows = [("en", f"s{i % 11}", " ".join(f"w{chr(97 + (i * k) % 13)}" for k in range(1, 9))) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert {tuple(r) for r in divergence.audit(docs, least=3).collect()} == plain_audit(rows, 3)


def test_radix_ties(spark):
    rows = [("a", i % 3, "y" * 40 + chr(97 + i % 26) + str(i)) for i in range(400)] + [("b", 5, "only"), (None, 1, "x"), (None, 2, "é"), (None, 2, "z")]
    df = spark.createDataFrame(rows, "k string, v long, item string")
    got = {tuple(r) for r in radix.top_rows(df, ["k"], "v", "item", 150).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2].encode()))[:150]
        want |= {(*r, i) for i, r in enumerate(ranked, 1)}
    assert got == want


def plain_removal(docs, size=13):
    first = {}
    for doc, text in docs:
        w = WORD.findall(text or "")
        for i in range(len(w) - size + 1):
            if doc is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_op12(spark, sf, documents):
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain_removal(documents)]
    assert sorted(map(tuple, llm.QUERIES["op12_substring_dedup"](spark, sf).collect())) == sorted(want)
    assert sum(g for _, _, g, _ in want) > 100


@pytest.mark.parametrize("small", [False, True])
def test_substring_cases(spark, odd, monkeypatch, small):
    """Nulls, empty and long texts, repeated rows and doc_ids, overlapping windows, passages that touch ends; many parts and buckets."""
    if small:
        monkeypatch.setattr(substrings, "PART_BYTES", 200)
        monkeypatch.setattr(substrings, "BUCKET", 64)
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a {p} b"), (2, p), (2, f"other {p}"), (3, p + " " + p), (None, p), (None, None), (4, " ".join(["x"] * 40)), (5, " ".join(["x"] * 13)), (6, f"{p}\n{p.upper()}"), (7, " ".join(p.split()[:12])), (8, "  lead\t" + p + "\x0bé tail ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(4)
    docs = docs.unionByName(odd.select("doc_id", "text", F.lit("y").alias("part")).withColumn("doc_id", F.col("doc_id") + 100))
    both = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substrings.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == plain_removal(both)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert substrings.repeat_digests(docs.where("false")).count() == 0


def plain_lloyd(rows, clusters=16, rounds=3, size=64, scale=64):
    rows = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [list(v) for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))[1]
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)].append(v)
        for n, vs in own.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, near(v), v) for i, v in rows]
    inertia = Counter()
    for _, n, v in found:
        inertia[n] += far(v, centroids[n])
    return sorted(((i, n, far(v, centroids[n]), inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, v in found), key=str)


def test_op13(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, llm.QUERIES["op13_centroids"](spark, sf).collect()), key=str) == plain_lloyd(rows)


def test_centroid_cases(spark, monkeypatch):
    """Null, odd and repeated vectors, ties, fewer vectors than clusters, no vectors, clashing columns; clustered data that prune well."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(dual_lloyd, "BLOCK", 64)
    spots = rng.normal(size=(8, 64)) * 5
    rows = [(i, (spots[i % 8] + rng.normal(size=64) * 0.01).tolist()) for i in range(300)]
    rows += [(1, rows[1][1]), (400, [0.0] * 64), (401, None), (402, [1.0]), (403, [float("nan")] * 64), (404, [None] * 64), (None, [0.5] * 64), (405, [-0.01] * 64), (406, [float("inf")] + [0.0] * 63)]
    schema = "vec_id long, embedding array<double>, cluster string, tree long"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    assert sorted(map(tuple, dual_lloyd.kmeans(df).collect()), key=str) == plain_lloyd(rows)
    few = rows[:5]
    assert sorted(map(tuple, dual_lloyd.kmeans(spark.createDataFrame([(*r, "x", 1) for r in few], schema)).collect()), key=str) == plain_lloyd(few)
    assert dual_lloyd.kmeans(df.where("false")).count() == 0


def test_dual_tree_prunes():
    """On clustered vectors hardly any pair of leaves is compared, and the assignment is the exact one, ties to the smaller centroid."""
    rng = np.random.default_rng(1)
    spots = rng.integers(-400, 400, size=(16, 64))
    points = spots[rng.integers(0, 16, 4000)] + rng.integers(-2, 3, size=(4000, 64))
    tree = dual_lloyd.Tree(points.copy())
    label, compared = dual_lloyd.assign(tree, spots)
    far = ((tree.points[:, None, :] - spots[None]) ** 2).sum(2)
    assert (label == far.argmin(1)).all() and compared < 0.02 * far.size
    label, _ = dual_lloyd.assign(dual_lloyd.Tree(points.copy()), np.concatenate([spots, spots]))
    assert label.max() < 16
