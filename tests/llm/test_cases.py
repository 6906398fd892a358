"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import math
import re
import textwrap
from collections import Counter
from importlib import resources

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_contracts import check_packing
from trivalent.llm import bm25, byte_bpe, cover_tree, licences, ngram_jaccard, packing, secret_scan, token_store, toxicity, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe(repeated, odd):
    encoding, texts = brute.tiktoken_encoding(), dict(odd.select("doc_id", "text").collect())
    rows = byte_bpe.encode_documents(repeated, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == 2 * len(texts)
    assert all(r.ids == encoding.encode_ordinary(texts[r.doc_id] or "") for r in rows)
    assert byte_bpe.encode_documents(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_jaccard(repeated, odd):
    want = brute.jaccard(odd.select("doc_id", "text").collect())
    rows = ngram_jaccard.jaccard_components(repeated).collect()
    assert len(rows) == 2 * len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert want[6][1] == 4 and want[8][1] == 7 and want[2] == (0, 2)


def test_jaccard_of_nothing(odd):
    assert ngram_jaccard.jaccard_components(odd.limit(0)).count() == 0


def near_copies(number, seed=3):
    """Texts in families of near copies around the threshold, with a passage that a third of all texts share."""
    random = np.random.default_rng(seed)
    passage, texts = " ".join(f"p{i}" for i in range(60)), []
    while len(texts) < number:
        words = [f"w{x}" for x in random.integers(0, 5000, int(random.integers(6, 120)))]
        for _ in range(int(random.integers(1, 12))):
            own = list(words)
            for _ in range(int(random.integers(0, 4))):
                own[int(random.integers(0, len(own)))] = f"e{random.integers(0, 10**6)}"
            texts.append(" ".join(own) + (" " + passage if random.random() < 0.33 else ""))
    return list(enumerate(texts[:number]))


def test_jaccard_of_frequent_shingles_in_parts(spark, monkeypatch):
    """Every limit of a task far below the data: frequent shingles over several buckets, groups in pieces, blocks of few classes."""
    for name, value in (("HOT", 20), ("BUCKET", 300), ("PIECE", 16), ("BLOCK", 8), ("PART", 4000), ("HELD", 2000)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rows = near_copies(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()} == brute.jaccard(rows)


def test_prefixes_stay_adaptive():
    """The number of shared shingles asked for follows a set's frequent shingles, not the corpus' size."""
    random = np.random.default_rng(1)
    for scale in (1, 20):
        sketch = random.poisson(80 * scale, 1 << ngram_jaccard.SKETCH_BITS)
        sketch[:1000] += 40_000
        order = ngram_jaccard.Order(sketch)
        rare = np.unique(random.integers(1000 << 44, 1 << 63, 300).astype(np.uint64))
        often = np.unique(np.r_[rare[:150], random.integers(0, 1000 << 44, 150).astype(np.uint64)])
        few, many = (order.prefix(np.sort(order.keys(x)), 80)[1] for x in (rare, often[:200]))
        assert few < len(rare) // ngram_jaccard.MOST_SHARED and few <= 1 + 61 // ngram_jaccard.COST
        assert (order.classes[:1000] > 0).all() and many <= 20


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ b", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\nx", 0)], "page_id long, url string, html string, digest int")
    warc.write_archive(pages, str(tmp_path / "w"))
    rows = warc.resolved(warc.assemble(warc.read_archive(spark, str(tmp_path / "w")))).collect()
    want = brute.archive([(r.page_id, r.html) for r in pages.collect()])
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want
    nested = warc.assemble(warc.read_archive(spark, str(tmp_path / "w"))).where("response.record_type = 'response'")
    texts = {r.response.page_id: r.text for r in nested.withColumn("text", warc.payload_text("response.payload")).collect()}
    assert texts == {p: h or "" for p, h in [(r.page_id, r.html) for r in pages.collect()] if want[p][2] == "response"}
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.captures(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.1], 1), (8, [0.0, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1e300, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(vectors).collect()}
    assert got == brute.near([(i, [x / 1e300 for x in v] if i == 11 else v) for i, v, _ in rows])
    assert cover_tree.near_duplicates(vectors.limit(0)).count() == 0


def test_vectors_in_many_blocks(spark, monkeypatch):
    """Cells, shells and hash cuts: blocks far smaller than the data, clusters of a third of all rows, equal vectors and null ids."""
    monkeypatch.setattr(cover_tree, "BLOCK_BYTES", 8 * 6 * 40)
    random = np.random.default_rng(5)
    heart = random.normal(size=6)
    vectors = [*(heart + 0.25 * random.normal(size=(150, 6))), *random.normal(size=(150, 6)), *np.repeat(random.normal(size=(2, 6)), 75, 0)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute.near(rows)
    unnamed = cover_tree.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in unnamed) == [(False, 0, 1, True), (True, 0, None, True), (True, 0, None, True)]


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", 0), (2, "a/b/c.py", "code without notice\n" * 50, 0), (3, "x/y.py", None, 0), (4, "x/z.py", "", 0), (5, None, "Released under the MIT License.", 0),
        (6, "q/long.py", "filler words here\n" * 5000 + "Licensed under CC BY-NC 4.0.\n" + "more\n" * 10, 0),
    ]
    got = {r.id: (r.licence, r.origin) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id int, path string, text string, licence int").drop("licence")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: (None, "none"), 5: ("MIT", "own"), 6: ("CC-BY-NC-4.0", "own")}


def scan_one(spark, texts):
    rows = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id int, path string, text string")
    return {r.id: r for r in licences.scan_licences(rows).collect()}


def test_licence_beside_ordinary_words(spark):
    """Words that most files hold weigh little, however many files there are."""
    for files in (50, 2000):
        got = scan_one(spark, ["This software is released under the MIT License.", *["this software is about other things"] * files])
        assert got[0].licence == "MIT" and got[0].cosine > 0.95, (files, got[0])
        assert got[1].licence is None


def plain_cosine(text, template, texts):
    files = [set(licences.words(t)) for t in texts]
    idf = lambda w: math.log((1 + len(files)) / (1 + sum(w in f for f in files))) + 1
    x, y = ({w: n * idf(w) for w, n in Counter(licences.words(t)).items()} for t in (text, template))
    return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_licence_texts(spark):
    """Whole texts of any length, wrapped headers and tags, each with the cosine counted in full."""
    folder = resources.files("trivalent.llm").joinpath("licence_texts")
    whole = {name: folder.joinpath(f"{name}.txt").read_text("utf-8") for name in licences.TEXTS}
    texts = ["Copyright 2020 A Person\n\n" + t for t in whole.values()]
    wrapped = "#!/usr/bin/env python\n" + "\n".join("# " + x for x in textwrap.wrap(licences.NOTICES["GPL-3.0"][1], 60)) + "\nimport os\n" + "x = os.getpid()\n" * 300
    inside = "int a;\n" * 200 + whole["MIT"] + "int b;\n" * 900
    texts += [wrapped, inside, "// SPDX-License-Identifier: Apache-2.0\nint main;\n" + "int a;\n" * 90, "plain words\n" * 50, "general words of the library\nin public software"]
    got = scan_one(spark, texts)
    assert [got[i].licence for i in range(len(texts))] == [*whole, "GPL-3.0", "MIT", "Apache-2.0", None, None]
    for i, (name, text) in enumerate(whole.items()):
        assert got[i].cosine >= round(plain_cosine(texts[i], text, texts), 12) - 1e-9
    alone = "Notice: Released under the MIT License by Somebody"
    assert scan_one(spark, [alone, "notice", "by"])[0].cosine == pytest.approx(max(plain_cosine(alone, t, [alone, "notice", "by"]) for t in licences.NOTICES["MIT"]))


def test_store(spark, tmp_path, repeated, odd):
    folder = str(tmp_path / "store")
    root = token_store.write_store(repeated, folder, WORDS)
    token_store.verify_store(spark, folder, root)
    with pytest.raises(ValueError):
        token_store.verify_store(spark, folder, "0" * 64)
    tokenizer, texts = brute.word_tokenizer(), dict(odd.select("doc_id", "text").collect())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    back = token_store.read_documents(spark, folder).collect()
    assert len(back) == 2 * len(ids) and all(r.ids == ids[r.doc_id] for r in back)
    start = 0
    for r in sorted(token_store.document_digests(spark, folder).collect(), key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), brute.crc(ids[r.doc_id]))
        start += r.n_tokens


def test_search(odd):
    want = brute.bm25(odd.select("doc_id", "text").collect())
    got = [(r["rank"], r.doc_id, r.score) for r in sorted(bm25.top_k(odd).collect(), key=lambda r: r["rank"])]
    assert [(d, pytest.approx(s)) for _, d, s in got] == want[20]
    assert bm25.top_k(odd.limit(0)).count() == 0


def test_secrets(repeated, odd):
    texts = dict(odd.select("doc_id", "text").collect())
    rows = secret_scan.scan(repeated).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(texts[r.doc_id])[:4]
    done = {r.doc_id: r for r in secret_scan.redact(odd).collect()}
    assert done[1].text is None and done[4].text == texts[4]
    assert done[9].text == "[secret] and [secret] [secret] é 🎉 token:abc"


def plain_entropy_spans(text, base):
    """Entropy spans by counting every window anew."""
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        value = m[0]
        if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)) or any(a <= m.start() and b >= m.end() for a, _, b, _ in base) or any(re.search(r, value) for r in secret_scan.ALLOWED):
            continue
        windows = [Counter(value[i : i + secret_scan.WINDOW]) for i in range(len(value) - secret_scan.WINDOW + 1)]
        best = max(-sum(n / secret_scan.WINDOW * math.log2(n / secret_scan.WINDOW) for n in w.values()) for w in windows)
        if best >= next(least for _, shape, least in secret_scan.CLASSES if re.search(shape, value)):
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def test_entropy_spans(spark):
    """Windows counted anew give the same spans; a candidate of 20,000 characters is judged whole."""
    random = np.random.default_rng(11)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
    some = lambda n, k=len(letters): "".join(random.choice(letters[:k], n))
    texts = [f"key {some(40)} é {some(24)} x {'ab1' * 20} {some(23)}", f"{some(30, 5)}1 {some(60)}/example", "0123456789abcdef" * 3 + " " + some(300), "a1" * 10_000 + some(30), "", "plain words only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(rows).collect():
        base = brute.secrets(texts[r.doc_id])[4]
        assert [s for s in r.spans.split(",") if s.startswith("entropy")] == plain_entropy_spans(texts[r.doc_id], base)


def test_toxicity(spark, odd):
    rows = [(i, ("you total dumbhead %d" if i % 4 == 0 else "a calm and friendly line %d") % i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(scored[i].predicted == (i % 4 == 0) for i, _ in rows)
    folded = spark.createDataFrame([(1, "you dumbh3@d"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score_documents(folded, model).orderBy("doc_id").collect()] == [1, 0, 0]
    nothing = toxicity.learn(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(odd, nothing).collect()} == {0.0}
    assert toxicity.keep_clean(odd, nothing).columns == odd.columns


def test_packing(odd):
    used, least = check_packing(packing.pack_documents(odd, WORDS).collect(), dict(odd.select("doc_id", "text").collect()))
    assert used <= least + 2
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_pipeline(spark, sf, documents):
    """Each stage against a plain counterpart on what the stages before it kept."""
    docs, texts = spark.read.parquet(f"{sf}/documents.parquet"), dict(documents)
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect() if r.predicted}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.select("doc_id").collect()} == set(texts) - rejected
    want = brute.jaccard([(d, t) for d, t in texts.items() if d not in rejected])
    kept = {d for d, (_, c) in want.items() if c == d}
    unique = steps["near_duplicates"](spark, clean, sf)
    assert unique.columns == docs.columns and {r.doc_id for r in unique.select("doc_id").collect()} == kept
    rows = corpus_pipeline.run(spark, sf).collect()
    redacted = {r.doc_id: r.text for r in steps["secrets"](spark, docs.where(F.col("doc_id").isin(sorted(kept))), sf).collect()}
    assert all(not brute.secrets(t)[4] for t in redacted.values())
    assert all(redacted[d] == texts[d] for d in kept if "[secret]" not in redacted[d])
    check_packing(rows, redacted)


def test_near_duplicates_by_row(spark):
    one, other, third = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g")
    rows = [(3, one, 0), (2, one, 1), (3, other, 2), (3, other, 3), (None, third, 4), (None, third, 5), (None, one, 6), (9, "", 7), (9, None, 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r.row for r in kept.collect()}
    assert len(got) == 6 and {1, 7, 8, 9} <= got and len(got & {2, 3}) == 1 and len(got & {4, 5}) == 1
    assert stage(spark, docs.limit(0), "").count() == 0


def test_few_toxic_labels(spark, sf):
    """A handful of toxic labels is evidence enough: the pipeline's stage rejects planted toxic rows at any size."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).select("doc_id").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert 2 * len(toxic - kept) > len(toxic) and clean <= kept
    rows, per_toxic, per_clean = toxicity.labelled_sample(docs, labels, 40)
    learnt = rows.collect()
    assert len(learnt) == 40 and sum(r.toxic for r in learnt) == 10 and per_toxic == 1.0 and per_clean > 1


def test_search_of_many_equal_words(spark):
    rows = [(1, "x " * 600_000 + "z"), (2, "x z z"), (3, "z " * 250), (20, "x z")]
    want = brute.bm25(rows)
    got = sorted((r["rank"], r.doc_id, r.score) for r in bm25.top_k(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, pytest.approx(s, rel=1e-12)) for _, d, s in got] == want[20]


def test_special_tokens_in_texts(spark, tmp_path):
    """The file as the library loads it: literals of its added tokens are those tokens."""
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["x <|endoftext|> y", "a<|startoftext|>b <|endoftext|>, c", "<|endoftext|><|endoftext|>", "plain <|endof text|>"]
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = str(tmp_path / "store")
    token_store.write_store(docs, folder, WORDS)
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, folder).collect()} == {i: [*ids, 1] for i, ids in want.items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs, WORDS).collect()} == {i: (len(ids) + 1, brute.crc([*ids, 0])) for i, ids in want.items()}


def test_search_of_copies_in_many_shards(spark):
    rows = [(i, "one two three four five six seven eight nine ten") for i in range(1, 61)] + [(100 + 20 * i + 1, " ".join(["one two three four five six seven eight nine ten".split()[(i * j) % 10] for j in range(1 + i % 7)] * (1 + i % 3))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = bm25.top_k(docs).where("query_id = 20").collect()
    assert sorted((r["rank"], r.doc_id) for r in found) == [(i, i) for i in range(1, 11)] and len({r.score for r in found}) == 1
