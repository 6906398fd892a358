"""Stores with lost or exchanged chunks, licence texts by time, redaction beside columns of its own names, the licence query recounted."""

import glob
import math
import time
from collections import Counter
from importlib import resources

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from trivalent.llm import licences, token_store, warc
from trivalent.llm import queries as llm


@pytest.fixture
def store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "first text of a few words"), (2, "another one, quite different"), (3, "the last of three"), (None, "without a name")], "doc_id long, text string")
    folder = tmp_path.as_uri()
    root = token_store.write_store(docs, folder, llm.WORDS)
    return str(tmp_path), folder, root


def chunk_files(path):
    return [f for f in glob.glob(f"{path}/pieces/kind=chunk/*.parquet") if pq.read_metadata(f).num_rows]


def test_whole_store(spark, store):
    _, folder, root = store
    token_store.verify_store(spark, folder, root)
    tokenizer = brute.word_tokenizer()
    got = {r.doc_id: r.n_tokens for r in token_store.document_digests(spark, folder).collect()}
    assert got[3] == len(tokenizer.encode("the last of three", add_special_tokens=False).ids) + 1 and set(got) == {1, 2, 3, None}


def test_lost_chunk_raises(spark, store):
    """A chunk that is gone makes reading fail; it doesn't make its document vanish."""
    path, folder, _ = store
    file = chunk_files(path)[0]
    rows = pq.read_table(file)
    pq.write_table(rows.slice(1), file)
    glob.glob(f"{path}/pieces/kind=chunk/.*.crc") and [__import__("os").unlink(f) for f in glob.glob(f"{path}/pieces/kind=chunk/.*.crc")]
    with pytest.raises(Exception, match="lost"):
        token_store.document_digests(spark, folder).collect()
    with pytest.raises(Exception, match="lost"):
        token_store.read_documents(spark, folder).collect()


def test_exchanged_chunks_raise(spark, store):
    path, folder, _ = store
    for file in chunk_files(path):
        rows = pq.read_table(file)
        if rows.num_rows > 1:
            turned = rows.column("payload").take(list(range(rows.num_rows))[::-1])
            pq.write_table(rows.set_column(rows.schema.get_field_index("payload"), "payload", turned), file)
    [__import__("os").unlink(f) for f in glob.glob(f"{path}/pieces/kind=chunk/.*.crc")]
    with pytest.raises(Exception, match="digest"):
        token_store.document_digests(spark, folder).collect()


def test_licence_texts_by_time():
    texts = licences.templates()
    scanner = licences.Scanner(texts, {w: 3 for _, t in texts for w in t}, 1000, licences.THRESHOLD)
    gpl = resources.files("trivalent.llm").joinpath("licence_texts", "GPL-3.0.txt").read_text("utf-8")
    began = time.process_time()
    size, found = scanner.scan(gpl)
    assert time.process_time() - began < 1.5 and size > 5000 and {c[0] for c in found} == {"GPL-3.0"}
    began = time.process_time()
    scanner.scan("\n".join([gpl] * 8))
    assert time.process_time() - began < 10


def test_licence_query_recounted(spark, sf, documents):
    """Each licence that the registered query finds in a text has the cosine that a plain count of some run of its lines gives, and no line without one has a greater."""
    got = {r.doc_id: r for r in llm.QUERIES["op5_licence_scan"](spark, sf).collect()}
    frequency = Counter(w for _, text in documents for w in set(licences.words(text or "")))
    idf = lambda w: math.log((1 + len(documents)) / (1 + frequency[w])) + 1
    vectors = [(name, {w: n * idf(w) for w, n in Counter(t).items()}) for name, t in licences.templates()]

    def cosine(bag, vector):
        own = {w: n * idf(w) for w, n in Counter(bag).items()}
        return sum(x * vector.get(w, 0.0) for w, x in own.items()) / math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in vector.values()))

    assert len(got) == len(documents)
    for doc, text in documents:
        lines = [licences.words(line) for line in (text or "").split("\n")]
        best = max((cosine(line, v) for line in lines if line for _, v in vectors), default=0.0)
        row = got[doc]
        assert row.cosine >= best - 1e-9 if best >= licences.THRESHOLD else row.origin != "own" or row.cosine >= licences.THRESHOLD
        if row.origin == "own":
            lines = [x for x in lines if x]
            runs = [sum(lines[a:b], []) for a in range(len(lines)) for b in range(a + 1, min(a + 12, len(lines)) + 1)]
            assert any(name == row.licence and abs(cosine(run, v) - row.cosine) < 1e-9 for run in runs for name, v in vectors)


def test_redaction_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "password = hunter2hunter2", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, base_spans int, ALL_SPANS string")
    out = corpus_pipeline.redact_secrets(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == [(1, "[secret]", 7, "x"), (2, None, 8, "y")]


def test_stages_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and docs.columns[0] == "doc_id"
    assert corpus_pipeline.pack(spark, docs, sf).count() == 0


def test_stages_on_odd_rows(spark, sf):
    """Rows without doc_id or text, repeated rows and clashing columns go through all stages; clean unique texts stay."""
    words = " ".join(f"clean{i}" for i in range(30))
    rows = [(1, words, 1), (1, words, 1), (None, "quite another text of its own, long enough to be clean", 2), (2, None, 3), (3, "", 4), (4, "token: abcdefgh12345678 in a line", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumn("n_chars", F.length("text"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    assert kept == Counter({(1, words): 1, (None, rows[2][1]): 1, (2, None): 1, (3, ""): 1, (4, "[secret] in a line"): 1})
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert len(packed) == 5


def test_incomplete_captures_stay(spark, tmp_path):
    """A capture that lost its request or metadata is as whole as its response; one that lost its response has nulls."""
    pages = spark.createDataFrame([(n, f"http://h{n}.example/a?b={n}", f"<p>{n}</p>") for n in range(4)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    torn = records.where("not (page_id = 0 and record_type = 'request') and not (page_id = 1 and record_type = 'metadata') and not (page_id = 2 and record_type = 'response')")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.uri) for r in warc.resolved(warc.assemble(torn)).collect()}
    assert got == {0: ("response", 8, "http://h0.example/a?b=0"), 1: ("response", 8, "http://h1.example/a?b=1"), 2: (None, None, "http://h2.example/a?b=2"), 3: ("response", 8, "http://h3.example/a?b=3")}
    assert {r.http_headers.split("\r\n")[0] for r in records.where("record_type = 'request'").collect()} == {f"GET /a?b={n} HTTP/1.1" for n in range(4)}


def test_large_pages_in_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    pages = spark.createDataFrame([(n, None, str(n) * 600_000) for n in range(8)], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "w"))
    assert len(glob.glob(f"{tmp_path}/w/*.gz")) >= 4
    got = {r.page_id: r.payload_bytes for r in warc.resolved(warc.assemble(warc.read_archive(spark, str(tmp_path / "w")))).collect()}
    assert got == {n: 600_000 for n in range(8)}


def test_request_blocks():
    assert warc.request_block(None) == "GET / HTTP/1.1\r\n\r\n" and warc.request_block("http://[x") == "GET / HTTP/1.1\r\n\r\n"
    assert warc.request_block("https://a.b:8/c d?e=f#g") == "GET /c%20d?e=f HTTP/1.1\r\nHost: a.b:8\r\n\r\n"
