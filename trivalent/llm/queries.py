"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trivalent.llm import bm25, byte_bpe, cover_tree, divergence, dual_lloyd, licences, ngram_jaccard, packing, secret_scan, substrings, token_store, toxicity, warc
from trivalent.llm.shared import new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.assemble(warc.read_archive(spark, folder)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: a document's is source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return licences.scan_licences(docs).withColumnRenamed("id", "doc_id")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-store")
    root = token_store.write_store(table(spark, sf_dir, "documents"), folder, WORDS)
    token_store.verify_store(spark, folder, root)
    return token_store.document_digests(spark, folder)


def op7_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top_k(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_lloyd.kmeans(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_warc": op3_warc,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_licence_scan": op5_licence_scan,
    "op6_token_store": op6_token_store,
    "op7_bm25_topk": op7_bm25_topk,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_centroids": op13_centroids,
    "pipeline": corpus_pipeline.run,
}
#: What follows from links (pairs a, b with a > b): the smallest id that each node of the table reaches.
REACHED = """edges as (select a, b from links union all select b, a from links),
 reach(node, seen) as (select node, node from nodes union select e.b, r.seen from reach r join edges e on e.a = r.node where r.seen < e.b),
 named as (select node, min(seen) as component_id from reach group by 1)"""
#: Lloyd's rounds over whole numbers: seeds, three assignments and means, unrolled.
_NEAREST = "select vec_id, v, cluster, distance from (select x.*, c.cluster, list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance from vectors x cross join {c} c) qualify row_number() over (partition by vec_id order by distance, cluster) = 1"
_MEANS = """select c.cluster, coalesce(m.c, c.c) as c from {c} c left join (select cluster, list(case when s >= 0 then s // n else -((n - 1 - s) // n) end order by i) as c from
 (select cluster, i, sum(v[i])::bigint as s, count(*) as n from {a} cross join range(1, 65) r(i) group by 1, 2) group by 1) m on m.cluster = c.cluster"""
_LLOYD = ", ".join(x for r in range(3) for x in (f"a{r} as materialized ({_NEAREST.format(c=f'c{r}')})", f"c{r + 1} as materialized ({_MEANS.format(c=f'c{r}', a=f'a{r}')})"))
#: Learning, tokenising, searching and packing have no SQL form; tests/llm holds each against brute force, a round trip or held-out rows.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": f"""with recursive tokens as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as shingle from tokens),
 sizes as (select doc_id, count(*) as n from shingles group by 1),
 shared as (select x.doc_id as a, y.doc_id as b, count(*) as o from shingles x join shingles y on x.shingle = y.shingle and x.doc_id > y.doc_id group by 1, 2),
 links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * o >= 80 * (p.n + q.n - o)),
 nodes as (select doc_id as node from documents), {REACHED}
 select node as doc_id, coalesce(n, 0) as n_shingles, component_id from named left join sizes on doc_id = node""",
    "op3_warc": """with p as (select page_id, url as uri, coalesce(html, '') as h from pages), d as (select page_id, uri, octet_length(encode(h)) as payload_bytes, sha1(h) as hex from p), r as (select *, max(page_id) over (partition by hex) as newest from d)
 select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
 if(page_id = newest, 'response', 'revisit') as record_type, if(page_id < newest, newest, null) as refers_to, uri from r""",
    "op4_embedding_dedup": f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings),
 usable as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 links as (select x.vec_id as a, y.vec_id as b from usable x join usable y on x.vec_id > y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
 nodes as (select vec_id as node from embeddings), {REACHED}, counted as (select a, count(*) as n from edges group by 1)
 select node as vec_id, coalesce(n, 0) as n_links, component_id, node = component_id as kept from named left join counted on a = node""",
    "op11_source_divergence": """with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
 t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
 kept as (select lang, term, count(*) as n from t group by 1, 2 having count(distinct id) >= 30), langs as (select lang, count(*) as v, sum(n) as total from kept group by 1),
 groups as (select distinct lang, source from d), counts as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3), sizes as (select lang, source, sum(n) as total from counts group by 1, 2),
 p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v))::bigint as p, (1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v))::bigint as q
  from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang left join sizes s on s.lang = g.lang and s.source = g.source left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 f as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p))::bigint as value from p x join p y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by 1, 2, 3),
 parts as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q)
 select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from parts qualify part = 'pair' or rank <= 50""",
    "op12_substring_dedup": """with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
 g as (select doc_id, unnest(range(1, len(w) - 11)) as i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) as s from t where len(w) >= 13),
 bad as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from g) where least < doc_id), gone as (select doc_id, list(distinct i + k) as places from bad cross join range(13) r(k) group by 1),
 kept as (select t.doc_id, w, coalesce(places, []) as places from t left join gone using (doc_id)), left_over as (select doc_id, string_agg(x, ' ' order by i) as text from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from t) a anti join (select doc_id, unnest(places) as i from gone) b using (doc_id, i) group by 1)
 select doc_id, len(w) as n_words, len(places) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from kept left join left_over using (doc_id)""",
    "op13_centroids": f"""with vectors as materialized (select vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 c0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster, v as c from vectors order by sha256('1:' || vec_id) limit 16), {_LLOYD}, a3 as materialized ({_NEAREST.format(c="c3")})
 select vec_id, a3.cluster::int as cluster, distance, sum(distance) over (partition by a3.cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c3.c, ',')) as centroid_sha256 from a3 join c3 on c3.cluster = a3.cluster""",
}
