"""Queries of the value, identity and text functions, each over all documents or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.functions import identity, status, text, values
from trivalent.queries.rules import table


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents as places, boxes, confidences, coverages, ranges and lengths."""
    n, d = F.col("n_chars"), F.col("doc_id")
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = values.bounding_box(F.array(corner(n % 97, d % 89), corner(d % 101, n % 83), corner(n % 13, d % 17)))
    crop = values.crop_box(F.array(n % 50, n % 40, n % 50 + 30, n % 40 + 20), n % 300 + 100, n % 200 + 100, F.lit(600), F.lit(800), d % 2 == 0)
    written = F.when(d % 4 == 0, F.format_string(" %d - %d ", d % 50, n % 60)).when(d % 4 == 1, d.cast("string")).when(d % 4 == 2, F.format_string("%d-", d)).otherwise("0")
    pages = values.page_range(written)
    length = values.content_length(F.when(d % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(" "))).otherwise(F.concat(n.cast("string"), F.lit("b"))))
    start, end = F.expr("timestamp_seconds(doc_id)"), F.expr("if(doc_id % 5 = 0, null, timestamp_seconds(doc_id + n_chars))")
    return table(spark, sf_dir, "documents").select(
        "doc_id", values.milli_points(n / F.lit(16.0)).alias("milli"), F.array_join(F.transform(box, lambda x: x.cast("int").cast("string")), ",").alias("box"), values.area(box).cast("int").alias("area"), values.coverage_permyriad(n, d % 3000).alias("coverage"),
        values.clamp_confidence((n % 1300) / F.lit(1000.0) - 0.1).alias("confidence"), F.array_join(F.transform(crop, lambda x: x.cast("string")), ",").alias("crop"), pages["start"].alias("start"), pages["stop"].alias("stop"), length.alias("length"), values.duration_seconds(start, end).alias("seconds"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of documents: page ids and back, document keys, candidate keys, machine names, hashes, paths, media types."""
    d, s = F.col("doc_id"), F.coalesce("source", F.lit(""))
    page = identity.page_id(F.sha2(s, 256), (d % 1_000_000).cast("int"))
    key = F.when(d % 3 == 0, F.format_string("volume-%d-edition-%d", d % 24, d % 7)).otherwise(F.format_string("volume-%d", d))
    parts = identity.document_key_parts(key)
    name = F.element_at(F.array(*map(F.lit, ("a.b:c", "A.b", "a b", "-a", "", "0_9"))), F.expr("cast(doc_id % 6 + 1 as int)"))
    path = F.element_at(F.array(*map(F.lit, ("a/b.txt", "/a", "a//b", "a/../b", "", "a\\b", "./a", "a/b/"))), F.expr("cast(doc_id % 8 + 1 as int)"))
    header = F.element_at(F.array(*map(F.lit, ("Text/HTML; charset=utf-8", " application/pdf ", ";x", ""))), F.expr("cast(doc_id % 4 + 1 as int)"))
    prefix = F.when(d % 3 == 0, F.encode(F.concat(F.repeat(F.lit("x"), (d % 1100).cast("int")), F.lit("%PDF-1.7")), "UTF-8")).when(d % 3 == 1, F.encode(F.concat(F.lit(" <!DocType HTML>"), s), "UTF-8")).otherwise(F.encode(s, "UTF-8"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", page.alias("page"), identity.page_of_id(F.concat(page, F.lit(":ocr:line:000001"))).alias("page_number"), parts["volume"].alias("volume"), parts["edition"].alias("edition"), identity.candidate_key("key-", s, F.col("lang"), d.cast("string"), F.lit("x")).alias("candidate"),
        identity.is_machine_identifier(name).alias("machine"), identity.is_sha256(F.when(d % 2 == 0, F.sha2(s, 256)).otherwise(F.upper(F.sha2(s, 256)))).alias("hash"), values.is_safe_relative(path).alias("safe"), values.media_type_of_header(header).alias("header"), values.media_type_of_prefix(prefix).alias("media"),
    )


def line_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' numbers as labels, units and cells: labels with their depth and kind, units, digits, margins, cells of a table, ranks."""
    d, n = F.col("doc_id"), F.col("n_chars")
    shapes = ("%d.%d word", "%d - %d.3 word", "%d.%d", "978-%d-%d x", "no %d.%d", "%d.%d.1.2.3 x", " %d . %d\ty", "%d.%dx")
    line = F.format_string("%s", F.element_at(F.array(*(F.format_string(s, d % 40, n % 300) for s in shapes)), F.expr("cast(doc_id % 8 + 1 as int)")))
    label = text.printed_label(line)
    units = ("mm", " M2 ", "کیلو نیوتن", "متر", "furlong", "°C")
    unit = F.element_at(F.array(*map(F.lit, units)), F.expr("cast(doc_id % 6 + 1 as int)"))
    margin = text.in_margin(n % 100, n % 100 + 5, F.when(d % 7 != 0, F.lit(100)), d % 2 == 0)
    cell = F.concat(F.lit(" a|"), d.cast("string"), F.lit("\n\tb | "))
    state = F.element_at(F.array(*map(F.lit, ("FAIL", "PASS", "INDETERMINATE", "other"))), F.expr("cast(doc_id % 4 + 1 as int)"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", label.alias("label"), text.label_depth(label).alias("depth"), text.node_kind(text.label_depth(label)).alias("kind"), text.unit_of(unit, text.GRAPH_UNITS).alias("unit"), text.digit_count(line).alias("digits"), margin.alias("margin"), text.table_cell(cell).alias("cell"),
        text.collapsed_casefold(F.concat(F.lit(" Straße \t "), F.upper("lang"))).alias("folded"), status.severity(state).alias("rank"),
    )


def rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents as rule tokens, in three scripts and with three separators, with units."""
    d, n = F.col("doc_id"), F.col("n_chars")
    plain = F.format_string("%d%s%02d", n, F.element_at(F.array(F.lit("."), F.lit(","), F.lit("٫"), F.lit("/")), F.expr("cast(doc_id % 4 + 1 as int)")), d % 100)
    value = F.when(d % 3 == 0, F.translate(plain, "0123456789", text.PERSIAN_DIGITS)).when(d % 3 == 1, F.translate(plain, "0123456789", text.ARABIC_DIGITS)).otherwise(plain)
    token = text.rule_token(value, F.element_at(F.array(*map(F.lit, ("mm", "متر مربع", "م", "kPa"))), F.expr("cast(doc_id div 4 % 4 + 1 as int)")))
    return table(spark, sf_dir, "documents").select("doc_id", token["ascii_view"].alias("view"), F.round(token["numeric"] * 100, 0).cast("long").alias("hundredths"), token["unit"].alias("unit"))


QUERIES = {"measures": measures, "identities": identities, "line_views": line_views, "rule_tokens": rule_tokens}
ORACLES = {
    "measures": """with p as (select *, least(n_chars % 97, doc_id % 101, n_chars % 13) as l, least(doc_id % 89, n_chars % 83, doc_id % 17) as b, greatest(n_chars % 97, doc_id % 101, n_chars % 13) as r, greatest(doc_id % 89, n_chars % 83, doc_id % 17) as t, doc_id % 2 = 0 as native, n_chars % 50 as x, n_chars % 40 as y, n_chars % 300 + 100 as w, n_chars % 200 + 100 as h from documents)
 select doc_id, round_even(n_chars / 16.0::double * 1000, 0)::bigint as milli, l || ',' || b || ',' || r || ',' || t as box, ((r - l) * (t - b))::int as area, if(doc_id % 3000 > 0, least(10000, n_chars * 10000 // greatest(1, doc_id % 3000)), 0) as coverage,
 greatest(0, least(10000, round_even(((n_chars % 1300) / 1000.0::double - 0.1::double) * 10000, 0)))::int as confidence,
 if(native, greatest(0, x * 600 // w - 8) || ',' || greatest(0, 800 - (y + 20) * 800 // h - 8) || ',' || least(600, (x + 30) * 600 // w + 8) || ',' || least(800, 800 - y * 800 // h + 8), greatest(0, x - 8) || ',' || greatest(0, y - 8) || ',' || least(600, x + 38) || ',' || least(800, y + 28)) as crop,
 case when doc_id % 4 = 0 and doc_id % 50 >= 1 and n_chars % 60 >= doc_id % 50 then doc_id % 50 when doc_id % 4 = 1 then doc_id end::int as start, case when doc_id % 4 = 0 and doc_id % 50 >= 1 and n_chars % 60 >= doc_id % 50 then n_chars % 60 when doc_id % 4 = 1 then doc_id end::int as stop,
 if(doc_id % 3 = 0, n_chars, null)::bigint as length, if(doc_id % 5 = 0, null, n_chars)::double as seconds from p""",
    "identities": r"""select doc_id, 'sha256:' || sha256(coalesce(source, '')) || ':page:' || lpad((doc_id % 1000000)::varchar, 6, '0') as page, (doc_id % 1000000)::int as page_number, if(doc_id % 3 = 0, doc_id % 24, null)::int as volume, if(doc_id % 3 = 0, doc_id % 7, null)::int as edition,
 'key-' || sha256(concat_ws(chr(0), coalesce(source, ''), lang, doc_id::varchar, 'x')) as candidate, doc_id % 6 in (0, 5) as machine, doc_id % 2 = 0 as hash, doc_id % 8 = 0 as safe, case doc_id % 4 when 0 then 'text/html' when 1 then 'application/pdf' end as header,
 case when doc_id % 3 = 0 and doc_id % 1100 + 5 <= 1024 then 'application/pdf' when doc_id % 3 = 1 then 'text/html' end as media from documents""",
    "line_views": """with p as (select *, (doc_id % 40)::varchar as a, (n_chars % 300)::varchar as b, doc_id % 8 as m from documents),
 s as (select *, case m when 0 then a || '.' || b || ' word' when 1 then a || ' - ' || b || '.3 word' when 2 then a || '.' || b when 3 then '978-' || a || '-' || b || ' x' when 4 then 'no ' || a || '.' || b when 5 then a || '.' || b || '.1.2.3 x' when 6 then ' ' || a || ' . ' || b || chr(9) || 'y' else a || '.' || b || 'x' end as line,
  case when m in (0, 2, 6) and length(b) <= 2 then a || '.' || b when m = 1 then a || '-' || b || '.3' when m = 5 then a || '.' || b || '.1.2.3' end as label from p)
 select doc_id, label, case when label is null then null when m in (0, 2, 6) then 2 when m = 1 then 3 else 5 end::int as depth, case when label is null then 'paragraph' when m in (0, 2, 6) then 'section' when m = 1 then 'clause' else 'subclause' end as kind, ['mm', 'm2', 'kN', 'm', null, 'Cel'][doc_id % 6 + 1] as unit,
 length(regexp_replace(line, '[^0-9]', '', 'g'))::int as digits, doc_id % 7 <> 0 and if(doc_id % 2 = 0, n_chars % 100 + 5 >= 90 or n_chars % 100 <= 8, n_chars % 100 <= 10 or n_chars % 100 + 5 >= 92) as margin, 'a\\|' || doc_id || ' b \\|' as cell, 'strasse ' || lower(lang) as folded, [0, 2, 1, 1][doc_id % 4 + 1]::int as rank from s""",
    "rule_tokens": """select doc_id, n_chars || ['.', ',', '٫', '/'][doc_id % 4 + 1] || lpad((doc_id % 100)::varchar, 2, '0') as view, if(doc_id % 4 = 3, null, n_chars * 100 + doc_id % 100)::bigint as hundredths, ['mm', 'm2', null, 'kPa'][doc_id // 4 % 4 + 1] as unit from documents""",
}
