"""Queries of symbols and page numbers, from lines made of documents' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import symbols
from trivalent.queries.corpus import LINES, document_lines
from trivalent.queries.rules import table

#: What lines say by turns, {} being a number, with the candidates of each: written down here, not found by the patterns.
SAYINGS = (
    ("plain words {}", []), ("a = {} mm", [("equation", None), ("unit_mention", "mm")]), ("LRFD or ASD, not ASDX {}", [("method_abbreviation", "LRFD"), ("method_abbreviation", "ASD")]), ("{} kN and 3 MPa", [("unit_mention", "kN"), ("unit_mention", "MPa")]),
    ("x≤{} per LRFD in m", [("equation", None), ("method_abbreviation", "LRFD"), ("unit_mention", "m")]), ("هر {} متر", [("unit_mention", "متر")]), ("{}mm and ém", []),
)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    wording = F.element_at(F.array(*(F.lit(s) for s, _ in SAYINGS)), F.expr(f"cast((doc_id + place) % {len(SAYINGS)} + 1 as int)"))
    return document_lines(spark, sf_dir).select(F.col("doc_id").alias("page"), F.when(F.col("place") % 2 == 0, "native").otherwise("ocr").alias("source"), "place", F.concat(F.lit("s"), F.col("place").cast("string")).alias("span"), F.replace(wording, F.lit("{}"), F.col("place").cast("string")).alias("text"))


def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.candidates(said(spark, sf_dir))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: their number stands first, last or nowhere, in digits or Roman figures, and whether it is critical."""
    d = F.col("doc_id")
    number = F.when(d % 5 == 0, F.concat(F.lit(" - "), d.cast("string"), F.lit(" - "))).when(d % 5 == 1, F.lit("xvii")).when(d % 5 == 2, F.translate(d.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")).otherwise(F.concat(F.lit("page "), d.cast("string")))
    native = F.when(d % 2 == 0, F.array(number, F.lit("words"), F.lit("more"))).otherwise(F.array(F.lit("words"), F.lit("more")))
    recognised = F.when(d % 2 == 1, F.array(F.lit("of another reading"), number)).when(d % 4 == 0, F.array(F.lit("last"), F.lit("12"))).otherwise(F.lit(None).cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", symbols.page_number(native, recognised).alias("printed"))
    return rows.withColumn("critical", symbols.is_critical(F.col("printed")))


QUERIES = {"symbol_candidates": symbol_candidates, "page_numbers": page_numbers}
_CASES = " ".join(f"when {n} then [{', '.join(f'''{{'kind': '{k}', 'text': {'null::varchar' if t is None else repr(t)}}}''' for k, t in found)}]" for n, (_, found) in enumerate(SAYINGS) if found)
_WORDINGS = ", ".join(repr(s) for s, _ in SAYINGS)
ORACLES = {
    "symbol_candidates": f"""with l as (select doc_id as page, place, if(place % 2 = 0, 'native', 'ocr') as source, 's' || place as span, replace([{_WORDINGS}][(doc_id + place) % {len(SAYINGS)} + 1], '{{}}', place::varchar) as line, case (doc_id + place) % {len(SAYINGS)} {_CASES} end as found from {LINES}),
 c as (select page, place, source, span, line, unnest(found) as c, generate_subscripts(found, 1) as i from l),
 n as (select *, c.kind as kind, row_number() over w - 1 as met, sum((c.kind = 'equation')::int) over w - (c.kind = 'equation')::int as eq from c window w as (partition by page order by source = 'ocr', place, i))
 select page, page || ':' || case kind when 'equation' then 'equation' when 'unit_mention' then 'unit' else 'abbreviation' end || ':' || lpad(if(kind = 'equation', eq, met)::varchar, 4, '0') as candidate_id, kind, source, span, coalesce(c.text, line) as text from n""",
    "page_numbers": """with n as (select doc_id, case doc_id % 5 when 0 then '- ' || doc_id || ' -' when 1 then 'xvii' when 2 then translate(doc_id::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') end as p, doc_id % 4 = 0 as twelve from documents)
 select doc_id, coalesce(p, if(twelve, '12', null)) as printed, coalesce(coalesce(p, if(twelve, '12', null)) <> 'xvii', false) as critical from n""",
}
