"""Rules as data over documents and their labels: outcomes, specification results, reports and their fixed tables.

Each source of documents is a model, each document an entity; quality and toxic are
attributes, unset where a document has no label. That is the missing datum which must
come out INDETERMINATE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.functions.status import established_nothing, judge, reason_code, status_of_code, three_valued
from trivalent.operators import check

ENTITY = ("entity", [], [("enumeration", "DOCUMENT")], [], None, "required", None)
PAGE = ("entity", [], [("enumeration", "PAGE")], [], None, "required", None)


def attribute(name: str, value: str) -> tuple:
    return ("attribute", [], [("literal", name)], [("literal", value)], None, "required", None)


#: ids, ordinal, name, description, instructions, ifc_versions, min_occurs, max_occurs, applicability, requirements
SPECIFICATIONS = [
    ("corpus", 0, "good quality", None, None, [], None, "unbounded", [ENTITY], [attribute("quality", "1")]),
    ("corpus", 1, "not toxic", None, None, [], None, "unbounded", [ENTITY], [attribute("toxic", "0")]),
    ("corpus", 2, "no pages", None, None, [], None, "0", [PAGE], []),
    ("corpus", 3, "nothing toxic", None, None, [], None, "0", [ENTITY, attribute("toxic", "1")], []),
    ("corpus", 4, "documents may exist", None, None, [], "0", "unbounded", [ENTITY], []),
    ("corpus", 5, "another schema", None, None, ["OTHER"], None, "unbounded", [ENTITY], [attribute("quality", "1")]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("model"), F.col("doc_id").alias("entity_id"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "entity_id")
    of = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("scope"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("data_type"), value.cast("string").alias("value"), value.cast("double").alias("number"))
    none = F.lit(None)
    return docs.join(labels, "entity_id", "left").select("model", "entity_id", F.inline(F.array(of("entity", "DOCUMENT", none), of("attribute", "quality", F.col("quality")), of("attribute", "toxic", F.col("toxic")))))


def specifications(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECIFICATIONS, check.SPECIFICATION)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "documents").select(F.col("source").alias("model")).distinct().withColumn("ifc_schema", F.lit("DOCS"))
    return check.specification_results(facts(spark, sf_dir), specifications(spark), models)


def check_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, specs = facts(spark, sf_dir), specifications(spark).where("ordinal < 2")
    return check.entity_outcomes(own, specs, check.subjects_of(own, specs)).select("ordinal", "model", "entity_id", "status", "reason_code")


LABELLED = "documents d left join labels l on l.doc_id = d.doc_id"
OUTCOMES = f"""select o.ordinal, d.source as model, d.doc_id as entity_id,
 case when v is null then 'INDETERMINATE' when v = want then 'PASS' else 'FAIL' end as status,
 case when v is null then 'ATTRIBUTE_EMPTY' when v <> want then 'ATTRIBUTE_VALUE_MISMATCH' end as reason_code
 from {LABELLED}, lateral (values (0, l.quality, 1), (1, l.toxic, 0)) o(ordinal, v, want)"""
RESULTS = f"""with o as ({OUTCOMES}),
 n as (select ordinal, model, count(*) as matched, count(*) filter (status = 'PASS') as passed, count(*) filter (status = 'FAIL') as failed, count(*) filter (status = 'INDETERMINATE') as indeterminate from o group by all),
 toxic as (select d.source as model, count(*) filter (l.toxic = 1) as matched, count(*) as documents from {LABELLED} group by 1)
 select 'corpus' as ids, ordinal, model, case ordinal when 0 then 'good quality' else 'not toxic' end as name, 'required' as cardinality, matched, passed, failed, indeterminate, 'APPLIES' as applicability,
  case when failed > 0 then 'FAIL' when indeterminate > 0 then 'INDETERMINATE' else 'PASS' end as status, null::varchar as reason_code from n
 union all select 'corpus', 2, model, 'no pages', 'prohibited', 0, 0, 0, 0, 'APPLIES', 'PASS', 'NO_SUBJECTS_AND_PROHIBITED' from toxic
 union all select 'corpus', 3, model, 'nothing toxic', 'prohibited', matched, 0, 0, 0, 'APPLIES', if(matched > 0, 'FAIL', 'PASS'), if(matched > 0, 'PROHIBITED_SUBJECTS_PRESENT', 'NO_SUBJECTS_AND_PROHIBITED') from toxic
 union all select 'corpus', 4, model, 'documents may exist', 'optional', documents, 0, 0, 0, 'APPLIES', 'INDETERMINATE', 'NO_REQUIREMENTS_NOTHING_ASSERTED' from toxic
 union all select 'corpus', 5, model, 'another schema', 'required', matched, passed, failed, indeterminate, 'UNDETERMINED_APPLICABILITY', 'INDETERMINATE', 'SCHEMA_MISMATCH' from n where ordinal = 0"""
REPORT = f"""with r as ({RESULTS}), s as (select model, count(*) filter (status = 'PASS') as specifications_passed, count(*) filter (status = 'FAIL') as specifications_failed, count(*) filter (status = 'INDETERMINATE') as specifications_indeterminate,
 sum(passed)::bigint as passed, sum(failed)::bigint as failed, sum(indeterminate)::bigint as indeterminate from r group by 1)
 select *, case when specifications_failed > 0 then 'FAIL' when specifications_indeterminate > 0 then 'INDETERMINATE' when specifications_passed > 0 then 'PASS' else 'INDETERMINATE' end as status from s"""


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.report(results(spark, sf_dir))


def pack_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models' reports as one: counts add up, the worst specification decides."""
    names = ["specifications_passed", "specifications_failed", "specifications_indeterminate", "passed", "failed", "indeterminate"]
    total = check_report(spark, sf_dir).agg(F.count("*").alias("models"), *(F.sum(n).alias(n) for n in names))
    return total.withColumn("status", three_valued(*(F.col(n) for n in names[:3])))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per specification: results, and how many of them established nothing."""
    return results(spark, sf_dir).groupBy("ordinal", "name").agg(F.count("*").alias("models"), F.count_if(established_nothing(F.col("reason_code"))).alias("established_nothing"), F.sum("matched").alias("matched"))


def judge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages as specifications: their labelled documents are subjects, toxic ones fail, poor ones are undecided."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    found = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.count("quality").alias("matched"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("quality") == 0).alias("indeterminate"))
    place = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    found = found.withColumn("cardinality", F.when(place % 3 == 0, "required").when(place % 3 == 1, "optional").otherwise("prohibited")).withColumn("schema_matches", F.when(F.col("lang") != "fr", ~((F.col("lang") == "de") & (place % 4 == 0)))).withColumn("has_requirements", place % 2 == 0)
    # Those of Spanish have no subjects.
    found = found.withColumns({n: F.when(F.col("lang") == "es", 0).otherwise(F.col(n)) for n in ("matched", "failed", "indeterminate")})
    verdict = judge(*(F.col(n) for n in ("cardinality", "matched", "schema_matches", "failed", "indeterminate", "has_requirements")))
    return found.withColumn("verdict", verdict).select("source", "lang", "verdict.applicability", "verdict.status", "verdict.code")


JUDGE = """with g as (select source, lang, regexp_extract(source, '([0-9]+)', 1)::int as n, if(lang = 'es', 0, count(quality)) as matched, if(lang = 'es', 0, count(*) filter (toxic = 1)) as failed, if(lang = 'es', 0, count(*) filter (quality = 0)) as indeterminate from documents left join labels using (doc_id) group by 1, 2, 3),
 s as (select *, lang = 'de' and n % 4 = 0 as mismatch, n % 3 = 1 as optional, n % 3 = 2 as prohibited, n % 2 = 0 as has from g)
 select source, lang, case when mismatch then 'UNDETERMINED_APPLICABILITY' when matched = 0 and optional then 'DOES_NOT_APPLY' else 'APPLIES' end as applicability,
 case when mismatch then 'INDETERMINATE' when matched = 0 then if(optional, 'INDETERMINATE', if(prohibited, 'PASS', 'FAIL')) when prohibited then 'FAIL' when optional and not has then 'INDETERMINATE' when failed > 0 then 'FAIL' when indeterminate > 0 then 'INDETERMINATE' else 'PASS' end as status,
 case when mismatch then 'SCHEMA_MISMATCH' when matched = 0 then if(optional, 'NO_SUBJECTS_NOTHING_CHECKED', if(prohibited, 'NO_SUBJECTS_AND_PROHIBITED', 'NO_SUBJECTS_BUT_REQUIRED')) when prohibited then 'PROHIBITED_SUBJECTS_PRESENT' when optional and not has then 'NO_REQUIREMENTS_NOTHING_ASSERTED' end as code from s"""
#: Reasons around a value of a document, with what each comes to: written down here by sentence, not by the patterns.
SENTENCES = (
    ("The required attribute did not exist", "ATTRIBUTE_MISSING", "INDETERMINATE"), ('The attribute value "{}" is empty', "ATTRIBUTE_EMPTY", "INDETERMINATE"), ('The attribute value "{}" does not match the requirement', "ATTRIBUTE_VALUE_MISMATCH", "FAIL"),
    ("The entity has no classification", "CLASSIFICATION_MISSING", "INDETERMINATE"), ('The property values "{}" do not match the requirements', "PROPERTY_VALUE_MISMATCH", "FAIL"), ('The property value "{}" does not match the requirement', "PROPERTY_VALUE_MISMATCH", "FAIL"),
    ("The data type {} does not match the required data type of IfcReal", "DATA_TYPE_MISMATCH", "INDETERMINATE"), ("The material should not have met the requirement", "MATERIAL_PROHIBITED", "FAIL"), ("The entity has a relationship with incorrect entities: {}", "RELATIONSHIP_ENTITY_MISMATCH", "FAIL"),
    ("{} something else entirely", "REASON_UNRECOGNISED", "INDETERMINATE"), ("prefix The entity has no material {}", "REASON_UNRECOGNISED", "INDETERMINATE"), ('The systems "{}" do not match the requirements', "CLASSIFICATION_SYSTEM_MISMATCH", "FAIL"), ("The required property set does not exist", "PROPERTY_SET_MISSING", "INDETERMINATE"),
)


def reason_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sources as values in the reasons of a checker, by turns."""
    wording = F.element_at(F.array(*(F.lit(s) for s, _, _ in SENTENCES)), F.expr(f"cast(doc_id % {len(SENTENCES)} + 1 as int)"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace(wording, F.lit("{}"), F.concat_ws(" ", "source", "n_chars")).alias("reason")).withColumn("code", reason_code(F.col("reason")))
    return rows.select("doc_id", "code", status_of_code(F.col("code")).alias("status"))


CLASSIFY = "select doc_id, {}[doc_id % {} + 1] as code, {}[doc_id % {} + 1] as status from documents".format(str([c for _, c, _ in SENTENCES]), len(SENTENCES), str([s for _, _, s in SENTENCES]), len(SENTENCES))


def entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of at least 25 pass; of the rest the first three of each order are listed, with the number left out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= 25, "PASS").otherwise("FAIL").alias("status"))
    return check.itemised(lines, ["l_orderkey"], ["l_linenumber"], 3).select("l_orderkey", "l_linenumber", "rank", F.col("omitted").cast("long").alias("omitted"))


QUERIES = {"check_report": check_report, "check_three_valued": check_three_valued, "check_rollup_spec": results, "pack_combine": pack_combine, "coverage_counts": coverage_counts, "judge_matrix": judge_matrix, "reason_classify": reason_classify, "entity_cap": entity_cap}
ORACLES = {
    "check_report": REPORT,
    "check_three_valued": OUTCOMES,
    "check_rollup_spec": RESULTS,
    "pack_combine": f"""with r as ({REPORT}), t as (select count(*) as models, sum(specifications_passed)::bigint as specifications_passed, sum(specifications_failed)::bigint as specifications_failed, sum(specifications_indeterminate)::bigint as specifications_indeterminate, sum(passed)::bigint as passed, sum(failed)::bigint as failed, sum(indeterminate)::bigint as indeterminate from r)
 select *, case when specifications_failed > 0 then 'FAIL' when specifications_indeterminate > 0 then 'INDETERMINATE' when specifications_passed > 0 then 'PASS' else 'INDETERMINATE' end as status from t""",
    "coverage_counts": f"with r as ({RESULTS}) select ordinal, name, count(*) as models, count(*) filter (reason_code in ('SCHEMA_MISMATCH', 'NO_SUBJECTS_NOTHING_CHECKED', 'NO_REQUIREMENTS_NOTHING_ASSERTED')) as established_nothing, sum(matched)::bigint as matched from r group by 1, 2",
    "judge_matrix": JUDGE,
    "reason_classify": CLASSIFY,
    "entity_cap": "select l_orderkey, l_linenumber, row_number() over w as rank, greatest(0, count(*) over (partition by l_orderkey) - 3) as omitted from lineitem where not l_quantity >= 25 window w as (partition by l_orderkey order by l_linenumber) qualify rank <= 3",
}
