"""Queries of report sentences and rule files, over parts as rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import report_text, rule_ir
from trivalent.queries.rules import RESULTS, results, table
from trivalent.queries.structure import _COMPILED, rules_of_parts

COMPARISONS = "array<struct<operator:string,value:string>>"
CARDINALITIES = {"required": "must be met", "prohibited": "must not occur"}


def _comparison(operator: str, value: Column) -> Column:
    return F.struct(F.lit(operator).alias("operator"), value.cast("string").alias("value"))


def requirement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements of each kind, cardinality and bound, with and without literal names."""
    key, size, brand, type_ = F.col("p_partkey"), F.col("p_size"), F.col("p_brand"), F.col("p_type")
    several = F.array(_comparison("enumeration", brand), _comparison("enumeration", type_))
    names = F.when(key % 7 == 0, several).when(key % 7 == 1, F.array(_comparison("literal", brand))).when(key % 7 == 2, F.array(_comparison("pattern", brand)))
    comparisons = (
        F.when(size % 5 == 0, F.array(_comparison("minInclusive", size), _comparison("maxExclusive", size + 10)))
        .when(size % 5 == 1, F.array(_comparison("enumeration", brand), _comparison("maxLength", size), _comparison("enumeration", type_)))
        .when(size % 5 == 2, F.array(_comparison("totalDigits", size)))
        .when(size % 5 == 3, F.array().cast(COMPARISONS))
    )
    kind = F.when(key % 11 == 0, "property").otherwise("attribute")
    cardinality = F.element_at(F.array(*map(F.lit, ("required", "optional", "prohibited", "other"))), (key % 4 + 1).cast("int"))
    text = report_text.requirement_sentence(kind, F.when(key % 7 > 2, F.col("p_name")), names, comparisons, cardinality, F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def applicability_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as applicability of one entity facet, with a type or without, and one other facet."""
    key = F.col("p_partkey")
    facet = lambda kind, name, value, description: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), description.alias("description"))
    none = F.lit(None).cast("string")
    entity = facet("entity", F.when(key % 5 != 0, F.col("p_brand")), F.when(key % 2 == 0, F.col("p_type")), F.col("p_name"))
    facets = F.when(key % 3 == 0, F.array(entity)).when(key % 3 == 1, F.array(entity, facet("property", F.col("p_brand"), none, F.concat(F.lit("Elements with "), F.col("p_name")))))
    return table(spark, sf_dir, "part").select("p_partkey", report_text.applicability_sentence(facets, F.lit("everything")).alias("text"))


def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification results by the labels of their cardinality and reason; those without a label keep their code."""
    labels = {"SCHEMA_MISMATCH": "another schema", "NO_REQUIREMENTS_NOTHING_ASSERTED": "nothing asserted"}
    found = results(spark, sf_dir).select("model", "ordinal", report_text.label(F.col("cardinality"), CARDINALITIES).alias("cardinality"), report_text.label(F.col("reason_code"), labels).alias("reason"))
    return found.groupBy("ordinal", "cardinality", "reason").agg(F.count("*").alias("models"))


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that can be asked natively as a rule file."""
    rules = rule_ir.compiled(rules_of_parts(spark, sf_dir)).where("status = 'native_supported'")
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    is_property = F.coalesce(F.col("requirement_kind"), F.lit("attribute")) == "property"
    datatype = F.when(is_property, F.col("datatype")).otherwise("double")
    xml = report_text.rule_file(F.concat(F.lit("rule & "), F.col("p_partkey").cast("string")), F.col("p_name"), F.array(F.lit("IFC2X3"), F.lit("IFC4")), F.lit("IfcDoor"), F.when(is_property, F.lit("Pset_<Door>")), F.col("p_brand"), datatype, F.col("facets"))
    return rules.join(brand, "p_partkey").select("p_partkey", xml.alias("ids_xml"), F.sha2(xml, 256).alias("ids_sha256"))


QUERIES = {"requirement_texts": requirement_texts, "applicability_texts": applicability_texts, "result_labels": result_labels, "rule_files": rule_files}
_SUBJECTS = """select p_partkey, case when p_partkey % 7 > 2 then p_name when p_partkey % 7 = 1 then p_brand when p_partkey % 7 = 0 and p_size % 5 > 2 then p_brand || ' or ' || p_type end as subject,
 case p_size % 5 when 0 then 'at least ' || p_size || ' and less than ' || (p_size + 10) when 1 then p_brand || ' or ' || p_type || ' and at most ' || p_size || ' characters' when 2 then null else 'provided' end as bound,
 ['shall be', 'may be', 'shall not be', 'shall be'][p_partkey % 4 + 1] as verb from part"""
_BASES = "case when p_partkey % 3 <> 0 then 'xs:double' when p_size % 2 <> 0 then 'xs:string' when p_partkey % 2 = 0 then 'xs:integer' else 'xs:double' end"
ORACLES = {
    "requirement_texts": f"select p_partkey, if(p_partkey % 11 = 0 or subject is null or bound is null, '-', 'The ' || subject || ' ' || verb || ' ' || bound || '.') as text from ({_SUBJECTS})",
    "applicability_texts": """select p_partkey, if(p_partkey % 3 = 2, 'everything', if(p_partkey % 5 = 0, p_name, 'All ' || p_brand || ' data' || if(p_partkey % 2 = 0, ' of type ' || p_type, '')) || if(p_partkey % 3 = 1, ' and Elements with ' || p_name, '')) as text from part""",
    "result_labels": f"""select ordinal, map {{'required': 'must be met', 'prohibited': 'must not occur', 'optional': 'optional'}}[cardinality] as cardinality,
 case reason_code when 'SCHEMA_MISMATCH' then 'another schema' when 'NO_REQUIREMENTS_NOTHING_ASSERTED' then 'nothing asserted' else reason_code end as reason, count(*) as models from ({RESULTS}) group by all""",
    "rule_files": f"""with c as ({_COMPILED}), f as (select p_partkey, p_brand, p_name, {_BASES} as base, p_partkey % 3 = 0 as property,
  array_to_string([ '<xs:' || split_part(x, '=', 1) || ' value="' || split_part(x, '=', 2) || '"/>' for x in string_split(c.facets, ';')], '') as written from c join part using (p_partkey) where c.reason is null),
 x as (select p_partkey, '<?xml version="1.0" encoding="UTF-8"?><ids:ids xmlns:ids="http://standards.buildingsmart.org/IDS" xmlns:xs="http://www.w3.org/2001/XMLSchema"><ids:specifications><ids:specification ifcVersion="IFC2X3 IFC4" name="rule &amp; ' || p_partkey || '" description="' || p_name
  || '"><ids:applicability maxOccurs="unbounded"><ids:entity><ids:name><ids:simpleValue>IFCDOOR</ids:simpleValue></ids:name></ids:entity></ids:applicability><ids:requirements>'
  || if(property, '<ids:property cardinality="required"><ids:propertySet><ids:simpleValue>Pset_&lt;Door&gt;</ids:simpleValue></ids:propertySet><ids:baseName><ids:simpleValue>' || p_brand || '</ids:simpleValue></ids:baseName>', '<ids:attribute cardinality="required"><ids:name><ids:simpleValue>' || p_brand || '</ids:simpleValue></ids:name>')
  || '<ids:value><xs:restriction base="' || base || '">' || written || '</xs:restriction></ids:value>' || if(property, '</ids:property>', '</ids:attribute>') || '</ids:requirements></ids:specification></ids:specifications></ids:ids>' as ids_xml from f)
 select p_partkey, ids_xml, sha256(ids_xml) as ids_sha256 from x""",
}
