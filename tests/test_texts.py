"""Sentences of parts that the tables don't hold, and rule files read back and checked."""

from pyspark.sql import functions as F

from trivalent.operators import check, report_text
from trivalent.queries import texts
from trivalent.sources.ids_xml import parse_ids

SF = "/root/testdata/sf0.001"
LIST = check.COMPARISONS


def test_sentences_that_cannot_be_told(spark):
    cases = [
        ("attribute", "Width", None, None, "required", "The Width shall be provided."),
        ("attribute", "", [("literal", "A")], [], "optional", "The A may be provided."),
        ("attribute", None, [("enumeration", "A"), ("enumeration", None)], [], "required", "-"),
        ("attribute", "Width", [], [(None, "1")], "required", "-"),
        ("attribute", "Width", [], [("pattern", "100%s")], None, "The Width shall be matching 100%s."),
        (None, "Width", [], [], "required", "-"),
    ]
    rows = spark.createDataFrame(cases, f"kind string, name string, names {LIST}, comparisons {LIST}, cardinality string, want string")
    text = report_text.requirement_sentence(*(F.col(c) for c in ("kind", "name", "names", "comparisons", "cardinality")), F.lit("-"))
    assert [r.want for r in rows.collect()] == [r.got for r in rows.select(text.alias("got")).collect()]


def test_rule_files_are_read_back(spark):
    found = texts.rule_files(spark, SF).collect()
    assert found
    for row in found:
        (spec,) = parse_ids("r", row.ids_xml.encode())
        assert spec["name"] == f"rule & {row.p_partkey}" and spec["ifc_versions"] == ["IFC2X3", "IFC4"] and len(spec["requirements"]) == 1


def test_a_written_rule_is_checked(spark):
    facets = F.array(F.struct(F.lit("minInclusive").alias("operator"), F.lit("5").alias("value")))
    made = spark.range(1).select(report_text.rule_file(F.lit("n"), F.lit('<"&\n'), F.array(F.lit("IFC4")), F.lit("IfcSlab"), F.lit(None).cast("string"), F.lit("Depth"), F.lit("double"), facets).alias("x")).first().x
    (spec,) = parse_ids("r", made.encode())
    assert spec["description"] == '<"&\n'
    facts = [("m", i, "entity", None, "IFCSLAB", None, None, None) for i in (1, 2, 3)] + [("m", i, "attribute", None, "Depth", None, v, n) for i, v, n in ((1, "5", 5.0), (2, "4", 4.0), (3, None, None))]
    specs, rows = spark.createDataFrame([spec], check.SPECIFICATION), spark.createDataFrame(facts, check.FACTS)
    got = {r.entity_id: r.status for r in check.entity_outcomes(rows, specs, check.subjects_of(rows, specs)).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "INDETERMINATE"}
