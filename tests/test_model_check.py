"""Tanks, a pump, a duct fitting of an unlisted class and their relations, against small rule files of their own."""

import pytest

from trivalent.operators import check
from trivalent.plans.model_check import run_check, run_report
from trivalent.sources.ids_xml import parse_ids
from trivalent.sources.ifc_step import arguments, facts_of, instances, open_entities, text_of

PLANT = """ISO-10303-21;
HEADER; /* the maker's note; not 'closed */ FILE_SCHEMA(('IFC4')); ENDSEC;
DATA;
#7=IFCTANK('1Tank________________1',$,'north; upper ''A''',$,'oil',$,$,'T-1',.STORAGE.);
#8=IFCTANK('1Tank________________2',$,'south',
  $,'water',$,$,'T-2',.STORAGE.);
#9=IFCTANK('1Tank________________3',$,$,$,$,$,$,$,$);
#11=IFCFILTER('1Filter______________1',$,'fine',$,$,$,$,$,.AIR.);
#12=IFCPUMP('1Pump________________1',$,'lift',$,$,$,$,'P-1',$);
#13=IFCGROUP('1Group_______________1',$,'wet part',$,$);
#20=IFCPROPERTYSINGLEVALUE('Capacity',$,IFCVOLUMEMEASURE(42.5),$);
#21=IFCPROPERTYSET('1Pset________________1',$,'Pset_Vessel',$,(#20));
#22=IFCRELDEFINESBYPROPERTIES('1Rel_________________1',$,$,$,(#7,#8),#21);
#23=IFCPROPERTYSINGLEVALUE('Capacity',$,IFCVOLUMEMEASURE(7.),$);
#24=IFCPROPERTYSINGLEVALUE('Lining',$,IFCLABEL('rubber'),$);
#25=IFCPROPERTYSET('1Pset________________2',$,'Pset_Vessel',$,(#23,#24));
#26=IFCTANKTYPE('1Type________________1',$,'big',$,$,(#25),$,$,$,.STORAGE.);
#27=IFCRELDEFINESBYTYPE('1Rel_________________2',$,$,$,(#8,#9),#26);
#30=IFCRELASSIGNSTOGROUP('1Rel_________________3',$,$,$,(#7,#12),$,#13);
#31=IFCMATERIAL('steel');
#32=IFCRELASSOCIATESMATERIAL('1Rel_________________4',$,$,$,(#7),#31);
#33=IFCCLASSIFICATION($,$,$,'Own',$,$,$);
#34=IFCCLASSIFICATIONREFERENCE($,'V.10',$,#33,$,$);
#35=IFCRELASSOCIATESCLASSIFICATION('1Rel_________________5',$,$,$,(#8),#34);
#36=IFCELEMENTQUANTITY('1Quan________________1',$,'Qto_Vessel',$,$,(#37));
#37=IFCQUANTITYVOLUME('Net',$,$,3.25,$);
#38=IFCRELDEFINESBYPROPERTIES('1Rel_________________6',$,$,$,(#9),#36);
ENDSEC;
END-ISO-10303-21;
"""


def rules(name, requirement="", occurs='maxOccurs="unbounded"', version="IFC4"):
    return f"""<i:ids xmlns:i="http://standards.buildingsmart.org/IDS" xmlns:x="http://www.w3.org/2001/XMLSchema"><i:specifications><i:specification name="{name}" ifcVersion="{version}">
<i:applicability {occurs}><i:entity><i:name><i:simpleValue>{name}</i:simpleValue></i:name></i:entity></i:applicability><i:requirements>{requirement}</i:requirements></i:specification></i:specifications></i:ids>""".encode()


def attribute(name, more="", cardinality="required"):
    return f'<i:attribute cardinality="{cardinality}"><i:name><i:simpleValue>{name}</i:simpleValue></i:name>{more}</i:attribute>'


def prop(name, restriction):
    return f"<i:property><i:propertySet><i:simpleValue>Pset_Vessel</i:simpleValue></i:propertySet><i:baseName><i:simpleValue>{name}</i:simpleValue></i:baseName><i:value><x:restriction>{restriction}</x:restriction></i:value></i:property>"


BIG = prop("Capacity", '<x:minExclusive value="40"/>')
TAGGED = attribute("Tag", '<i:value><x:restriction><x:pattern value="T-[0-9]"/></x:restriction></i:value>')
CASES = {
    # matched, passed, failed, indeterminate, applicability, status, code
    "capacity": (rules("IFCTANK", BIG), (3, 2, 1, 0, "APPLIES", "FAIL", None)),  # the third has its type's 7
    "lining": (rules("IFCTANK", prop("Lining", '<x:enumeration value="rubber"/>')), (3, 2, 0, 1, "APPLIES", "INDETERMINATE", None)),
    "tagged": (rules("IFCTANK", TAGGED), (3, 2, 0, 1, "APPLIES", "INDETERMINATE", None)),
    "named": (rules("IFCPUMP", attribute("Name")), (1, 1, 0, 0, "APPLIES", "PASS", None)),
    "no pumps": (rules("IFCPUMP", occurs='maxOccurs="0"'), (1, 0, 0, 0, "APPLIES", "FAIL", "PROHIBITED_SUBJECTS_PRESENT")),
    "no valves": (rules("IFCVALVE", occurs='maxOccurs="0"'), (0, 0, 0, 0, "APPLIES", "PASS", "NO_SUBJECTS_AND_PROHIBITED")),
    "other schema": (rules("IFCPUMP", attribute("Name"), version="IFC2X3"), (1, 1, 0, 0, "UNDETERMINED_APPLICABILITY", "INDETERMINATE", "SCHEMA_MISMATCH")),
    # Classes that the table of attributes lacks are entities all the same, and what can't be seen of them isn't absent.
    "no filters": (rules("IFCFILTER", occurs='maxOccurs="0"'), (1, 0, 0, 0, "APPLIES", "FAIL", "PROHIBITED_SUBJECTS_PRESENT")),
    "filter named": (rules("IFCFILTER", attribute("Name")), (1, 1, 0, 0, "APPLIES", "PASS", None)),
    "filter untagged": (rules("IFCFILTER", attribute("Tag", cardinality="prohibited")), (1, 0, 0, 1, "APPLIES", "INDETERMINATE", None)),
    "filter perhaps tagged": (rules("IFCFILTER", attribute("Tag", cardinality="optional")), (1, 0, 0, 1, "APPLIES", "INDETERMINATE", None)),
    "pump untagged": (rules("IFCPUMP", attribute("ObjectType", cardinality="optional")), (1, 1, 0, 0, "APPLIES", "PASS", None)),
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    models, files = tmp_path_factory.mktemp("models"), tmp_path_factory.mktemp("rules")
    (models / "plant.ifc").write_text(PLANT)
    for name, (content, _) in CASES.items():
        (files / f"{name}.ids").write_bytes(content)
    return str(models), str(files)


def test_verdicts(spark, folders):
    rows = run_check(spark, *folders).collect()
    assert {r.ids: (r.matched, r.passed, r.failed, r.indeterminate, r.applicability, r.status, r.reason_code) for r in rows} == {f"{name}.ids": expected for name, (_, expected) in CASES.items()}
    total = run_report(spark, *folders).first()
    assert (total.status, total.specifications_passed, total.specifications_failed, total.specifications_indeterminate) == ("FAIL", 4, 3, 5)


def test_facts(spark, folders):
    facts = facts_of(instances(spark, folders[0]))
    got = {(r.entity_id, r.kind, r.scope, r.name, r.value, r.number) for r in facts.collect()}
    assert {(0, "model", None, None, "IFC4", None), (7, "material", None, None, "steel", None), (8, "classification", "Own", None, "V.10", None), (7, "part_of", "IFCRELASSIGNSTOGROUP", "IFCGROUP", None, None)} <= got
    assert {(e, v) for e, kind, scope, name, v, _ in got if kind == "property" and name == "Capacity"} == {(7, "42.5"), (8, "42.5"), (9, "7.0")}
    assert (9, "property", "Qto_Vessel", "Net", "3.25", 3.25) in got and (7, "attribute", None, "Name", "north; upper 'A'", None) in got
    assert {e for e, kind, _, name, *_ in got if kind == "entity" and not name.startswith(("IFCREL", "IFCP", "IFCE", "IFCTANKTYPE"))} == {7, 8, 9, 11, 13}
    assert {11, 13} <= {r.entity_id for r in open_entities(facts).collect()} and 7 not in {r.entity_id for r in open_entities(facts).collect()}


@pytest.mark.parametrize("size", [150])
def test_ranges_of_a_file(spark, folders, size):
    """A file that is read in many ranges gives the rows of one that is read whole, with strings and comments across the cuts."""
    whole = sorted(map(str, facts_of(instances(spark, folders[0])).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert instances(spark, folders[0]).rdd.getNumPartitions() >= 1
        assert sorted(map(str, facts_of(instances(spark, folders[0])).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_entity_level(spark, folders):
    facts = facts_of(instances(spark, folders[0]))
    specs = spark.createDataFrame(parse_ids("c", CASES["tagged"][0]), check.SPECIFICATION)
    found = {r.entity_id: (r.status, r.reason_code) for r in check.entity_outcomes(facts, specs, check.subjects_of(facts, specs)).collect()}
    assert found == {7: ("PASS", None), 8: ("PASS", None), 9: ("INDETERMINATE", "ATTRIBUTE_EMPTY")}


def test_step_text():
    assert text_of("'it''s \\X2\\0645\\X0\\'") == "it's م"
    assert [(a["kind"], a["value"], a["refs"]) for a in arguments("'a;(',(#1,#2),IFCLABEL('x'),$,.T.,-2.5E1)")] == [("text", "a;(", []), ("list", None, [1, 2]), ("text", "x", []), (None, None, []), ("enum", "T", []), ("number", "-25.0", [])]


def test_empty_rules_are_refused():
    with pytest.raises(ValueError):
        parse_ids("x", b"<ids/>")


def test_plan_has_no_products(spark):
    from trivalent.queries import rules as queries

    plan = queries.check_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # One scan of documents and labels for subjects, one for requirements, one of documents for the list of models.
    assert plan.count("FileScan parquet") <= 5 and plan.count("Exchange hashpartitioning") <= 12


def test_rules_too_large_to_broadcast(spark, monkeypatch):
    from trivalent.queries import rules as queries

    broadcast = queries.results(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(check, "RULE_BYTES", -1)
    assert sorted(map(str, queries.results(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, broadcast))


def test_restrictions(spark):
    """(comparisons, value, number, whether they hold) of every restriction; null operators, values and lists included."""
    cases = [
        ([], None, None, True), (None, "x", None, True), ([("literal", "a")], None, None, False), ([("literal", "a"), ("enumeration", "b")], "b", None, True), ([("literal", "A")], "a", None, False),
        ([("literal", "900.0")], "900", 900.0, True), ([("minInclusive", "2"), ("maxExclusive", "3")], "3", 3.0, False), ([("minInclusive", "2"), ("maxInclusive", "3")], "3", 3.0, True), ([("minExclusive", "2")], "x", None, False),
        ([("length", "2")], "ab", None, True), ([("minLength", "3")], "ab", None, False), ([("maxLength", "2")], "ab", None, True), ([("pattern", "a|b")], "b", None, True), ([("pattern", "a")], "ab", None, False),
        ([("totalDigits", "3")], "12.34", 12.34, False), ([("fractionDigits", "2")], "12.34", 12.34, True), ([("fractionDigits", "1")], "12.34", 12.34, False), ([("unknown", "1")], "a", None, False), ([(None, "1")], "1", 1.0, False),
        ([("literal", None)], "a", None, False), ([("enumeration", "a"), ("minLength", "2")], "a", None, False),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, comparisons {check.COMPARISONS}, value string, number double, expected boolean")
    wrong = [tuple(r) for r in rows.withColumn("got", check.holds("comparisons", "value", "number")).collect() if r.got is not r.expected]
    assert not wrong
    folded = rows.where("i = 4").select(check.holds("comparisons", "value", fold=True)).first()[0]
    assert folded is True
