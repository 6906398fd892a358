"""Rules as data: specifications evaluated over model facts, rolled up to a three-valued report.

A model is a long table of facts: (model, entity_id, kind, scope, name, data_type, value,
number). Kinds and the meaning of scope, name and value:

    entity          -              class           predefined type
    attribute       -              attribute       value, null when unset
    property        property set   property        value
    classification  system         -               reference
    material        -              -               name or category
    part_of         relation       whole's class   whole's predefined type

A facet names a kind and restricts scope, name and value, each by a list of (operator,
value) comparisons: enumeration and literal members are alternatives, everything else must
hold. Facets, requirements and subjects meet by equi-joins on model, entity and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.status import judge, status_of_code, three_valued

COMPARISONS = "array<struct<operator:string,value:string>>"
FACET = f"struct<kind:string,scope:{COMPARISONS},name:{COMPARISONS},value:{COMPARISONS},data_type:string,cardinality:string,description:string>"
FACTS = "model string, entity_id bigint, kind string, scope string, name string, data_type string, value string, number double"
SPECIFICATION = f"ids string, ordinal int, name string, description string, instructions string, ifc_versions array<string>, min_occurs string, max_occurs string, applicability array<{FACET}>, requirements array<{FACET}>"
ENTITY_LIMIT = 500
ALTERNATIVES = ("enumeration", "literal")
#: Kinds whose names are compared without regard to case.
FOLDED = ("entity", "part_of")
#: Rules of at most this many bytes are broadcast; larger sets of rules meet facts by shuffled joins.
RULE_BYTES = 32 << 20
#: Specifications meet models in this many shares.
SHARES = 16
#: The key of facets that list no names.
ANY = "\x00"


#: Each restriction as a test of value and number against the bound b, its number n.
TESTS = {
    "minInclusive": "{number} >= {n}", "maxInclusive": "{number} <= {n}", "minExclusive": "{number} > {n}", "maxExclusive": "{number} < {n}",
    "length": "length({value}) = {n}", "minLength": "length({value}) >= {n}", "maxLength": "length({value}) <= {n}",
    "pattern": "regexp_like({value}, concat('^(?:', {b}, ')$'))",
    "totalDigits": "length(regexp_replace({value}, '[^0-9]', '')) <= {n}", "fractionDigits": "length(regexp_extract({value}, r'\\.([0-9]+)', 1)) <= {n}",
}


def holds(comparisons: str, value: str, number: str = "cast(null as double)", fold: bool = False) -> Column:
    """Whether a value satisfies a list of comparisons, all given as SQL: an empty list always holds, a null value never."""
    case = (lambda text: f"upper({text})") if fold else (lambda text: text)
    listed = "coalesce(c.operator in ({}), false)".format(", ".join(f"'{a}'" for a in ALTERNATIVES))
    bound = {"value": value, "number": number, "b": "c.value", "n": "try_cast(c.value as double)"}
    same = f"coalesce({case(value)} = {case('c.value')}, false) or coalesce({number} = {bound['n']}, false)"
    met = "case c.operator {} else false end".format(" ".join(f"when '{name}' then coalesce({test.format(**bound)}, false)" for name, test in TESTS.items()))
    some = f"(not exists({comparisons}, c -> {listed}) or exists({comparisons}, c -> {listed} and ({same})))"
    return F.expr(f"coalesce(size({comparisons}), 0) <= 0 or ({value} is not null and {some} and forall({comparisons}, c -> {listed} or {met}))")


def rules_fit(specifications: DataFrame) -> bool:
    """Whether specifications are small enough to broadcast, by their measured size."""
    size = specifications.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= RULE_BYTES


def _rules(rules: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rules) if small else rules


def _folded(kind: Column) -> Column:
    return kind.isin(*FOLDED)


def _tested(pairs: DataFrame, present: Column) -> DataFrame:
    """pairs of facet and fact with how far the fact gets, each column from the one before."""
    folded = _folded(F.col("facet.kind"))
    types = F.col("facet.data_type").isNull() | F.col("data_type").isNull() | (F.upper("facet.data_type") == F.upper("data_type"))
    return (
        pairs.withColumn("is_scope", present & holds("facet.scope", "scope", fold=True))
        .withColumn("is_name", F.col("is_scope") & F.when(folded, holds("facet.name", "fact_name", fold=True)).otherwise(holds("facet.name", "fact_name")))
        .withColumn("is_set", F.col("is_name") & F.coalesce(F.col("value") != "", F.lit(False)))
        .withColumn("is_typed", F.col("is_set") & types)
        .withColumn("is_good", F.when(folded, F.col("is_name") & holds("facet.value", "value", "number", fold=True)).otherwise(F.col("is_typed") & holds("facet.value", "value", "number")))
    )


def _fact_rows(facts: DataFrame, *more: Column) -> DataFrame:
    return facts.select("model", "entity_id", "kind", "scope", F.col("name").alias("fact_name"), "data_type", "value", "number", *more)


def facet_counts(subjects: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """For each subject and facet, how many of its facts get how far; keys identify the facet.

    Grouping keeps the keys of the join before it, so that one shuffle serves both.
    """
    f = F.col("facet")
    cardinality, restricted = F.coalesce(f["cardinality"], F.lit("required")), F.coalesce(F.size(f["value"]) > 0, F.lit(False))
    asked = subjects.select("model", "entity_id", *keys, "facet", f["kind"].alias("kind"), cardinality.alias("cardinality"), restricted.alias("restricted"))
    joined = _tested(asked.join(_fact_rows(facts, F.lit(True).alias("is_fact")), ["model", "entity_id", "kind"], "left"), F.col("is_fact").isNotNull())
    counts = {"n_facts": "is_fact", "n_scope": "is_scope", "n_name": "is_name", "n_set": "is_set", "n_typed": "is_typed", "n_good": "is_good"}
    return joined.groupBy("model", "entity_id", "kind", *keys, "cardinality", "restricted").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def facet_code(kind: Column, cardinality: Column, restricted: Column) -> Column:
    """Reason code of one subject under one requirement from its counts; null when it passes.

    A restricted value must hold for every fact that is set; without one, a fact that is set suffices.
    """
    n = lambda x: F.col(f"n_{x}")
    entity = kind == "entity"
    complete = F.when(entity | (kind == "part_of"), n("good") > 0).when(restricted & kind.isin("attribute", "property"), (n("good") > 0) & (n("good") == n("set"))).otherwise(n("good") > 0)
    required = (
        F.when(complete, None)
        .when(entity & (n("name") == 0), "ENTITY_CLASS_MISMATCH")
        .when(entity, "PREDEFINED_TYPE_MISMATCH")
        .when(kind == "attribute", F.when(n("name") == 0, "ATTRIBUTE_MISSING").when(n("set") == 0, "ATTRIBUTE_EMPTY").otherwise("ATTRIBUTE_VALUE_MISMATCH"))
        .when(kind == "property", F.when(n("scope") == 0, "PROPERTY_SET_MISSING").when(n("set") == 0, "PROPERTY_MISSING").when(n("typed") == 0, "DATA_TYPE_MISMATCH").otherwise("PROPERTY_VALUE_MISMATCH"))
        .when(kind == "classification", F.when(n("facts") == 0, "CLASSIFICATION_MISSING").when(n("scope") == 0, "CLASSIFICATION_SYSTEM_MISMATCH").otherwise("CLASSIFICATION_REFERENCE_MISMATCH"))
        .when(kind == "material", F.when(n("facts") == 0, "MATERIAL_MISSING").otherwise("MATERIAL_MISMATCH"))
        .otherwise(F.when(n("scope") == 0, "RELATIONSHIP_MISSING").when(n("name") == 0, "RELATIONSHIP_ENTITY_MISMATCH").otherwise("RELATIONSHIP_PREDEFINED_TYPE_MISMATCH"))
    )
    prohibited = F.when(n("good") > 0, F.element_at(F.create_map(*[F.lit(x) for pair in {"attribute": "ATTRIBUTE_VALUE_PROHIBITED", "property": "PROPERTY_PROHIBITED", "classification": "CLASSIFICATION_PROHIBITED", "material": "MATERIAL_PROHIBITED", "part_of": "RELATIONSHIP_PROHIBITED", "entity": "ENTITY_CLASS_MISMATCH"}.items() for x in pair]), kind))
    absent = F.when(kind == "property", n("set") == 0).when(kind == "attribute", n("set") == 0).otherwise(n("scope") == 0)
    return F.when(cardinality == "prohibited", prohibited).when((cardinality == "optional") & absent, None).otherwise(required)


def _cardinality() -> Column:
    return F.when(F.col("max_occurs") == "0", "prohibited").when(F.col("min_occurs") == "0", "optional").otherwise("required")


def subjects_of(facts: DataFrame, specifications: DataFrame, small: bool | None = None) -> DataFrame:
    """ids, ordinal, model, entity_id of what each specification applies to: all its applicability facets hold.

    An entity is whatever has facts. Facets meet facts by kind and by the names that a facet
    lists; only facets without listed names see every fact of their kind. Facts are read once.
    """
    facets = specifications.select("ids", "ordinal", F.size("applicability").alias("facets"), F.posexplode("applicability").alias("facet_no", "facet")).withColumn("kind", F.col("facet.kind"))
    key = lambda name: F.when(_folded(F.col("kind")), F.upper(name)).otherwise(name)
    listed = F.transform(F.filter(F.coalesce("facet.name", F.array().cast(COMPARISONS)), lambda c: c["operator"].isin(*ALTERNATIVES)), lambda c: key(c["value"]))
    keyed = facets.withColumn("key", F.explode(F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array(F.lit(ANY)))))
    rows = _fact_rows(facts, F.explode(F.array_compact(F.array(key(F.col("name")), F.lit(ANY)))).alias("key"))
    small = rules_fit(specifications) if small is None else small
    good = _tested(rows.join(_rules(keyed, small), ["kind", "key"]), F.lit(True)).where("is_good")
    met = good.groupBy("ids", "ordinal", "model", "entity_id", "facets").agg(F.size(F.collect_set("facet_no")).alias("met"))
    return met.where("met = facets").select("ids", "ordinal", "model", "entity_id")


#: Why a facet is undecided on an entity that may have attributes which no fact tells.
UNKNOWN_ATTRIBUTES = "ATTRIBUTES_UNKNOWN"


def _undecided(counted: DataFrame, outcomes: DataFrame, open_entities: DataFrame) -> DataFrame:
    """outcomes where an attribute's absence is no evidence: a pass of an open entity that rests on it becomes undecided."""
    absent = counted.where("kind = 'attribute' and n_name = 0").join(open_entities.select("model", "entity_id").distinct(), ["model", "entity_id"]).select("ids", "ordinal", "requirement", "model", "entity_id", F.lit(True).alias("_open"))
    joined = outcomes.join(absent, ["ids", "ordinal", "requirement", "model", "entity_id"], "left")
    return joined.withColumn("reason_code", F.when(F.col("_open") & F.col("reason_code").isNull(), UNKNOWN_ATTRIBUTES).otherwise(F.col("reason_code"))).drop("_open")


def _evaluated(facts: DataFrame, specifications: DataFrame, subjects: DataFrame, small: bool, open_entities: DataFrame | None = None) -> DataFrame:
    """entity_outcomes, and one row without requirement for each subject of which nothing is required."""
    asked = F.when(_cardinality() != "prohibited", F.col("requirements"))
    specs = specifications.select("ids", "ordinal", F.posexplode_outer(asked).alias("requirement", "facet"))
    counted = facet_counts(subjects.join(_rules(specs, small), ["ids", "ordinal"]), facts, ["ids", "ordinal", "requirement"])
    code = F.when(F.col("requirement").isNotNull(), facet_code(F.col("kind"), F.col("cardinality"), F.col("restricted")))
    outcomes = counted.select("ids", "ordinal", "requirement", "model", "entity_id", code.alias("reason_code"))
    if open_entities is not None:
        outcomes = _undecided(counted, outcomes, open_entities)
    return outcomes.withColumn("status", F.when(F.col("requirement").isNull(), None).when(F.col("reason_code").isNull(), "PASS").otherwise(status_of_code(F.col("reason_code"))))


def entity_outcomes(facts: DataFrame, specifications: DataFrame, subjects: DataFrame) -> DataFrame:
    """ids, ordinal, requirement, model, entity_id, status, reason_code. Prohibited specifications evaluate no requirement."""
    return _evaluated(facts, specifications, subjects, rules_fit(specifications)).where("requirement is not null")


def itemised(outcomes: DataFrame, keys: list[str], order: list[str], limit: int = ENTITY_LIMIT) -> DataFrame:
    """The first `limit` outcomes that don't pass, of each group, with the exact number left out.

    Ranks are limited before the shuffle and counts are added up before it, so that a group
    of any size leaves `limit` rows a task.
    """
    other = outcomes.where("status <> 'PASS'")
    first = other.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
    totals = other.groupBy(*keys).agg(F.greatest(F.lit(0), F.count("*") - limit).alias("omitted"))
    return first.join(totals, keys)


def _every(specifications: DataFrame, schemas: DataFrame, small: bool) -> DataFrame:
    """Each specification for each model: the result has a row for all of these. They meet by shares of the specifications."""
    base = specifications.select("ids", "ordinal", "name", "ifc_versions", _cardinality().alias("cardinality"), (F.coalesce(F.size("requirements"), F.lit(0)) > 0).alias("has_requirements"))
    shares = base.withColumn("share", F.pmod(F.xxhash64("ids", "ordinal"), F.lit(SHARES).cast("long")))
    models = schemas.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return models.join(_rules(shares, small), "share").drop("share")


def specification_results(facts: DataFrame, specifications: DataFrame, schemas: DataFrame, open_entities: DataFrame | None = None) -> DataFrame:
    """A row per model and specification: counts, applicability, status, reason code; schemas: (model, ifc_schema).

    open_entities (model, entity_id): those of classes whose attributes aren't all told by facts.
    """
    small = rules_fit(specifications)
    evaluated = _evaluated(facts, specifications, subjects_of(facts, specifications, small), small, open_entities)
    key = ["ids", "ordinal", "model"]
    tally = lambda s: F.count_if(F.col("status") == s)
    counts = evaluated.groupBy(*key).agg(
        F.count_if(F.coalesce("requirement", F.lit(0)) == 0).alias("matched"), tally("PASS").alias("passed"), tally("FAIL").alias("failed"), tally("INDETERMINATE").alias("indeterminate")
    )
    joined = _every(specifications, schemas, small).join(counts, key, "left").fillna(0, ["matched", "passed", "failed", "indeterminate"])
    fits = F.when(F.size("ifc_versions") > 0, F.array_contains(F.transform("ifc_versions", F.upper), F.upper("ifc_schema")))
    verdict = judge(F.col("cardinality"), F.col("matched"), fits, F.col("failed"), F.col("indeterminate"), F.col("has_requirements"))
    return joined.withColumn("verdict", verdict).select(*key, "name", "cardinality", "matched", "passed", "failed", "indeterminate", "verdict.applicability", "verdict.status", F.col("verdict.code").alias("reason_code"))


def report(results: DataFrame) -> DataFrame:
    """A row per model: its status is that of its specifications; entity counts add up."""
    tally = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy("model").agg(
        tally("PASS").alias("specifications_passed"), tally("FAIL").alias("specifications_failed"), tally("INDETERMINATE").alias("specifications_indeterminate"),
        F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), F.sum("indeterminate").alias("indeterminate"),
    )
    return out.withColumn("status", three_valued(F.col("specifications_passed"), F.col("specifications_failed"), F.col("specifications_indeterminate")))
