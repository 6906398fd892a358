"""Three-valued status: reason codes, aggregation and the applicability judgement, as Column expressions.

A status is a string, never a boolean: PASS, FAIL or INDETERMINATE. What was not
evaluated is INDETERMINATE, so missing data never counts as compliance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, INDETERMINATE = "PASS", "FAIL", "INDETERMINATE"

# Reason patterns in order of precedence, with code and status.
REASONS = (
    (r"^The required attribute did not exist$", "ATTRIBUTE_MISSING", INDETERMINATE),
    (r"^The attribute value .* is empty$", "ATTRIBUTE_EMPTY", INDETERMINATE),
    (r"^An invalid attribute name was specified in the IDS$", "ATTRIBUTE_NAME_INVALID", INDETERMINATE),
    (r"^The entity has no classification$", "CLASSIFICATION_MISSING", INDETERMINATE),
    (r"^The entity has no relationship$", "RELATIONSHIP_MISSING", INDETERMINATE),
    (r"^The required property set does not exist$", "PROPERTY_SET_MISSING", INDETERMINATE),
    (r"^The property set does not contain the required property$", "PROPERTY_MISSING", INDETERMINATE),
    (r"does not match the required data type of", "DATA_TYPE_MISMATCH", INDETERMINATE),
    (r"^The entity has no material$", "MATERIAL_MISSING", INDETERMINATE),
    (r"^The entity class .* does not meet the required IFC class$", "ENTITY_CLASS_MISMATCH", FAIL),
    (r"^The predefined type .* does not meet the required type$", "PREDEFINED_TYPE_MISMATCH", FAIL),
    (r"^The attribute value .* does not match the requirement$", "ATTRIBUTE_VALUE_MISMATCH", FAIL),
    (r"^The attribute value should not have met the requirement$", "ATTRIBUTE_VALUE_PROHIBITED", FAIL),
    (r"^The references .* do not match the requirements$", "CLASSIFICATION_REFERENCE_MISMATCH", FAIL),
    (r"^The systems .* do not match the requirements$", "CLASSIFICATION_SYSTEM_MISMATCH", FAIL),
    (r"^The classification should not have met the requirement$", "CLASSIFICATION_PROHIBITED", FAIL),
    (r"^The entity has a relationship with incorrect entities", "RELATIONSHIP_ENTITY_MISMATCH", FAIL),
    (r"^The entity has a relationship with incorrect predefined type", "RELATIONSHIP_PREDEFINED_TYPE_MISMATCH", FAIL),
    (r"^The relationship should not have met the requirement$", "RELATIONSHIP_PROHIBITED", FAIL),
    (r"^The property values? .* do(es)? not match the requirements?$", "PROPERTY_VALUE_MISMATCH", FAIL),
    (r"^The property should not have met the requirement$", "PROPERTY_PROHIBITED", FAIL),
    (r"^The material names and categories of .* does not match the requirement$", "MATERIAL_MISMATCH", FAIL),
    (r"^The material should not have met the requirement$", "MATERIAL_PROHIBITED", FAIL),
)
UNRECOGNISED = "REASON_UNRECOGNISED"
# Codes under which nothing was established about any entity.
ESTABLISHED_NOTHING = ("SCHEMA_MISMATCH", "NO_SUBJECTS_NOTHING_CHECKED", "NO_REQUIREMENTS_NOTHING_ASSERTED")
SEVERITY = {FAIL: 0, INDETERMINATE: 1, PASS: 2}


def reason_code(reason: Column) -> Column:
    """The code of the first pattern that matches."""
    code = F.lit(UNRECOGNISED)
    for pattern, name, _ in reversed(REASONS):
        code = F.when(reason.rlike(pattern), name).otherwise(code)
    return code


def status_of_code(code: Column) -> Column:
    """FAIL for codes of violations, INDETERMINATE for all others."""
    return F.when(code.isin([name for _, name, status in REASONS if status == FAIL]), FAIL).otherwise(INDETERMINATE)


def is_recognised(reason: Column) -> Column:
    return reason_code(reason) != UNRECOGNISED


def established_nothing(code: Column) -> Column:
    return F.coalesce(code.isin(*ESTABLISHED_NOTHING), F.lit(False))


def three_valued(passed: Column, failed: Column, indeterminate: Column) -> Column:
    """FAIL outranks INDETERMINATE, which outranks PASS; of nothing, nothing is known."""
    return F.when(failed > 0, FAIL).when(indeterminate > 0, INDETERMINATE).when(passed > 0, PASS).otherwise(INDETERMINATE)


def severity(status: Column) -> Column:
    """Rank for sorting, worst first; an unknown status ranks as INDETERMINATE."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), status), F.lit(SEVERITY[INDETERMINATE]))


def judge(cardinality: Column, matched: Column, schema_matches: Column, failed: Column, indeterminate: Column, has_requirements: Column) -> Column:
    """STRUCT<applicability, status, code> of a specification; the first rule that applies decides.

    An unknown schema_matches (null) is no mismatch.
    """

    def outcome(applicability: str, status, code: str | None) -> Column:
        return F.struct(F.lit(applicability).alias("applicability"), (F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(code).cast("string").alias("code"))

    return (
        F.when(F.coalesce(~schema_matches, F.lit(False)), outcome("UNDETERMINED_APPLICABILITY", INDETERMINATE, "SCHEMA_MISMATCH"))
        .when((matched == 0) & (cardinality == "required"), outcome("APPLIES", FAIL, "NO_SUBJECTS_BUT_REQUIRED"))
        .when((matched == 0) & (cardinality == "prohibited"), outcome("APPLIES", PASS, "NO_SUBJECTS_AND_PROHIBITED"))
        .when(matched == 0, outcome("DOES_NOT_APPLY", INDETERMINATE, "NO_SUBJECTS_NOTHING_CHECKED"))
        .when(cardinality == "prohibited", outcome("APPLIES", FAIL, "PROHIBITED_SUBJECTS_PRESENT"))
        .when((cardinality == "optional") & ~has_requirements, outcome("APPLIES", INDETERMINATE, "NO_REQUIREMENTS_NOTHING_ASSERTED"))
        .otherwise(outcome("APPLIES", three_valued(matched, failed, indeterminate), None))
    )
