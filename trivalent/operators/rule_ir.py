"""Rules made executable: what a rule can ask natively, its bounds as facets, and its facets as check specifications.

A rule is a row: requirement_kind (attribute or property), comparator, value, datatype,
bounds (a map from facet name to its values as strings) and which of formula, table and
observation it refers to. Whatever can't be asked natively is deferred with a reason, never
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Facets in canonical order, comparators and the facet each stands for, numeric datatypes.
FACETS = ("enumeration", "pattern", "minInclusive", "minExclusive", "maxInclusive", "maxExclusive", "length", "minLength", "maxLength")
COMPARATORS = {"eq": "enumeration", "equals": "enumeration", "gt": "minExclusive", "gte": "minInclusive", "lt": "maxExclusive", "lte": "maxInclusive"}
NUMERIC = ("integer", "double", "decimal")
FACET = "array<struct<operator:string,value:string>>"


def unsupported(kind: Column, comparator: Column, formula: Column, table: Column, observation: Column) -> Column:
    """Why a rule can't be asked natively, the first reason that holds; null if it can."""
    return (
        F.when(formula.isNotNull(), "FORMULA_REQUIRES_DERIVED_OBSERVATION")
        .when(table.isNotNull(), "TABLE_LOOKUP_REQUIRES_DEFERRED_EVALUATION")
        .when(observation.isNotNull(), "DERIVED_OBSERVATION_NOT_NATIVE")
        .when(F.coalesce(kind, F.lit("attribute")) == "property", F.lit(None))
        .when(comparator.isNull() | ~comparator.isin(*COMPARATORS), "UNSUPPORTED_COMPARATOR")
    )


def bound_valid(value: Column, datatype: Column) -> Column:
    """Whether a bound's value fits its datatype: finite numbers, whole ones for integer, other texts not empty."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.coalesce(F.when(datatype == "integer", finite & (number == F.floor(number))).when(datatype.isin(*NUMERIC), finite).otherwise(F.length(value) > 0), F.lit(False))


def facets(kind: Column, comparator: Column, value: Column, bounds: Column) -> Column:
    """The rule's requirement as (operator, value) in canonical order; of a comparator, its one facet."""
    of = F.create_map(*(F.lit(x) for pair in COMPARATORS.items() for x in pair))
    single = F.array(F.struct(F.element_at(of, comparator).alias("operator"), value.alias("value")))

    def named(name: str) -> Column:
        own = F.coalesce(F.element_at(bounds, F.lit(name)), F.array().cast("array<string>"))
        return F.transform(own, lambda v: F.struct(F.lit(name).alias("operator"), v.alias("value")))

    listed = F.flatten(F.array(*map(named, FACETS)))
    return F.when(F.coalesce(kind, F.lit("attribute")) == "property", listed.cast(FACET)).otherwise(single.cast(FACET))


def compiled(rules: DataFrame) -> DataFrame:
    """rules with status (native_supported or deferred), reason and facets (null where deferred)."""
    c = F.col
    is_property = F.coalesce(c("requirement_kind"), F.lit("attribute")) == "property"
    unknown = F.size(F.array_except(F.map_keys(c("bounds")), F.array(*map(F.lit, FACETS)))) > 0
    valid = F.forall(F.flatten(F.map_values(c("bounds"))), lambda v: bound_valid(v, c("datatype")))
    some = F.size(F.flatten(F.map_values(c("bounds")))) > 0
    whole = F.when(is_property, F.coalesce(~unknown & valid & some, F.lit(False))).otherwise(bound_valid(c("value"), F.lit("double")))
    reason = F.coalesce(unsupported(c("requirement_kind"), c("comparator"), c("formula"), c("lookup"), c("observation")), F.when(~whole, "RULE_IR_INVALID"))
    made = facets(c("requirement_kind"), c("comparator"), c("value"), c("bounds"))
    return rules.withColumn("reason", reason).withColumn("status", F.when(c("reason").isNull(), "native_supported").otherwise("deferred")).withColumn("facets", F.when(c("reason").isNull(), made))


def resolved(kind: Column, values: Column) -> Column:
    """status and value of an observation from its values, as text: one valid value is AVAILABLE, whatever else INDETERMINATE."""
    one = F.when(F.size(values) == 1, F.element_at(values, 1))
    number = one.try_cast("double")
    good = (
        F.when(kind == "numeric", number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))))
        .when(kind == "text", F.trim(one) != "")
        .when(kind == "boolean", one.isin("true", "false"))
    )
    valid = F.coalesce(good, F.lit(False))
    return F.struct(F.when(valid, "AVAILABLE").otherwise("INDETERMINATE").alias("status"), F.when(valid, one).alias("value"))
