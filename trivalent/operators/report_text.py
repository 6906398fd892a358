"""Sentences of a report from its structured parts, and rule files from compiled rules, as Column expressions.

A part that can't be put into a sentence in full gives the fallback: half a rule stated
would be a wrong rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of each restriction.
BOUNDS = {
    "minInclusive": "at least %s", "maxInclusive": "at most %s", "minExclusive": "more than %s", "maxExclusive": "less than %s", "enumeration": "%s",
    "literal": "%s", "pattern": "matching %s", "length": "exactly %s characters", "minLength": "at least %s characters", "maxLength": "at most %s characters",
}
# The verb of each cardinality; any other reads as required.
VERBS = {"required": "shall be", "prohibited": "shall not be", "optional": "may be"}
# XML Schema types of a restriction.
BASES = {"double": "xs:double", "decimal": "xs:decimal", "integer": "xs:integer", "string": "xs:string"}
# Namespaces of rule files.
IDS, XS = "http://standards.buildingsmart.org/IDS", "http://www.w3.org/2001/XMLSchema"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown code is its own label, none has none."""
    return F.when(code != "", F.coalesce(_lookup(labels, code), code))


def subject_name(names: Column, comparisons: Column) -> Column:
    """What a restricted name names: its listed members joined by or; null where it restricts otherwise.

    Several names beside a bound must all meet it, which or would misstate: null as well.
    """
    listed = F.forall(names, lambda n: F.coalesce(n["operator"].isin("literal", "enumeration") & n["value"].isNotNull(), F.lit(False)))
    several = (F.size(names) > 1) & (F.coalesce(F.size(comparisons), F.lit(0)) > 0)
    return F.when((F.size(names) > 0) & listed & ~several, F.array_join(F.transform(names, lambda n: n["value"]), " or "))


def recognised(comparisons: Column) -> Column:
    """Whether every comparison has wording and a value."""
    return F.forall(comparisons, lambda c: F.coalesce(c["operator"].isin(*BOUNDS) & c["value"].isNotNull(), F.lit(False)))


def bound(comparisons: Column) -> Column:
    """Members of an enumeration joined by or, all else by and; null without comparisons."""
    worded = F.transform(comparisons, lambda c: F.struct((c["operator"] == "enumeration").alias("member"), F.replace(_lookup(BOUNDS, c["operator"]), F.lit("%s"), c["value"]).alias("words")))
    words = lambda member: F.transform(F.filter(worded, lambda w: w["member"] == member), lambda w: w["words"])
    members = F.array_join(words(True), " or ")
    return F.when(F.size(comparisons) > 0, F.array_join(F.concat(F.filter(F.array(members), lambda m: m != ""), words(False)), " and "))


def requirement_sentence(kind: Column, name: Column, names: Column, comparisons: Column, cardinality: Column, fallback: Column) -> Column:
    """The sentence of an attribute requirement; fallback for other kinds, and where name or bound can't be stated."""
    none = F.array().cast("array<struct<operator:string,value:string>>")
    comparisons, names = F.coalesce(comparisons, none), F.coalesce(names, none)
    subject = F.coalesce(F.nullif(name, F.lit("")), subject_name(names, comparisons))
    verb = F.coalesce(_lookup(VERBS, cardinality), F.lit(VERBS["required"]))
    sentence = F.concat(F.lit("The "), subject, F.lit(" "), verb, F.lit(" "), F.coalesce(bound(comparisons), F.lit("provided")), F.lit("."))
    stated = (kind == "attribute") & (F.coalesce(subject, F.lit("")) != "") & recognised(comparisons)
    return F.when(F.coalesce(stated, F.lit(False)), sentence).otherwise(fallback)


def applicability_sentence(facets: Column, fallback: Column) -> Column:
    """facets: array of (kind, name, value, description); fallback where there is no list of facets."""

    def one(facet: Column) -> Column:
        typed = F.when(F.coalesce(facet["value"], F.lit("")) != "", F.concat(F.lit(" of type "), facet["value"])).otherwise("")
        entity = (facet["kind"] == "entity") & (F.coalesce(facet["name"], F.lit("")) != "")
        return F.when(entity, F.concat(F.lit("All "), facet["name"], F.lit(" data"), typed)).otherwise(F.coalesce(facet["description"], F.lit("")))

    return F.when(facets.isNotNull(), F.array_join(F.transform(facets, one), " and ")).otherwise(fallback)


def escaped(text: Column) -> Column:
    """Text for XML content and quoted attributes."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _simple(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"<ids:{tag}><ids:simpleValue>"), escaped(text), F.lit(f"</ids:simpleValue></ids:{tag}>"))


def rule_file(name: Column, description: Column, versions: Column, entity: Column, property_set: Column, subject: Column, datatype: Column, facets: Column) -> Column:
    """A rule file of one specification: entities of a class need an attribute, or with property_set a property, within facets.

    Read back by the source of rule files, it gives the same specification. Null where any part but property_set is null.
    """
    written = F.array_join(F.transform(facets, lambda f: F.concat(F.lit("<xs:"), f["operator"], F.lit(' value="'), escaped(f["value"]), F.lit('"/>'))), "")
    value = F.concat(F.lit('<ids:value><xs:restriction base="'), F.coalesce(_lookup(BASES, datatype), F.lit("xs:string")), F.lit('">'), written, F.lit("</xs:restriction></ids:value>"))
    attribute = F.concat(F.lit('<ids:attribute cardinality="required">'), _simple("name", subject), value, F.lit("</ids:attribute>"))
    property_ = F.concat(F.lit('<ids:property cardinality="required">'), _simple("propertySet", property_set), _simple("baseName", subject), value, F.lit("</ids:property>"))
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><ids:ids xmlns:ids="{IDS}" xmlns:xs="{XS}"><ids:specifications><ids:specification ifcVersion="'), F.array_join(F.transform(versions, escaped), " "),
        F.lit('" name="'), escaped(name), F.lit('" description="'), escaped(description), F.lit('"><ids:applicability maxOccurs="unbounded"><ids:entity>'), _simple("name", F.upper(entity)),
        F.lit("</ids:entity></ids:applicability><ids:requirements>"), F.coalesce(property_, attribute), F.lit("</ids:requirements></ids:specification></ids:specifications></ids:ids>"),
    )
