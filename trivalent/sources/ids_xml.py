"""IDS rule files: one row per specification, facets as arrays of comparisons.

A rule file is small and read whole; many files are spread over tasks by binaryFile.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trivalent.operators.check import SPECIFICATION

KINDS = {"entity": "entity", "attribute": "attribute", "property": "property", "classification": "classification", "material": "material", "partOf": "part_of"}
#: Which elements of each facet are its scope, name and value.
PARTS = {
    "entity": (None, "name", "predefinedType"), "attribute": (None, "name", "value"), "property": ("propertySet", "baseName", "value"),
    "classification": ("system", None, "value"), "material": (None, None, "value"), "part_of": ("@relation", "entity/name", "entity/predefinedType"),
}


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _find(element: ElementTree.Element, path: str) -> ElementTree.Element | None:
    for step in path.split("/"):
        element = next((c for c in element if _local(c) == step), None) if element is not None else None
    return element


def comparisons(element: ElementTree.Element | None) -> list[dict[str, str]]:
    """(operator, value) members of a simple value or a restriction, in document order."""
    if element is None:
        return []
    out = []
    for child in element:
        if _local(child) == "simpleValue":
            out.append({"operator": "literal", "value": child.text or ""})
        elif _local(child) == "restriction":
            out += [{"operator": _local(f), "value": f.get("value", "")} for f in child if _local(f) != "annotation"]
    return out


def _facet(element: ElementTree.Element) -> dict | None:
    kind = KINDS.get(_local(element))
    if kind is None:
        return None
    read = lambda p: [] if p is None else [{"operator": "literal", "value": element.get(p[1:])}] * bool(element.get(p[1:])) if p[0] == "@" else comparisons(_find(element, p))
    scope, name, value = (read(p) for p in PARTS[kind])
    return {"kind": kind, "scope": scope, "name": name, "value": value, "data_type": element.get("dataType"), "cardinality": element.get("cardinality"), "description": element.get("instructions")}


def parse_ids(name: str, content: bytes) -> list[dict]:
    root = ElementTree.fromstring(content)
    specifications = [s for s in root.iter() if _local(s) == "specification"]
    if _local(root) != "ids" or not specifications:
        raise ValueError(f"{name} holds no specification")
    rows = []
    for ordinal, s in enumerate(specifications):
        applicability, requirements = _find(s, "applicability"), _find(s, "requirements")
        facets = lambda e: [f for f in map(_facet, e if e is not None else []) if f]
        occurs = applicability if applicability is not None else s
        rows.append(
            {
                "ids": name, "ordinal": ordinal, "name": s.get("name"), "description": s.get("description"), "instructions": s.get("instructions"),
                "ifc_versions": (s.get("ifcVersion") or "").split(), "min_occurs": occurs.get("minOccurs") or s.get("minOccurs"), "max_occurs": occurs.get("maxOccurs") or s.get("maxOccurs"),
                "applicability": facets(applicability), "requirements": facets(requirements),
            }
        )
    return rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Specifications of all rule files below path; a file without one is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["ids", "ordinal", "name", "description", "instructions", "ifc_versions", "min_occurs", "max_occurs", "applicability", "requirements"]
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in parse_ids(p.rpartition("/")[2], c)]
            yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SPECIFICATION)
