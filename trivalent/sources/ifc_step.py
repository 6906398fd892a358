"""IFC models in STEP files: facts for the check, from statements read in byte ranges.

Instances are parsed one by one, each in the task that reads it, and relations meet what they name by
joins on (model, instance). No class is silent: whatever carries a global id, and whatever a relation
names, is an entity. Names of positional attributes come from `attributes`, by class; of a class
that it lacks only the attributes that all rooted instances share are known, and open_entities()
names those entities, so that the check doesn't take what it can't see for absent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators.check import FACTS
from trivalent.sources.pieces import statements

# Positional attributes, by kind of class.
ROOT = ("GlobalId", "OwnerHistory", "Name", "Description")
PRODUCT = (*ROOT, "ObjectType", "ObjectPlacement", "Representation")
ELEMENT = (*PRODUCT, "Tag")
TYPED = (*ELEMENT, "PredefinedType")
OPENING = (*ELEMENT, "OverallHeight", "OverallWidth", "PredefinedType")
SPATIAL = (*PRODUCT, "LongName", "CompositionType")
# Classes of elements whose ninth attribute is their predefined type.
TYPED_CLASSES = """WALL WALLSTANDARDCASE SLAB BEAM COLUMN STAIR RAMP RAMPFLIGHT ROOF RAILING COVERING CURTAINWALL PLATE MEMBER FOOTING CHIMNEY SHADINGDEVICE BUILDINGELEMENTPROXY
FURNITURE TRANSPORTELEMENT DISTRIBUTIONCHAMBERELEMENT PIPESEGMENT DUCTSEGMENT CABLESEGMENT PIPEFITTING DUCTFITTING VALVE PUMP FAN BOILER TANK LIGHTFIXTURE OUTLET SANITARYTERMINAL SENSOR ALARM""".split()
ATTRIBUTES = {f"IFC{name}": TYPED for name in TYPED_CLASSES} | {
    "IFCDOOR": (*OPENING, "OperationType", "UserDefinedOperationType"), "IFCWINDOW": (*OPENING, "PartitioningType", "UserDefinedPartitioningType"),
    "IFCSPACE": (*SPATIAL, "PredefinedType", "ElevationWithFlooring"), "IFCBUILDINGSTOREY": (*SPATIAL, "Elevation"), "IFCBUILDING": (*SPATIAL, "ElevationOfRefHeight", "ElevationOfTerrain", "BuildingAddress"), "IFCOPENINGELEMENT": TYPED,
}
# Relations between a whole and its parts, with the places of both.
WHOLES = {"IFCRELAGGREGATES": (4, 5), "IFCRELNESTS": (4, 5), "IFCRELCONTAINEDINSPATIALSTRUCTURE": (5, 4), "IFCRELVOIDSELEMENT": (4, 5), "IFCRELFILLSELEMENT": (4, 5), "IFCRELASSIGNSTOGROUP": (6, 4)}
#: A global id: 22 digits of base 64, of which the first has two bits.
GLOBAL_ID = "^[0-3][0-9A-Za-z_$]{21}$"
TOKEN = re.compile(r"\s+|/\*.*?\*/|'(?:[^']|'')*'|#\d+|[A-Za-z_][A-Za-z0-9_]*|[-+]?\d+\.?\d*(?:[Ee][-+]?\d+)?|\.[A-Za-z0-9_]+\.|\"[0-9A-Fa-f]*\"|[()=,;$*]|.", re.S)
INSTANCE = re.compile(r"(?:\s|/\*.*?\*/)*#(\d+)\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(", re.S)
ARGUMENT = "kind string, value string, number double, refs array<long>"
PARSED = f"model string, id long, class string, args array<struct<{ARGUMENT.replace(' ', ':').replace(',:', ',')}>>"
ARGUMENT_TYPE = pa.struct([("kind", pa.string()), ("value", pa.string()), ("number", pa.float64()), ("refs", pa.list_(pa.int64()))])


def text_of(token: str) -> str:
    """A STEP string's text: doubled quotes, and the X2, X4, X and S escapes."""
    body = token[1:-1].replace("''", "'")
    body = re.sub(r"\\X2\\([0-9A-Fa-f]+)\\X0\\", lambda m: bytes.fromhex(m[1]).decode("utf-16-be"), body)
    body = re.sub(r"\\X4\\([0-9A-Fa-f]+)\\X0\\", lambda m: bytes.fromhex(m[1]).decode("utf-32-be"), body)
    body = re.sub(r"\\X\\([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), body)
    return re.sub(r"\\S\\(.)", lambda m: chr(ord(m[1]) + 128), body).replace("\\\\", "\\")


def arguments(text: str) -> list[dict]:
    """Arguments of an instance, from behind its opening bracket: kind, value and number of single ones, and all references within each."""
    found, depth, now = [], 0, {"kind": None, "value": None, "number": None, "refs": []}
    for match in TOKEN.finditer(text):
        token = match[0]
        if token.isspace() or token.startswith("/*"):
            continue
        if token == "(":
            depth += 1
            now["kind"] = now["kind"] if now["kind"] == "typed" else "list"
        elif token == ")" and depth == 0:
            return [*found, now]
        elif token == ")":
            depth -= 1
        elif token == "," and depth == 0:
            found, now = [*found, now], {"kind": None, "value": None, "number": None, "refs": []}
        elif token[0] == "#":
            now["refs"].append(int(token[1:]))
            now["kind"] = now["kind"] or "ref"
        elif now["kind"] != "list" and token not in (",", "$", "*"):
            if token[0] == "'":
                now |= {"kind": "text", "value": text_of(token)}
            elif token[0] == "." and len(token) > 2:
                now |= {"kind": "enum", "value": token.strip(".")}
            elif re.match(r"[-+]?\d", token):
                now |= {"kind": "number", "value": str(float(token)), "number": float(token)}
            elif token[0].isalpha():
                now["kind"] = "typed"
    return [*found, now]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
            if found := INSTANCE.match(text):
                rows.append((file.rpartition("/")[2], int(found[1]), found[2].upper(), arguments(text[found.end() :])))
            elif schema := re.search(r"FILE_SCHEMA\s*\(\s*\(\s*'([^']+)'", text):
                rows.append((file.rpartition("/")[2], 0, "", [{"kind": "text", "value": schema[1].upper(), "number": None, "refs": []}]))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(ARGUMENT_TYPE))], ["model", "id", "class", "args"])


def instances(spark: SparkSession, path: str) -> DataFrame:
    """model, id, class, args of every instance below path; a model's schema is the text of its instance 0."""
    return statements(spark, path).select("file", "text").mapInArrow(_parsed, PARSED)


def _names(attributes: dict[str, tuple[str, ...]]) -> Column:
    """The attribute names of a class as an array; of one that isn't listed those of ROOT."""
    lists = {}
    for name, own in attributes.items():
        lists.setdefault(own, []).append(name)
    names = F.array(*map(F.lit, ROOT))
    for own, classes in lists.items():
        names = F.when(F.col("class").isin(classes), F.array(*map(F.lit, own))).otherwise(names)
    return names


def _rooted() -> Column:
    return F.coalesce((F.col("args")[0]["kind"] == "text") & F.col("args")[0]["value"].rlike(GLOBAL_ID), F.lit(False))


def _relations(read: DataFrame, classes: list[str]) -> DataFrame:
    return read.where(F.col("class").isin(classes))


def facts_of(read: DataFrame, attributes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Facts from instances; a model's own row (kind model, entity 0) has its schema as value.

    Entities: instances with a global id, and instances that a relation to properties, a
    classification, a material or a whole names as related. Properties of a set are its single values, of types those
    of the types' sets, where the instance has no property of the same set and name itself.
    """
    known = ATTRIBUTES if attributes is None else attributes
    fact = lambda df, kind, scope, name, value, number=None: df.select("model", F.col("entity_id"), F.lit(kind).alias("kind"), *((x if isinstance(x, Column) else F.lit(x).cast("string")).alias(n) for x, n in ((scope, "scope"), (name, "name"))), F.lit(None).cast("string").alias("data_type"), value.alias("value"), (number if number is not None else F.lit(None).cast("double")).alias("number"))
    arg = lambda i: F.col("args")[i]
    single = lambda a: (F.when(a["kind"].isin("text", "enum", "number"), a["value"]), F.when(a["kind"] == "number", a["number"]))
    ids = read.select("model", F.col("id").alias("entity_id"), "class")

    whole = [_relations(read, [name]).select("model", "class", arg(w)["refs"][0].alias("whole"), F.explode(arg(p)["refs"]).alias("entity_id")) for name, (w, p) in WHOLES.items()]
    parts = whole[0]
    for more in whole[1:]:
        parts = parts.unionByName(more)
    defined = _relations(read, ["IFCRELDEFINESBYPROPERTIES"]).select("model", F.explode(arg(4)["refs"]).alias("entity_id"), F.explode(arg(5)["refs"]).alias("set"))
    typed = _relations(read, ["IFCRELDEFINESBYTYPE"]).select("model", F.explode(arg(4)["refs"]).alias("entity_id"), arg(5)["refs"][0].alias("type"))
    labelled = _relations(read, ["IFCRELASSOCIATESCLASSIFICATION"]).select("model", F.explode(arg(4)["refs"]).alias("entity_id"), arg(5)["refs"][0].alias("reference"))
    made_of = _relations(read, ["IFCRELASSOCIATESMATERIAL"]).select("model", F.explode(arg(4)["refs"]).alias("entity_id"), arg(5)["refs"][0].alias("material"))

    related = [df.select("model", "entity_id") for df in (parts, defined, typed, labelled, made_of)]
    named = related[0]
    for more in related[1:]:
        named = named.unionByName(more)
    rooted = read.where(_rooted())
    entities = rooted.select("model", F.col("id").alias("entity_id")).unionByName(named).distinct().join(ids, ["model", "entity_id"])

    values = rooted.select("model", F.col("id").alias("entity_id"), "class", F.posexplode(F.arrays_zip(_names(known).alias("name"), F.slice("args", 1, F.size(_names(known))).alias("arg"))).alias("at", "pair")).where("pair.name is not null and pair.arg is not null")
    values = values.where(~F.col("pair.name").isin("OwnerHistory", "ObjectPlacement", "Representation"))
    text, number = single(F.col("pair.arg"))
    kinds = values.where("pair.name = 'PredefinedType'").select("model", "entity_id", text.alias("type"))
    entity_facts = fact(entities.join(kinds, ["model", "entity_id"], "left"), "entity", None, F.col("class"), F.col("type"))

    sets = _relations(read, ["IFCPROPERTYSET"]).select("model", F.col("id").alias("set"), arg(2)["value"].alias("set_name"), F.explode(arg(4)["refs"]).alias("property"))
    quantity = F.when(F.col("class") == "IFCPROPERTYSINGLEVALUE", arg(2)).otherwise(arg(3))
    single_values = read.where("class = 'IFCPROPERTYSINGLEVALUE' or class rlike '^IFCQUANTITY(LENGTH|AREA|VOLUME|COUNT|WEIGHT|TIME)$'").select("model", F.col("id").alias("property"), arg(0)["value"].alias("property_name"), single(quantity)[0].alias("value"), single(quantity)[1].alias("number"))
    amounts = _relations(read, ["IFCELEMENTQUANTITY"]).select("model", F.col("id").alias("set"), arg(2)["value"].alias("set_name"), F.explode(arg(5)["refs"]).alias("property"))
    contents = sets.unionByName(amounts).join(single_values, ["model", "property"])
    own = defined.join(contents, ["model", "set"]).select("model", "entity_id", "set_name", "property_name", "value", "number")
    of_types = read.where("class rlike 'TYPE$|STYLE$'").select("model", F.col("id").alias("type"), F.explode(arg(5)["refs"]).alias("set"))
    inherited = typed.join(of_types, ["model", "type"]).join(contents, ["model", "set"]).select("model", "entity_id", "set_name", "property_name", "value", "number")
    inherited = inherited.join(own.select("model", "entity_id", "set_name", "property_name").distinct(), ["model", "entity_id", "set_name", "property_name"], "left_anti")
    properties = own.unionByName(inherited)

    systems = _relations(read, ["IFCCLASSIFICATION"]).select("model", F.col("id").alias("system"), arg(3)["value"].alias("system_name"))
    references = _relations(read, ["IFCCLASSIFICATIONREFERENCE"]).select("model", F.col("id").alias("reference"), arg(1)["value"].alias("code"), arg(3)["refs"][0].alias("system")).join(systems, ["model", "system"], "left")
    materials = _relations(read, ["IFCMATERIAL"]).select("model", F.col("id").alias("material"), arg(0)["value"].alias("material_name"))
    wholes = parts.join(ids.select("model", F.col("entity_id").alias("whole"), F.col("class").alias("whole_class")), ["model", "whole"], "left")

    found = [
        fact(read.where("id = 0").select("model", F.lit(0).cast("long").alias("entity_id"), "args"), "model", None, None, arg(0)["value"]),
        entity_facts,
        fact(values, "attribute", None, F.col("pair.name"), text, number),
        fact(properties, "property", F.col("set_name"), F.col("property_name"), F.col("value"), F.col("number")),
        fact(labelled.join(references, ["model", "reference"]), "classification", F.col("system_name"), None, F.col("code")),
        fact(made_of.join(materials, ["model", "material"]), "material", None, None, F.col("material_name")),
        fact(wholes, "part_of", F.col("class"), F.col("whole_class"), F.lit(None).cast("string")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*(f.split()[0] for f in FACTS.split(", ")))


def open_entities(facts: DataFrame, attributes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """model, entity_id of entities whose class isn't in the table of attributes: they may have attributes that no fact tells."""
    known = list(ATTRIBUTES if attributes is None else attributes)
    return facts.where((F.col("kind") == "entity") & ~F.col("name").isin(known)).select("model", "entity_id").distinct()


def read_ifc(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all models below path."""
    return facts_of(instances(spark, path))


def schemas(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'model'").select("model", F.col("value").alias("ifc_schema"))
