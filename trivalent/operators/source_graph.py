"""Audit of source graphs: every way in which nodes, pages, records and source lines of a document may disagree, as rows.

All checks are joins on (document, name) or aggregates; lists of children, spans and page members are
opened into rows first, so that no document is held as one value. The cycle search walks only
documents that have an edge against their order: a parent that doesn't stand before its child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.operators.trees import walked
from trivalent.plans.lineage import gathered, written


def _rows(rows: DataFrame, breach: str, item: str) -> DataFrame:
    return rows.select("document", F.lit(breach).alias("breach"), F.col(item).cast("string").alias("item"))


def _cases(rows: DataFrame, cases: dict[str, tuple[Column, str]]) -> DataFrame:
    """Several breaches of the same rows, in one pass; cases: breach to its rule and item."""
    told = [F.when(rule, F.struct(F.lit(breach).alias("breach"), F.col(item).cast("string").alias("item"))) for breach, (rule, item) in cases.items()]
    return rows.select("document", F.inline(F.array_compact(F.array(*told))))


def _anti(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    return rows.join(others.select(*keys).distinct(), list(keys), "left_anti")


def audit_nodes(nodes: DataFrame) -> list[DataFrame]:
    """Order, parents, children and cycles of nodes (document, node, place, parent, children)."""
    ids = nodes.groupBy("document", "node").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min("parent").alias("parent"))
    numbered = nodes.withColumn("_at", F.row_number().over(Window.partitionBy("document").orderBy("place", "node")))
    down = nodes.select("document", "node", F.explode("children").alias("child")).distinct()
    child = down.join(ids.select("document", F.col("node").alias("child"), F.col("parent").alias("_parent"), F.lit(True).alias("_known")), ["document", "child"], "left")
    up = ids.where("parent is not null").select("document", "node", "place", "parent").join(ids.select("document", F.col("node").alias("parent"), F.col("place").alias("_above")), ["document", "parent"], "left")
    listed = up.join(down.select("document", F.col("node").alias("parent"), F.col("child").alias("node"), F.lit(True).alias("_listed")), ["document", "parent", "node"], "left")
    odd = up.where("_above >= place").select("document").distinct()
    name = lambda column: F.concat_ws("\x1f", F.col("document").cast("string"), F.col(column))
    held = ids.join(odd, "document", "left_semi")
    walk = walked(held.select(name("node").alias("node"), F.when(F.col("parent").isNotNull(), name("parent")).alias("parent"))).where("state = 'cycle'")
    cyclic = held.withColumn("_name", name("node")).join(walk.select(F.col("node").alias("_name")), "_name", "left_semi")
    return [
        _rows(ids.where("n > 1"), "REPEATED_NODE", "node"),
        _rows(numbered.where("place is null or place <> _at"), "ORDER", "node"),
        _cases(listed, {"ORPHAN": (F.expr("_above is null"), "node"), "PARENT_NOT_RECIPROCAL": (F.expr("_above is not null and _listed is null"), "node")}),
        _cases(child, {"UNKNOWN_CHILD": (F.expr("_known is null"), "child"), "CHILD_NOT_RECIPROCAL": (F.expr("_known and not (_parent <=> node)"), "child")}),
        _rows(cyclic, "CYCLE", "node"),
    ]


def audit_pages(nodes: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """Membership: pages (document, page, members) list just their own nodes (document, node, page, place), in order, each once."""
    members = pages.select("document", "page", F.posexplode("members").alias("_at", "node"))
    own = nodes.select("document", "node", F.col("page").alias("own_page"), "place")
    on_pages = members.groupBy("document", "node").agg(F.count_distinct("page").alias("pages"))
    once = members.groupBy("document", "page", "node").agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    placed = own.join(once.select("document", "node", F.col("page").alias("own_page"), "_at"), ["document", "node", "own_page"], "left")
    in_order = Window.partitionBy("document", "own_page").orderBy("place", "node")
    turned = placed.where("_at is not null").withColumn("_before", F.lag("_at").over(in_order))
    strangers = _anti(once, own, "document", "node")
    return [
        _rows(pages.groupBy("document", "page").agg(F.count("*").alias("n")).where("n > 1"), "REPEATED_PAGE", "page"),
        _rows(once.where("n > 1"), "PAGE_REPEATS_NODE", "node"),
        _rows(strangers, "PAGE_UNKNOWN_NODE", "node"),
        _rows(placed.where("_at is null"), "NOT_ON_ITS_PAGE", "node"),
        _rows(on_pages.where("pages > 1"), "ON_SEVERAL_PAGES", "node"),
        _rows(turned.where("_before > _at"), "PAGE_ORDER", "node"),
    ]


def audit_spans(nodes: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """Source cover: every canonical line (document, page, span, text) that isn't blank belongs to one node of its page (spans, text), and a node of one span has its text."""
    anchors = nodes.select("document", "node", "page", "text", F.size("spans").alias("_spans"), F.explode("spans").alias("span"))
    uses = anchors.groupBy("document", "span").agg(F.count("*").alias("n"))
    source = lines.select("document", "page", "span", F.col("text").alias("_text"))
    met = anchors.join(source, ["document", "page", "span"], "left")
    return [
        _rows(nodes.where("spans is null or size(spans) = 0"), "NO_SPAN", "node"),
        _rows(uses.where("n > 1"), "SPAN_TWICE", "span"),
        _cases(met, {"UNKNOWN_SPAN": (F.expr("_text is null"), "span"), "CONTENT_DIFFERS": (F.expr("_spans = 1 and _text <> text"), "node")}),
        _rows(_anti(lines.where("not blank"), anchors, "document", "span"), "UNCOVERED", "span"),
    ]


def audit_records(records: DataFrame, listed: DataFrame) -> list[DataFrame]:
    """Records (document, collection, record, page) and what pages list (the same columns) agree both ways, and no record repeats."""
    keys = ("document", "collection", "record", "page")
    repeated = records.groupBy("document", "collection", "record").agg(F.count("*").alias("n")).where("n > 1")
    return [
        _rows(repeated, "REPEATED_RECORD", "record"),
        _rows(_anti(records.select(*keys).distinct(), listed, *keys), "RECORD_NOT_LISTED", "record"),
        _rows(_anti(listed.select(*keys).distinct(), records, *keys), "LISTED_WITHOUT_RECORD", "record"),
    ]


def audit_graph(nodes: DataFrame, pages: DataFrame, lines: DataFrame, records: DataFrame, listed: DataFrame) -> DataFrame:
    """document, breach, item of everything that is wrong; no rows: the graphs are valid.

    nodes: document, node, page, place (from 1), parent, children, spans, text. pages: document,
    page, members (nodes in order). lines: document, page, span, text. records and listed: document, collection,
    record, page. Null lists are empty; names are strings, places and pages numbers. All are written
    once, texts as digests, since each of the checks reads a few of their columns; each check is a plan of its own.
    """
    nodes, lines = written(nodes.withColumn("text", F.md5("text"))), written(lines.select("document", "page", "span", F.md5("text").alias("text"), (F.trim("text") == "").alias("blank")))
    pages, records, listed = written(pages), written(records), written(listed)
    return gathered([*audit_nodes(nodes), *audit_pages(nodes, pages), *audit_spans(nodes, lines), *audit_records(records, listed)])

