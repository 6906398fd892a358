"""Anchoring of records to source lines, and forward-only alignment of two readings of a page.

record_anchors finds where a record's own lines stand, once and contiguous, among the lines of
its own pages. Every range of pages gets prefix hashes of its normalised lines (a cyclic
polynomial: line hashes turned by their place and folded by exclusive or), so that the hash of a run
of any width is two prefixes folded and turned back. Runs of the widths that are asked for meet
the records by an equi-join on (document, pages, width, hash) and are then compared line by line (by a second hash).
Work is in the lines of a range times its distinct widths, never records times lines.

greedy_alignment links each canonical line to the next alternate line of the same text behind
the last link. Each text's places are known beforehand, so a step is a search in one list, not a
scan; lines stream in order through a task, whose state is one pair of readings.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import normalize_search_text
from trivalent.plans.lineage import written

#: What ends a line of a record's text.
LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"


def searchable(line: Column) -> Column:
    return F.trim(normalize_search_text(line))


def _turned(hash_: str, by: str) -> Column:
    """A 64-bit hash turned left by `by` modulo 64 bits."""
    n = f"cast(pmod({by}, 64) as int)"
    return F.expr(f"shiftleft({hash_}, {n}) | shiftrightunsigned({hash_}, 64 - {n})")


def _text_lines(text: Column, normalize: Callable[[Column], Column]) -> Column:
    """The text's lines that aren't blank, normalised; the text goes through `normalize` as a whole, which leaves line feeds alone."""
    whole = F.split(normalize(F.regexp_replace(text, LINE_END, "\n")), "\n")
    return F.filter(F.transform(whole, lambda x: F.trim(x)), lambda x: x != "")


def record_anchors(records: DataFrame, nodes: DataFrame, normalize: Callable[[Column], Column] = searchable) -> DataFrame:
    """document, record, status, reason, matches, spans, exact_sha256 of every record.

    records: document, record (unique within a document), pages (array), text, spans (array of
    spans that the record claims already, null or empty: none). nodes: document, page, place
    (order within the document), span, line.

    Statuses: anchored (one run of lines is the record's text), ambiguous (several are), unmatched,
    already_anchored (the claimed spans are a run with the record's text), invalid_existing_anchor.
    Cases: null pages or a null among them (invalid_source_page_ids), pages that no node stands on
    (unknown_source_page), null among the claimed spans, null and blank texts (missing_text); blank lines of
    a record don't count, blank lines of the source do, so a run doesn't cross them; empty tables give no rows.
    """
    valid = F.expr("pages is not null and forall(pages, p -> p is not null)")
    lines = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("d"))))
    own = records.withColumn("_lines", _text_lines(F.col("text"), normalize)).select("document", "record", "pages", "spans", valid.alias("valid"), F.when(valid, F.concat_ws(",", F.transform(F.array_sort(F.array_distinct("pages")), lambda p: p.cast("string")))).alias("range"), lines.alias("lines"))
    own = written(own.withColumn("width", F.size("lines")))

    # Lines go on as two hashes, one to meet by and one to be compared by; texts come back for what was found.
    ranges = own.where("valid").select("document", "range", "pages").dropDuplicates(["document", "range"])
    asked = ranges.select("document", "range", F.explode(F.array_distinct("pages")).alias("page"))
    norm = normalize(F.col("line"))
    bare = nodes.select("document", "page", "place", "span", F.xxhash64(norm).alias("h"), F.xxhash64(norm, F.lit(1)).alias("d"), (norm == "").alias("blank"))
    there = nodes.select("document", "page").distinct()
    unknown = asked.join(there, ["document", "page"], "left_anti").select("document", "range").distinct().withColumn("unknown", F.lit(True))
    by_place = Window.partitionBy("document", "range").orderBy("place", "span")
    lined = asked.join(bare, ["document", "page"]).withColumn("at", F.row_number().over(by_place) - 1)
    lined = lined.withColumn("upto", F.bit_xor(_turned("h", "at")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    lined = written(lined.withColumn("before", F.lag("upto", 1, 0).over(by_place)).select("document", "range", "at", "place", "span", "d", "blank", "upto", "before"))

    # Runs of every width that a record without claimed spans asks for.
    fresh = own.where("valid and coalesce(size(spans), 0) <= 0 and width > 0")
    widths = fresh.select("document", "range", "width").distinct()
    starts = lined.join(widths, ["document", "range"]).select("document", "range", "width", F.col("at").alias("start"), (F.col("at") + F.col("width") - 1).alias("at"), "before")
    runs = starts.join(lined.select("document", "range", "at", "upto"), ["document", "range", "at"]).withColumn("x", F.expr("upto ^ before")).select("document", "range", "width", "start", _turned("x", "-start").alias("hash"))
    hashed = fresh.withColumn("hash", F.expr("aggregate(transform(lines, (x, i) -> shiftleft(x.h, i % 64) | shiftrightunsigned(x.h, 64 - i % 64)), 0L, (a, x) -> a ^ x)"))
    near = hashed.select("document", "record", "range", "width", "hash", "lines").join(runs, ["document", "range", "width", "hash"])
    steps = near.select("document", "record", "range", "width", "start", F.posexplode("lines.d").alias("i", "wanted")).withColumn("at", F.col("start") + F.col("i"))
    compared = steps.join(lined.select("document", "range", "at", "place", "span", "d"), ["document", "range", "at"])
    found = compared.groupBy("document", "record", "start", "width").agg(F.count_if(F.col("d") == F.col("wanted")).alias("same"), F.collect_list(F.struct("i", "place", "span")).alias("run")).where("same = width")
    found = found.groupBy("document", "record").agg(F.count("*").alias("matches"), F.min_by("run", "start").alias("run"))

    # Claimed spans: on the record's pages, a run, of the record's text.
    claimed = own.where("valid and size(spans) > 0")
    held = claimed.select("document", "record", "range", F.posexplode("spans").alias("i", "span")).join(lined.select("document", "range", "span", "at", "place", "d", "blank"), ["document", "range", "span"])
    held = held.groupBy("document", "record").agg(F.count("*").alias("on_pages"), (F.count_distinct(F.expr("at - i")) == 1).alias("runs"), F.array_sort(F.collect_list(F.struct("i", "place", "span", "d", "blank"))).alias("claimed"))

    joined = own.join(unknown, ["document", "range"], "left").join(found, ["document", "record"], "left").join(held, ["document", "record"], "left")
    claims, odd_claims = F.expr("coalesce(size(spans), 0) > 0"), F.expr("exists(spans, s -> s is null)")
    same_text = F.expr("transform(filter(claimed, c -> not c.blank), c -> c.d) = coalesce(lines.d, cast(array() as array<bigint>))")
    reason = (
        F.when(~F.col("valid"), "invalid_source_page_ids").when(F.col("unknown"), "unknown_source_page").when(odd_claims, "invalid_source_span_ids")
        .when(claims & ~F.expr("coalesce(on_pages, 0) = size(spans)"), "span_not_on_source_page").when(claims & ~(F.col("runs") & same_text), "existing_spans_do_not_match_record_text").when(claims, None)
        .when(F.col("lines").isNull(), "missing_text").when(F.col("matches").isNull(), "no_exact_contiguous_match").when(F.col("matches") > 1, "multiple_exact_matches")
    )
    joined = joined.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("invalid_source_span_ids", "span_not_on_source_page", "existing_spans_do_not_match_record_text"), "invalid_existing_anchor").when(F.col("reason") == "multiple_exact_matches", "ambiguous").when(F.col("reason").isNotNull(), "unmatched").when(claims, "already_anchored").otherwise("anchored")
    bare_run = lambda column: F.expr(f"transform(array_sort({column}), c -> struct(c.place, c.span))")
    run = F.when(F.col("reason").isNull(), F.when(claims, bare_run("claimed")).otherwise(bare_run("run")))
    judged = joined.select("document", "record", status.alias("status"), "reason", F.coalesce("matches", F.lit(0)).alias("matches"), run.alias("run"))
    judged = written(judged)
    # Source texts, once a document, meet all its records' runs.
    texts = nodes.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("place", "span"), "line"))).alias("texts"))
    told = judged.where("run is not null").join(texts, "document").select("document", "record", "status", "reason", "matches", F.col("run.span").alias("spans"), F.sha2(F.array_join(F.transform("run", lambda r: F.col("texts")[r]), "\n"), 256).alias("exact_sha256"))
    untold = judged.where("run is null").select("document", "record", "status", "reason", "matches", F.lit(None).cast("array<string>").alias("spans"), F.lit(None).cast("string").alias("exact_sha256"))
    return told.unionByName(untold)


def greedy_alignment(canonical: DataFrame, alternate: DataFrame, key: str, place: str, line: str, normalize: Callable[[Column], Column] = searchable) -> DataFrame:
    """key, place, other: each canonical line with the place of its alternate line, null without one.

    A link goes to the first alternate line of equal normalised text behind the last link; a line
    without one leaves the cursor where it is. Places are unique within a key. Lines of a key without
    alternate lines link with nothing; alternate lines without canonical ones give no rows.
    """
    rows = alternate.select(key, F.lit(0).alias("side"), F.col(place).cast("long").alias("at"), normalize(F.col(line)).alias("norm")).unionByName(canonical.select(key, F.lit(1).alias("side"), F.col(place).cast("long").alias("at"), normalize(F.col(line)).alias("norm")))
    # Texts shrink to hashes before the shuffle; two hashes keep different lines apart.
    rows = rows.select(F.col(key).cast("string").alias("key"), "side", "at", F.xxhash64("norm").alias("a"), F.xxhash64("norm", F.lit(1)).alias("b"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, places, cursor = None, {}, None
        for batch in batches:
            keys, ats, others = [], [], []
            for name, side, at, *text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != current:
                    current, places, cursor = name, {}, None
                if side == 0:
                    places.setdefault(tuple(text), []).append(at)
                    continue
                known = places.get(tuple(text), [])
                n = 0 if cursor is None else bisect_left(known, cursor + 1)
                if n < len(known):
                    cursor = known[n]
                keys.append(name), ats.append(at), others.append(known[n] if n < len(known) else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ats, pa.int64()), pa.array(others, pa.int64())], ["key", "at", "other"])

    made = rows.repartition("key").sortWithinPartitions("key", "side", "at").mapInArrow(linked, "key string, at long, other long")
    return made.select(F.col("key").cast(canonical.schema[key].dataType).alias(key), F.col("at").alias(place), "other")
