"""Page measures: routing, thresholds, repeated lines, markup to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of page routing (characters, and ten-thousandths of the page).
TEXT_LEAST, IMAGE_LEAST, MIXED_LEAST, BLANK_INK = 20, 8000, 1000, 30


def route(chars: Column, bitmap: Column, ink: Column) -> Column:
    """STRUCT<classification, route, state> of a page by its text, its bitmaps' share and its ink."""
    out = lambda a, b, c: F.struct(F.lit(a).alias("classification"), F.lit(b).alias("route"), F.lit(c).alias("state"))
    empty = chars == 0
    return (
        F.when(empty & (bitmap >= IMAGE_LEAST), out("image_scan", "ocr", "ready"))
        .when(empty & (ink <= BLANK_INK), out("blank", "none", "ready"))
        .when(empty, out("degraded_photo", "ocr", "needs_review"))
        .when(chars < TEXT_LEAST, out("suspect_native", "native_plus_ocr", "needs_review"))
        .when(bitmap >= MIXED_LEAST, out("mixed", "native_plus_ocr", "ready"))
        .otherwise(out("native_text", "native", "ready"))
    )


def otsu(histogram: DataFrame, level: str, count: str) -> DataFrame:
    """threshold: the level that parts a histogram into two classes of greatest variance between them; the least of equals.

    The histogram holds one row per grey level, so its single window is of fixed size whatever it counts.
    """
    up = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col(level) * F.col(count)
    w = histogram.select(level, F.sum(count).over(up).alias("n0"), F.sum(mass).over(up).alias("m0"), F.sum(count).over(all_).alias("n"), F.sum(mass).over(all_).alias("m"))
    between = (F.col("m") * F.col("n0") - F.col("m0") * F.col("n")).cast("double") ** 2 / (F.col("n0") * (F.col("n") - F.col("n0"))).cast("double")
    scored = w.where("n0 < n").select(F.col(level).alias("threshold"), between.alias("between"))
    return scored.orderBy(F.desc("between"), "threshold").limit(1).select("threshold")


def lines_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (from 0), line."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))


def repeated_lines(lines: DataFrame, key: str, least: int) -> DataFrame:
    """line, n_keys: lines that stand in at least `least` different documents or files."""
    return lines.where(F.trim("line") != "").select("line", key).distinct().groupBy("line").agg(F.count("*").alias("n_keys")).where(F.col("n_keys") >= least)


def html_text(html: Column) -> Column:
    """Readable text of markup: no scripts, styles, comments and tags, entities of the five basic marks resolved, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(bare, "<[^>]*>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
