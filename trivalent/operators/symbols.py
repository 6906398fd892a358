"""Symbols that a page's lines hold: equations, design methods and units, named in the order in which they are met; critical tokens and printed page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of equations, names of design methods, spellings of units, what a printed page number consists of.
EQUATION = "[=≤≥≠≈±×÷√∑∫^²³₀-₉]"
METHOD = "(?<![A-Za-z])(LRFD|ASD)(?![A-Za-z])"
UNIT = "(?U)(?<!\\w)(?:mm|cm|m|m2|m3|kN|N|MPa|Pa|kg|s|Hz|°C)(?!\\w)|(?:میلی[‌ ]?متر|سانتی[‌ ]?متر|کیلو[‌ ]?نیوتن|مگاپاسکال|متر(?:مربع|مکعب)?)"
PAGE_NUMBER = "(?U)^[\\s\\-–—()\\[\\]۰-۹٠-٩0-9ivxlcdmIVXLCDM]{1,24}$"


def is_critical(token: Column) -> Column:
    """Whether a token's reading matters: it has a digit of any script or a mark of an equation."""
    return F.coalesce(token.rlike("(?U)\\d") | token.rlike(EQUATION), F.lit(False))


def candidates(lines: DataFrame) -> DataFrame:
    """page, candidate_id, kind, source, span, text of every symbol of lines (page, source, place, span, text).

    Within a page native lines come before recognised ones, within a line its equation (the whole line, once) before methods before
    units. Equations are numbered among themselves, methods and units among all candidates of the page, so that numbers
    of one kind may have gaps. Null texts hold nothing.
    """
    found = lambda kind, pattern, group: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    equation = F.when(F.col("text").rlike(EQUATION), F.array(F.struct(F.lit("equation").alias("kind"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    each = F.concat(equation, found("method_abbreviation", METHOD, 1), found("unit_mention", UNIT, 0))
    met = lines.where("text is not null").select("page", "source", "place", "span", F.posexplode(each).alias("at", "c")).select("page", "source", "place", "span", "at", "c.kind", "c.text")
    order = Window.partitionBy("page").orderBy(F.when(F.col("source") == "native", 0).otherwise(1), "place", "at")
    before = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, -1))
    equations = F.coalesce(F.sum((F.col("kind") == "equation").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    word = F.when(F.col("kind") == "method_abbreviation", "abbreviation").when(F.col("kind") == "unit_mention", "unit").otherwise("equation")
    number = F.when(F.col("kind") == "equation", equations).otherwise(before)
    return met.withColumn("candidate_id", F.format_string("%s:%s:%04d", F.col("page").cast("string"), word, number.cast("int"))).select("page", "candidate_id", "kind", "source", "span", "text")


def page_number(native: Column, recognised: Column) -> Column:
    """The first of a page's first two and last two lines (native before recognised ones) that looks like a printed page number, trimmed; null without one."""
    lines = F.concat(F.coalesce(native, F.array().cast("array<string>")), F.coalesce(recognised, F.array().cast("array<string>")))
    ends = F.transform(F.concat(F.slice(lines, 1, 2), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 1), 2)), lambda x: F.regexp_replace(x, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", ""))
    fits = F.filter(ends, lambda x: (x != "") & x.rlike(PAGE_NUMBER))
    return F.when(F.size(fits) > 0, fits[0])
