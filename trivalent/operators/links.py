"""Anchors of pages as a state machine over tokens: an anchor is open from its start tag to its end tag, the next start tag or the page's end.

The state is two running counts over a page's tokens, so the machine runs as windows in the JVM: the
number of anchors opened so far names the anchor that a text may belong to, and the number of ends
since it opened tells whether it is still open. A page of any length spills; no list of its tokens is held.
"""

from __future__ import annotations

import html as entities
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Comments and declarations, scripts and styles as wholes, tags (with > inside quotes), texts, and a lone <.
TOKENS = r"""(?s)<!--.*?-->|<[!?][^>]*>|(?i:<(script|style)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|$))|</?[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
HREF = r"""(?i)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*)"""
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: A character reference that its semicolon ends.
ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Character references as characters, as browsers read them."""
    return values.map(entities.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def unescaped_ended(values: pd.Series) -> pd.Series:
    """Character references that have their semicolon as characters; one cut short stays as it is written."""
    one = lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return values.map(lambda x: ENDED.sub(one, x), na_action="ignore")


def page_links(pages: DataFrame, key: str, html: str, schemes: tuple[str, ...] | None = ("http", "https"), unended: bool = True) -> DataFrame:
    """key, place (of the anchor within its page, from 1 over all anchors), href, label; the last href of a tag counts, labels have single blanks.

    schemes: those that a link may have; None keeps all. Anchors without href are none, but end an open one. Null and
    empty pages give no rows; scripts and styles within an anchor are part of its label, as text, comments aren't.
    unended: whether references without their semicolon are read, too, as browsers do.
    """
    characters = unescaped if unended else unescaped_ended
    tokens = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0))).alias("at", "token"))
    starts, ends = F.col("token").rlike(r"(?i)^<a(?=[\s/>])"), F.col("token").rlike(r"(?i)^</a(?=[\s/>])")
    raw = F.col("token").rlike(r"(?i)^<(script|style)\b")
    inner = F.regexp_replace(F.regexp_replace("token", r"(?is)^<(script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", ""), r"(?is)</(script|style)\s*>$", "")
    text = F.when(raw, inner).when(~F.col("token").rlike(r"^<[!?/A-Za-z]"), F.col("token"))
    quoted = F.element_at(F.regexp_extract_all("token", F.lit(HREF), F.lit(1)), -1)
    bare = F.regexp_replace(quoted, r"""^["']|["']$""", "")
    # An end is its own tag, or the slash of a start tag that closes itself.
    read = tokens.select(key, "at", starts.cast("int").alias("opens"), (ends | (starts & F.col("token").rlike(r"/>$"))).cast("int").alias("closes"), F.when(starts & (F.regexp_count("token", F.lit(HREF)) > 0), bare).alias("href"), text.alias("text"), raw.alias("raw"))
    read = read.where("opens = 1 or closes = 1 or text is not null")
    in_page = Window.partitionBy(key).orderBy("at")
    placed = read.withColumn("place", F.sum("opens").over(in_page)).where("place > 0")
    in_anchor = Window.partitionBy(key, "place").orderBy("at")
    held = placed.withColumn("ended", F.sum("closes").over(in_anchor)).where("opens = 1 or (ended = 0 and text is not null)")
    held = held.withColumn("text", F.when(F.col("raw"), F.col("text")).otherwise(characters("text")))
    links = held.groupBy(key, "place").agg(F.max("href").alias("href"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"]), "").alias("label"))
    named = links.where("href is not null").select(key, "place", F.regexp_replace(characters("href"), rf"^{BLANKS}|{BLANKS}$".replace("(?U)", ""), "").alias("href"), F.trim(F.regexp_replace("label", BLANKS, " ")).alias("label"))
    return named if schemes is None else named.where(F.lower("href").rlike(f"^({'|'.join(schemes)}):"))
