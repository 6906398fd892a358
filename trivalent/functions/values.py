"""Numbers, places, addresses and media types as Column expressions."""

from __future__ import annotations

from urllib.parse import quote, unquote_to_bytes, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def milli_points(points: Column) -> Column:
    """Thousandths of a point, halves to even."""
    return F.bround(points * 1000, 0).cast("long")


def bounding_box(corners: Column) -> Column:
    """ARRAY<left, bottom, right, top> of an array of (x, y) arrays."""
    x, y = F.transform(corners, lambda p: p[0]), F.transform(corners, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0), box[2] - box[0]) * F.greatest(F.lit(0), box[3] - box[1])


def coverage_permyriad(covered: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(10_000).cast("long"), F.floor(covered * 10_000 / total))).otherwise(F.lit(0).cast("long"))


def clamp_confidence(value: Column) -> Column:
    return F.least(F.lit(10_000), F.greatest(F.lit(0), F.bround(value * 10_000, 0).cast("int")))


def crop_box(box: Column, width: Column, height: Column, image_width: Column, image_height: Column, native: Column, padding: int = 8) -> Column:
    """Pixel box of a line: native layouts count from the bottom and scale, OCR boxes are pixels; padded and clamped."""
    scale_x = lambda v: F.floor(v * image_width / F.greatest(F.lit(1), width))
    scale_y = lambda v: F.floor(v * image_height / F.greatest(F.lit(1), height))
    left, right = F.when(native, scale_x(box[0])).otherwise(box[0]), F.when(native, scale_x(box[2])).otherwise(box[2])
    top, bottom = F.when(native, image_height - scale_y(box[3])).otherwise(box[1]), F.when(native, image_height - scale_y(box[1])).otherwise(box[3])
    return F.array(*(x.cast("long") for x in (F.greatest(F.lit(0), left - padding), F.greatest(F.lit(0), top - padding), F.least(image_width, right + padding), F.least(image_height, bottom + padding))))


def duration_seconds(start: Column, end: Column) -> Column:
    """Null unless both are known."""
    return end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")


def media_type_of_header(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split(value, ";")[0])), F.lit(""))


def content_length(value: Column) -> Column:
    """A length header's number, null when it isn't one."""
    return F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("long"))


def media_type_of_prefix(prefix: Column) -> Column:
    """By signature, never by name: a PDF mark within 1024 bytes, an HTML mark within 4096."""
    pdf = F.decode(F.substring(prefix, 1, 1024), "ISO-8859-1").contains("%PDF-")
    html = F.lower(F.decode(F.substring(prefix, 1, 4096), "ISO-8859-1")).rlike(r"<!doctype html|<html[\s>]")
    return F.when(pdf, "application/pdf").when(html, "text/html")


def page_range(value: Column) -> Column:
    """STRUCT<start, stop> of a or a-b; null when malformed or not ascending from 1."""
    start = F.regexp_extract(value, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1)
    stop = F.regexp_extract(value, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2)
    a = start.try_cast("int")
    b = F.when(stop == "", a).otherwise(stop.try_cast("int"))
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("start"), b.alias("stop")))


def canonical_origin(url: Column) -> Column:
    """scheme://host, and the port unless it is the scheme's own; null for other schemes."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1), F.lit(""))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(scheme.isin("http", "https") & host.isNotNull(), F.concat(scheme, F.lit("://"), host, F.when(port.isNotNull() & ~default, F.concat(F.lit(":"), port)).otherwise("")))


def _transport(url: str) -> str | None:
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").lower()
    if scheme not in ("http", "https") or not host:
        return None
    own = port is None or (scheme, port) in (("http", 80), ("https", 443))
    again = lambda x, safe: quote(unquote_to_bytes(x), safe=safe)
    return urlunsplit((scheme, host if own else f"{host}:{port}", again(parts.path or "/", "/:@!$&'()*+,;=-._~"), again(parts.query, "/:@!$&'()*+,;=-._~?"), ""))


@F.pandas_udf(StringType())
def transport_url(values: pd.Series) -> pd.Series:
    """A URL as it is requested: quoted alike, without default port and fragment; null when it can't be."""
    return values.map(_transport, na_action="ignore")


def is_safe_relative(path: Column) -> Column:
    """A relative path without empty, dot and dot-dot parts, backslashes and control characters."""
    parts = F.split(path, "/")
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00-\x1f]") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))
