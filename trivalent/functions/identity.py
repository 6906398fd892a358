"""Content identities: canonical JSON and its hash, and keys derived from content.

What Spark's functions can't do are plain functions of one value: their workers hold a hundred
values at a time whatever the table's size, and no pandas.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical(value: object) -> str:
    """Sorted keys, two spaces, non-ASCII as it is, a line feed at the end; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def parse_object(text: str) -> dict:
    """A JSON object; repeated keys and other roots are refused."""

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    value = json.loads(text, object_pairs_hook=unique)
    if not isinstance(value, dict):
        raise ValueError("the root is not an object")
    return value


@F.udf(StringType(), useArrow=False)
def canonical_json(text: str | None) -> str | None:
    """Canonical form of a JSON object's text. Spark's to_json keeps insertion order, and VARIANT rewrites numbers."""
    return None if text is None else canonical(parse_object(text))


@F.udf(StringType(), useArrow=False)
def json_sha256(text: str | None) -> str | None:
    return None if text is None else hashlib.sha256(canonical(parse_object(text)).encode()).hexdigest()


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def page_id(source_sha256: Column, page: Column) -> Column:
    return F.format_string("sha256:%s:page:%06d", source_sha256, page)


def page_of_id(identifier: Column) -> Column:
    """The page number in a page's or span's identifier."""
    return F.nullif(F.regexp_extract(identifier, r":page:(\d{6})(?::|$)", 1), F.lit("")).cast("int")


def candidate_key(prefix: str, document: Column, record: Column, rule: Column, extraction: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u0000", document, record, rule, extraction), 256))


def document_key_parts(key: Column) -> Column:
    """STRUCT<volume, edition> of keys like volume-10-edition-5."""
    part = lambda n: F.nullif(F.regexp_extract(key, r"volume-(\d+)-edition-(\d+)", n), F.lit("")).cast("int")
    return F.struct(part(1).alias("volume"), part(2).alias("edition"))


def is_machine_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z0-9][a-z0-9._:-]*$"), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


@F.udf(StringType(), useArrow=False)
def json_object_error(text: str | None) -> str | None:
    """Why a text isn't one JSON object without repeated keys; null if it is."""
    try:
        if text is not None:
            parse_object(text)
    except ValueError as error:
        return str(error)
    return None
