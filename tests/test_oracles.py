"""Every query with a DuckDB counterpart gives the same columns and rows, as a multiset."""

import glob
import math
import os

import duckdb
import pytest

from trivalent.queries import catalog

SF = "/root/testdata/sf0.01"


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{round(value, 6):.6f}" if math.isfinite(value) else str(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches(spark, duck, name):
    result = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got and got == want


def test_bundles(spark):
    from trivalent.operators.windows import TERMINAL

    want = []
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        lines = (row.text or "").split("\n") if row.text is not None else []
        made, opened, before = [], None, None
        for i, line in enumerate(lines):
            size = len(line.encode()) if line.strip(" ") else None
            if size is None or opened and not (opened[2] < 3 and opened[3] + size <= 400):
                made += [opened] if opened else []
                opened = None
            if size is not None:
                if opened:
                    opened = (opened[0], i, opened[2] + 1, opened[3] + size)
                elif before and before[1] and before[0] + size <= 400:
                    opened = (i - 1, i, 2, before[0] + size)
                else:
                    opened = (i, i, 1, size)
            before = None if size is None else (size, line.rstrip(" ")[-1] not in TERMINAL)
        want += [(row.doc_id, n, *b) for n, b in enumerate([*made, *([opened] if opened else [])])]
    got = [tuple(r) for r in catalog.QUERIES["bundle_pack"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_normalize_text(spark):
    from trivalent.functions.text import normalize_search_text

    rows = spark.createDataFrame([("كتاب  يك \n\n",), ("ﻻ x",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalize_search_text(rows["t"])).collect()] == ["کتاب یک", "لا x", None]
    assert catalog.QUERIES["normalize_text"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
