"""Findings of the third round, each by a case that failed before."""

import hashlib

import duckdb

from trivalent.functions import identity, text
from trivalent.operators import trees
from trivalent.queries import catalog


def rows_of(frame):
    return sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


def oracle(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    return sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall())


def test_references_cut_short(spark, tmp_path):
    html = '<a href="/x?a=1&amp;b">one &amp;&amp;&amp</a> <a href="/y">&copy; &lt; &amp;lt; &unknown; &#39;</a><a href="/z">open &am<p>more &amp'
    spark.createDataFrame([(i, html, "u") for i in (1, 5, 7)], "page_id long, html string, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(catalog.QUERIES["page_links"](spark, str(tmp_path)))
    assert got and got == oracle("page_links", tmp_path, "pages")
    assert ("/x?a=1&b", "one &&&amp", 1, 1) in got


def test_graph_audit_is_read_from_parts(spark):
    plan = catalog.QUERIES["audit_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Exchange" not in plan and "Join" not in plan


def test_walk_writes_what_moves(spark, monkeypatch):
    counts = []

    def counted(df):
        counts.append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(trees, "written", counted)
    rows = [(f"r{i}", None) for i in range(50)] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(8)]
    found = {r.node: (r.root, r.depth, r.state) for r in trees.walked(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert len(found) == 58 and all(found[f"n{i}"] == ("n0", i + 1, "rooted") for i in range(8))
    assert counts == [58, 7, 6, 4]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sidecars_hold_few_values_at_a_time(spark):
    plan = plan_of(catalog.QUERIES["sidecar_faults"](spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    made = spark.createDataFrame([('{"b": 1.0, "a": "é"}',), (None,)], "t string").select(identity.canonical_json("t"), identity.json_sha256("t"), identity.json_object_error("t")).collect()
    want = '{\n  "a": "é",\n  "b": 1.0\n}\n'
    assert tuple(made[0]) == (want, hashlib.sha256(want.encode()).hexdigest(), None) and tuple(made[1]) == (None, None, None)


def test_texts_hold_few_values_at_a_time(spark):
    plan = plan_of(catalog.QUERIES["normalize_text"](spark, "/root/testdata/sf0.001"))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    rows = spark.createDataFrame([("ﻻ é ﭐ",), ("plain é ﷻ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.presentation_nfkc(rows["t"])).collect()] == ["لا é ٱ", "plain é جل جلاله", "", None]
