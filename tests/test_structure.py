"""Trees with orphans and cycles, JSON Lines, rules and observations of odd shapes."""

import pytest
from pyspark.sql import functions as F

from trivalent.operators import ledger, rule_ir, transcripts, trees
from trivalent.sources.jsonl import read_jsonl


def test_walk(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    rows = [*chain, ("lost", "nowhere"), ("below", "lost"), ("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("self", "self")]
    got = {r.node: (r.root, r.depth, r.state) for r in trees.walked(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert all(got[f"n{i}"] == ("n0", i + 1, "rooted") for i in range(40))
    assert got["lost"] == ("lost", 1, "orphan") and got["below"] == ("lost", 2, "orphan")
    assert all(got[n] == (None, None, "cycle") for n in ("a", "b", "c", "into", "self"))
    assert trees.walked(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_parents_of_labels(spark):
    depths = [2, 1, 3, None, 2, 9, 12, None, 1, None]
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate(depths)] + [(2, 0, None)], "k int, n int, d int")
    got = {(r.k, r.n): r.parent for r in trees.parents(rows, "k", "n", F.col("d")).collect()}
    assert [got[1, i] for i in range(10)] == [None, None, 1, 2, 1, 4, 4, 6, None, 8] and got[2, 0] is None


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 1, "a": 2}\r\n{"b"\n')
    rows = sorted((r.line, r.record, r.error) for r in read_jsonl(spark, str(tmp_path)).collect())
    assert [r[0] for r in rows] == [1, 3, 4, 5] and rows[0][2] is None
    assert rows[1][2] == "line 3: the root is not an object" and rows[2][2] == "line 4: repeated key" and rows[3][2].startswith("line 5: ")


@pytest.mark.parametrize(
    "rule, want",
    [
        ((None, "gte", "900", None, None), ("native_supported", None, "minInclusive=900")),
        (("attribute", "eq", "nan", None, None), ("deferred", "RULE_IR_INVALID", None)),
        (("attribute", None, "1", None, None), ("deferred", "UNSUPPORTED_COMPARATOR", None)),
        (("property", None, None, "integer", {"maxInclusive": ["9"], "enumeration": ["1", "2"]}), ("native_supported", None, "enumeration=1;enumeration=2;maxInclusive=9")),
        (("property", None, None, "integer", {"maxInclusive": ["9.5"]}), ("deferred", "RULE_IR_INVALID", None)),
        (("property", None, None, "string", {"enumeration": [""]}), ("deferred", "RULE_IR_INVALID", None)),
        (("property", None, None, "string", {}), ("deferred", "RULE_IR_INVALID", None)),
        (("property", None, None, "string", None), ("deferred", "RULE_IR_INVALID", None)),
    ],
)
def test_rules(spark, rule, want):
    schema = "requirement_kind string, comparator string, value string, datatype string, bounds map<string,array<string>>, formula string, lookup string, observation string"
    r = rule_ir.compiled(spark.createDataFrame([(*rule, None, None, None)], schema)).first()
    assert (r.status, r.reason, None if r.facets is None else ";".join(f"{f.operator}={f.value}" for f in r.facets)) == want


def test_observations(spark):
    rows = [("numeric", ["1.5"]), ("numeric", ["inf"]), ("numeric", ["1", "2"]), ("numeric", []), ("text", [" "]), ("text", ["x"]), ("boolean", ["true"]), ("boolean", ["1"]), ("other", ["1"]), ("text", None)]
    got = [r.r.status for r in spark.createDataFrame(rows, "kind string, v array<string>").select(rule_ir.resolved(F.col("kind"), F.col("v")).alias("r")).collect()]
    assert [s == "AVAILABLE" for s in got] == [True, False, False, False, False, True, True, False, False, False]


def test_ledger_and_items(spark):
    rows = [(1, 1, "lease"), (1, 2, "fail"), (1, 3, "requeue"), (1, 4, "lease"), (1, 5, "complete"), (1, 6, "complete"), (1, 7, "fail"), (2, 1, "complete")]
    jobs = ledger.folded(spark.createDataFrame(rows, "job int, at int, ev string"), "job", ["at"], F.col("ev"))
    assert {r.job: (r.state, r.attempts, r.refused) for r in jobs.collect()} == {1: ("completed", 2, 1), 2: ("pending", 0, 1)}
    assert {r.state: r.jobs for r in ledger.summary(jobs).collect()} == {"pending": 1, "leased": 0, "completed": 1, "failed": 0}
    records = transcripts.qualified(spark.createDataFrame([(1, "f", "1", 1, "a"), (1, "f", "1", 2, "b"), (1, "t", "1", 3, "c"), (1, "t", "2", 4, "d")], "s int, kind string, id string, n int, text string"), "s", "kind", "id", "n", ["text"])
    assert {r.record: r.text for r in records.collect()} == {"f:1": "b", "t:1": "c", "t:2": "d"}
    items = spark.createDataFrame([(1, "f:1", "x"), (1, "1", "y"), (1, "2", "z"), (1, "9", "w")], "s int, item string, outcome string")
    assert {r.record: r.outcome for r in transcripts.with_items(records, items, "s", "item", "outcome").collect()} == {"f:1": "x", "t:1": "unprocessed", "t:2": "z"}
    assert [r.item for r in transcripts.unmatched_items(records, items, "s", "item").collect()] == ["9"]
