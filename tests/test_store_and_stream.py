import pytest
from pyspark.sql import functions as F

from trivalent.operators import sets, store, windows
from trivalent.streaming.tallies import tallies, write_tallies

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_no_tenant_sees_nothing(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, tenant int")
    assert store.for_tenant(rows, "tenant", None).count() == 0
    assert [r.id for r in store.for_tenant(rows, "tenant", 7).collect()] == [1]


def test_page_sizes(spark):
    with pytest.raises(ValueError):
        windows.page_slice(spark.range(3), ["id"], 1, 101)
    assert [r.id for r in windows.page_slice(spark.range(5), [F.desc("id")], 2, 2).collect()] == [2, 1]


def test_reconcile_tells_missing_from_different(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, None), (4, "x")], "k int, v string")
    assert {r.k: r.outcome for r in sets.reconcile(a, b, "k", "v").collect()} == {1: "only_a", 2: "conflict", 3: "agreed", 4: "only_b"}


def test_stream_agrees_with_batch(spark, tmp_path):
    """Windows that the watermark has closed are the batch's own."""
    source = tmp_path / "in"
    spark.read.parquet(EVENTS).select("ts", "event_type", "value").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    write_tallies(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.event_type): (r.n, r.total) for r in tallies(spark.read.parquet(EVENTS)).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())
