"""Chunks and runs: every move and refusal, and the stream against the batch fold."""

import random
from collections import Counter

from pyspark.sql import functions as F

from trivalent.operators import work
from trivalent.streaming import work as stream

HOUR, BASE = 3_600_000, 1_700_000_000_000
RUN_COLUMNS = "run string, number long, at long, kind string, task string, reason string, passed long, failed long, indeterminate long"


def test_chunk_moves():
    machine = work.Chunks("q")
    first, second = work.lease_token("q", "j", "w", 1), work.lease_token("q", "j", "v", 2)
    event = lambda kind, worker=None, token=None, response=None, error=None: dict(zip(work.CHUNK_EVENT.names, (kind, worker, token, response, error)))
    story = [
        (event("complete", "w", first, "r"), "pending", 1, 0), (event("requeue"), "pending", 1, 1), (event("lease", ""), "pending", 2, 1), (event("lease", "w"), "leased", 2, 1), (event("lease", "v"), "leased", 3, 1), (event("fail", "w", first), "leased", 4, 1),
        (event("fail", "w", first, error="e"), "failed", 4, 1), (event("fail", "w", first, error="e"), "failed", 4, 2), (event("fail", "w", first, error="f"), "failed", 5, 2), (event("reclaim"), "failed", 6, 2), (event("requeue"), "pending", 6, 2), (event("lease", "v"), "leased", 6, 2),
        (event("complete", "w", first, "r"), "leased", 7, 2), (event("reclaim"), "pending", 7, 2), (event("reclaim"), "pending", 7, 3), (event("lease", "v"), "leased", 7, 3), (event("complete", "v", second, "r"), "leased", 8, 3),
        (event("complete", "v", work.lease_token("q", "j", "v", 3), "r"), "completed", 8, 3), (event("complete", "x", None, "r"), "completed", 8, 4), (event("complete", "v", second, "other"), "completed", 9, 4), (event("unheard of"), "completed", 10, 4),
    ]
    state = machine.start()
    for e, status, refused, repeated in story:
        state = machine.step("j", state, e)
        assert (state["status"], state["refused"], state["repeated"]) == (status, refused, repeated), e
    assert state["attempts"] == 3 and state["response"] == "r"


def test_events_of_one_number_count_once(spark):
    rows = [("j", 1, "lease", "w"), ("j", 1, "lease", "w"), (None, 2, "lease", "w"), ("k", None, "lease", "w"), ("l", 5, "reclaim", None)]
    events = spark.createDataFrame(rows, "job string, number long, kind string, worker string").withColumns({c: F.lit(None).cast("string") for c in ("token", "response", "error")})
    got = {r.job: (r.status, r.attempts, r.refused, r.repeated) for r in work.folded(events, work.Chunks("q")).collect()}
    assert got == {"j": ("leased", 1, 0, 1), "l": ("pending", 0, 0, 1)}
    assert work.folded(events.where("false"), work.Chunks("q")).count() == 0


def runs(rng):
    rows = []
    for run in range(24):
        at = BASE + run * HOUR // 6
        for number, kind in enumerate(["request", *rng.choices(["claim", "claim", "dispatch", "succeed", "fail"], k=rng.randint(0, 6))], 1):
            at += rng.randint(1, 2 * HOUR)
            rows.append((f"r{run}", number, at, kind, "t" if kind == "dispatch" else rng.choice(["t", ""]), "broken" if kind == "fail" else None, rng.randint(0, 3), rng.choice([0, 0, 2]), 0))
    return rows


def test_stream_agrees_with_batch(spark, tmp_path):
    """Events late and out of order, some twice, over a stream that is stopped and started: the last states are those of the batch fold, expiry included."""
    rng, machine = random.Random(5), work.Runs(3 * HOUR, 2)
    rows = runs(rng)
    clock = max(r[2] for r in rows) + 100 * HOUR
    want = {r.run: r for r in work.folded(spark.createDataFrame(rows, RUN_COLUMNS), machine, clock).collect()}
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def feed(part):
        spark.createDataFrame(part, RUN_COLUMNS).withColumn("time", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        stream.write_updates(read, machine, out, checkpoint).awaitTermination()

    rows.sort(key=lambda r: r[2] + rng.randint(0, HOUR))
    third = len(rows) // 3
    for n in range(3):
        part = rows[n * third : (n + 1) * third if n < 2 else len(rows)]
        feed(part + part[:4])
    for n in range(2):  # moves the watermark past all of it
        feed([("later", n + 1, clock + 3 * HOUR + n, "request", "t", None, 0, 0, 0)])
    got = {r.run: r for r in stream.latest(spark.read.parquet(out).drop("batch"), machine).collect()}
    compared = [n for n in work.RUN_STATE.names if n != "repeated"]
    assert {k: [v[n] for n in compared] for k, v in got.items() if k != "later"} == {k: [v[n] for n in compared] for k, v in want.items()}
    assert {"STALLED", "DISPATCH_LOST"} <= set(Counter(r.reason for r in want.values()))


def test_claim_limit():
    machine = work.Runs(HOUR, 1)
    event = lambda kind, at, **more: dict.fromkeys(work.RUN_EVENT.names) | {"kind": kind, "at": at} | more
    state = machine.start()
    for e in (event("request", 0, task="t"), event("claim", 5), event("claim", 6), event("succeed", 7), event("claim", 8)):
        state = machine.step("r", state, e)
    assert (state["status"], state["reason"], state["claims"], state["refused"], state["repeated"]) == ("FAILED", work.RESOURCE_EXHAUSTED, 1, 1, 1)
    fresh = machine.step("r", machine.step("r", machine.step("r", machine.start(), event("request", 0, task="t")), event("claim", 5)), event("succeed", 9, passed=3, failed=0, indeterminate=1))
    assert (fresh["status"], fresh["outcome"], fresh["finished_at"]) == ("SUCCEEDED", "INDETERMINATE", 9)
