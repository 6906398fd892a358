"""Work as machines folded over events: chunks under leases, and runs with claims and reapers.

The same step functions serve the batch fold here and the stream in trivalent/streaming/work.py.
A fold streams events in order through a task and holds one state, so that a key of very many
events is never gathered. Events that their state doesn't allow change nothing and are counted:
`refused` ones are faults, `repeated` ones say again what holds already. Of events that share a key
and a number the first in order of all their fields counts, the others are repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A state and an event, as plain values by name.
State = dict[str, Any]
Event = dict[str, Any]

CHUNK_EVENT = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("worker", T.StringType()), ("token", T.StringType()), ("response", T.StringType()), ("error", T.StringType()))])
CHUNK_STATE = T.StructType(
    [T.StructField(n, t) for n, t in (("status", T.StringType()), ("attempts", T.IntegerType()), ("worker", T.StringType()), ("token", T.StringType()), ("response", T.StringType()), ("error", T.StringType()), ("refused", T.IntegerType()), ("repeated", T.IntegerType()))]
)
RUN_EVENT = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("at", T.LongType()), ("task", T.StringType()), ("reason", T.StringType()), ("passed", T.LongType()), ("failed", T.LongType()), ("indeterminate", T.LongType()))])
RUN_STATE = T.StructType(
    [T.StructField(n, t) for n, t in (("status", T.StringType()), ("claims", T.IntegerType()), ("task", T.StringType()), ("created_at", T.LongType()), ("started_at", T.LongType()), ("finished_at", T.LongType()), ("reason", T.StringType()), ("outcome", T.StringType()),
     ("passed", T.LongType()), ("failed", T.LongType()), ("indeterminate", T.LongType()), ("refused", T.IntegerType()), ("repeated", T.IntegerType()))]
)
#: Why a run failed that ended by itself.
STALLED, DISPATCH_LOST, RESOURCE_EXHAUSTED = "STALLED", "DISPATCH_LOST", "RESOURCE_EXHAUSTED"


def lease_token(queue: str, job: str, worker: str, attempts: int) -> str:
    """What a worker must show: the hash of what the lease is, in canonical JSON."""
    identity = {"attempts": attempts, "job_id": job, "queue_sha256": queue, "worker_id": worker}
    return "sha256:" + hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def blank(schema: T.StructType, **known: Any) -> State:
    return {name: 0 if name in ("attempts", "claims", "refused", "repeated") else None for name in schema.names} | known


class Chunks:
    """Chunks of a queue: pending, leased, completed, failed. A completion or failure must show the lease it ends."""

    key, event, state = "job", CHUNK_EVENT, CHUNK_STATE

    def __init__(self, queue: str):
        self.queue = queue

    def start(self) -> State:
        return blank(CHUNK_STATE, status="pending")

    def step(self, job: str, state: State, event: Event) -> State:
        kind, status = event["kind"], state["status"]
        held = status == "leased" and event["worker"] == state["worker"] and event["token"] == state["token"]
        refused, repeated = state | {"refused": state["refused"] + 1}, state | {"repeated": state["repeated"] + 1}
        if kind == "lease":
            if status != "pending" or not event["worker"]:
                return refused
            attempts = state["attempts"] + 1
            return state | {"status": "leased", "worker": event["worker"], "attempts": attempts, "token": lease_token(self.queue, job, event["worker"], attempts), "error": None}
        if kind == "complete":
            if status == "completed":
                return repeated if event["response"] == state["response"] else refused
            return state | {"status": "completed", "response": event["response"], "error": None} if held and event["response"] else refused
        if kind == "fail":
            if status == "failed" and event["error"] and event["error"] == state["error"]:
                return repeated
            return state | {"status": "failed", "error": event["error"]} if held and event["error"] else refused
        allowed = {"requeue": "failed", "reclaim": "leased"}.get(kind)
        if allowed and status == "pending":
            return repeated
        return state | {"status": "pending", "worker": None, "token": None} if status == allowed else refused

    def due(self, state: State) -> int | None:
        return None

    def expire(self, state: State) -> State:
        return state


class Runs:
    """Check runs: PENDING, RUNNING, SUCCEEDED, FAILED. Times are milliseconds.

    A claim raises the count before the work begins; one beyond most_claims ends the run
    (RESOURCE_EXHAUSTED). A run that has been RUNNING for longer than `stall` (STALLED), or PENDING so long
    without a task (DISPATCH_LOST), fails when that time is over. What ended stays as it is.
    """

    key, event, state = "run", RUN_EVENT, RUN_STATE

    def __init__(self, stall: int, most_claims: int):
        self.stall, self.most_claims = stall, most_claims

    def start(self) -> State:
        return blank(RUN_STATE)

    def due(self, state: State) -> int | None:
        """When the run fails by itself, if nothing happens."""
        if state["status"] == "RUNNING":
            return state["started_at"] + self.stall
        return state["created_at"] + self.stall if state["status"] == "PENDING" and not state["task"] else None

    def expire(self, state: State) -> State:
        return state | {"status": "FAILED", "reason": STALLED if state["status"] == "RUNNING" else DISPATCH_LOST, "finished_at": self.due(state)}

    def step(self, run: str, state: State, event: Event) -> State:
        due = self.due(state)
        if due is not None and due < event["at"]:
            state = self.expire(state)
        kind, status, at = event["kind"], state["status"], event["at"]
        refused, repeated = state | {"refused": state["refused"] + 1}, state | {"repeated": state["repeated"] + 1}
        if kind == "request":
            return repeated if status else state | {"status": "PENDING", "created_at": at, "task": event["task"]}
        if status is None:
            return refused
        if status in ("SUCCEEDED", "FAILED"):
            return repeated if kind == "claim" else refused
        if kind == "dispatch":
            return state | {"task": event["task"]} if status == "PENDING" and event["task"] else refused
        if kind == "claim":
            if state["claims"] >= self.most_claims:
                return state | {"status": "FAILED", "reason": RESOURCE_EXHAUSTED, "finished_at": at}
            return state | {"status": "RUNNING", "started_at": at, "claims": state["claims"] + 1}
        if status != "RUNNING":
            return refused
        if kind == "succeed":
            counts = {name: event[name] or 0 for name in ("passed", "failed", "indeterminate")}
            outcome = "FAIL" if counts["failed"] else "PASS" if counts["passed"] and not counts["indeterminate"] else "INDETERMINATE"
            return state | counts | {"status": "SUCCEEDED", "outcome": outcome, "reason": None, "finished_at": at}
        return state | {"status": "FAILED", "reason": event["reason"], "finished_at": at} if kind == "fail" and event["reason"] else refused


Machine = Chunks | Runs


def advance(machine: Machine, key: str, state: State, last: int | None, events: list[tuple[int, Event]]) -> tuple[State, int | None]:
    """The state after events (number, event) in order; numbers up to the last one have been seen."""
    for number, event in events:
        if last is not None and number <= last:
            state = state | {"repeated": state["repeated"] + 1}
            continue
        state, last = machine.step(key, state, event), number
    return state, last


def _folding(machine: Machine, schema: pa.Schema, clock: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, last, done = None, machine.start(), None, []

        def close() -> None:
            ended = state
            if clock is not None and (due := machine.due(state)) is not None and due < clock:
                ended = machine.expire(state)
            done.append({machine.key: current} | ended)

        for batch in batches:
            for row in batch.to_pylist():
                if row[machine.key] != current:
                    if current is not None:
                        close()
                    current, state, last = row[machine.key], machine.start(), None
                state, last = advance(machine, current, state, last, [(row["number"], row)])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, schema)

    return fold


def folded(events: DataFrame, machine: Machine, clock: int | None = None) -> DataFrame:
    """The last state of every key: its key column (string) and the machine's state.

    events: the key (job or run), number (order of the key's events) and the machine's event columns, null where an
    event has none. clock: the time up to which runs expire. Rows without key or number are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = machine.event.names
    schema = T.StructType([T.StructField(machine.key, T.StringType()), *machine.state.fields])
    read = events.select(F.col(machine.key).cast("string").alias(machine.key), F.col("number").cast("long").alias("number"), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in machine.event.fields)).dropna(subset=[machine.key, "number"])
    ordered = read.repartition(machine.key).sortWithinPartitions(machine.key, "number", *names)
    return ordered.mapInArrow(_folding(machine, to_arrow_schema(schema), clock), schema)
