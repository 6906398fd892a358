"""The work machines over a stream: a state a key, events put in order by event time, expiry by the watermark.

Events may come late and out of order within `late`: a key's state holds those that the watermark
hasn't passed (no more than `late` of them) and takes them in order of time and number once it has. Numbers follow
times within a key. The same event twice counts once. What the stream holds is its checkpoint, so
it can be stopped and started anew; its rows are updates, the last one of a key by `version` stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trivalent.operators.work import Machine, advance

HELD = T.StructType([T.StructField("state", T.StringType()), T.StructField("last", T.LongType()), T.StructField("waiting", T.StringType()), T.StructField("version", T.LongType())])


def updates(events: DataFrame, machine: Machine, late: str = "2 hours") -> DataFrame:
    """version and the machine's state after each batch that changed a key; events also have time (timestamp)."""
    names = machine.event.names
    out = T.StructType([T.StructField(machine.key, T.StringType()), *machine.state.fields, T.StructField("version", T.LongType())])

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        text, last, waiting, version = held.get if held.exists else (None, None, None, 0)
        state = json.loads(text) if text else machine.start()
        waiting = json.loads(waiting) if waiting else []
        for batch in batches:
            if len(batch):
                waiting += [[int(at), int(number), event] for at, number, event in zip(batch["ms"], batch["number"], batch["event"])]
        mark = held.getCurrentWatermarkMs()
        waiting.sort()
        ripe, waiting = [e for e in waiting if e[0] <= mark], [e for e in waiting if e[0] > mark]
        before = dict(state)
        state, last = advance(machine, key[0], state, last, [(e[1], dict.fromkeys(names) | json.loads(e[2])) for e in ripe])
        due = machine.due(state)
        if due is not None and due < mark and not any(e[0] <= due for e in waiting):
            state, due = machine.expire(state), None
        changed = state != before or version == 0 and bool(ripe)
        version += changed
        held.update((json.dumps(state), last, json.dumps(waiting), version))
        wake = [t for t in (due, waiting[0][0] if waiting else None) if t is not None]
        if wake:
            held.setTimeoutTimestamp(max(min(wake), mark) + 1)
        if changed:
            yield pd.DataFrame([[key[0], *(state[n] for n in machine.state.names), version]], columns=out.names).astype(object)

    # The version stamp tells apart which of a key's updates is the last.
    read = events.select(F.col(machine.key).cast("string").alias(machine.key), F.col("number").cast("long").alias("number"), F.col("time").cast("timestamp").alias("time"), F.to_json(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in machine.event.fields))).alias("event"))
    read = read.withColumn("ms", F.unix_millis("time")).dropna(subset=[machine.key, "number", "time"]).withWatermark("time", late)
    return read.groupBy(machine.key).applyInPandasWithState(step, out, HELD, "update", GroupStateTimeout.EventTimeTimeout)


def write_updates(events: DataFrame, machine: Machine, folder: str, checkpoint: str, late: str = "2 hours"):
    """Starts the stream over what is there; each batch is written into a folder of its number, so one that runs again replaces its own rows."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return updates(events, machine, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame, machine: Machine) -> DataFrame:
    """Of each key the last state that was written."""
    last = F.row_number().over(Window.partitionBy(machine.key).orderBy(F.desc("version")))
    return written.withColumn("_n", last).where("_n = 1").select(machine.key, *machine.state.names)
