"""The work ledger: each job's state is a fold of its events in order.

pending -> leased (an attempt more) -> completed, failed, or pending again when reclaimed;
failed -> pending when requeued. Attempts are kept. An event that its state doesn't allow
changes nothing and is counted as refused; completing anew is no fault when it is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event, the states that allow it, the state that follows.
MOVES = (("lease", ("pending",), "leased"), ("complete", ("leased",), "completed"), ("fail", ("leased",), "failed"), ("requeue", ("failed",), "pending"), ("reclaim", ("leased",), "pending"))
STATES = ("pending", "leased", "completed", "failed")


def folded(events: DataFrame, key: str, at: list[str], event: Column) -> DataFrame:
    """key, state, attempts, refused. A job's own events are few by nature: leases, failures and one end."""
    history = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*at, event.alias("event")))).alias("history"))

    def step(s: Column, x: Column) -> Column:
        following = F.lit(None).cast("string")
        for name, allowed, to in MOVES:
            following = F.when((x["event"] == name) & s["state"].isin(*allowed), to).otherwise(following)
        again = (x["event"] == "complete") & (s["state"] == "completed")
        return F.struct(
            F.coalesce(following, s["state"]).alias("state"),
            (s["attempts"] + F.when(following == "leased", 1).otherwise(0)).alias("attempts"),
            (s["refused"] + F.when(following.isNull() & ~again, 1).otherwise(0)).alias("refused"),
        )

    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))
    return history.select(key, F.aggregate("history", start, step).alias("s")).select(key, "s.state", "s.attempts", "s.refused")


def summary(jobs: DataFrame) -> DataFrame:
    """state, jobs, attempts for every state, those without a job too."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    counts = jobs.groupBy("state").agg(F.count("*").alias("jobs"), F.sum("attempts").alias("attempts"))
    return every.join(counts, "state", "left").fillna(0)


# Filters of check runs; status, report, error, task and times are columns of the run.
IN_FLIGHT, TERMINAL = ("PENDING", "RUNNING"), ("SUCCEEDED", "FAILED")


def run_filters(clock: Column, older_than: str) -> dict[str, Column]:
    """Named filters over runs. missing_report and generation_failed part the succeeded runs without a report between them."""
    c = F.col
    cutoff = clock - F.expr(f"interval {older_than}")
    unreported = (c("status") == "SUCCEEDED") & c("report").isNull()
    return {
        "pending": c("status") == "PENDING",
        "running": c("status") == "RUNNING",
        "terminal": c("status").isin(*TERMINAL),
        "in_flight": c("status").isin(*IN_FLIGHT),
        "missing_report": unreported & (c("error") == ""),
        "generation_failed": unreported & (c("error") != ""),
        "stalled": (c("status") == "RUNNING") & (c("started_at") < cutoff),
        "dispatch_lost": (c("status") == "PENDING") & (c("task") == "") & (c("created_at") < cutoff),
        "incoherent": ((c("status") == "SUCCEEDED") & c("report").isNull() & (c("error") == "")) | ((c("status") == "FAILED") & (c("error") == "")),
    }
