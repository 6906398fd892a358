"""Queries of work folded over events: chunks under leases and check runs, both from the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import work
from trivalent.queries.rules import table

QUEUE, MINUTE = "q1", 60_000
STALL, MOST_CLAIMS, CLOCK = 45 * MINUTE, 2, 400 * MINUTE


def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of the chunk that is their conversation; of turns that repeat a number the shortest. Leases shown are right, of another worker or of an earlier attempt."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.length("text")).alias("size"))
    mark, worker = F.expr("if(turn = 0, 0, (conv_id * 3 + turn * 5 + size) % 8)"), F.expr("concat('w', cast((conv_id + turn div 5) % 2 as string))")
    kind = F.when(mark <= 2, "lease").when(mark <= 4, "complete").when(mark == 5, "fail").when(mark == 6, "requeue").otherwise("reclaim")
    token = F.concat(F.lit("sha256:"), F.sha2(F.format_string(f'{{"attempts":%d,"job_id":"%d","queue_sha256":"{QUEUE}","worker_id":"%s"}}', F.expr("1 + turn div 4"), "conv_id", worker), 256))
    ends = F.col("kind").isin("complete", "fail")
    return turns.withColumn("kind", kind).select(
        F.col("conv_id").cast("string").alias("job"), F.col("turn").alias("number"), "kind", F.when(ends | (F.col("kind") == "lease"), worker).alias("worker"), F.when(ends, token).alias("token"),
        F.when(F.col("kind") == "complete", F.expr("cast(size % 2 as string)")).alias("response"), F.when(F.col("kind") == "fail", F.expr("concat('e', cast(conv_id % 2 as string))")).alias("error"),
    )


def work_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.folded(chunk_events(spark, sf_dir), work.Chunks(QUEUE)).drop("token")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of the check run that is their conversation, 10 to 50 minutes apart."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.length("text")).alias("size"))
    mark = F.expr("if(turn = 0, -1, (conv_id + turn * 7 + size) % 6)")
    kind = F.when(mark == -1, "request").when(mark <= 1, "claim").when(mark == 2, "dispatch").when(mark <= 4, "succeed").otherwise("fail")
    return turns.select(
        F.col("conv_id").cast("string").alias("run"), F.col("turn").alias("number"), kind.alias("kind"), F.expr(f"turn * (conv_id % 5 + 1) * 10 * {MINUTE}L").alias("at"), F.expr("if((conv_id + turn) % 3 = 0, '', 'task')").alias("task"),
        F.expr("if(size % 4 = 0, '', 'TOO_LARGE')").alias("reason"), F.expr("size % 5").alias("passed"), F.expr("if(size % 3 = 0, 1, 0)").alias("failed"), F.expr("if(size % 2 = 0, 1, 0)").alias("indeterminate"),
    )


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.folded(run_events(spark, sf_dir), work.Runs(STALL, MOST_CLAIMS), CLOCK)


QUERIES = {"work_ledger": work_ledger, "run_ledger": run_ledger}

_TURNS = "(select conv_id, turn, min(length(text)) as size from conversations group by 1, 2)"
ORACLES = {
    "work_ledger": f"""with recursive marked as (select *, if(turn = 0, 0, (conv_id * 3 + turn * 5 + size) % 8) as mark, 'w' || ((conv_id + turn // 5) % 2) as worker from {_TURNS}),
 e as materialized (select conv_id, row_number() over (partition by conv_id order by turn) as i, case when mark <= 2 then 'lease' when mark <= 4 then 'complete' when mark = 5 then 'fail' when mark = 6 then 'requeue' else 'reclaim' end as kind, worker, worker || ':' || (1 + turn // 4) as token, (size % 2)::varchar as response, 'e' || (conv_id % 2) as error from marked),
 walk as (select conv_id, 0::bigint as i, 'pending' as status, 0 as attempts, null::varchar as worker, null::varchar as token, null::varchar as response, null::varchar as error, 0 as refused, 0 as repeated from (select distinct conv_id from e) union all
  select conv_id, i, case what when 'lease' then 'leased' when 'complete' then 'completed' when 'fail' then 'failed' when 'free' then 'pending' else status end, attempts + (what = 'lease')::int, case what when 'lease' then e_worker when 'free' then null else worker end,
   case what when 'lease' then e_worker || ':' || (attempts + 1) when 'free' then null else token end, if(what = 'complete', e_response, response), case what when 'fail' then e_error when 'lease' then null when 'complete' then null else error end, refused + (what = 'refused')::int, repeated + (what = 'repeated')::int
  from (select w.* exclude (i), e.i, e.worker as e_worker, e.response as e_response, e.error as e_error, case
    when kind = 'lease' then if(status = 'pending', 'lease', 'refused') when kind = 'complete' and status = 'completed' then if(e.response = w.response, 'repeated', 'refused') when kind = 'fail' and status = 'failed' and e.error = w.error then 'repeated'
    when kind in ('complete', 'fail') then if(status = 'leased' and e.worker = w.worker and e.token = w.token, kind, 'refused') when status = 'pending' then 'repeated' when status = if(kind = 'requeue', 'failed', 'leased') then 'free' else 'refused' end as what
   from walk w join e on e.conv_id = w.conv_id and e.i = w.i + 1))
 select conv_id::varchar as job, status, attempts, worker, response, error, refused, repeated from walk qualify row_number() over (partition by conv_id order by i desc) = 1""",
    "run_ledger": f"""with recursive marked as (select *, if(turn = 0, -1, (conv_id + turn * 7 + size) % 6) as mark from {_TURNS}),
 e as materialized (select conv_id, row_number() over (partition by conv_id order by turn) as i, case when mark = -1 then 'request' when mark <= 1 then 'claim' when mark = 2 then 'dispatch' when mark <= 4 then 'succeed' else 'fail' end as kind, turn * (conv_id % 5 + 1) * 10 * {MINUTE} as moment,
  if((conv_id + turn) % 3 = 0, '', 'task') as task, if(size % 4 = 0, '', 'TOO_LARGE') as reason, size % 5 as passed, (size % 3 = 0)::bigint as failed, (size % 2 = 0)::bigint as indeterminate from marked),
 walk as (select conv_id, 0::bigint as i, null::varchar as status, 0 as claims, null::varchar as task, null::bigint as created_at, null::bigint as started_at, null::bigint as finished_at, null::varchar as reason, null::varchar as outcome, null::bigint as passed, null::bigint as failed, null::bigint as indeterminate, 0 as refused, 0 as repeated from (select distinct conv_id from e) union all
  select conv_id, i, case what when 'request' then 'PENDING' when 'claim' then 'RUNNING' when 'succeed' then 'SUCCEEDED' when 'fail' then 'FAILED' when 'exhausted' then 'FAILED' else status end, claims + (what = 'claim')::int, if(what in ('request', 'dispatch'), e_task, task), if(what = 'request', moment, created_at), if(what = 'claim', moment, started_at),
   if(what in ('succeed', 'fail', 'exhausted'), moment, finished_at), case what when 'fail' then e_reason when 'exhausted' then 'RESOURCE_EXHAUSTED' when 'succeed' then null else reason end, if(what = 'succeed', case when e_failed > 0 then 'FAIL' when e_passed > 0 and e_open = 0 then 'PASS' else 'INDETERMINATE' end, outcome),
   if(what = 'succeed', e_passed, passed), if(what = 'succeed', e_failed, failed), if(what = 'succeed', e_open, indeterminate), refused + (what = 'refused')::int, repeated + (what = 'repeated')::int
  from (select *, case when kind = 'request' then if(status is null, 'request', 'repeated') when status is null then 'refused' when status in ('SUCCEEDED', 'FAILED') then if(kind = 'claim', 'repeated', 'refused') when kind = 'dispatch' then if(status = 'PENDING' and e_task <> '', 'dispatch', 'refused')
     when kind = 'claim' then if(claims >= {MOST_CLAIMS}, 'exhausted', 'claim') when status <> 'RUNNING' then 'refused' when kind = 'succeed' then 'succeed' when e_reason <> '' then 'fail' else 'refused' end as what
   from (select * replace (if(late, 'FAILED', status) as status, case when late and status = 'RUNNING' then 'STALLED' when late then 'DISPATCH_LOST' else reason end as reason, if(late, due, finished_at) as finished_at) from (select *, coalesce(due < moment, false) as late
    from (select w.* exclude (i), e.i, e.kind, e.moment, e.task as e_task, e.reason as e_reason, e.passed as e_passed, e.failed as e_failed, e.indeterminate as e_open, case when status = 'RUNNING' then started_at + {STALL} when status = 'PENDING' and coalesce(w.task, '') = '' then created_at + {STALL} end as due from walk w join e on e.conv_id = w.conv_id and e.i = w.i + 1))))),
 ended as (select *, case when status = 'RUNNING' then started_at + {STALL} when status = 'PENDING' and coalesce(task, '') = '' then created_at + {STALL} end as due from walk qualify row_number() over (partition by conv_id order by i desc) = 1)
 select conv_id::varchar as run, if(coalesce(due < {CLOCK}, false), 'FAILED', status) as status, claims, task, created_at, started_at, if(coalesce(due < {CLOCK}, false), due, finished_at) as finished_at, case when coalesce(due < {CLOCK}, false) then if(status = 'RUNNING', 'STALLED', 'DISPATCH_LOST') else reason end as reason, outcome, passed, failed, indeterminate, refused, repeated from ended""",
}
