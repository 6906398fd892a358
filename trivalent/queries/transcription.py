"""Queries over transcribed pages: scores, table-like regions, bundle ranges, states, assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivalent.operators import transcription
from trivalent.queries.rules import table


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, their orders as tokens."""
    tokens = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 10001).alias("confidence"))
    return transcription.token_scores(table(spark, sf_dir, "customer"), tokens, "c_custkey", "confidence")


def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with why each holds a table-like region, if it does; commas stand for shapes, and each line ends with its own length."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat_ws(" ", x, F.length(x).cast("string")))
    reasons = transcription.table_reasons(F.regexp_count("text", F.lit(",")), lines)
    return docs.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


def bundle_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are pages, purchases failed ones; every five make a bundle, and every fourth bundle is lost."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    pages = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("page"), (F.col("event_type") == "purchase").alias("failed"))
    made = pages.groupBy("user_id", F.floor((F.col("page") - 1) / 5).alias("b")).agg(F.min("page").alias("first"), F.max("page").alias("last"))
    bundles = made.where("b % 4 <> 2").select("user_id", (F.col("b") + 1).alias("sequence"), "first", "last")
    return transcription.bundle_breaches(bundles, pages, "user_id")


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {"O": "pending", "P": "leased", "F": "complete", "X": "failed"}
    return transcription.state_summary(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", states)


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcription.assertions(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], "o_orderkey")


QUERIES = {"token_scores": token_scores, "table_regions": table_regions, "bundle_breaches": bundle_breaches, "state_summary": state_summary, "assertions": assertions}
ORACLES = {
    "token_scores": """select c_custkey, count(o_orderkey) as tokens, coalesce((sum(o_orderkey % 10001) // count(o_orderkey))::bigint, 0) as mean_confidence, count(o_orderkey) < 20 or coalesce(sum(o_orderkey % 10001) // count(o_orderkey), 0) < 6000 as dense
 from customer left join orders on o_custkey = c_custkey group by 1""",
    "table_regions": r"""with r as (select doc_id, len(regexp_extract_all(text, ',')) >= 8 as shapes, len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x || ' ' || length(x), '[^\p{Nd}]', '', 'g')) >= 3)) >= 4 as numeric from documents where text is not null)
 select doc_id, concat_ws(',', if(shapes, 'MANY_VECTOR_SHAPES', null), if(numeric, 'MULTIPLE_NUMERIC_LINES', null)) as reasons from r""",
    "bundle_breaches": """with p as (select user_id, row_number() over (partition by user_id order by event_id) as page, event_type = 'purchase' as failed from events),
 b as (select user_id, (page - 1) // 5 as b, min(page) as first, max(page) as last from p group by 1, 2 having (page - 1) // 5 % 4 <> 2),
 o as (select user_id, b + 1 as sequence, first, last, row_number() over w as place, lag(last) over w as before from b window w as (partition by user_id order by b))
 select user_id, 'SEQUENCE' as breach, sequence as number from o where sequence <> place union all select user_id, 'OVERLAP', first from o where first < before
 union all select p.user_id, 'GAP', page from p join o on o.user_id = p.user_id and page > before and page < first where not failed
 union all select user_id, 'UNCOVERED', page from p where not failed and not exists (select 1 from b where b.user_id = p.user_id and page between first and last)""",
    "state_summary": "select o_orderpriority, count_if(o_orderstatus = 'O')::bigint as pending, count_if(o_orderstatus = 'P')::bigint as leased, count_if(o_orderstatus = 'F')::bigint as complete, count_if(o_orderstatus = 'X')::bigint as failed, count(*) as total from orders group by 1",
    "assertions": "select sha256(concat_ws(chr(31), o_custkey::varchar, o_orderpriority, o_orderstatus)) as assertion_id, count(*) as occurrences, min(o_orderkey) as first_key, count(*) - 1 as collapsed from orders group by 1",
}
