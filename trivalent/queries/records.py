"""Store and ledger queries over orders, events and line items: order, leases, choice, scope, reconciliation, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import audit, sets, store, trees, windows
from trivalent.queries.rules import table
from trivalent.streaming.tallies import tallies

BY_DATE = ["o_orderdate", "o_orderkey"]
CLOCK = "timestamp'2024-01-31 00:00:00'"


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(table(spark, sf_dir, "orders").select("o_custkey", *BY_DATE), ["o_custkey"], BY_DATE).select("o_orderkey", "o_custkey", F.col("ordinal").cast("long").alias("ordinal"))


def lease_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per priority the first five open orders; the limit is the lease's size."""
    return windows.leased(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", *BY_DATE), ["o_orderpriority"], BY_DATE, F.col("o_orderstatus") == "O", 5).select("o_orderpriority", "o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


def overlap_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders take 90 days: does a customer's order start before the last one ends?"""
    orders = table(spark, sf_dir, "orders").select("o_custkey", *BY_DATE, F.expr("o_orderdate + interval 90 days").alias("ends"))
    return windows.overlap_marked(orders, ["o_custkey"], BY_DATE, "o_orderdate", "ends").select("o_orderkey", "overlaps")


def draft_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), "event_id"]).select("event_id", "state")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_states(table(spark, sf_dir, "events"), "user_id", "ts", F.expr(CLOCK), "6 hours")


def event_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(table(spark, sf_dir, "events")).withColumn("total", F.col("total").cast("double"))


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of nation 7's customers with totals by status; the scope reaches the customer scan."""
    own = store.for_tenant(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 7)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return orders.join(own, "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("price").cast("double").alias("total"))


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders, newest first."""
    return windows.page_slice(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)


def reconcile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass A judges labelled documents by quality, pass B all even ones and the toxic ones by toxicity."""
    labels = table(spark, sf_dir, "labels")
    a = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    b = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").where("doc_id % 2 = 0 or toxic = 1").select("doc_id", F.when(F.col("toxic") == 1, "drop").otherwise("keep").alias("verdict"))
    return sets.reconcile(a, b, "doc_id", "verdict")


def left_miss_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.with_miss_reason(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", [(F.col("quality") == 0, "REJECTED")])
    return rows.groupBy("source", "reason").agg(F.count("*").alias("n"))


def full_outer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.inventory(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


#: Ranges are a fixed list, so the side that is broadcast cannot grow.
RANGES = [("small", 0, 10), ("medium", 10, 30), ("large", 30, 51)]


def range_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(RANGES, "bundle string, lo int, hi int")
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return lines.join(F.broadcast(ranges), (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))).groupBy("bundle").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("total"))


def node_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree region, nation, customer: identifier, parent's identifier, depth by walking to the root, and how many stand below."""
    name = lambda kind, column: F.concat(F.lit(kind + ":"), F.col(column).cast("string"))
    customers = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    regions = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nodes = regions.unionByName(nations).unionByName(customers)
    below = nodes.groupBy("parent").agg(F.count("*").alias("children")).where("parent is not null").withColumnRenamed("parent", "node")
    depths = trees.walked(nodes).select("node", F.col("depth").cast("int").alias("depth"))
    return nodes.join(depths, "node").join(below, "node", "left").fillna(0, ["children"])


def distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order its distinct suppliers in order, joined; an order's lines are few by nature."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).select("l_orderkey", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("suppliers"))


def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys that line items leave out between consecutive ones of a supplier."""
    return store.gaps(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey")


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return audit.counted(
        {
            "lines without order": audit.orphans(lines.select("l_orderkey"), orders, "l_orderkey", "o_orderkey"),
            "repeated lines": audit.repeated(lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]),
            "discount out of range": audit.breaches(lines.select("l_discount"), F.col("l_discount").between(0, 0.08)),
            "repeated texts": audit.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"]),
            "documents without label": audit.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id"), "doc_id", "label_id"),
        }
    )


QUERIES = {
    "chunk_order": chunk_order, "lease_next": lease_next, "overlap_mark": overlap_mark, "draft_choice": draft_choice, "latest_per_key": latest_per_key, "run_states": run_states, "event_tallies": event_tallies, "tenant_scope": tenant_scope, "page_slice": page_slice,
    "reconcile_sets": reconcile_sets, "left_miss_reason": left_miss_reason, "full_outer_inventory": full_outer_inventory, "range_bundle": range_bundle, "node_tree_depth": node_tree_depth, "distinct_spans": distinct_spans, "number_gaps": number_gaps, "audits": audits,
}
ORACLES = {
    "chunk_order": "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as ordinal from orders",
    "lease_next": "select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as ordinal from orders where o_orderstatus = 'O' qualify ordinal <= 5",
    "overlap_mark": "select o_orderkey, coalesce(o_orderdate <= lag(o_orderdate + interval 90 days) over (partition by o_custkey order by o_orderdate, o_orderkey), false) as overlaps from orders",
    "draft_choice": "select event_id, if(row_number() over (partition by user_id order by ts desc, event_id) = 1, 'chosen', 'superseded') as state from events",
    "latest_per_key": "select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "run_states": "select user_id, max(ts) as last_at, if(max(ts) >= timestamp '2024-01-31 00:00:00' - interval 6 hours, 'running', 'stalled') as state from events group by 1",
    "event_tallies": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, sum(value::decimal(20,4))::double as total from events group by 1, 2",
    "tenant_scope": "select o_orderstatus, count(*) as orders, sum(o_totalprice::decimal(18,2))::double as total from orders join customer on c_custkey = o_custkey where c_nationkey = 7 group by 1",
    "page_slice": "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 40",
    "reconcile_sets": """with a as (select doc_id, if(quality = 1, 'keep', 'drop') as verdict_a from labels where quality is not null), b as (select d.doc_id, if(coalesce(toxic, 0) = 1, 'drop', 'keep') as verdict_b from documents d left join labels l on l.doc_id = d.doc_id where d.doc_id % 2 = 0 or toxic = 1)
 select doc_id, verdict_a, verdict_b, case when b.doc_id is null then 'only_a' when a.doc_id is null then 'only_b' when verdict_a = verdict_b then 'agreed' else 'conflict' end as outcome from a full join b using (doc_id)""",
    "left_miss_reason": "select d.source, case when l.doc_id is null then 'NO_RECORD' when quality is null then 'EMPTY' when quality = 0 then 'REJECTED' end as reason, count(*) as n from documents d left join labels l on l.doc_id = d.doc_id group by 1, 2",
    "full_outer_inventory": "select coalesce(c_custkey, o_custkey) as custkey, case when o_custkey is null then 'missing' when c_custkey is null then 'extra' else 'covered' end as state from (select distinct c_custkey from customer) full join (select distinct o_custkey from orders) on c_custkey = o_custkey",
    "range_bundle": "select bundle, count(*) as n, sum(l_extendedprice::decimal(18,2))::double as total from lineitem join (values ('small', 0, 10), ('medium', 10, 30), ('large', 30, 51)) r(bundle, lo, hi) on l_quantity >= lo and l_quantity < hi group by 1",
    "node_tree_depth": """with recursive n as (select 'r:' || r_regionkey as node, null::varchar as parent from region union all select 'n:' || n_nationkey, 'r:' || n_regionkey from nation union all select 'c:' || c_custkey, 'n:' || c_nationkey from customer),
 t as (select node, parent, 1 as depth from n where parent is null union all select n.node, n.parent, depth + 1 from n join t on n.parent = t.node)
 select node, parent, depth, (select count(*) from n x where x.parent = t.node) as children from t""",
    "distinct_spans": "select l_orderkey, string_agg(l_suppkey::varchar, ',' order by l_suppkey) as suppliers from (select distinct l_orderkey, l_suppkey from lineitem) group by 1",
    "number_gaps": "select l_suppkey, l_orderkey as after, b as before from (select l_suppkey, l_orderkey, lead(l_orderkey) over (partition by l_suppkey order by l_orderkey) as b from (select distinct l_suppkey, l_orderkey from lineitem)) where b > l_orderkey + 1",
    "audits": """select 'lines without order' as audit, count(*) as violations from lineitem where l_orderkey not in (select o_orderkey from orders)
 union all select 'repeated lines', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'discount out of range', count(*) from lineitem where not l_discount between 0 and 0.08::double
 union all select 'repeated texts', count(*) from (select 1 from documents group by text having count(*) > 1) union all select 'documents without label', count(*) from documents where doc_id not in (select doc_id from labels)""",
}
