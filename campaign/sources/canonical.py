"""Canonical campaign tables over the driver tables, and the same tables as SQL for checks.

Each table is a function of (spark, sf_dir); SQL[name] is the matching common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The task states.
STATES = ("NEW", "SUBMITTED", "RUNNING", "STOPPED", "UNKNOWN", "TERMINATING", "TERMINATED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(base: Column, hours: Column) -> Column:
    return base + F.make_dt_interval(F.lit(0), hours.cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task: orders, with the customer as the collection."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    state = F.get(F.array(*map(F.lit, STATES)), F.least(key % 10, F.lit(6)).cast("int"))
    exitcode = F.when((F.col("state") == "TERMINATED") & (key % 7 != 0), key % 3).cast("int")
    base = o.select(
        key.alias("task_id"), cust.alias("parent_id"), F.concat(F.lit("run_"), cust % 50, F.lit("#"), key).alias("jobname"), F.col("o_orderpriority").alias("class"),
        state.alias("state"), "o_orderkey", "o_custkey", "o_orderdate", (1 + key % 8).cast("int").alias("requested_cores"),
        F.floor(F.col("o_totalprice")).cast("long").alias("requested_memory"), (cust % 72).cast("int").alias("requested_walltime"),
    )
    base = base.withColumn("exitcode", exitcode)
    base = base.withColumn("signal", F.when(F.col("exitcode").isNotNull(), F.when(key % 11 == 0, 122).otherwise(0)).cast("int"))
    run = _hours(F.col("o_orderdate"), key % 48)
    return base.select(
        "task_id", "parent_id", "jobname", "class", "state", "exitcode", "signal",
        F.shiftleft("exitcode", 8).bitwiseOR(F.col("signal")).alias("returncode"),
        F.when(F.col("state") != "NEW", F.col("o_orderdate")).alias("submitted"),
        F.when(F.col("state").isin("RUNNING", "STOPPED", "TERMINATING", "TERMINATED"), run).alias("running"),
        F.when(F.col("state").isin("TERMINATING", "TERMINATED"), _hours(run, cust % 72)).alias("terminating"),
        "requested_cores", "requested_memory", "requested_walltime",
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes and messages of tasks: events, a user being a task."""
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "NEW", "view": "SUBMITTED", "click": "RUNNING", "purchase": "TERMINATED", "error": "STOPPED"}.items() for x in pair))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.try_element_at(kind, F.col("event_type")).alias("state"), F.col("props").alias("message"), "value")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered steps of a sequence: line items of an order."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return item.select(F.col("l_orderkey").alias("group_id"), (F.row_number().over(order) - 1).cast("long").alias("step"), (F.col("l_partkey") % 3).cast("int").alias("returncode"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    arch = F.when(k % 3 == 0, F.array(F.lit("x86_64"))).when(k % 3 == 1, F.array(F.lit("i686"))).otherwise(F.array(F.lit("x86_64"), F.lit("i686")))
    return s.select(
        F.col("s_name").alias("resource"), (k % 5 != 0).alias("enabled"), arch.alias("architecture"), (1 + k % 8).cast("int").alias("max_cores_per_job"),
        F.floor(F.col("s_acctbal") * 10).cast("long").alias("max_memory_per_core"), (F.col("s_nationkey") * 3).cast("int").alias("max_walltime"),
        (k % 4).cast("int").alias("user_queued"), (k % 13).cast("int").alias("free_slots"), (k % 6).cast("int").alias("queued"), (k % 3).cast("int").alias("user_run"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, parent_id): region, nation, customer, order; ids made distinct by a prefix."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("task_id"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    order = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    return region.union(nation).union(customer).union(order)


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    return table(spark, sf_dir, "part").where(half > 0).select(F.col("p_partkey").alias("task_id"), half.alias("depends_on"))


def listing(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    if new:
        return p.where("page_id % 7 <> 0").groupBy("path").agg(F.max(F.col("page_id") + F.col("page_id") % 2).alias("mtime"))
    return p.where("page_id % 5 <> 0").groupBy("path").agg(F.max("page_id").alias("mtime"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, head, value) in long form."""
    run = F.concat(F.lit("gamma="), F.col("o_custkey") % 5, F.lit("_beta="), F.col("o_custkey") % 3)
    o = table(spark, sf_dir, "orders").select(run.alias("run"), F.col("o_orderpriority").alias("head"), "o_totalprice")
    return o.groupBy("run", "head").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.col("value").alias("v1"), F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("v2"))


SQL = {
    "tasks": """tasks AS (
      WITH a AS (SELECT *, ['NEW','SUBMITTED','RUNNING','STOPPED','UNKNOWN','TERMINATING','TERMINATED'][least(o_orderkey % 10, 6) + 1] AS state FROM orders),
      b AS (SELECT *, CASE WHEN state = 'TERMINATED' AND o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 AS INT) END AS exitcode,
              o_orderdate + to_hours(CAST(o_orderkey % 48 AS INT)) AS r FROM a),
      c AS (SELECT *, CASE WHEN exitcode IS NOT NULL THEN CASE WHEN o_orderkey % 11 = 0 THEN 122 ELSE 0 END END AS signal FROM b)
      SELECT o_orderkey AS task_id, o_custkey AS parent_id, 'run_' || (o_custkey % 50) || '#' || o_orderkey AS jobname, o_orderpriority AS class, state, exitcode, signal,
        (exitcode << 8) | signal AS returncode,
        CASE WHEN state <> 'NEW' THEN o_orderdate END AS submitted,
        CASE WHEN state IN ('RUNNING','STOPPED','TERMINATING','TERMINATED') THEN r END AS running,
        CASE WHEN state IN ('TERMINATING','TERMINATED') THEN r + to_hours(CAST(o_custkey % 72 AS INT)) END AS terminating,
        CAST(1 + o_orderkey % 8 AS INT) AS requested_cores, CAST(floor(o_totalprice) AS BIGINT) AS requested_memory, CAST(o_custkey % 72 AS INT) AS requested_walltime FROM c)""",
    "task_events": """task_events AS (SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'SUBMITTED' WHEN 'click' THEN 'RUNNING'
      WHEN 'purchase' THEN 'TERMINATED' WHEN 'error' THEN 'STOPPED' END AS state, props AS message, value FROM events)""",
    "steps": """steps AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS step,
      CAST(l_partkey % 3 AS INT) AS returncode FROM lineitem)""",
    "resources": """resources AS (SELECT s_name AS resource, s_suppkey % 5 <> 0 AS enabled, CASE s_suppkey % 3 WHEN 0 THEN ['x86_64'] WHEN 1 THEN ['i686'] ELSE ['x86_64','i686'] END AS architecture,
      CAST(1 + s_suppkey % 8 AS INT) AS max_cores_per_job, CAST(floor(s_acctbal * 10) AS BIGINT) AS max_memory_per_core, CAST(s_nationkey * 3 AS INT) AS max_walltime,
      CAST(s_suppkey % 4 AS INT) AS user_queued, CAST(s_suppkey % 13 AS INT) AS free_slots, CAST(s_suppkey % 6 AS INT) AS queued, CAST(s_suppkey % 3 AS INT) AS user_run FROM supplier)""",
    "tree": """tree AS (SELECT 'r' || r_regionkey AS task_id, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)""",
    "deps": "deps AS (SELECT p_partkey AS task_id, p_partkey // 2 AS depends_on FROM part WHERE p_partkey // 2 > 0)",
    "listing_old": "listing_old AS (SELECT url AS path, max(page_id) AS mtime FROM pages WHERE page_id % 5 <> 0 GROUP BY 1)",
    "listing_new": "listing_new AS (SELECT url AS path, max(page_id + page_id % 2) AS mtime FROM pages WHERE page_id % 7 <> 0 GROUP BY 1)",
    "run_results": """run_results AS (SELECT 'gamma=' || (o_custkey % 5) || '_beta=' || (o_custkey % 3) AS run, o_orderpriority AS head, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)""",
    "series": "series AS (SELECT user_id, event_id, value AS v1, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v2 FROM events)",
}


def with_(*names: str) -> str:
    """A WITH clause of the named tables."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + " "
