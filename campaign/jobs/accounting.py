"""Jobs on resources and accounting records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting as op
from ..operators import matching as m
from ..sources import canonical as c
from .base import Jobs

job = Jobs()
PAIR = """enabled AND (w IS NULL OR list_contains(architecture, w)) AND requested_cores <= max_cores_per_job AND requested_memory <= requested_cores * max_memory_per_core AND requested_walltime <= max_walltime"""
ASKED = "asked AS (SELECT *, CASE task_id % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'i686' END AS w FROM tasks WHERE state = 'NEW')"


def _asked(spark, sf):
    k = F.col("task_id") % 3
    return c.tasks(spark, sf).where("state = 'NEW'").withColumn("architecture_wanted", F.when(k == 0, "x86_64").when(k == 1, "i686"))


@job(c.with_("tasks", "resources") + f", {ASKED} SELECT task_id, resource FROM asked, resources WHERE {PAIR}")
def match_resources(spark, sf):
    return m.match_resources(_asked(spark, sf), c.resources(spark, sf))


@job(c.with_("resources") + "SELECT resource, CAST(row_number() OVER (ORDER BY CASE WHEN resource = 'Supplier#000000004' THEN 1 ELSE 0 END, user_queued, free_slots DESC, queued, user_run, resource) AS INT) AS rank FROM resources")
def rank_resources(spark, sf):
    return m.rank_resources(c.resources(spark, sf), ["Supplier#000000004"])


@job(
    c.with_("tasks")
    + """, f AS (SELECT s_name AS flavor, CAST(1 + s_suppkey % 16 AS INT) AS cpus, CAST(floor(abs(s_acctbal)) AS BIGINT) * 60 AS ram, CAST(s_nationkey AS INT) AS disk FROM supplier),
    x AS (SELECT task_id, arg_min(flavor, (CASE WHEN flavor <> 'Supplier#000000007' THEN 1 ELSE 0 END, cpus, ram, disk, flavor)) AS flavor FROM tasks, f
      WHERE state = 'NEW' AND cpus >= requested_cores AND ram - 512 >= requested_memory GROUP BY 1)
    SELECT task_id, flavor FROM tasks LEFT JOIN x USING (task_id) WHERE state = 'NEW'"""
)
def smallest_flavor(spark, sf):
    flavors = c.table(spark, sf, "supplier").select(F.col("s_name").alias("flavor"), (1 + F.col("s_suppkey") % 16).cast("int").alias("cpus"), (F.floor(F.abs("s_acctbal")).cast("long") * 60).alias("ram"), F.col("s_nationkey").alias("disk"))
    return m.smallest_flavor(c.tasks(spark, sf).where("state = 'NEW'").withColumn("preferred", F.lit("Supplier#000000007")), flavors, 512)


@job(
    """WITH t AS (SELECT l_orderkey AS reaction, l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS qty FROM lineitem WHERE l_linenumber <> 3),
    e AS (SELECT s_suppkey AS subject, s_acctbal / 10000 AS energy FROM supplier WHERE s_suppkey % 10 <> 0),
    x AS (SELECT reaction, sum(627.509::DOUBLE * qty * energy) AS v, count(*) FILTER (energy IS NULL) AS u FROM t LEFT JOIN e USING (subject) GROUP BY 1)
    SELECT reaction, round(CASE WHEN u = 0 THEN v END, 6) AS energy, round(CASE WHEN u = 0 THEN v END - reaction % 100, 6) AS deviation FROM x"""
)
def reaction_energy(spark, sf):
    item = c.table(spark, sf, "lineitem")
    term = F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_suppkey")).alias("subject"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("qty"))
    reactions = item.groupBy(F.col("l_orderkey").alias("reaction")).agg(F.collect_list(term).alias("terms")).withColumn("reference", F.col("reaction") % 100)
    energies = c.table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("subject"), (F.col("s_acctbal") / 10000).alias("energy"))
    done = m.reaction_energy(reactions, energies)
    return done.select("reaction", F.round("energy", 6).alias("energy"), F.round("deviation", 6).alias("deviation"))


@job(
    """WITH s AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 3 AS INT) END AS code FROM orders), p AS (SELECT o_orderkey AS job, CAST(o_orderkey % 2 AS INT) AS code FROM orders WHERE o_orderkey % 3 <> 0),
    q AS (SELECT o_orderkey AS job, 7 AS code FROM orders WHERE o_orderkey % 3 = 0)
    SELECT s.job, coalesce(s.code, p.code, q.code) AS code, len(list_distinct(list_filter([s.code, p.code, q.code], lambda x: x IS NOT NULL))) > 1 AS conflict FROM s LEFT JOIN p USING (job) LEFT JOIN q USING (job)"""
)
def coalesce_accounting(spark, sf):
    o = c.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), "o_custkey")
    status = o.select("job", F.when(F.col("job") % 4 == 0, F.col("o_custkey") % 3).cast("int").alias("code"))
    primary = o.where("job % 3 <> 0").select("job", (F.col("job") % 2).cast("int").alias("code"))
    return m.coalesce_accounting(status, primary, o.where("job % 3 = 0").select("job", F.lit(7).alias("code")), "job", ["code"])


@job("SELECT c_custkey, n_name FROM customer, nation")
def pair_all(spark, sf):
    return m.pair_all(c.table(spark, sf, "customer").select("c_custkey"), c.table(spark, sf, "nation").select("n_name"))


def _slurm(spark, sf):
    """A master record per order and a step record per line item, as text."""
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    o, key = c.table(spark, sf, "orders"), F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, ("COMPLETED", "FAILED", "CANCELLED by 1000", "NODE_FAIL", "TIMEOUT", "RUNNING"))), (key % 6).cast("int"))
    master = o.select(F.concat_ws("|", key.cast("string"), F.concat((key % 3).cast("string"), F.lit(":"), (key % 2).cast("string")), state, (1 + key % 8).cast("string"), F.concat(F.lit("01:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":05")), F.concat(F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":10.5")), stamp("o_orderdate"), stamp("o_orderdate"), stamp(F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")), F.lit(""), F.lit(""), F.lit("")).alias("line"))
    i, n = c.table(spark, sf, "lineitem"), F.col("l_linenumber")
    step = i.select(F.concat_ws("|", F.concat("l_orderkey", F.lit("."), n), F.lit("0:0"), F.lit("COMPLETED"), F.lit("1"), F.lit("00:01"), F.lit("00:01"), stamp("l_shipdate"), stamp("l_shipdate"), stamp("l_shipdate"), F.concat((F.col("l_partkey") % 1000).cast("string"), F.lit("K")), F.concat((F.col("l_suppkey") % 100).cast("string"), F.lit(".50M")), F.lit("")).alias("line"))
    return master.union(step)


@job(
    """WITH s AS (SELECT l_orderkey AS job, max(l_partkey % 1000) * 1000 AS rss, max(l_suppkey % 100) * 1000000 + 500000 AS vmem, min(date_trunc('second', l_shipdate)) AS t FROM lineitem GROUP BY 1),
    a AS (SELECT o_orderkey AS j, o_orderkey % 6 AS k, date_trunc('second', o_orderdate) AS d FROM orders WHERE o_orderkey % 6 <> 5),
    b AS (SELECT *, CAST(CASE WHEN k IN (2, 3, 4) THEN 75 ELSE j % 3 END AS INT) AS exitcode, CAST(CASE WHEN k IN (2, 4) THEN 122 WHEN k = 3 THEN 124 ELSE j % 2 END AS INT) AS signal FROM a)
    SELECT CAST(j AS VARCHAR) AS job, exitcode, signal, (exitcode << 8) | signal AS termstatus, CAST(1 + j % 8 AS INT) AS cores, (3600 + j % 60 * 60 + 5) * 1000000000 AS duration, (j % 60 * 60 + 10) * 1000000000 + 500000000 AS used_cpu_time,
      coalesce(vmem, 0) AS max_used_memory, coalesce(rss, 0) AS max_used_ram, least(d, t) AS submission_time, least(d + INTERVAL 2 HOUR, t) AS start_time, d + INTERVAL 2 HOUR AS completion_time FROM b LEFT JOIN s ON s.job = j"""
)
def slurm_usage(spark, sf):
    return op.slurm_usage(_slurm(spark, sf))


@job(c.with_("tasks") + "SELECT class AS user, count(*) FILTER (state = 'RUNNING') AS running, count(*) FILTER (state = 'SUBMITTED') AS queued FROM tasks GROUP BY GROUPING SETS ((class), ())")
def queue_counts(spark, sf):
    return op.queue_counts(c.tasks(spark, sf).withColumnRenamed("class", "user"))


@job(
    """WITH h AS (SELECT 'host' || (l_suppkey % 50) AS host, max(l_linenumber * 4) AS total, max(CAST(l_quantity AS INT) % 3 + l_partkey % 2) AS unavailable FROM lineitem GROUP BY 1)
    SELECT coalesce(host, 'global') AS host, CAST(sum(total) AS BIGINT) AS total, CAST(sum(unavailable) AS BIGINT) AS unavailable, CAST(sum(total - unavailable) AS BIGINT) AS available FROM h GROUP BY ROLLUP (host)"""
)
def host_slots(spark, sf):
    q = c.table(spark, sf, "lineitem").select(F.concat(F.lit("host"), F.col("l_suppkey") % 50).alias("host"), (F.col("l_linenumber") * 4).alias("slots_total"), (F.col("l_quantity").cast("int") % 3).alias("slots_used"), (F.col("l_partkey") % 2).alias("slots_resv"))
    return op.host_slots(q)


@job("SELECT CAST((SELECT sum(c_custkey % 64) FROM customer WHERE c_custkey % 5 <> 0) - (SELECT sum(o_orderkey % 4 + 1) FROM orders) AS BIGINT) AS free")
def cluster_free_slots(spark, sf):
    hosts = c.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "-").otherwise((F.col("c_custkey") % 64).cast("string")).alias("ncpus"))
    k = F.col("o_orderkey")
    jobs = c.table(spark, sf, "orders").select(F.concat((k % 4).cast("string"), F.lit("*a"), k % 9, F.lit(":b"), k % 7).alias("exec_host"))
    return op.cluster_free_slots(hosts, jobs)


def _block(spark, sf):
    return c.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("# comment\nbrand = "), "p_brand", F.lit("\nsize: 0\nsize: "), "p_size", F.lit("\nother ?\nprice  "), F.col("p_partkey") * 3, F.lit("\n")).alias("text"))


@job("SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey * 3 AS VARCHAR) AS price, CAST(NULL AS VARCHAR) AS other FROM part")
def key_value_block(spark, sf):
    return op.key_value_block(_block(spark, sf), "p_partkey", "text", ["brand", "size", "price", "other"])


@job("SELECT p_partkey, CAST(p_size AS INT) AS cores, CAST(p_partkey % 3 AS INT) AS exitcode, p_size * 250000000::BIGINT AS used_cpu_time, p_partkey * 1000000000 AS duration, p_size * 1048576::BIGINT AS max_used_memory, 'n' || p_size AS host, 'all.q' AS queue, 100 AS failed FROM part")
def sge_usage(spark, sf):
    text = F.concat(F.lit("==============\nqname        all.q\nhostname     n"), "p_size", F.lit("\nfailed       100 : assumedly after job\nexit_status  "), F.col("p_partkey") % 3, F.lit("\nru_wallclock "), "p_partkey", F.lit("\nslots        "), "p_size", F.lit("\ncpu          "), F.col("p_size") / 4, F.lit("\nmaxvmem      "), "p_size", F.lit(".000M\n"))
    return op.sge_usage(c.table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey")


@job(
    """WITH p AS (SELECT *, CAST(p_partkey % 256 AS INT) AS rc FROM part)
    SELECT p_partkey, CASE WHEN rc > 128 THEN (255 << 8) | (rc - 128) ELSE rc << 8 END AS termstatus, p_size * 1000000000::BIGINT AS used_cpu_time, (3600 + p_size) * 1000000000::BIGINT AS duration, p_partkey * 1000 AS max_used_memory, p_size * 1000::BIGINT AS max_used_ram, 'short' AS queue FROM p"""
)
def pbs_usage(spark, sf):
    pad = F.lpad(F.col("p_size").cast("string"), 2, "0")
    text = F.concat(F.lit("03/04/2012 10:00:00  S    Job Queued at request of x, job name = j, queue = short\n03/04/2012 10:00:01  S    Job Run at request of y\n03/04/2012 11:00:00  S    Exit_status="), F.col("p_partkey") % 256, F.lit(" resources_used.cput=00:00:"), pad, F.lit(" resources_used.mem="), "p_size", F.lit("kb resources_used.vmem="), "p_partkey", F.lit("kb resources_used.walltime=01:00:"), pad)
    return op.pbs_usage(c.table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey")


@job("SELECT p_partkey, p_size * 500000000::BIGINT AS used_cpu_time, p_size * 3000000::BIGINT AS max_used_memory, 'done' AS status FROM part")
def lsf_usage(spark, sf):
    text = F.concat(F.lit("Job <1>\n     CPU_T     WAIT     TURNAROUND   STATUS     HOG_FACTOR    MEM    SWAP\n      "), F.col("p_size") / 2, F.lit("    5     6     done   0.0049   "), "p_size", F.lit("M   "), F.col("p_size") * 2, F.lit("M\n"))
    return op.lsf_usage(c.table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey")


@job(
    """SELECT p_partkey, p_size * 1000000000::BIGINT + 100000000 AS duration, p_size * 1500000000::BIGINT AS used_cpu_time, p_partkey * 1000 AS max_used_memory,
    CASE WHEN p_partkey % 5 = 0 THEN 15 ELSE 0 END AS signal, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_partkey % 3 END AS INT) AS exitcode FROM part"""
)
def gnu_time_usage(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 5 == 0, "Command terminated by signal 15\n").otherwise(""), F.lit("WallTime="), "p_size", F.lit(".1s\nKernelTime="), (F.col("p_size") / 2), F.lit("s\nUserTime="), "p_size", F.lit("s\nMaxResidentMemory="), k, F.lit("kB\nReturnCode="), F.when(k % 5 == 0, 0).otherwise(k % 3), F.lit("\n"))
    return op.gnu_time_usage(c.table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey")


@job(
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey <> min(o_orderkey) OVER (PARTITION BY o_custkey) AS more FROM orders),
    g AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM l)
    SELECT o_custkey, CAST(line_no AS BIGINT) AS line_no, string_agg('k' || o_orderkey, '' ORDER BY o_orderkey) AS line FROM g GROUP BY 1, 2"""
)
def join_continuation_lines(spark, sf):
    o = c.table(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    more = (F.col("o_orderkey") % 3 != 0) & (F.col("o_orderkey") != F.col("first"))
    lines = o.join(first, "o_custkey").select("o_custkey", "o_orderkey", F.concat(F.when(more, "    k").otherwise("k"), "o_orderkey").alias("text"))
    return op.join_continuation_lines(lines, "o_custkey", "o_orderkey", "text", "    ")


QUERIES, ORACLES = job.queries, job.oracles
