"""Jobs on task tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import commands
from ..operators import tasks as op
from ..sources import canonical as c
from ..sources.merged import join_parts, read_document, write_parts
from ..sources.scratch import new_folder
from .base import Jobs

job = Jobs()
T = c.with_("tasks")
ALL = "task_id, state, returncode"
#: class -> ancestors: each priority class, and `any` above all.
ANCESTORS = "ancestors AS (SELECT DISTINCT class, class AS ancestor FROM tasks UNION ALL SELECT DISTINCT class, 'any' FROM tasks)"


def _ancestors(tasks):
    kinds = tasks.select("class").distinct()
    return kinds.select("class", F.explode(F.array("class", F.lit("any"))).alias("ancestor"))


def _brief(df):
    return df.select("task_id", "state", "returncode")


@job(T + f"SELECT {ALL} FROM tasks WHERE state IN ('RUNNING','STOPPED')")
def by_state(spark, sf):
    return _brief(op.by_state(c.tasks(spark, sf), ["running", "Stopped"]))


@job(T + f"SELECT {ALL} FROM tasks WHERE regexp_matches(jobname, '(?i)RUN_1[0-9]#')")
def by_jobname(spark, sf):
    return _brief(op.by_jobname(c.tasks(spark, sf), "RUN_1[0-9]#"))


@job(T + f"SELECT {ALL} FROM tasks WHERE regexp_matches(CAST(task_id AS VARCHAR), '77$')")
def by_jobid(spark, sf):
    return _brief(op.by_jobid(c.tasks(spark, sf), "77$"))


@job(T + f"SELECT {ALL} FROM tasks WHERE returncode = 0")
def successful(spark, sf):
    return _brief(op.successful(c.tasks(spark, sf)))


@job(T + f"SELECT {ALL} FROM tasks WHERE returncode <> 0")
def unsuccessful(spark, sf):
    return _brief(op.unsuccessful(c.tasks(spark, sf)))


@job(T + f"SELECT {ALL} FROM tasks WHERE exitcode IN (1, 2)")
def by_exitcode(spark, sf):
    return _brief(op.by_exitcode(c.tasks(spark, sf), [1, 2]))


@job(T + f"SELECT {ALL} FROM tasks WHERE coalesce(submitted, running, TIMESTAMP '1970-01-01') BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def by_submission_date(spark, sf):
    return _brief(op.by_submission_date(c.tasks(spark, sf), datetime(1995, 1, 1), datetime(1996, 12, 31)))


@job(T + f"SELECT {ALL} FROM tasks WHERE task_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '(?m)^The '))")
def by_message(spark, sf):
    logs = c.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), "text")
    return _brief(op.by_message(c.tasks(spark, sf), logs, "^The "))


@job("SELECT l_orderkey AS task_id, count(*) AS n FROM lineitem WHERE 'part' || (l_partkey % 40) || '.dat' = 'part7.dat' OR 'supp' || (l_suppkey % 9) || '.out' = 'part7.dat' GROUP BY 1")
def by_iofile(spark, sf):
    item = c.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        F.array(F.concat(F.lit("/data/in/part"), F.col("l_partkey") % 40, F.lit(".dat"))).alias("inputs"),
        F.array(F.concat(F.lit("out/supp"), F.col("l_suppkey") % 9, F.lit(".out"))).alias("outputs"),
    )
    return op.by_iofile(item, "part7.dat", "inputs", "outputs").groupBy("task_id").agg(F.count("*").alias("n"))


@job(T + f"SELECT {ALL} FROM tasks WHERE state = 'NEW' OR (state = 'TERMINATED' AND returncode IS DISTINCT FROM 0)")
def in_state(spark, sf):
    return _brief(op.in_state(c.tasks(spark, sf), ["NEW", "failed"]))


@job(c.with_("tasks") + f", {ANCESTORS} SELECT {ALL} FROM tasks WHERE class IN (SELECT class FROM ancestors WHERE ancestor = '1-URGENT')")
def by_class(spark, sf):
    tasks = c.tasks(spark, sf)
    return _brief(op.by_class(tasks, _ancestors(tasks), "1-URGENT"))


@job("SELECT s_name AS resource FROM supplier WHERE regexp_matches(s_name, '^Supplier.*1.$')")
def by_resource_glob(spark, sf):
    return op.by_resource_glob(c.resources(spark, sf), "Supplier*1?").select("resource")


@job(T + f"SELECT {ALL} FROM tasks WHERE state IN ('NEW','TERMINATED','TERMINATING')")
def removable_tasks(spark, sf):
    return _brief(op.removable_tasks(c.tasks(spark, sf)))


@job(T + f"SELECT {ALL} FROM tasks WHERE state = 'TERMINATED' AND exitcode IN (0, 1) AND submitted >= TIMESTAMP '1995-06-01' AND regexp_matches(jobname, '#.*5')")
def select_tasks(spark, sf):
    tests = [F.col("state") == "TERMINATED", F.col("exitcode").isin(0, 1), F.col("submitted") >= F.lit(datetime(1995, 6, 1)).cast("timestamp_ntz"), op.matches("jobname", "#.*5")]
    return _brief(op.select_tasks(c.tasks(spark, sf), *tests))


@job(T + "SELECT task_id, coalesce(CAST(exitcode AS VARCHAR), 'N/A') AS exitcode, jobname, coalesce(CAST(returncode AS VARCHAR), 'N/A') AS returncode, 'N/A' AS queue FROM tasks")
def project_attrs(spark, sf):
    tasks = c.tasks(spark, sf)
    nested = tasks.select("task_id", "jobname", F.struct("exitcode", "returncode").alias("execution"))
    return op.project_attrs(nested, ["exitcode", "jobname", "returncode", "queue", "_hidden"])


@job(T + "SELECT task_id, CASE WHEN class = '5-LOW' THEN coalesce(exitcode, -1) END AS value FROM tasks")
def accessor(spark, sf):
    return c.tasks(spark, sf).select("task_id", op.accessor(F.col("exitcode"), -1, "5-LOW").alias("value"))


@job(
    c.with_("tasks", "task_events")
    + """, last AS (SELECT task_id, arg_max(message, (ts, seq)) AS message FROM task_events GROUP BY 1)
    SELECT task_id, jobname, state, coalesce(message, '') AS info, requested_cores FROM tasks LEFT JOIN last USING (task_id)
    WHERE state = 'RUNNING' OR (state = 'TERMINATED' AND returncode = 0)"""
)
def task_table(spark, sf):
    from ..operators.history import last_message

    return op.task_table(c.tasks(spark, sf), last_message(c.task_events(spark, sf)), ["RUNNING", "ok"], "requested_cores")


@job(c.with_("resources") + "SELECT resource, enabled, max_cores_per_job, free_slots FROM resources")
def resource_table(spark, sf):
    return op.resource_table(c.resources(spark, sf), ["enabled", "max_cores_per_job", "free_slots"])


@job(
    T
    + """SELECT task_id, CASE WHEN task_id IN (1, 2, 3, 4, 5) THEN 4 ELSE requested_cores END AS requested_cores,
    CASE WHEN task_id IN (1, 2, 3, 4, 5) THEN 8000 ELSE requested_memory END AS requested_memory, requested_walltime FROM tasks"""
)
def update_requests(spark, sf):
    done = op.update_requests(c.tasks(spark, sf), [1, 2, 3, 4, 5], cores=4, memory_per_core=2000)
    return done.select("task_id", "requested_cores", "requested_memory", "requested_walltime")


STATS = "stats AS (SELECT class, unnest(list_filter([state, CASE WHEN state = 'TERMINATED' THEN CASE WHEN returncode IS NOT DISTINCT FROM 0 THEN 'ok' ELSE 'failed' END END, 'total'], lambda x: x IS NOT NULL)) AS stat FROM tasks)"


@job(T + f", {STATS} SELECT stat, count(*) AS n FROM stats GROUP BY 1")
def state_counts(spark, sf):
    return op.state_counts(c.tasks(spark, sf))


@job(T + f", {STATS}, {ANCESTORS} SELECT ancestor AS class, stat, count(*) AS n FROM stats JOIN ancestors USING (class) GROUP BY 1, 2")
def state_counts_by_class(spark, sf):
    tasks = c.tasks(spark, sf)
    return op.state_counts_by_class(tasks, _ancestors(tasks))


@job(T + "SELECT state, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS percent FROM tasks GROUP BY 1")
def state_percent(spark, sf):
    return op.state_percent(c.tasks(spark, sf))


@job(T + "SELECT c_custkey AS parent_id, CASE WHEN count(task_id) = 0 THEN 0 ELSE max(exitcode) END AS exitcode FROM customer LEFT JOIN tasks ON parent_id = c_custkey GROUP BY 1")
def collection_exitcode(spark, sf):
    return op.collection_exitcode(c.table(spark, sf, "customer").select(F.col("c_custkey").alias("parent_id")), c.tasks(spark, sf))


RANK = "list_position(['STOPPED','UNKNOWN','RUNNING','SUBMITTED','NEW','TERMINATING','TERMINATED'], state)"
NAMES = "['STOPPED','UNKNOWN','RUNNING','SUBMITTED','RUNNING','TERMINATING','TERMINATED']"


@job(T + f"SELECT c_custkey AS parent_id, coalesce({NAMES}[min({RANK})], 'TERMINATED') AS state FROM customer LEFT JOIN tasks ON parent_id = c_custkey GROUP BY 1")
def collection_state(spark, sf):
    return op.collection_state(c.table(spark, sf, "customer").select(F.col("c_custkey").alias("parent_id")), c.tasks(spark, sf))


@job(
    T
    + """SELECT parent_id, CAST(CASE WHEN bool_or(state = 'TERMINATED' AND returncode IS DISTINCT FROM 0) THEN 2 ELSE 0 END + CASE WHEN bool_or(state IN ('RUNNING','SUBMITTED','UNKNOWN')) THEN 4 ELSE 0 END
    + CASE WHEN bool_or(state = 'NEW') THEN 8 ELSE 0 END AS INT) AS bits FROM tasks GROUP BY 1"""
)
def session_exit_bits(spark, sf):
    return op.session_exit_bits(c.tasks(spark, sf))


@job(T + "SELECT count(*) AS tasks, CAST(sum(requested_cores) AS BIGINT) AS cores, CAST(sum(requested_memory) AS BIGINT) AS memory FROM tasks WHERE state <> 'TERMINATED'")
def live_usage(spark, sf):
    return op.live_usage(c.tasks(spark, sf))


@job(T + "SELECT task_id, jobname FROM tasks WHERE jobname NOT IN (SELECT jobname FROM tasks WHERE state = 'TERMINATED')")
def new_tasks_only(spark, sf):
    tasks = c.tasks(spark, sf)
    return op.new_tasks_only(tasks.select("task_id", "jobname"), op.by_state(tasks, ["TERMINATED"]))


@job(T + "SELECT l_orderkey AS task_id, l_linenumber AS line, l_quantity AS value FROM lineitem WHERE l_orderkey IN (SELECT task_id FROM tasks WHERE returncode = 0)")
def merge_outputs(spark, sf):
    out = c.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("value"))
    return op.merge_outputs(out, c.tasks(spark, sf))


@job(T + "SELECT l_orderkey AS task_id, l_linenumber AS line, sum(l_quantity) AS value FROM lineitem WHERE l_orderkey IN (SELECT task_id FROM tasks WHERE returncode = 0) GROUP BY 1, 2")
def merged_document(spark, sf):
    """Outputs of successful tasks merged into one XML document, which is read back."""
    out = c.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("line")).agg(F.sum("l_quantity").alias("value"))
    path = new_folder(spark, "document")
    write_parts(op.merge_outputs(out, c.tasks(spark, sf)), f"{path}/parts", ["task_id", "line"])
    join_parts(spark, f"{path}/parts", f"{path}/merged.xml")
    return read_document(spark, f"{path}/merged.xml", "task_id long, line int, value double")


@job("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey * 2 AS VARCHAR) ELSE '' END AS stdout, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END AS exitcode FROM customer")
def run_command(spark, sf):
    """A shell program that doubles numbers, kept for the records of a task; it ends with exit code 3 at every seventh and is started again."""
    program = "while read x; do [ $((x % 7)) = 0 ] && exit 3; echo $((x * 2)); done"
    done = commands.run_command(c.table(spark, sf, "customer").select("c_custkey"), ["/bin/sh", "-c", program], "c_custkey", 60, keep=True, parts=4 * spark.sparkContext.defaultParallelism)
    return done.select("c_custkey", "stdout", "exitcode")


QUERIES, ORACLES = job.queries, job.oracles
