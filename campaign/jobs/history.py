"""Jobs on task histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as op
from ..sources import canonical as c
from .base import Jobs

job = Jobs()
E = c.with_("task_events")
S = c.with_("steps")


@job(E + "SELECT task_id, coalesce(arg_max(message, (ts, seq)), '') AS message FROM task_events GROUP BY 1")
def last_message(spark, sf):
    return op.last_message(c.task_events(spark, sf))


@job(
    E
    + """, m AS (SELECT task_id, seq, ts, lag(state) OVER (PARTITION BY task_id ORDER BY ts, seq) AS from_state, state AS to_state FROM task_events WHERE state IS NOT NULL)
    SELECT *, 'Transition from state ' || from_state || ' to state ' || to_state || CASE WHEN to_state = 'TERMINATED' THEN ' (returncode: ' || CASE WHEN seq % 5 = 0 THEN 'None' ELSE CAST(seq % 3 AS VARCHAR) END || ')' ELSE '' END AS text
    FROM m WHERE from_state <> to_state"""
)
def state_transitions(spark, sf):
    return op.state_transitions(c.task_events(spark, sf).withColumn("returncode", F.when(F.col("seq") % 5 != 0, F.col("seq") % 3)))


@job(E + "SELECT task_id, max(CASE WHEN state = 'NEW' THEN ts END) AS new, max(CASE WHEN state = 'RUNNING' THEN ts END) AS running, max(CASE WHEN state = 'TERMINATED' THEN ts END) AS terminated FROM task_events GROUP BY 1")
def state_timestamps(spark, sf):
    return op.state_timestamps(c.task_events(spark, sf), ["NEW", "RUNNING", "TERMINATED"])


@job(
    c.with_("tasks")
    + """SELECT task_id, submitted, running, terminating AS finished, CAST(epoch(running) - epoch(submitted) AS BIGINT) AS wait_time, CAST(epoch(terminating) - epoch(running) AS BIGINT) AS exec_time
    FROM tasks WHERE returncode = 0 AND submitted IS NOT NULL AND running IS NOT NULL"""
)
def lifetimes(spark, sf):
    return op.lifetimes(c.tasks(spark, sf))


_NESTED = E + """, tree AS (SELECT DISTINCT task_id, task_id // 4 AS parent_id FROM task_events WHERE task_id > 0), top AS (SELECT r_regionkey + 1 AS task_id FROM region),
    nested AS (SELECT CAST(task_id AS BIGINT) AS task_id FROM top UNION SELECT t.task_id FROM nested n JOIN tree t ON t.parent_id = n.task_id)
    SELECT ts, seq, task_id, message FROM task_events WHERE task_id IN (SELECT task_id FROM nested)"""


@job(_NESTED)
def session_log(spark, sf):
    """A session of a task per region, each with the tasks nested in it: task k is part of task k / 4."""
    events = c.task_events(spark, sf)
    tree = events.where("task_id > 0").select("task_id", F.floor(F.col("task_id") / 4).cast("long").alias("parent_id")).distinct()
    return op.session_log(events, c.table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("long").alias("task_id")), tree)


@job(
    """WITH l AS (SELECT doc_id AS task_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents)
    SELECT task_id, unnest(range(greatest(0, len(lines) - 3), len(lines))) AS line_no, unnest(lines[greatest(0, len(lines) - 3) + 1:]) AS line FROM l"""
)
def tail_lines(spark, sf):
    return op.tail_lines(c.table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"), "text"), 3)


@job(
    S
    + """, a AS (SELECT group_id, min(step) FILTER (returncode = 0) AS good, arg_max(returncode, step) AS rc, max(step) AS last FROM steps WHERE step <= 2 GROUP BY 1)
    SELECT group_id, CASE WHEN good IS NOT NULL THEN 0 ELSE rc END AS returncode, coalesce(good, last) AS retries, good IS NOT NULL OR last >= 2 AS done FROM a"""
)
def retry_outcome(spark, sf):
    return op.retry_outcome(c.steps(spark, sf), 2)


@job(
    S
    + """, a AS (SELECT group_id, min(step) FILTER (returncode % 2 = 0) AS good, arg_min(returncode, step) FILTER (returncode % 2 = 0) AS good_rc, arg_max(returncode, step) AS rc, max(step) AS last FROM steps GROUP BY 1)
    SELECT group_id, coalesce(good_rc, rc) AS returncode, coalesce(good, last) AS retries, good IS NOT NULL AS done FROM a"""
)
def retry_by_code(spark, sf):
    """Tried again without limit, but only after odd return codes."""
    return op.retry_outcome(c.steps(spark, sf), 0, F.col("returncode") % 2 == 1)


def _sequence(policy: str) -> str:
    end = "last" if policy == "plain" else "coalesce(bad, last)"
    state = f"CASE WHEN {end} < last THEN 'STOPPED' ELSE 'TERMINATED' END" if policy == "stop" else "'TERMINATED'"
    return S + f""", a AS (SELECT group_id, min(step) FILTER (returncode <> 0) AS bad, max(step) AS last FROM steps GROUP BY 1)
    SELECT a.group_id, {end} + 1 AS steps_run, {state} AS state, returncode FROM a JOIN steps s ON s.group_id = a.group_id AND s.step = {end}"""


@job(_sequence("plain"))
def sequence_outcome(spark, sf):
    return op.sequence_outcome(c.steps(spark, sf), "plain")


@job(_sequence("abort"))
def sequence_outcome_abort(spark, sf):
    return op.sequence_outcome(c.steps(spark, sf), "abort")


@job(_sequence("stop"))
def sequence_outcome_stop(spark, sf):
    return op.sequence_outcome(c.steps(spark, sf), "stop")


@job(
    S
    + """, a AS (SELECT group_id, min(step) FILTER (returncode = 2) AS halt, max(step) AS last, arg_max(returncode, step) AS rc FROM steps GROUP BY 1)
    SELECT group_id, coalesce(halt, last + 1) AS steps_run, CASE WHEN halt IS NOT NULL THEN 7 ELSE rc END AS returncode FROM a"""
)
def sequence_outcome_staged(spark, sf):
    return op.staged_outcome(c.steps(spark, sf), F.when(F.col("returncode") == 2, 7))


@job("SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def best_so_far(spark, sf):
    return op.best_so_far(c.table(spark, sf, "events"), "user_id", "event_id", "value")


@job(
    """SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT DISTINCT FROM o_orderpriority
    THEN 1 ELSE 0 END AS switch FROM orders"""
)
def switch_indicator(spark, sf):
    part = c.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return op.switch_indicator(part, "o_orderkey", "o_orderpriority", "o_custkey")


@job(
    """WITH f AS (SELECT o_custkey AS run, 'restart.' || (o_orderkey % 1000) AS path, o_orderkey % 1000 AS n FROM orders)
    SELECT run, arg_max(path, (n, path)) AS path, max(n) AS number FROM f GROUP BY 1"""
)
def latest_restart(spark, sf):
    files = c.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.lit("restart."), F.col("o_orderkey") % 1000).alias("path"))
    return op.latest_restart(files, "run", "path")


@job(
    """WITH w AS (SELECT DISTINCT p_brand, p_size FROM part), h AS (SELECT p_brand, p_size, count(*) AS have FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
    x AS (SELECT w.*, coalesce(have, 0) AS have FROM w LEFT JOIN h USING (p_brand, p_size))
    SELECT p_brand, p_size, unnest(range(have + 1, 6)) AS replicate FROM x WHERE have < 5"""
)
def missing_replicates(spark, sf):
    part = c.table(spark, sf, "part").select("p_brand", "p_size", "p_partkey")
    return op.missing_replicates(part.select("p_brand", "p_size").distinct(), part.where("p_partkey % 3 = 0"), ["p_brand", "p_size"], 5)


LOST = """WITH k AS (SELECT user_id AS task_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS state FROM events),
    g AS (SELECT task_id, max(ts) FILTER (state IS NOT NULL) AS good FROM k GROUP BY 1),
    s AS (SELECT task_id, min(ts) AS since FROM k JOIN g USING (task_id) WHERE state IS NULL AND (good IS NULL OR ts > good) GROUP BY 1)
    SELECT task_id, since FROM s WHERE (SELECT max(ts) FROM k) >= since + INTERVAL 1 HOUR"""


@job(LOST)
def lost_tasks(spark, sf):
    e = c.table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"))
    return op.lost_tasks(e, "1 HOUR")


QUERIES, ORACLES = job.queries, job.oracles
