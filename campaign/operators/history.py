"""Histories of tasks: messages, transitions, times, retries and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import descendants


def last_message(events: DataFrame) -> DataFrame:
    """(task_id, message): the last by time and sequence number; '' where it is null. No sort is needed."""
    return events.groupBy("task_id").agg(F.coalesce(F.max_by("message", F.struct("ts", "seq")), F.lit("")).alias("message"))


def state_transitions(events: DataFrame) -> DataFrame:
    """(task_id, seq, ts, from_state, to_state, text): changes only; a repeated state is none.

    The text of a change to TERMINATED ends with the event's return code, `None` where it has none.
    """
    w = Window.partitionBy("task_id").orderBy("ts", "seq")
    code = F.col("returncode").cast("string") if "returncode" in events.columns else F.lit(None).cast("string")
    moved = events.where(F.col("state").isNotNull()).select("task_id", "seq", "ts", F.lag("state").over(w).alias("from_state"), F.col("state").alias("to_state"), code.alias("code_"))
    end = F.when(F.col("to_state") == "TERMINATED", F.concat(F.lit(" (returncode: "), F.coalesce("code_", F.lit("None")), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("Transition from state "), "from_state", F.lit(" to state "), "to_state", end)
    return moved.where(F.col("from_state") != F.col("to_state")).withColumn("text", text).drop("code_")


def state_timestamps(events: DataFrame, states: list[str]) -> DataFrame:
    """One row per task with the last time that each state was reached."""
    return events.groupBy("task_id").agg(*(F.max(F.when(F.col("state") == s, F.col("ts"))).alias(s.lower()) for s in states))


def lifetimes(tasks: DataFrame) -> DataFrame:
    """Times of successful tasks that were submitted and ran; finished is the time of TERMINATING. Waits in seconds."""
    good = tasks.where((F.col("returncode") == 0) & F.col("submitted").isNotNull() & F.col("running").isNotNull())
    gap = lambda a, b: F.unix_seconds(F.col(a).cast("timestamp")) - F.unix_seconds(F.col(b).cast("timestamp"))
    return good.select("task_id", "submitted", "running", F.col("terminating").alias("finished"), gap("running", "submitted").alias("wait_time"), gap("terminating", "running").alias("exec_time"))


def session_log(events: DataFrame, members: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """All messages of the member tasks and, with a tree (task_id, parent_id), of all tasks nested in them, in time order."""
    whole = members.select("task_id") if tree is None else descendants(tree, members.select("task_id").distinct()).select("task_id")
    return events.join(whole, "task_id", "left_semi").select("ts", "seq", "task_id", "message").orderBy("ts", "seq")


def tail_lines(logs: DataFrame, n: int, id_col: str = "task_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): the last n lines of each log, numbered from 0; the slice is taken before lines become rows."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\n$", ""), "\n")
    cut = logs.select(id_col, lines.alias("lines"))
    first = F.greatest(F.lit(0), F.size("lines") - n)
    return cut.select(id_col, first.alias("first"), F.posexplode_outer(F.slice("lines", first + 1, n)).alias("k", "line")).select(id_col, (F.col("first") + F.col("k")).cast("long").alias("line_no"), "line")


def retry_outcome(attempts: DataFrame, most: int, again: Column | None = None) -> DataFrame:
    """(group_id, returncode, retries, done): attempts in order, again while `again` holds and retries are left (most = 0: forever).

    `again` is a predicate over an attempt, by default that it did not succeed; where it is null, there is no further attempt. The
    first attempt that ends the series and the last allowed one come from one aggregation, without a window.
    """
    limit = F.lit(2**31 - 1) if most == 0 else F.lit(most)
    ends = ~F.col("returncode").eqNullSafe(F.lit(0)) if again is None else again
    at = F.when(~F.coalesce(ends, F.lit(False)), F.col("step"))
    used = attempts.where(F.col("step") <= limit)
    agg = used.groupBy("group_id").agg(F.min(at).alias("good"), F.min_by("returncode", at).alias("good_rc"), F.max_by("returncode", "step").alias("last_rc"), F.max("step").alias("last"))
    done = F.col("good").isNotNull() | (F.col("last") >= limit)
    return agg.select("group_id", F.when(F.col("good").isNotNull(), F.col("good_rc")).otherwise(F.col("last_rc")).cast("int").alias("returncode"), F.coalesce("good", "last").alias("retries"), done.alias("done"))


def sequence_outcome(steps: DataFrame, policy: str) -> DataFrame:
    """(group_id, steps_run, state, returncode): `plain` runs all, `abort` and `stop` end at the first failure.

    After `stop` the sequence is STOPPED unless the failed step was its last.
    """
    if policy not in ("plain", "abort", "stop"):
        raise ValueError(policy)
    bad = F.min(F.when(F.col("returncode") != 0, F.struct("step", "returncode")))
    agg = steps.groupBy("group_id").agg(bad.alias("bad"), F.max(F.struct("step", "returncode")).alias("last"))
    end = F.col("last") if policy == "plain" else F.coalesce("bad", "last")
    halted = (end["step"] < F.col("last.step")) & F.lit(policy == "stop")
    return agg.select("group_id", (end["step"] + 1).alias("steps_run"), F.when(halted, "STOPPED").otherwise("TERMINATED").alias("state"), end["returncode"].alias("returncode"))


def staged_outcome(steps: DataFrame, stop_code: Column) -> DataFrame:
    """Like sequence_outcome, where a step for which stop_code is not null ends the sequence with that code instead of running."""
    marked = steps.withColumn("code", stop_code)
    agg = marked.groupBy("group_id").agg(F.min(F.when(F.col("code").isNotNull(), F.struct("step", "code"))).alias("halt"), F.max(F.struct("step", "returncode")).alias("last"))
    return agg.select("group_id", F.coalesce(F.col("halt.step"), F.col("last.step") + 1).alias("steps_run"), F.coalesce("halt.code", "last.returncode").cast("int").alias("returncode"))


def best_so_far(values: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The least value up to each row of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return values.select(key, order, value, F.min(value).over(w).alias("best"))


def switch_indicator(combinations: DataFrame, run: str, index: str, key: str | None = None) -> DataFrame:
    """0 where the index differs from that of the previous combination, or is the first; else 1."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(run)
    return combinations.withColumn("switch", F.when(F.lag(index).over(w).eqNullSafe(F.col(index)), 1).otherwise(0))


def latest_restart(files: DataFrame, key: str, path: str) -> DataFrame:
    """The path with the greatest number at its end, by key; files without a number are left out."""
    number = F.regexp_extract(path, r"(\d+)$", 1)
    numbered = files.where(number != "").withColumn("n_", number.cast("long"))
    return numbered.groupBy(key).agg(F.max_by(path, F.struct("n_", path)).alias(path), F.max("n_").alias("number"))


def missing_replicates(wanted: DataFrame, existing: DataFrame, keys: list[str], requested: int) -> DataFrame:
    """The keys with replicate = existing + 1 .. requested, for sets that have fewer."""
    have = existing.groupBy(*keys).agg(F.count("*").alias("have"))
    part = wanted.join(have, keys, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return part.where(F.col("have") < requested).select(*keys, F.explode(F.sequence(F.col("have") + 1, F.lit(requested).cast("long"))).alias("replicate"))


def lost_tasks(checks: DataFrame, delay: str) -> DataFrame:
    """(task_id, since): tasks whose checks have failed since before the delay, seen from the last check of all; since is the first failed check after the last good one."""
    bad = F.col("state").isNull()
    now = checks.agg(F.max("ts").alias("now"))
    last_good = checks.groupBy("task_id").agg(F.max(F.when(~bad, F.col("ts"))).alias("good"))
    after = checks.where(bad).join(last_good, "task_id").where(F.col("good").isNull() | (F.col("ts") > F.col("good")))
    since = after.groupBy("task_id").agg(F.min("ts").alias("since")).join(F.broadcast(now))
    return since.where(F.col("now") >= F.col("since") + F.expr(f"INTERVAL {delay}")).select("task_id", "since")
