"""Selecting, counting and listing tasks.

A tasks table has task_id, parent_id, jobname, class, state, exitcode, signal, returncode (null while
there is none), submitted, running, terminating and the requested_* columns.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.canonical import STATES

#: States in which a task may be cleaned without force.
REMOVABLE = ("NEW", "TERMINATED", "TERMINATING")


def _checked(states: list[str]) -> list[str]:
    upper = [s.upper() for s in states]
    unknown = sorted(set(upper) - set(STATES))
    if unknown:
        raise ValueError(f"unknown states: {', '.join(unknown)}")
    return upper


def by_state(tasks: DataFrame, states: list[str]) -> DataFrame:
    """Tasks in some of the states; names in any case, unknown names are an error."""
    return tasks.where(F.col("state").isin(_checked(states)))


def matches(column: str, pattern: str) -> Column:
    """Un-anchored match in any case; null never matches."""
    return F.coalesce(F.col(column).cast("string").rlike(f"(?i){pattern}"), F.lit(False))


def by_jobname(tasks: DataFrame, pattern: str) -> DataFrame:
    return tasks.where(matches("jobname", pattern))


def by_jobid(tasks: DataFrame, pattern: str) -> DataFrame:
    return tasks.where(matches("task_id", pattern))


def successful(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("returncode") == 0)


def unsuccessful(tasks: DataFrame) -> DataFrame:
    """Tasks with a return code other than 0; those without one are neither."""
    return tasks.where(F.col("returncode") != 0)


def by_exitcode(tasks: DataFrame, codes: list[int]) -> DataFrame:
    """Tasks with one of the exit codes; an empty list keeps all."""
    return tasks.where(F.col("exitcode").isin(codes)) if codes else tasks


def by_submission_date(tasks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Submitted, or else started, in the closed range; tasks with neither time count as of the epoch."""
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    return tasks.where(F.coalesce("submitted", "running", time(datetime(1970, 1, 1))).between(time(start), time(end)))


def by_message(tasks: DataFrame, logs: DataFrame, pattern: str, id_col: str = "task_id", text_col: str = "text") -> DataFrame:
    """Tasks some line of whose log matches. The expression runs inside the text; lines are never exploded."""
    return tasks.join(logs.where(F.col(text_col).rlike(f"(?m){pattern}")).select(id_col), id_col, "left_semi")


def by_iofile(tasks: DataFrame, name: str, *columns: str) -> DataFrame:
    """Tasks with an input or output path (array columns) whose last part is the name."""
    has = [F.exists(c, lambda p: F.regexp_extract(p, "[^/]*$", 0) == name) for c in columns]
    return tasks.where(F.coalesce(reduce(lambda a, b: a | b, has), F.lit(False)))


def returncode_ok() -> Column:
    return F.col("returncode").eqNullSafe(F.lit(0))


def in_state(tasks: DataFrame, names: list[str]) -> DataFrame:
    """States and the pseudo-states ok and failed; a terminated task without a return code has failed."""
    pseudo = [n for n in names if n in ("ok", "failed")]
    test = F.col("state").isin(_checked([n for n in names if n not in pseudo]))
    ended = F.col("state") == "TERMINATED"
    if "ok" in pseudo:
        test |= ended & returncode_ok()
    if "failed" in pseudo:
        test |= ended & ~returncode_ok()
    return tasks.where(test)


def by_class(tasks: DataFrame, ancestors: DataFrame, wanted: str) -> DataFrame:
    """Tasks of a class or a subclass. `ancestors`: (class, ancestor), each class being its own ancestor."""
    return tasks.join(F.broadcast(ancestors.where(F.col("ancestor") == wanted).select("class").distinct()), "class", "left_semi")


def by_resource_glob(resources: DataFrame, pattern: str) -> DataFrame:
    """Resources whose name matches a pattern of *, ? and plain characters."""
    regex = "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in pattern)
    return resources.where(F.col("resource").rlike(f"^{regex}$"))


def removable_tasks(tasks: DataFrame, force: bool = False) -> DataFrame:
    return tasks if force else tasks.where(F.col("state").isin(*REMOVABLE))


def select_tasks(tasks: DataFrame, *criteria: Column) -> DataFrame:
    """Tasks that satisfy all criteria; null counts as not satisfied. Spark orders them by cost."""
    return tasks.where(reduce(lambda a, b: a & b, criteria, F.lit(True)))


def project_attrs(tasks: DataFrame, paths: list[str], default: str = "N/A") -> DataFrame:
    """Dotted paths, looked up in `execution` first and then in the task, as text; absent or null gives the default.

    A path with a part that starts with _ is hidden.
    """
    def found(path: str, schema) -> bool:
        for part in path.split("."):
            if not hasattr(schema, "fieldNames") or part not in schema.fieldNames():
                return False
            schema = schema[part].dataType
        return True

    out = [F.col("task_id")]
    for path in paths:
        if any(p.startswith("_") for p in path.split(".")):
            continue
        ways = [F.col(f"execution.{path}").cast("string")] if found(f"execution.{path}", tasks.schema) else []
        ways += [F.col(path).cast("string")] if found(path, tasks.schema) else []
        out.append(F.coalesce(*ways, F.lit(default)).alias(path.replace(".", "_")))
    return tasks.select(*out)


def accessor(value: Column, default=None, only: str | None = None) -> Column:
    """A value with a default, limited to tasks of a class."""
    value = F.coalesce(value, F.lit(default)) if default is not None else value
    return F.when(F.col("class") == only, value) if only else value


def task_table(tasks: DataFrame, last_messages: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Id, name, state, last message ('' if none) and chosen attributes of tasks in the (pseudo-)states, by id."""
    part = in_state(tasks, names).join(last_messages.select("task_id", "message"), "task_id", "left")
    return part.select("task_id", "jobname", "state", F.coalesce("message", F.lit("")).alias("info"), *keys).orderBy("task_id")


def resource_table(resources: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    part = resources.where(F.col("resource").isin(only)) if only else resources
    return part.select("resource", *keys).orderBy("resource")


def update_requests(tasks: DataFrame, ids: list[int], cores: int | None = None, memory_per_core: int | None = None, walltime: int | None = None) -> DataFrame:
    """New requests for the given ids; values that are not given stay. Memory is per core times the new cores."""
    ours = F.col("task_id").isin(ids)
    new_cores = F.coalesce(F.lit(cores), F.col("requested_cores")).cast("int")
    memory = F.coalesce(F.lit(memory_per_core).cast("long") * new_cores, F.col("requested_memory"))
    return tasks.select(
        *(c for c in tasks.columns if not c.startswith("requested_")),
        F.when(ours, new_cores).otherwise(F.col("requested_cores")).alias("requested_cores"),
        F.when(ours, memory).otherwise(F.col("requested_memory")).alias("requested_memory"),
        F.when(ours, F.coalesce(F.lit(walltime), F.col("requested_walltime"))).otherwise(F.col("requested_walltime")).cast("int").alias("requested_walltime"),
    )


def _stats() -> Column:
    outcome = F.when(F.col("state") == "TERMINATED", F.when(returncode_ok(), "ok").otherwise("failed"))
    return F.explode(F.array_compact(F.array(F.col("state"), outcome, F.lit("total"))))


def state_counts(tasks: DataFrame) -> DataFrame:
    """(stat, n): tasks per state, and ok, failed and total. At most ten keys, so only partial sums are shuffled."""
    return tasks.select(_stats().alias("stat")).groupBy("stat").agg(F.count("*").alias("n"))


def state_counts_by_class(tasks: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The same for each class; a task counts for all its class's ancestors."""
    counted = tasks.select("class", _stats().alias("stat")).groupBy("class", "stat").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(ancestors), "class").groupBy(F.col("ancestor").alias("class"), "stat").agg(F.sum("n").alias("n"))


def state_percent(tasks: DataFrame) -> DataFrame:
    """(state, n, percent): the share of all tasks, with two decimals."""
    counted = tasks.groupBy("state").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("state", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def collection_exitcode(parents: DataFrame, tasks: DataFrame) -> DataFrame:
    """(parent_id, exitcode): the greatest of the children's; null if all are null, 0 without children."""
    own = tasks.groupBy("parent_id").agg(F.max("exitcode").alias("m"), F.count("*").alias("n"))
    return parents.join(own, "parent_id", "left").select("parent_id", F.when(F.col("n").isNull(), 0).otherwise(F.col("m")).cast("int").alias("exitcode"))


#: States from the one that decides first; a NEW child makes the collection RUNNING.
RANKS = ("STOPPED", "UNKNOWN", "RUNNING", "SUBMITTED", "NEW", "TERMINATING", "TERMINATED")


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), state).cast("int")


def rank_state(rank: Column) -> Column:
    """The state of a collection whose children's least rank is given; no children: TERMINATED."""
    names = ["RUNNING" if s == "NEW" else s for s in RANKS]
    return F.coalesce(F.get(F.array(*map(F.lit, names)), rank - 1), F.lit("TERMINATED"))


def collection_state(parents: DataFrame, tasks: DataFrame) -> DataFrame:
    """(parent_id, state) from the children's states."""
    own = tasks.groupBy("parent_id").agg(F.min(state_rank(F.col("state"))).alias("rank"))
    return parents.join(own, "parent_id", "left").select("parent_id", rank_state(F.col("rank")).alias("state"))


def session_exit_bits(tasks: DataFrame, session: str = "parent_id") -> DataFrame:
    """Per session: 2 if a task failed, 4 if one is active or unknown, 8 if one is new, added up."""
    failed = (F.col("state") == "TERMINATED") & ~returncode_ok()
    bit = lambda test, value: F.when(F.coalesce(F.bool_or(test), F.lit(False)), value).otherwise(0)
    bits = bit(failed, 2) + bit(F.col("state").isin("RUNNING", "SUBMITTED", "UNKNOWN"), 4) + bit(F.col("state") == "NEW", 8)
    return tasks.groupBy(session).agg(bits.cast("int").alias("bits"))


def live_usage(tasks: DataFrame) -> DataFrame:
    """Tasks, cores and memory of tasks that have not ended."""
    zero = F.lit(0).cast("long")
    live = tasks.where(F.col("state") != "TERMINATED")
    return live.agg(F.count("*").alias("tasks"), F.coalesce(F.sum("requested_cores"), zero).alias("cores"), F.coalesce(F.sum(F.coalesce("requested_memory", zero)), zero).alias("memory"))


def new_tasks_only(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose jobname is not known yet; repeats inside the batch stay."""
    return candidates.join(known.select("jobname"), "jobname", "left_anti").select(*candidates.columns)


def merge_outputs(outputs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Output rows of successful tasks only."""
    return outputs.join(successful(tasks).select("task_id"), "task_id", "left_semi")
