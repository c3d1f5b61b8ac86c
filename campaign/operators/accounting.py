"""Accounting records: one usage row per job from the raw text of batch systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as f

#: Final states of a master record, the exit code of a temporary failure, the signals of a kill and of a broken node.
FINAL_STATES = ("BOOT_FAIL", "CANCELLED", "COMPLETED", "FAILED", "NODE_FAIL", "PREEMPTED", "TIMEOUT")
TEMPORARY_FAILURE, REMOTE_KILL, REMOTE_ERROR = 75, 122, 124
SLURM_FIELDS = ("jobid", "exit", "state", "ncpus", "elapsed", "totalcpu", "submit", "start", "end", "maxrss", "maxvmsize")


def slurm_usage(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row per job from `jobid|exit:signal|state|...|` lines; steps have a dot in their id.

    Jobs without a master record in a final state are left out. All roll-ups are max or min, so an
    array job with very many steps is reduced before the shuffle. Lines are cut up once; empty ones are
    masters without a state, so they need no test of their own, which would make the line a second time.
    """
    cells = F.split(F.trim(line), r"\|")
    raw = lines.select(*(F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(SLURM_FIELDS)), F.get(cells, F.lit(0)).contains(".").alias("step"))
    time = lambda c: F.when(F.length(c) == 19, F.col(c).try_cast("timestamp_ntz"))
    step = F.col("step")
    code = lambda k: F.split_part("exit", F.lit(":"), F.lit(k)).try_cast("int")
    # states and exits are numbers, since a greatest text would need a sort. A field is parsed only in the records whose value counts, since steps are many and parsing is what costs
    of_master, of_step = (lambda x: F.when(~step, x)), (lambda x: F.when(step, x))
    part = raw.select(
        F.substring_index("jobid", ".", 1).alias("job"), step, of_master(F.array_position(F.array(*map(F.lit, FINAL_STATES)), F.split_part("state", F.lit(" "), F.lit(1)))).alias("state"), of_master(code(1)).alias("code"), of_master(code(2)).alias("signal"),
        of_master(F.col("ncpus").try_cast("int")).alias("ncpus"), of_master(f.parse_elapsed(F.col("elapsed"))).alias("elapsed"), of_master(f.parse_elapsed(F.col("totalcpu"))).alias("totalcpu"),
        time("submit").alias("submit"), time("start").alias("start"), of_master(time("end")).alias("end"),
        of_step(f.parse_suffixed_memory(F.col("maxrss"), f.SLURM_MEMORY)).alias("rss"), of_step(f.parse_suffixed_memory(F.col("maxvmsize"), f.SLURM_MEMORY)).alias("vmem"),
    )
    master = lambda c: F.max(F.when(~F.col("step"), F.col(c)))
    of_steps = lambda agg, c: agg(F.when(F.col("step"), F.col(c)))
    zero = F.lit(0).cast("long")
    jobs = part.groupBy("job").agg(
        master("state").alias("state"), master("code").alias("code"), master("signal").alias("own_signal"), master("ncpus").alias("cores"), master("elapsed").alias("duration"), master("totalcpu").alias("used_cpu_time"),
        F.coalesce(of_steps(F.max, "vmem"), zero).alias("max_used_memory"), F.coalesce(of_steps(F.max, "rss"), zero).alias("max_used_ram"),
        master("submit").alias("m_submit"), master("start").alias("m_start"), master("end").alias("m_end"), of_steps(F.min, "submit").alias("s_submit"), of_steps(F.min, "start").alias("s_start"),
    ).where("state > 0")
    is_ = lambda *names: F.col("state").isin([FINAL_STATES.index(n) + 1 for n in names])
    killed, broken = is_("CANCELLED", "TIMEOUT"), is_("NODE_FAIL")
    exitcode = F.when(killed | broken, TEMPORARY_FAILURE).otherwise(F.col("code"))
    signal = F.when(killed, REMOTE_KILL).when(broken, REMOTE_ERROR).otherwise(F.col("own_signal"))
    return jobs.select(
        "job", exitcode.alias("exitcode"), signal.alias("signal"), f.encode_returncode(exitcode, signal).alias("termstatus"), "cores", "duration", "used_cpu_time", "max_used_memory", "max_used_ram",
        F.least("m_submit", "m_start", "s_submit").alias("submission_time"), F.least("m_end", "s_start").alias("start_time"), F.greatest("m_submit", "m_start", "m_end").alias("completion_time"),
    )


def queue_counts(jobs: DataFrame, user: str = "user", state: str = "state") -> DataFrame:
    """(user, running, queued) by user and, with a null user, in total."""
    counts = jobs.groupingSets([[F.col(user)], []], F.col(user)) if hasattr(jobs, "groupingSets") else jobs.rollup(user)
    return counts.agg(F.count_if(F.col(state) == "RUNNING").alias("running"), F.count_if(F.col(state) == "SUBMITTED").alias("queued"))


def host_slots(queues: DataFrame) -> DataFrame:
    """(host, total, unavailable, available) of hosts that are in several queues, and their sums under `global`."""
    host = queues.groupBy("host").agg(F.max("slots_total").alias("total"), F.max(F.col("slots_used") + F.col("slots_resv")).alias("unavailable"))
    host = host.withColumn("available", F.col("total") - F.col("unavailable"))
    both = host.rollup("host").agg(*(F.sum(c).alias(c) for c in ("total", "unavailable", "available")))
    return both.withColumn("host", F.coalesce("host", F.lit("global")))


def cluster_free_slots(hosts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(free,): cores of all hosts, those that are no numbers left out, less the cores that jobs use on all their hosts (`n*host:m*host`)."""
    total = hosts.agg(F.coalesce(F.sum(F.col("ncpus").try_cast("long")), F.lit(0).cast("long")).alias("total"))
    one = F.explode(F.split("exec_host", ":")).alias("h")
    cores = F.when(F.col("h").contains("*"), F.split_part("h", F.lit("*"), F.lit(1)).try_cast("long")).otherwise(1)
    used = jobs.select(one).where("h <> ''").agg(F.coalesce(F.sum(cores), F.lit(0).cast("long")).alias("used"))
    return total.join(F.broadcast(used)).select((F.col("total") - F.col("used")).alias("free"))


def key_value_block(texts: DataFrame, key: str, text: str, wanted: list[str], comment: str = "#") -> DataFrame:
    """Lines `key = value`, `key: value` or `key value` as columns; the last of repeated keys counts, `?` is null."""
    pattern = r"^\s*([A-Za-z_][\w.]*)\s*(?:[=:]|\s)\s*(.*?)\s*$"
    lines = texts.select(key, F.posexplode_outer(F.split(text, "\n")).alias("n", "line")).where(~F.col("line").startswith(comment))
    pairs = lines.select(key, "n", F.regexp_extract("line", pattern, 1).alias("k"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("?")).alias("v"))
    return pairs.groupBy(key).agg(*(F.max_by(F.when(F.col("k") == w, F.col("v")), F.when(F.col("k") == w, F.col("n"))).alias(w) for w in wanted))


def _line(text: str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?m){pattern}", group), F.lit(""))


def sge_usage(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Common fields from the `key value` lines of one job's record each."""
    v = lambda k: _line(text, rf"^{k}\s+(.*?)\s*$")
    return records.select(
        key, v("slots").try_cast("int").alias("cores"), F.coalesce(v("exit_status").try_cast("int"), F.lit(None)).alias("exitcode"),
        F.round(v("cpu").try_cast("double") * 1e9).cast("long").alias("used_cpu_time"), F.round(v("ru_wallclock").try_cast("double") * 1e9).cast("long").alias("duration"),
        f.parse_suffixed_memory(v("maxvmem"), f.SGE_MEMORY).alias("max_used_memory"), v("hostname").alias("host"), v("qname").alias("queue"),
        F.split_part(v("failed"), F.lit(" "), F.lit(1)).try_cast("int").alias("failed"),
    )


def pbs_usage(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Common fields from one job's dated log lines; the exit status is a shell's."""
    last = lambda k: _line(text, rf"Exit_status=.*?{k}=(\S+)")
    signal, code = f.shell_exit(_line(text, r"Exit_status=(\d+)").try_cast("int"))
    return records.select(
        key, f.encode_returncode(code, signal).alias("termstatus"), f.parse_duration(last("resources_used.cput")).alias("used_cpu_time"), f.parse_duration(last("resources_used.walltime")).alias("duration"),
        f.parse_suffixed_memory(last("resources_used.vmem"), f.PBS_MEMORY).alias("max_used_memory"), f.parse_suffixed_memory(last("resources_used.mem"), f.PBS_MEMORY).alias("max_used_ram"),
        _line(text, r"queue =\s*([^,\n]+)").alias("queue"),
    )


def lsf_usage(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """CPU time, and memory plus swap, from the line after the resource usage header."""
    row = _line(text, r"^\s*CPU_T\s+WAIT\s+TURNAROUND\s+STATUS\s+HOG_FACTOR\s+MEM\s+SWAP\s*\n\s*(.*?)\s*$")
    cell = lambda k: F.get(F.split(row, r"\s+"), F.lit(k))
    mem = lambda k: f.parse_suffixed_memory(cell(k), f.LSF_MEMORY)
    return records.select(key, F.round(cell(0).try_cast("double") * 1e9).cast("long").alias("used_cpu_time"), (mem(5) + mem(6)).alias("max_used_memory"), cell(3).alias("status"))


def gnu_time_usage(records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Times and memory from `Key=Value` lines; a signal named in the first line beats the return code."""
    v = lambda k: _line(text, rf"^{k}=(.*?)\s*$")
    seconds = lambda k: f.parse_elapsed(v(k))
    memory = F.coalesce(f.parse_memory(v("MaxResidentMemory")), f.parse_suffixed_memory(v("MaxResidentMemory"), f.SLURM_MEMORY))
    killed = _line(text, r"^Command terminated by signal (\d+)").try_cast("int")
    signal, code = f.shell_exit(v("ReturnCode").try_cast("int"))
    return records.select(
        key, seconds("WallTime").alias("duration"), (seconds("UserTime") + seconds("KernelTime")).alias("used_cpu_time"), memory.alias("max_used_memory"),
        F.coalesce(killed, signal).alias("signal"), F.when(killed.isNotNull(), -1).otherwise(code).alias("exitcode"),
    )


def join_continuation_lines(lines: DataFrame, key: str, order: str, line: str, prefix: str) -> DataFrame:
    """Lines that start with the prefix are glued, without it, to the line before; empty lines go."""
    more = F.col(line).startswith(prefix)
    group = F.sum((~more).cast("int")).over(Window.partitionBy(key).orderBy(order))
    marked = lines.where(F.col(line) != "").select(key, order, F.when(more, F.substring(F.col(line), len(prefix) + 1, 10**6)).otherwise(F.col(line)).alias("part_"), group.cast("long").alias("line_no"))
    parts = F.sort_array(F.collect_list(F.struct(order, "part_")))
    return marked.groupBy(key, "line_no").agg(F.array_join(F.transform(parts, lambda x: x["part_"]), "").alias("line"))
