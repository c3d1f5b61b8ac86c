"""Operators whose work and memory must not grow faster than their input."""

import re
import weakref

import duckdb
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import functions as F

from campaign.functions import scalars
from campaign.llm import toxicity
from campaign.operators import accounting, commands, graph, matching, text
from campaign.sources import merged


def brute_flavors(tasks, flavors, overhead):
    """The smallest flavor of each task by comparing it with all."""
    out = {}
    for id_, cores, memory, preferred in tasks:
        fit = [(f != (preferred or ""), c, r, d, f) for f, c, r, d in flavors if None not in (cores, memory, f) and c >= cores and r - overhead >= memory]
        out[id_] = min(fit)[4] if fit else None
    return out


def largest_join(spark, df):
    """The most rows that a join of the plan puts out."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        plan += [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_smallest_flavor_meets_few_flavors_for_each_task(spark):
    flavors = [(f"f{k}", 1 + k * 7 % 5, 100 + k * 37 % 64 * 10, k % 3) for k in range(60)] + [("f3", 5, 9000, 1), ("huge", 2, 10**9, 0), (None, 5, 10**9, 0)]
    tasks = [(k, 1 + k % 6 if k % 11 else None, k * 13 % 900 if k % 13 else None, None if k % 3 == 0 else "f3" if k % 3 == 1 else "gone") for k in range(300)]
    tasks += [(1000, 1, 10**9 - 64, "x"), (1001, 1, 10**9 - 63, "x"), (1002, 1, -5, "x"), (1003, 5, 8936, "f3"), (1004, 5, 8936, None)]
    left = spark.createDataFrame(tasks, "task_id long, requested_cores int, requested_memory long, preferred string")
    right = spark.createDataFrame(flavors, "flavor string, cpus int, ram long, disk int")
    done = matching.smallest_flavor(left, right, 64)
    assert {r["task_id"]: r["flavor"] for r in done.collect()} == brute_flavors(tasks, flavors, 64)
    assert largest_join(spark, done) <= len(tasks)
    assert {r["flavor"] for r in matching.smallest_flavor(left, right.limit(0), 64).collect()} == {None} and matching.smallest_flavor(left.limit(0), right, 64).collect() == []


def test_quantities_are_rounded_as_in_sql(spark):
    amounts = [2_047_500_000, 78_750 * 26_000, 1_000_500, 999_999_999, 1_000_000, 1, 0, 1_234_565, 5_000_500_000_000]
    df = spark.createDataFrame([(n,) for n in amounts], "n long").select("n", scalars.quantity_text(F.col("n"), {"B": 1, "kB": 1000, "MB": 10**6, "GB": 10**9, "TB": 10**12}).alias("text"))
    sql = "CASE " + " ".join(f"WHEN n >= {u} THEN round(n / {u}::DOUBLE, 3) || '{t}'" for t, u in (("TB", 10**12), ("GB", 10**9), ("MB", 10**6), ("kB", 1000))) + " ELSE round(n / 1.0::DOUBLE, 3) || 'B' END"
    want = duckdb.sql(f"SELECT n, {sql} FROM (SELECT unnest({amounts}) AS n)").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and dict(want)[2_047_500_000] == "2.047GB"


def test_toxicity_sends_no_dense_weights(spark, monkeypatch):
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    rows = [(k, f"you {'idiot' if k % 2 else 'friend'} number {k} of many", k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df)
    assert len({r["score"] for r in toxicity.score(df, model).collect()}) > 1
    assert not sent  # functions of more than 1 MB are broadcast, as are models
    weights = toxicity.Weights.of(model.weights)
    assert 0 < len(weights.feature) < toxicity.FEATURES // 10 and (weights.whole() == model.weights).all()


def test_tasks_are_paired_with_blocks_of_resources(spark):
    have = [(f"r{k}", k % 9 != 0, [["a"], ["b"], ["a", "b"], None][k % 4], 1 + k % 3, None if k % 50 == 0 else k * 31 % 97, 5 * (k % 2)) for k in range(400)]
    want = [(k, [None, "a", "b", "z"][k % 4], 1 + k % 4, [None, 0, 40, 90, 200][k % 5], [None, 0, 3, 5][k % 4 - 1]) for k in range(60)]
    left = spark.createDataFrame(want, "task_id long, architecture_wanted string, requested_cores int, requested_memory long, requested_walltime int")
    right = spark.createDataFrame(have, "resource string, enabled boolean, architecture array<string>, max_cores_per_job int, max_memory_per_core long, max_walltime int")
    expected = {
        (t, r) for t, arch, cores, memory, wall in want for r, on, archs, c, m, w in have
        if on and (arch is None or archs and arch in archs) and cores <= c and (memory is None or m is not None and memory <= cores * m) and (wall is None or wall <= w)
    }
    done = matching.match_resources(left, right)
    got = [tuple(r) for r in done.collect()]
    assert set(got) == expected and len(got) == len(expected) > 1000
    assert largest_join(spark, done) < len(expected) // 5


def test_pairs_of_many_names_take_few_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "TILE_RESOURCES", 100, raising=False)
    k, any_of = F.col("id"), lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    left = spark.range(3000).select(k.alias("task_id"), F.when(k % 3 > 0, F.concat(F.lit("a"), k % 3)).alias("architecture_wanted"), (1 + k % 2).alias("requested_cores"), any_of(60_000).alias("requested_memory"), F.lit(1).alias("requested_walltime"))
    kind = F.when(k % 2 == 0, F.array(F.lit("a1"))).otherwise(F.array(F.lit("a1"), F.lit("a2"))).alias("architecture")
    name = F.concat(F.lpad(k.cast("string"), 9, "0"), F.repeat(F.lit("x"), F.lit(1200)))  # together more than Parquet's dictionaries hold, 1 MB
    right = spark.range(1000).select(name.alias("resource"), F.lit(True).alias("enabled"), kind, (1 + k % 4).alias("max_cores_per_job"), any_of(30_000).alias("max_memory_per_core"), (k % 5).alias("max_walltime"))
    matching.match_resources(left, right).write.parquet(str(tmp_path / "pairs"))
    n = left.join(right, matching.fits()).count()
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n > 500_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2 * n


def test_pairs_are_dealt_out_by_tiles(spark, monkeypatch):
    for name, n in {"TILE_RESOURCES": 40, "TILE_TASKS": 100, "RESOURCE_BLOCK": 4, "TASK_RUN": 8}.items():
        monkeypatch.setattr(matching, name, n, raising=False)
    have = [(f"r{k % 290}", True, ["a"], 3, None if k % 50 == 0 else k * 31 % 97 - 9, 5) for k in range(300)]
    want = [(k % 990, None if k % 3 else "a", (-2, 1, 3, None, 0)[k % 5], None if k % 7 == 0 else k * 13 % 150 - 20, None if k % 11 == 0 else k % 7) for k in range(1000)]
    left = spark.createDataFrame(want, "task_id long, architecture_wanted string, requested_cores int, requested_memory long, requested_walltime int")
    right = spark.createDataFrame(have, "resource string, enabled boolean, architecture array<string>, max_cores_per_job int, max_memory_per_core long, max_walltime int")
    expected = [
        (t, r) for t, _, cores, memory, wall in want for r, _, _, c, m, w in have
        if cores is not None and cores <= c and (memory is None or m is not None and memory <= cores * m) and (wall is None or wall <= w)
    ]
    got = matching.match_resources(left, right).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r["task_id"], r["resource"]) for r in got) == sorted(expected)
    parts = {r["at"] for r in got}
    assert len(parts) > 40
    assert max(len({r["resource"] for r in got if r["at"] == k}) for k in parts) <= 60 and max(len({r["task_id"] for r in got if r["at"] == k}) for k in parts) <= 200
    monkeypatch.setattr(matching, "checked", lambda df: df)
    again = matching.match_resources(left, right).collect()
    assert sorted((r["task_id"], r["resource"]) for r in again) == sorted(expected)
    for empty in (matching.match_resources(left.limit(0), right), matching.match_resources(left, right.limit(0)), matching.match_resources(left, right.where("not enabled"))):
        assert empty.collect() == []


def test_records_are_dealt_out_to_tasks_for_a_program(spark):
    df = spark.range(200).coalesce(1).withColumn("n", F.col("id").cast("string"))
    done = commands.run_command(df, ["/bin/sh", "-c", 'while read x; do echo "$x $$"; done'], "n", keep=True, parts=8)
    got = [r["stdout"].split(" ") for r in done.collect()]
    assert sorted(int(x) for x, _ in got) == list(range(200)) and len({p for _, p in got}) == 8


def test_a_merged_document_is_read_in_pieces(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 != 0, F.col("id")).alias("a"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("</row> <row> &é\n"), F.col("id").cast("string"))).alias("b"))
    merged.write_parts(rows, str(tmp_path / "x"), ["a", "b"], parts=3)
    merged.join_parts(spark, str(tmp_path / "x"), str(tmp_path / "one.xml"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = merged.read_document(spark, str(tmp_path / "one.xml"), "a long, b string")
        assert back.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    merged.write_parts(rows.limit(0), str(tmp_path / "none"), ["a"])
    assert merged.read_document(spark, str(tmp_path / "none"), "a long, b string").collect() == []


def test_levels_send_no_tables_to_the_driver(spark):
    deps = spark.range(1, 3000).select(F.col("id").alias("task_id"), F.floor(F.col("id") / 2).alias("depends_on")).where("depends_on > 0")
    done = graph.topological_levels(deps.select("task_id"), deps)
    assert {r["task_id"]: r["level"] for r in done.collect()} == {k: k.bit_length() - 1 for k in range(1, 3000)}
    plans = []
    with_written = graph.written
    graph.written = lambda df, *kind: plans.append(df._jdf.queryExecution().executedPlan().toString()) or with_written(df, *kind)
    try:
        graph.topological_levels(deps.select("task_id"), deps)
        graph.descendants(deps.withColumnRenamed("depends_on", "parent_id"), spark.createDataFrame([(1,)], "task_id long"))
    finally:
        graph.written = with_written
    assert plans and sum("Join" in p for p in plans) > 5
    assert not any("BroadcastHashJoin" in p and "at_root" not in p for p in plans)


def method_sizes(spark, df):
    """Bytes of the largest method that Spark generates for each stage of a plan; the JVM compiles none of more than 8,000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        text = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_slurm_records_are_parsed_by_methods_that_are_compiled(spark):
    id_, rest = F.col("id").cast("string"), F.lit("|1:0|COMPLETED|4|00:05|00:02.5|2012-09-04T11:18:06|2012-09-04T11:18:24|2012-09-04T11:18:47|7K|1.5M|")
    master, step = spark.range(50).select(F.concat(id_, rest).alias("line")), spark.range(50).select(F.concat(id_, F.lit(".0"), rest).alias("line"))
    empty = spark.range(3).select(F.when(F.col("id") > 0, F.repeat(F.lit(" "), F.col("id").cast("int") - 1)).alias("line"))
    done = accounting.slurm_usage(master.union(step).union(empty))
    sizes = method_sizes(spark, done)
    assert sizes and max(sizes) <= 8000
    got = {r["job"]: (r["duration"], r["used_cpu_time"], r["max_used_ram"], r["max_used_memory"]) for r in done.collect()}
    assert got == {str(k): (5 * 10**9, 25 * 10**8, 7000, 1_500_000) for k in range(50)}


def test_a_scorer_gets_pieces_and_what_it_leaves_is_collected(spark):
    seen = []

    def scorer(texts):
        left = sum(s() is not None for s in seen)
        seen.append(weakref.ref(texts))
        sizes = texts.str.len()  # leaves a cycle behind
        return pd.DataFrame({"size": sizes.where(sizes > 0), "piece": sizes.sum(), "left": left})

    size = F.when(F.col("id") == 7, 3 << 20).when(F.col("id") % 10 == 3, 0).otherwise(100_000 + F.col("id"))
    df = spark.range(400).coalesce(1).select("id", F.when(F.col("id") % 10 != 5, F.repeat(F.lit("x"), size.cast("int"))).alias("text"), F.when(F.col("id") == 15, "é.").alias("body"))
    done = text.scored_texts(df, scorer, ["size", "piece", "left"]).drop("text").collect()
    want = {k: 2 if k == 15 else None if k % 10 in (3, 5) else 3 << 20 if k == 7 else 100_000 + k for k in range(400)}
    assert {r["id"]: r["size"] for r in done} == want and {r["id"] for r in done if r["piece"] is None} == {k for k in range(400) if k % 10 == 5 and k != 15}
    assert max(r["piece"] for r in done if r["id"] != 7 and r["piece"]) <= text.PIECE_BYTES
    assert max(r["left"] for r in done if r["left"] is not None) <= text.COLLECT_BYTES // text.PIECE_BYTES + 1
    assert text.scored_texts(df.limit(0), scorer, ["size", "piece", "left"]).collect() == []
