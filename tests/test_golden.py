"""Small inputs with known results."""

import datetime
import gzip
import io
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaign.functions import scalars as f
from campaign.operators import accounting, evolve, graph, grids, history, statistics, tables, tasks, text
from campaign.sources import io as files
from campaign.streaming import events as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("amount", "expected"), [("5B", 5), ("5 kB", 5000), ("1.5MB", 1_500_000), ("3KiB", 3072), ("2GiB", 2 << 30), ("5", None), ("", None), ("x MB", None)])
def test_memory(spark, amount, expected):
    assert one(spark, f.parse_memory(F.lit(amount))) == expected


@pytest.mark.parametrize(("duration", "seconds"), [("01:02:03", 3723), ("1:00:00:00", 86400), ("1d 4h 9m 16s", 101356), ("5 minutes", 300), ("2h", 7200), ("0.5 s", 0.5), ("03:04", None), ("soon", None)])
def test_duration(spark, duration, seconds):
    assert one(spark, f.parse_duration(F.lit(duration))) == (None if seconds is None else int(seconds * 10**9))


@pytest.mark.parametrize(("elapsed", "seconds"), [("1-02:03:04", 93784), ("03:04", 184), ("12", 12), ("12.25s", 12.25), ("01:00:00", 3600), ("", None)])
def test_elapsed(spark, elapsed, seconds):
    assert one(spark, f.parse_elapsed(F.lit(elapsed))) == (None if seconds is None else int(seconds * 10**9))


@pytest.mark.parametrize(("exitcode", "signal", "returncode"), [(0, 0, 0), (1, 0, 256), (0, 15, 15), (None, 9, 65289), (None, None, None), (75, 122, 19322)])
def test_returncode(spark, exitcode, signal, returncode):
    assert one(spark, f.encode_returncode(F.lit(exitcode).cast("int"), F.lit(signal).cast("int"))) == returncode


@pytest.mark.parametrize(("system", "code", "state"), [("sge", "qw", "SUBMITTED"), ("sge", "hqw", "STOPPED"), ("sge", "r", "RUNNING"), ("sge", "E", "TERMINATING"), ("slurm", "PENDING", "SUBMITTED"), ("pbs", "H", "STOPPED"), ("lsf", "EXIT", "TERMINATING"), ("ps", "Ss", "RUNNING"), ("lsf", "?", "UNKNOWN")])
def test_batch_states(spark, system, code, state):
    assert one(spark, f.map_batch_state(system, F.lit(code))) == state


@pytest.mark.parametrize(("value", "truth"), [("true", True), (" YES ", True), ("1", True), ("0", False), ("", False), (None, False)])
def test_boolean(spark, value, truth):
    assert one(spark, f.parse_boolean(F.lit(value).cast("string"))) is truth


def test_urls(spark):
    url = f.url_parts(F.lit("/data/x"))
    assert one(spark, url["scheme"]) == "file" and one(spark, url["path"]) == "/data/x"
    assert one(spark, f.url_adjoin(F.lit("http://h/a/?q=1"), "b")) == "http://h/a/b?q=1"


def test_null_return_codes_fail_in_counts_but_are_neither_in_filters(spark):
    t = spark.createDataFrame([(1, "TERMINATED", 0), (2, "TERMINATED", 256), (3, "TERMINATED", None), (4, "NEW", None)], "task_id long, state string, returncode int")
    assert {r["stat"]: r["n"] for r in tasks.state_counts(t).collect()} == {"TERMINATED": 3, "NEW": 1, "ok": 1, "failed": 2, "total": 4}
    assert [r["task_id"] for r in tasks.successful(t).collect()] == [1]
    assert [r["task_id"] for r in tasks.unsuccessful(t).collect()] == [2]
    assert sorted(r["task_id"] for r in tasks.in_state(t, ["failed", "new"]).collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="unknown states"):
        tasks.by_state(t, ["gone"])


def test_slurm_records(spark):
    lines = [
        "7|0:0|COMPLETED|64|00:00:23|00:01.452|2012-09-04T11:18:06|2012-09-04T11:18:24|2012-09-04T11:18:47|||",
        "7.batch|0:0|COMPLETED|1|00:00:23|00:01.452|2012-09-04T11:18:24|2012-09-04T11:18:24|2012-09-04T11:18:47|7884K|49184K|",
        "8|0:1|CANCELLED by 1000|4|00:00:05|00:00:01|2012-09-24T10:47:28|2012-09-24T10:47:29|2012-09-24T10:48:34|||",
        "9|0:0|NODE_FAIL|1|00:05|00:01|2012-09-24T10:00:00|2012-09-24T10:00:00|2012-09-24T10:00:05|||",
        "10|0:0|RUNNING|1|00:05|00:01|2012-09-24T10:00:00|2012-09-24T10:00:00|Unknown|||",
        "",
    ]
    got = {r["job"]: r for r in accounting.slurm_usage(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(got) == {"7", "8", "9"}
    r = got["7"]
    assert (r["cores"], r["duration"], r["used_cpu_time"], r["max_used_memory"], r["max_used_ram"]) == (64, 23 * 10**9, 1_452_000_000, 49_184_000, 7_884_000)
    assert (r["submission_time"], r["start_time"], r["completion_time"]) == tuple(datetime.datetime(2012, 9, 4, 11, 18, s) for s in (6, 24, 47))
    assert (got["8"]["exitcode"], got["8"]["signal"]) == (75, 122) and (got["9"]["exitcode"], got["9"]["signal"]) == (75, 124)


def test_gnu_time_signal_beats_exit(spark):
    text_ = "Command terminated by signal 15\nWallTime=6.44s\nUserTime=1.0s\nKernelTime=0.5s\nMaxResidentMemory=2004kB\nReturnCode=0"
    r = accounting.gnu_time_usage(spark.createDataFrame([(1, text_)], "k int, text string"), "k").first()
    assert (r["signal"], r["exitcode"], r["duration"], r["max_used_memory"], r["used_cpu_time"]) == (15, -1, 6_440_000_000, 2_004_000, 1_500_000_000)


@pytest.mark.parametrize(("given", "values"), [("3", [3]), ("1:4", [1, 2, 3]), ("1:8:3", [1, 4, 7]), ("5:1:-2", [5, 3]), ("1:2:0.25", [1.0, 1.25, 1.5, 1.75]), ("2:2", [])])
def test_ranges(spark, given, values):
    assert [r[0] for r in grids.expand_range(spark, given).orderBy(F.abs(F.col("value") - F.lit(grids.parse_range(given)[0]))).collect()] == values
    with pytest.raises(ValueError):
        grids.parse_range("1:2:0")


def test_grouped_grid_minus_one_follows_the_run(spark):
    rows = grids.grouped_grid(spark, {-1: {"z": ["p", "q"]}, 0: {"a": ["1", "2"], "b": ["3", "4"]}}, {0: "diag"}).orderBy("run_no").collect()
    assert [(r["run"], r["z"]) for r in rows] == [("para_a=1_b=3", "p"), ("para_a=2_b=4", "q")]


def test_big_grid_is_counted_without_collecting(spark):
    factors = [spark.range(100).toDF(f"f{k}") for k in range(3)]
    assert grids.expand_grid(factors, F.col("f0") <= F.col("f1")).count() == 505_000


def test_merge_indicator_finds_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(2, "c")], "k int, w string")
    with pytest.raises(Exception, match="repeats on the left"):
        tables.merge_indicator(left, right, "k").collect()
    with pytest.raises(ValueError, match="both sides"):
        tables.merge_indicator(left, left, "k")


def test_numbering_is_global_and_complete(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    got = tables.numbered(df, ["x"]).collect()
    assert sorted((r["x"], r["row_idx"]) for r in got) == [(k, k) for k in range(1000)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", ["4", "16", "200"])
def test_numbering_keeps_every_row_of_wide_tables(spark, adaptive, partitions):
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": partitions}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = spark.range(120_000).select((F.col("id") * 7919 % 120_000).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(1).alias("range"))
        for df in (made, made.groupBy("x").agg(F.max("text").alias("text"), F.count("*").alias("range"))):  # also after a shuffle, and with the operator's own names taken
            got = tables.numbered(df, ["x"])
            assert got.columns == [*df.columns, "row_idx"]
            assert got.agg(F.count("*"), F.countDistinct("row_idx"), F.sum((F.col("x") != F.col("row_idx")).cast("int"))).first()[:] == (120_000, 120_000, 0)
        assert tables.assign_ids(made, made.limit(0).select(F.lit("job.1").alias("id")), ["x"], "job").select("id").distinct().count() == 120_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbering_of_ties_and_nothing(spark):
    same = spark.range(1000).select(F.lit(5).alias("x"), F.lit(None).cast("string").alias("y"))
    assert sorted(r["row_idx"] for r in tables.numbered(same, ["x", "y"]).collect()) == list(range(1000))
    assert tables.numbered(same.limit(0), ["x"]).collect() == []


def test_topological_cycle(spark):
    deps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "task_id long, depends_on long")
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_levels(deps.select("task_id"), deps)
    chain = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "task_id long, depends_on long")
    assert {r["task_id"]: r["level"] for r in graph.topological_levels(chain.select("task_id"), chain).collect()} == {1: 2, 2: 1, 3: 0, 4: 0}


def test_retries_by_a_predicate(spark):
    a = spark.createDataFrame([(1, 0, 99), (1, 1, 99), (1, 2, 4), (1, 3, 0), (2, 0, 99), (3, 0, None), (3, 1, 0)], "group_id int, step long, returncode int")
    got = {r["group_id"]: (r["returncode"], r["retries"], r["done"]) for r in history.retry_outcome(a, 0, F.col("returncode") == 99).collect()}
    assert got == {1: (4, 2, True), 2: (99, 0, False), 3: (None, 0, True)}
    assert {r["group_id"]: r["retries"] for r in history.retry_outcome(a, 1).collect()} == {1: 1, 2: 0, 3: 1}


def test_matches_in_a_grid_of_all_columns(spark):
    rng = random.Random(3)
    rows, targets = ([(k, 7.0, rng.randint(0, 40) / 4, rng.randint(0, 8) / 4) for k in range(n)] for n in (200, 60))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    wanted = {t[0]: sum(all(abs(x - y) < 0.3 for x, y in zip(r[1:], t[1:])) for r in rows) for t in targets}
    got = tables.match_within(df.drop("k"), spark.createDataFrame(targets, "t int, x double, y double, z double"), "t", {"a": "x", "b": "y", "c": "z"}, 0.3)
    assert {r["t"]: r["matches"] for r in got.collect()} == wanted


def test_grouped_headers_with_quotes_and_rows_like_the_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a, b",x,,y\n"a, b",x,,y\n1,"2,5",3,4\n,,,\n')
    got = files.read_grouped_header(spark, str(tmp_path / "q.csv"))
    assert got.columns == ["a, b", "x", "y"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a, b", ["x", None], "y"), ("1", ["2,5", "3"], "4"), (None, [None, None], None)], key=repr)


def test_draws_stay_in_their_box_and_searches_never_get_worse(spark):
    drawn = statistics.draw_population(spark, 200, [-1.0, 5.0], [1.0, 6.0], 3)
    x = np.array([r["x"] for r in drawn.orderBy("member_id").collect()])
    assert x.shape == (200, 2) and (x >= [-1, 5]).all() and (x <= [1, 6]).all() and x.std(axis=0).min() > 0.2
    assert (x == [r["x"] for r in statistics.draw_population(spark, 200, [-1.0, 5.0], [1.0, 6.0], 3).orderBy("member_id").collect()]).all()
    assert (x != [r["x"] for r in statistics.draw_population(spark, 200, [-1.0, 5.0], [1.0, 6.0], 4).orderBy("member_id").collect()]).any()
    rounds = {k: np.array([r["y"] for r in evolve.optimise(spark, lambda v: (v**2).sum(axis=1), [-3.0, -3.0], [3.0, 3.0], 12, k).orderBy("member_id").collect()]) for k in (0, 1, 3)}
    assert (rounds[1] <= rounds[0]).all() and (rounds[3] <= rounds[1]).all() and rounds[3].min() < rounds[0].min()


def test_elapsed_times_and_suffixed_memory_of_odd_forms(spark):
    times = {"1-02:03:04.5": ((26 * 60 + 3) * 60 + 4) * 10**9 + 5 * 10**8, "03:04": 184 * 10**9, "7": 7 * 10**9, " 0:05.25s ": 5_250_000_000, "1:2:3:4": None, "": None, "x": None, "99999999999999999999:00": None, "1-": None, "5.": None, None: None}
    sizes = {"12K": 12_000, " 1.5 M ": 1_500_000, "7": 7, "1.K": None, ".5K": None, "K5": None, "5X": None, "5KK": None, "-5K": None, "1e3K": None, "": None, None: None}
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["v"] for r in frame(times).select("t", f.parse_elapsed(F.col("t")).alias("v")).collect()} == times
    assert {r["t"]: r["v"] for r in frame(sizes).select("t", f.parse_suffixed_memory(F.col("t"), f.SLURM_MEMORY).alias("v")).collect()} == sizes


def test_ranges_of_a_table_may_be_empty_or_very_long(spark):
    rows = [(1, 5, 3, 1), (2, 3, 5, 1), (3, 5, 0, -2), (4, 0, 10, 4), (5, 7, 7, 1), (6, None, 3, 1), (7, 3, 9, -1)]
    df = spark.createDataFrame(rows, "k int, low long, high long, step int")
    wanted = sorted((k, v) for k, low, high, step in rows if low is not None for v in range(low, high, step))
    for block in (1, 2, 3, 1000):
        assert sorted((r["k"], r["value"]) for r in grids.expand_ranges(df, "low", "high", "step", block=block).collect()) == wanted
    large = spark.createDataFrame([(1, 0, 200_000_000, 1), (2, 5, 0, 1)], "k int, low long, high long, step int")
    assert grids.expand_ranges(large, "low", "high", "step").agg(F.count("*"), F.max("value")).first()[:] == (200_000_000, 199_999_999)
    with pytest.raises(Exception, match="step of zero"):
        grids.expand_ranges(df.withColumn("step", F.lit(0)), "low", "high", "step").collect()


def test_what_is_left_of_ten_billion_slices(spark):
    scheduled = spark.createDataFrame([(0, 7)], "start long, end long")
    left = grids.unscheduled_range(spark, scheduled, 3 * 10**9, 3)
    assert left.count() == 10**9 - 2 and left.limit(1).first()[:] == (7, 10)
    assert grids.unscheduled_range(spark, scheduled, 8, 3).collect()[0][:] == (7, 8)
    assert grids.unscheduled_range(spark, scheduled, 7, 3).count() == 0
    assert grids.unscheduled_range(spark, scheduled.limit(0), 4, 3).count() == 2


def test_decoding_takes_the_first_encoding_that_fits(spark):
    values = [("é€".encode(), "é€"), ("é€".encode("utf-16"), "é€"), (b"\x80 caf\xe9s", "€ cafés"), (b"\x81\xff\x00", "\x81ÿ\x00"), (b"", ""), (None, None), (b"plain", "plain")]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(values)], "k int, data binary")
    got = {r["k"]: r["t"] for r in df.select("k", f.decode_bytes(F.col("data"), ["utf-8", "utf-16", "cp1252", "latin-1"]).alias("t")).collect()}
    # seven bytes are no UTF-16, so the third falls to the next
    assert got == {k: t for k, (_, t) in enumerate(values)}
    strict = {r["k"]: r["t"] for r in df.select("k", f.decode_bytes(F.col("data"), ["ascii", "utf-8"]).alias("t")).collect()}
    assert [strict[k] for k in range(7)] == ["é€", None, None, None, "", None, "plain"]
    with pytest.raises(LookupError):
        f.decode_bytes(F.col("data"), ["no such encoding"])


@pytest.mark.parametrize("block", [3, 2048])
def test_interpolation_in_blocks_equals_pairs(spark, block):
    rng = np.random.default_rng(4)
    s, q = rng.integers(0, 6, (40, 2)).astype(float), rng.integers(0, 60, (70, 2)) / 10
    value = rng.random(40)
    samples = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(s, value)] + [(None, 1.0, 5.0), (1.0, 1.0, None)], "a double, b double, f double")
    queries = spark.createDataFrame([(f"q{k}", *map(float, p)) for k, p in enumerate(q)] + [("none", None, 1.0)], "query_id string, a double, b double")
    got = {r["query_id"]: r["value"] for r in statistics.idw_interpolate(queries.repartition(3), samples.repartition(4), ["a", "b"], block=block).collect()}
    for k, p in enumerate(q):
        d = np.sqrt(((s - p) ** 2).sum(axis=1))
        wanted = value[d == 0].mean() if (d == 0).any() else (value / d**4).sum() / (1 / d**4).sum()
        assert got[f"q{k}"] == pytest.approx(wanted)
    assert len(got) == 71 and got["none"] is None
    assert {r["value"] for r in statistics.idw_interpolate(queries, samples.limit(0), ["a", "b"]).collect()} == {None}


def levels_by_hand(edges):
    on, level = {}, {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
        on.setdefault(b, set())

    def of(v):
        if v not in level:
            level[v] = max((of(u) + 1 for u in on[v] if u != v), default=0)
        return level[v]

    return {v: of(v) for v in sorted(on)}


def test_levels_of_a_chain_of_five_thousand(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "written", lambda df, written=graph.written: cuts.append(1) or written(df))
    chain = spark.range(1, 5000).select(F.col("id").alias("task_id"), (F.col("id") - 1).alias("depends_on"))
    got = graph.topological_levels(chain.select("task_id"), chain)
    assert got.agg(F.count("*"), F.sum((F.col("level") != F.col("task_id")).cast("int"))).first()[:] == (5000, 0)
    assert len(cuts) <= 2 + 3 * 16  # three writes a round


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_tangled_tasks(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k - rng.randint(1, min(k, 3 if seed == 1 else 12))) for k in range(1, 24) for _ in range(rng.randint(0, 2))] + [(5, 5)]
    deps = spark.createDataFrame(edges * 2, "task_id long, depends_on long")
    got = {r["task_id"]: r["level"] for r in graph.topological_levels(deps.select("task_id"), deps).collect()}
    assert got == levels_by_hand(edges)


def test_descendants_of_deep_trees_nested_roots_and_cycles(spark):
    rng = random.Random(6)
    parent = {k: k - rng.choice([1, 1, 1, 2, 5]) for k in range(1, 400)}
    parent = {k: max(0, v) for k, v in parent.items()} | {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1002}
    tree = spark.createDataFrame([*parent.items(), (0, None)], "task_id long, parent_id long")
    roots = [0, 7, 7, 150, 399, 5555]
    got = sorted(tuple(r) for r in graph.descendants(tree, spark.createDataFrame([(r,) for r in roots], "task_id long")).collect())
    wanted = []
    for v in [*parent, 0, 5555]:
        seen, at, depth = set(), v, 0
        while at is not None and at not in seen:
            if at in roots:
                wanted.append((at, v, depth))
            seen.add(at)
            at, depth = parent.get(at), depth + 1
    assert got == sorted(wanted)
    with pytest.raises(ValueError, match="cycle through: 1001"):
        graph.descendants(tree, spark.createDataFrame([(1001,)], "task_id long"))
    chain = spark.range(1, 5000).select(F.col("id").alias("task_id"), (F.col("id") - 1).alias("parent_id"))
    below = graph.descendants(chain, spark.createDataFrame([(0,)], "task_id long"))
    assert below.agg(F.count("*"), F.max("depth"), F.sum((F.col("depth") != F.col("task_id")).cast("int"))).first()[:] == (5000, 4999, 0)
    assert graph.descendants(chain.limit(0), chain.select("task_id").limit(0)).collect() == []


def test_retries(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 1)], "group_id int, step long, returncode int")
    assert {r["group_id"]: (r["returncode"], r["retries"], r["done"]) for r in history.retry_outcome(a, 2).collect()} == {1: (0, 1, True), 2: (3, 2, True), 3: (1, 0, False)}


def test_first_match_falls_back_to_the_whole_text(spark):
    rules = [text.Rule("late", "end", 0.8, 1.0), text.Rule("early", "begin", 0.0, 0.3)]
    df = spark.createDataFrame([("begin xxxxxxxxxxxxxxxxx end",), ("end xxxxxxxxxxxxxxxxxxxx",), ("nothing",), ("",)], "text string")
    assert [r["class"] for r in text.classify_first_match(df, rules).collect()] == ["late", "late", "none_found", "none_found"]


def test_rosenbrock(spark):
    def rosenbrock(x):
        return (1 - x[:, 0]) ** 2 + 100 * (x[:, 1] - x[:, 0] ** 2) ** 2

    first = evolve.evaluate_population(statistics.draw_population(spark, 20, [-2, -2], [2, 2], 3), rosenbrock)
    last = evolve.optimise(spark, rosenbrock, [-2, -2], [2, 2], 20, 5, seed=3, probability=0.9)
    assert last.agg(F.min("y")).first()[0] <= first.agg(F.min("y")).first()[0]
    assert last.count() == 20


@pytest.mark.parametrize("strategy", evolve.STRATEGIES)
def test_strategies_keep_the_shape(spark, strategy):
    pop = statistics.draw_population(spark, 12, [0, 0, 0], [1, 1, 1], 1)
    ready = evolve.with_partners(pop, 12, F.col("member_id")).select("*", F.array(*[F.lit(0.5)] * 3).alias("best"), F.array(*[F.lit(0.25)] * 3).alias("jitter"), evolve.crossover_mask(3, 0.5, 9, exponential=True).alias("mask"))
    got = evolve.evolve(ready, strategy, 0.8).collect()
    assert len(got) == 12 and all(len(r["x"]) == 3 and not np.isnan(r["x"]).any() for r in got)


def test_streamed_counts_equal_batch_counts_for_random_histories(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), k, datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=int(k)), str(rng.choice(["NEW", "RUNNING", "TERMINATED"]))) for k, t in enumerate(rng.integers(0, 9, 200))]
    df = spark.createDataFrame(rows, "task_id long, seq long, ts timestamp, state string")
    folder = spark.sparkContext.getCheckpointDir() + "/histories"
    for k in range(4):
        df.where(F.col("seq") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    from campaign.jobs.streams import drain

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    live = {r["state"]: r["n"] for r in drain(st.state_deltas(stream)).groupBy("state").agg(F.sum("delta").alias("n")).collect()}
    batch = {r["state"]: r["n"] for r in st.live_state_counts_batch(df).collect()}
    assert {k: v for k, v in live.items() if v} == batch


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# comment\n1,2.5,x\n\n2,oops,y\n3,4\n")
    good, bad = files.read_commented_table(spark, str(tmp_path / "p.csv"), {"a": "int", "b": "double", "c": "string"})
    assert [tuple(r) for r in good.collect()] == [(1, 2.5, "x")]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad value: b", "fields: 2"]
    (tmp_path / "g.csv").write_text("name,xs,,y\na,1,2,3\n")
    assert tuple(files.read_grouped_header(spark, str(tmp_path / "g.csv")).first()) == ("a", ["1", "2"], "3")
    (tmp_path / "t.txt").write_text("a b c\n1 2.5 x\n-- 3 y\n\nfoot note\n")
    table = files.read_space_table(spark, str(tmp_path / "t.txt"))
    assert table.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")] and [tuple(r) for r in table.collect()] == [(1, 2.5, "x"), (None, 3.0, "y")]
    (tmp_path / "r.xml").write_text("<ROWSET><ROW><PostId>1</PostId><Content>hi</Content></ROW><ROW><PostId>2</PostId></ROW></ROWSET>")
    assert [tuple(r) for r in files.read_xml_rows(spark, str(tmp_path / "r.xml"), "PostId long, Content string").collect()] == [(1, "hi"), (2, None)]
    with gzip.open(tmp_path / "j.json.gz", "wt") as out:
        out.write('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r[0] for r in files.read_json_lines(spark, str(tmp_path / "j.json.gz"), "a long").collect()) == [1, 2]
    assert [tuple(r) for r in files.read_param_csv(spark, str(tmp_path / "g.csv"), "n string, a int, b int, c int").collect()] == [("a", 1, 2, 3)]


def test_folders_and_archives(spark, tmp_path):
    (tmp_path / "run" / ".hidden").mkdir(parents=True)
    (tmp_path / "run" / "a.out").write_text("one\ntwo")
    (tmp_path / "run" / ".hidden" / "b.out").write_text("no")
    assert [r["text"] for r in files.read_outputs(spark, str(tmp_path / "run"), "*.out").collect()] == ["one\ntwo"]
    (tmp_path / "arch").mkdir()
    with zipfile.ZipFile(tmp_path / "arch" / "x.zip", "w") as z:
        z.writestr("m.txt", "abc")
        z.writestr("empty.txt", "")
    with tarfile.open(tmp_path / "arch" / "y.tar", "w") as t:
        info = tarfile.TarInfo("n.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"de"))
    got = {r["member"]: bytes(r["content"]) for r in files.read_archive_members(spark, str(tmp_path / "arch")).collect()}
    assert got == {"m.txt": b"abc", "n.txt": b"de"}


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([(2, None), (1, 5)], "task_id long, exitcode int")
    files.export_attrs_csv(t, ["exitcode"], str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == [("1", "5"), ("2", "N/A")]
    files.export_json(t, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    pop = statistics.draw_population(spark, 3, [0], [1], 1)
    for k in (1, 2):
        files.write_generation(pop, k, str(tmp_path / "pop"))
    assert spark.read.parquet(str(tmp_path / "pop")).groupBy("iteration").count().count() == 2
    assert files.task_store(t, {"twice": F.col("exitcode") * 2}).columns == ["task_id", "exitcode", "twice"]


def test_templates_are_filled_once_and_paths_count_once(spark):
    row = spark.range(1).select(
        f.substitute_template(F.lit("${a} and ${b}, $c ${unknown} ${} {a}"), F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("x$1\\"))).alias("t"),
        f.io_map(F.array(F.lit("d/e"), F.lit("d/e"), F.lit("f"))).alias("m"),
    ).first()
    assert row["t"] == "${b} and x$1\\, $c ${unknown} ${} {a}" and row["m"] == {"d/e": "e", "f": "f"}


def test_terminated_tasks_count_as_ok_or_failed_and_late_events_change_nothing(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    batches = [
        [(1, 1, at(1), "RUNNING", None), (2, 2, at(2), "TERMINATED", 0), (3, 1, at(1), "TERMINATED", None)],
        [(1, 3, at(5), "TERMINATED", 256), (2, 1, at(1), "RUNNING", None)],
        [(1, 2, at(4), "STOPPED", None), (2, 4, at(9), "TERMINATED", 1)],
    ]
    schema, folder = "task_id long, seq long, ts timestamp, state string, returncode int", str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    from campaign.jobs.streams import drain

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live = {r["state"]: r["n"] for r in drain(st.state_deltas(stream)).groupBy("state").agg(F.sum("delta").alias("n")).where("n <> 0").collect()}
    batch = {r["state"]: r["n"] for r in st.live_state_counts_batch(spark.createDataFrame(sum(batches, []), schema)).collect()}
    assert live == batch == {"TERMINATED": 3, "failed": 2}


def test_a_lost_task_that_is_seen_again_is_taken_back(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m, 0)
    batches = [[(1, at(0), None), (2, at(0), "RUNNING"), (3, at(1), None)], [(2, at(20), "RUNNING"), (3, at(5), "RUNNING")], [(2, at(21), "RUNNING")], [(1, at(22), "RUNNING"), (3, at(23), None)], [(2, at(59), None)]]
    schema, folder = "task_id long, ts timestamp, state string", str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    from campaign.jobs.streams import drain
    from campaign.operators.history import lost_tasks

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    told = drain(st.lost_tasks_stream(stream, 600)).collect()
    assert sorted((r["task_id"], r["since"], r["lost"]) for r in told) == [(1, at(0), False), (1, at(0), True), (3, at(23), True)]
    assert [tuple(r) for r in lost_tasks(spark.createDataFrame(sum(batches, []), schema), "10 MINUTES").collect()] == [(3, at(23))]
