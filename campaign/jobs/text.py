"""Jobs on texts, statistics and hierarchies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import records as rec
from ..operators import statistics as st
from ..operators import text as op
from ..sources import canonical as c
from .base import Jobs

job = Jobs()
RULES = [op.Rule("the_start", "^The ", 0.0, 0.2), op.Rule("secret", "(?i)password|token", 0.5, 1.0), op.Rule("table", r" \| ", 0.0, 0.5), op.Rule("ending", r"\.$", 0.9, 1.0)]


def _docs(spark, sf):
    return c.table(spark, sf, "documents").select("doc_id", "text")


def _rules_sql() -> str:
    cut = lambda r: f"substring(text, CAST(floor(length(text) * {r.start}::DOUBLE) AS INT) + 1, CAST(floor(length(text) * ({r.end - r.start})::DOUBLE) AS INT) + 1)"
    tests = [f"WHEN regexp_matches({cut(r)}, '{r.pattern}') THEN '{r.name}'" for r in RULES] + [f"WHEN regexp_matches(text, '{r.pattern}') THEN '{r.name}'" for r in RULES]
    return f"classified AS (SELECT doc_id, CASE {' '.join(tests)} ELSE 'none_found' END AS class FROM documents)"


@job(f"WITH {_rules_sql()} SELECT * FROM classified")
def classify_first_match(spark, sf):
    return op.classify_first_match(_docs(spark, sf), RULES).select("doc_id", "class")


@job(f"WITH {_rules_sql()} SELECT class, count(*) AS n FROM classified GROUP BY 1")
def class_summary(spark, sf):
    return op.class_summary(op.classify_first_match(_docs(spark, sf), RULES))


@job(
    r"""SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', 2), '') AS domain, nullif(regexp_extract(text, '(\d+\.\d+\.\d+\.\d+)', 1), '') AS address,
    nullif(regexp_extract(text, '^(\S+)', 1), '') AS first_word FROM documents"""
)
def extract_fields(spark, sf):
    return op.extract_fields(_docs(spark, sf), "doc_id", {"domain": (r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", 2), "address": (r"(\d+\.\d+\.\d+\.\d+)", 1), "first_word": (r"^(\S+)", 1)})


@job(
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 70 END AS outcome FROM p"""
)
def termination_outcome(spark, sf):
    k = (F.col("p_partkey") % 4).cast("int")
    line = F.get(F.array(*map(F.lit, ("run TERMINATED NORMALLY 1\nABNORMALLY later", "job ABNORMALLY ended\nTERMINATED NORMALLY", "failed: syntax\n", "gracefully"))), k)
    texts = c.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("start\n"), line, F.lit("\nend")).alias("text"))
    return op.termination_outcome(texts, "p_partkey", [("TERMINATED NORMALLY", 0), ("ABNORMALLY", 1), ("failed:", 2)])


@job("SELECT doc_id, ends_with(rtrim(text), '.') AS ended FROM documents")
def ends_normally(spark, sf):
    return _docs(spark, sf).select("doc_id", op.ends_normally(F.col("text"), ".").alias("ended"))


@job(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size * 60 + p_partkey % 60 AS VARCHAR) WHEN 1 THEN CAST(3600 * 2 + p_size * 60 + p_partkey % 60 AS VARCHAR) WHEN 2 THEN 'invalid' ELSE 'no file' END AS used FROM part"""
)
def time_used(spark, sf):
    k, sec = F.col("p_partkey") % 4, F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")
    text = F.when(k == 0, F.concat(F.lit("x\nTime used: "), "p_size", F.lit(":"), sec, F.lit("\n"))).when(k == 1, F.concat(F.lit("Time used:  2:"), "p_size", F.lit(":"), sec)).when(k == 2, "Time: 5")
    return c.table(spark, sf, "part").select("p_partkey", op.time_used(text).alias("used"))


_HEADS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@job(c.with_("run_results") + "SELECT run, regexp_extract(run, 'gamma=([^_]*)', 1) AS gamma, regexp_extract(run, 'beta=([^_]*)', 1) AS beta_disc, " + ", ".join(f"max(CASE WHEN head = '{h}' THEN value END) AS \"{h}\"" for h in _HEADS) + " FROM run_results GROUP BY 1")
def overview_table(spark, sf):
    line = F.concat("head", F.lit(" : "), F.format_string("%.4f", F.col("value")))
    texts = c.run_results(spark, sf).groupBy("run").agg(F.concat(F.lit("Iteration: 3\nvector: 1 2 3\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return op.overview_table(op.overview_long(texts, "run", []), "run", _HEADS, ["gamma", "beta_disc"])


@job("SELECT p_partkey, round(p_partkey / 60.0::DOUBLE, 6) AS minutes FROM part WHERE p_partkey % 3 <> 0")
def running_times(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit("Total running time = "), "p_partkey", F.lit(".0\n")))
    return op.running_times(c.table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey")


@job(
    c.with_("tasks")
    + """SELECT task_id, CASE WHEN task_id % 13 = 0 THEN 11 ELSE exitcode END AS exitcode, CASE WHEN requested_walltime < 10 THEN 'too short' WHEN task_id % 500 * 1000 >= requested_memory THEN 'memory' END AS retry FROM tasks"""
)
def error_reclassify(spark, sf):
    t = c.tasks(spark, sf).select("task_id", "exitcode", "requested_memory", F.col("requested_walltime").alias("seconds"), (F.col("task_id") % 500 * 1000).alias("used_memory"), F.when(F.col("task_id") % 13 == 0, "Error: Out of memory.").otherwise("fine").alias("text"))
    return op.error_reclassify(t, 10)


@job("WITH l AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT * FROM l WHERE regexp_matches(line, '^The .*\\.$')")
def grep_lines(spark, sf):
    return op.grep_lines(_docs(spark, sf), "doc_id", r"^The .*\.$")


@job(
    """WITH f AS (SELECT o_custkey, o_orderkey % 3 AS h, o_orderkey % 4 <> 1 AS valid FROM orders),
    a AS (SELECT o_custkey, bool_or(h = 0) AS e0, bool_or(h = 0 AND valid) AS v0, bool_or(h = 1) AS e1, bool_or(h = 1 AND valid) AS v1 FROM f GROUP BY 1)
    SELECT o_custkey, CASE WHEN e0 THEN 0 ELSE 16 END + CASE WHEN v0 THEN 0 ELSE 8 END + CASE WHEN e1 THEN 0 ELSE 4 END + CASE WHEN v1 THEN 0 ELSE 2 END AS bits FROM a"""
)
def output_validity_bits(spark, sf):
    k = F.col("o_orderkey")
    return op.output_validity_bits(c.table(spark, sf, "orders").select("o_custkey", (k % 3).alias("hypothesis"), (k % 4 != 1).alias("valid")), "o_custkey")


@job(
    """WITH w AS (SELECT source, text, string_split_regex(lower(text), '\\W+') AS w FROM documents), s AS (SELECT source, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x IN ('the', 'of')))::DOUBLE AS p, len(list_filter(w, lambda x: x IN ('on', 'le')))::DOUBLE AS q FROM w)
    SELECT source, round(avg(p / n), 9) AS pos, round(avg(q / n), 9) AS neg, round(avg((n - p - q) / n), 9) AS neu, round(avg(CASE WHEN p + q > 0 THEN (p - q) / (p + q) ELSE 0 END), 9) AS compound, 0::BIGINT AS skipped FROM s GROUP BY 1"""
)
def group_sentiment(spark, sf):
    scores = op.lexicon_scores(F.col("text"), ["the", "of"], ["on", "le"])
    scored = c.table(spark, sf, "documents").select("source", "text", *(v.alias(k) for k, v in scores.items()))
    done = op.group_sentiment(scored, "source", list(scores))
    return done.select("source", *(F.round(k, 9).alias(k) for k in scores), "skipped")


@job(
    """WITH t AS (SELECT source, CASE WHEN doc_id % 7 <> 0 THEN text WHEN doc_id % 2 = 0 THEN 'body of ' || source END AS t FROM documents)
    SELECT source, round(avg(length(t)::DOUBLE), 6) AS size, round(avg(length(t) - length(replace(t, '.', '')))::DOUBLE, 6) AS stops, count(*) FILTER (t IS NULL) AS skipped FROM t GROUP BY 1"""
)
def group_sentiment_scorer(spark, sf):
    """The same means with a scorer of one's own, a function of pandas series; texts are null here and there, and some have a body instead."""
    own = c.table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("body of "), "source")).alias("body"))
    scored = op.scored_texts(own, lambda texts: pd.DataFrame({"size": texts.str.len(), "stops": texts.str.count(r"\.")}), ["size", "stops"])
    done = op.group_sentiment(scored, "source", ["size", "stops"])
    return done.select("source", F.round("size", 6).alias("size"), F.round("stops", 6).alias("stops"), "skipped")


@job(
    """SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 <> 0 AND p_size <> 13 THEN p_partkey // p_size END AS share, CASE WHEN p_partkey % 7 <> 0 AND p_size <> 13 THEN 'part ' || p_partkey END AS label,
      CASE WHEN p_partkey % 7 = 0 THEN 'LookupError: no key' WHEN p_size = 13 THEN 'ValueError: size 13' END AS error FROM part"""
)
def apply_records(spark, sf):
    """A function that fails on some records."""

    def function(record: dict) -> dict:
        if record["p_partkey"] % 7 == 0:
            raise LookupError("no key")
        if record["p_size"] == 13:
            raise ValueError("size 13")
        return {"share": int(record["p_partkey"] // record["p_size"]), "label": f"part {record['p_partkey']}"}

    return rec.apply_records(c.table(spark, sf, "part").select("p_partkey", "p_size"), function, "share long, label string")


def _paths(spark, sf):
    """A path per user: the values of its events in order."""
    from pyspark.sql import Window

    e = c.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("path_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), "value")


PATHS = "paths AS (SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step, value FROM events)"


@job(f"WITH {PATHS} SELECT step, round(avg(value), 6) AS mean, max(value) AS highest FROM paths GROUP BY 1")
def path_statistics(spark, sf):
    return st.path_statistics(_paths(spark, sf)).select("step", F.round("mean", 6).alias("mean"), "highest")


@job(f"WITH {PATHS} SELECT max(value) AS highest, round((SELECT avg(f) FROM (SELECT arg_max(value, step) AS f FROM paths GROUP BY path_id)), 6) AS mean_final FROM paths")
def path_totals(spark, sf):
    return st.path_totals(_paths(spark, sf)).select("highest", F.round("mean_final", 6).alias("mean_final"))


@job(
    f"""WITH {PATHS}, m AS (SELECT path_id, step, 50 * exp(sum((0.05 - 0.02) * 0.01 + 0.2 * 0.1 * (value % 2 - 1)) OVER (PARTITION BY path_id ORDER BY step)) AS value FROM paths)
    SELECT path_id, step, round(value, 6) AS value FROM m UNION ALL SELECT DISTINCT path_id, 0, 50.0 FROM paths"""
)
def cumulative_path(spark, sf):
    draws = _paths(spark, sf).select("path_id", "step", (F.col("value") % 2 - 1).alias("z"))
    return st.cumulative_path(draws, 50, 0.05, 0.2, 0.01).select("path_id", "step", F.round("value", 6).alias("value"))


_SKEW = "SELECT '{0}' AS series, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, round(skewness({0}), 6) AS skew FROM lineitem"


@job(" UNION ALL ".join(_SKEW.format(x) for x in ("l_quantity", "l_extendedprice")))
def describe_series(spark, sf):
    done = st.describe_series(c.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return done.select("series", *(F.round(x, 6).alias(x) for x in ("mean", "sd", "skew")))


@job("SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', 1.0")
def describe_correlations(spark, sf):
    done = st.correlations(c.table(spark, sf, "lineitem"), "l_quantity", "l_tax")
    return done.select("a", "b", F.round("r", 6).alias("r"))


@job(
    """WITH p AS (SELECT value AS y1, value * value AS y2, lag(value) OVER w AS x1, lag(value * value) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS d, covar_pop(y1, x1) AS u1, covar_pop(y1, x2) AS u2, covar_pop(y2, x1) AS v1, covar_pop(y2, x2) AS v2 FROM p WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
    c AS (SELECT 'value' AS target, 'value' AS source, (u1 * d - u2 * b) / (a * d - b * b) AS k FROM s UNION ALL SELECT 'value', 'square', (u2 * a - u1 * b) / (a * d - b * b) FROM s
      UNION ALL SELECT 'square', 'value', (v1 * d - v2 * b) / (a * d - b * b) FROM s UNION ALL SELECT 'square', 'square', (v2 * a - v1 * b) / (a * d - b * b) FROM s)
    SELECT target, source, round(k, 4) AS coefficient FROM c"""
)
def var1_persistence(spark, sf):
    e = c.table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("value") * F.col("value")).alias("square"))
    return st.var1_persistence(e, "user_id", "event_id", "value", "square").withColumn("coefficient", F.round("coefficient", 4))


@job(
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, label::DOUBLE AS f FROM embeddings), s AS (SELECT avg(a) AS a, avg(b) AS b, f FROM p GROUP BY f),
    j AS (SELECT p.vec_id AS query_id, sqrt(pow(p.a - s.a, 2) + pow(p.b - s.b, 2)) AS d, s.f FROM p, s)
    SELECT query_id, round(coalesce(avg(f) FILTER (d = 0), sum(f / pow(d, 4)) FILTER (d > 0) / sum(1 / pow(d, 4)) FILTER (d > 0)), 6) AS value FROM j GROUP BY 1"""
)
def idw_interpolate(spark, sf):
    p = c.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.col("label").cast("double").alias("f"))
    samples = p.groupBy("f").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))  # the mean point of every label
    done = st.idw_interpolate(p.drop("f"), samples, ["a", "b"])
    return done.select("query_id", F.round("value", 6).alias("value"))


@job("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS member_id, min(o_totalprice) AS y FROM orders GROUP BY 1")
def best_member(spark, sf):
    return st.best_member(c.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("member_id"), F.col("o_totalprice").alias("y")), ["o_custkey"])


@job(
    """WITH m AS (SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS member_id, embedding AS x FROM embeddings), z AS (SELECT x AS x0 FROM m WHERE member_id = 0),
    d AS (SELECT unnest(x)::DOUBLE - unnest(x0)::DOUBLE AS dx FROM m, z) SELECT bool_and(abs(dx) <= 0.5) AS converged FROM d"""
)
def has_converged(spark, sf):
    e = c.table(spark, sf, "embeddings")
    low = e.agg(F.min("vec_id").alias("low"))
    pop = e.join(F.broadcast(low)).select((F.col("vec_id") - F.col("low")).alias("member_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return st.has_converged(pop, 0.5)


@job(
    """WITH n AS (SELECT p_retailprice AS v FROM part ORDER BY abs(p_retailprice - 1500), p_retailprice LIMIT 8)
    SELECT (SELECT count(*) FROM part WHERE p_retailprice < 1500) AS below, (SELECT count(*) FROM part WHERE p_retailprice > 1500) AS above, (SELECT min(v) < 1500 AND max(v) > 1500 FROM n) AS straddles"""
)
def target_bracket(spark, sf):
    return st.target_bracket(c.table(spark, sf, "part"), "p_retailprice", 1500, 8)


@job(c.with_("tree") + ", d AS (SELECT 'r1' AS root, 'r1' AS task_id, 0 AS depth UNION ALL SELECT root, tree.task_id, depth + 1 FROM d JOIN tree ON tree.parent_id = d.task_id) SELECT * FROM d")
def descendants(spark, sf):
    tree = c.tree(spark, sf)
    return g.descendants(tree, tree.where("task_id = 'r1'"))


@job(c.with_("tree") + ", d AS (SELECT 'n3' AS task_id UNION ALL SELECT tree.task_id FROM d JOIN tree ON tree.parent_id = d.task_id) SELECT tree.task_id FROM tree WHERE tree.task_id NOT IN (SELECT task_id FROM d)")
def delete_tasks(spark, sf):
    """A task and all below it leave the store."""
    tree = c.tree(spark, sf)
    gone = g.descendants(tree, tree.where("task_id = 'n3'"))
    return tree.join(gone.select("task_id"), "task_id", "left_anti").select("task_id")


@job(c.with_("deps") + ", l AS (SELECT p_partkey AS task_id, 0 AS level FROM part WHERE p_partkey // 2 = 0 UNION ALL SELECT deps.task_id, level + 1 FROM l JOIN deps ON deps.depends_on = l.task_id) SELECT task_id, max(level) AS level FROM l GROUP BY 1")
def topological_levels(spark, sf):
    return g.topological_levels(c.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id")), c.deps(spark, sf))


_RANK = "list_position(['STOPPED','UNKNOWN','RUNNING','SUBMITTED','NEW','TERMINATING','TERMINATED'], state)"
_NAME = "['STOPPED','UNKNOWN','RUNNING','SUBMITTED','RUNNING','TERMINATING','TERMINATED']"


@job(
    c.with_("tree", "tasks")
    + f""", o AS (SELECT 'o' || task_id AS task_id, 'c' || parent_id AS parent_id, state, exitcode FROM tasks),
    k AS (SELECT x.task_id, x.parent_id, CASE WHEN count(c.task_id) = 0 THEN 'TERMINATED' ELSE {_NAME}[min({_RANK.replace('state', 'c.state')})] END AS state, CASE WHEN count(c.task_id) = 0 THEN 0 ELSE max(c.exitcode) END AS exitcode
      FROM tree x LEFT JOIN o c ON c.parent_id = x.task_id WHERE x.task_id LIKE 'c%' GROUP BY 1, 2),
    n AS (SELECT x.task_id, x.parent_id, CASE WHEN count(c.task_id) = 0 THEN 'TERMINATED' ELSE {_NAME}[min({_RANK.replace('state', 'c.state')})] END AS state, CASE WHEN count(c.task_id) = 0 THEN 0 ELSE max(c.exitcode) END AS exitcode
      FROM tree x LEFT JOIN k c ON c.parent_id = x.task_id WHERE x.task_id LIKE 'n%' GROUP BY 1, 2),
    r AS (SELECT x.task_id, x.parent_id, CASE WHEN count(c.task_id) = 0 THEN 'TERMINATED' ELSE {_NAME}[min({_RANK.replace('state', 'c.state')})] END AS state, CASE WHEN count(c.task_id) = 0 THEN 0 ELSE max(c.exitcode) END AS exitcode
      FROM tree x LEFT JOIN n c ON c.parent_id = x.task_id WHERE x.task_id LIKE 'r%' GROUP BY 1, 2)
    SELECT task_id, state, exitcode FROM o UNION ALL SELECT task_id, state, exitcode FROM k UNION ALL SELECT task_id, state, exitcode FROM n UNION ALL SELECT task_id, state, exitcode FROM r"""
)
def rollup_tree(spark, sf):
    tree = c.tree(spark, sf)
    leaves = c.tasks(spark, sf).select(F.concat(F.lit("o"), "task_id").alias("task_id"), "state", "exitcode")
    depth = F.when(F.col("task_id").startswith("r"), 0).when(F.col("task_id").startswith("n"), 1).when(F.col("task_id").startswith("c"), 2).otherwise(3)
    return g.rollup_tree(tree, leaves, tree.select("task_id", depth.alias("depth")))


QUERIES, ORACLES = job.queries, job.oracles
