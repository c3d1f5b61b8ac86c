"""Jobs on parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as op
from ..sources import canonical as c
from .base import Jobs

job = Jobs()


def _part(spark, sf):
    return c.table(spark, sf, "part")


@job("SELECT p_partkey, unnest(range(CAST(p_partkey AS BIGINT), p_partkey + p_size, 1 + p_partkey % 3)) AS value FROM part")
def expand_range(spark, sf):
    r = _part(spark, sf).select("p_partkey", F.col("p_partkey").alias("low"), (F.col("p_partkey") + F.col("p_size")).alias("high"), (1 + F.col("p_partkey") % 3).alias("step"))
    return op.expand_ranges(r, "low", "high", "step").select("p_partkey", "value")


@job("SELECT r_name, p_brand, s FROM region, (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT CAST(p_size % 5 AS INT) AS s FROM part) WHERE NOT (r_name = 'ASIA' AND s = 0)")
def expand_grid(spark, sf):
    region = c.table(spark, sf, "region").select("r_name")
    sizes = _part(spark, sf).select((F.col("p_size") % 5).cast("int").alias("s")).distinct()
    return op.expand_grid([region, _part(spark, sf).select("p_brand").distinct(), sizes], ~((F.col("r_name") == "ASIA") & (F.col("s") == 0)))


@job("SELECT a.p_brand AS outer_brand, b.p_brand AS inner_brand FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_brand FROM part) b WHERE b.p_brand >= a.p_brand")
def expand_dependent_grid(spark, sf):
    brands = _part(spark, sf).select("p_brand").distinct()
    return op.expand_dependent_grid(brands.toDF("outer_brand"), brands.toDF("inner_brand"), F.col("inner_brand") >= F.col("outer_brand"))


def _sides(spark, sf):
    """The lengths of a grid's sides: regions, nations and brands."""
    return [c.table(spark, sf, "region").count(), c.table(spark, sf, "nation").count(), _part(spark, sf).select("p_brand").distinct().count()]


_SIDES = "s AS (SELECT (SELECT count(*) FROM region) AS a, (SELECT count(*) FROM nation) AS b, (SELECT count(DISTINCT p_brand) FROM part) AS c)"


@job(f"WITH {_SIDES}, g AS (SELECT x.range AS i0, y.range AS i1, z.range AS i2, (x.range * b + y.range) * c + z.range AS n FROM s, range(a) x, range(b) y, range(c) z) SELECT * FROM g WHERE i0 < i1 OR i1 < i2")
def index_grid(spark, sf):
    return op.index_grid(spark, _sides(spark, sf), "lowertr")


@job(
    """WITH g AS (SELECT r_name, p_brand, n_name, row_number() OVER (ORDER BY r_name, p_brand, n_name) - 1 AS run_no FROM region, (SELECT DISTINCT p_brand FROM part), nation)
    SELECT r_name AS region, p_brand AS brand, n_name AS nation, run_no, 'para_region=' || r_name || '_brand=' || p_brand || '_nation=' || n_name AS run, CASE run_no WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END AS tries FROM g"""
)
def grouped_grid(spark, sf):
    values = lambda df, column: sorted(r[0] for r in df.select(column).distinct().collect())
    nations = c.table(spark, sf, "nation")
    groups = {0: {"region": values(c.table(spark, sf, "region"), "r_name"), "brand": values(_part(spark, sf), "p_brand")}, 1: {"nation": values(nations, "n_name")}, -1: {"tries": ["1", "2", "3"]}}
    return op.grouped_grid(spark, groups)


@job("SELECT n_nationkey, CAST(n_regionkey * 7 AS INT) AS grp, CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INT) AS new_group FROM nation WHERE n_regionkey <> 2")
def remap_groups(spark, sf):
    nation = c.table(spark, sf, "nation").where("n_regionkey <> 2").select("n_nationkey", (F.col("n_regionkey") * 7).cast("int").alias("grp"))
    return op.remap_groups(nation, "grp")


@job("SELECT p_brand, p_size, s_name FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part), (SELECT s_name FROM supplier)")
def product_tables(spark, sf):
    return op.expand_grid([_part(spark, sf).select("p_brand").distinct(), _part(spark, sf).select("p_size").distinct(), c.table(spark, sf, "supplier").select("s_name")])


@job("SELECT DISTINCT n_name, value FROM nation, (SELECT unnest(range(1, 6)) AS value UNION ALL SELECT unnest(range(10, 21, 5)))")
def ranges_by_files(spark, sf):
    values = op.expand_range(spark, "1:5", closed=True).union(op.expand_range(spark, "10:20:5", closed=True))
    return op.expand_grid([c.table(spark, sf, "nation").select("n_name"), values])


@job("WITH m AS (SELECT CAST(max(o_orderkey) AS BIGINT) AS top FROM orders), v AS (SELECT unnest(range(100, 100 + top, 3)) AS value FROM m) SELECT value, 100 + (value - 100) // 60 * 60 AS chunk FROM v")
def slice_range(spark, sf):
    top = c.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    return op.slice_range(spark, 100, 100 + top, 3, 20)


@job("WITH t AS (SELECT p_partkey, CAST(p_partkey % 50 AS BIGINT) AS total FROM part), s AS (SELECT *, unnest(range(0, CAST(ceil(total / 7) AS BIGINT))) AS part FROM t WHERE total > 0) SELECT *, least(7, total - part * 7) AS size FROM s")
def split_total(spark, sf):
    return op.split_total(_part(spark, sf).select("p_partkey", (F.col("p_partkey") % 50).alias("total")), "total", 7)


@job('WITH t AS (SELECT p_partkey, CAST(p_partkey % 50 AS BIGINT) AS total FROM part), s AS (SELECT *, unnest(range(0, total, 8)) AS start FROM t WHERE total > 0) SELECT *, least(start + 7, total) AS "end" FROM s')
def slices_with_last(spark, sf):
    return op.slices_with_last(_part(spark, sf).select("p_partkey", (F.col("p_partkey") % 50).alias("total")), "total", 8)


@job("SELECT p_partkey, CAST(r AS INT) AS repeat, ('0x' || substr(md5(p_partkey || ':' || r || ':0'), 1, 8))::BIGINT % 2147483648 AS seed FROM part, range(4) t(r)")
def replicate_seeds(spark, sf):
    return op.replicate_seeds(_part(spark, sf).select("p_partkey"), "p_partkey", 4)


@job("SELECT p_partkey FROM part WHERE p_partkey >= 5 AND p_partkey < 150 AND (p_partkey - 5) % 4 = 0")
def select_models(spark, sf):
    return op.select_models(_part(spark, sf).select("p_partkey"), "p_partkey", "5:150:4")


@job("SELECT p_partkey, CAST(4 * p_size + 8 AS DOUBLE) AS first_row, p_partkey + 1.5::DOUBLE AS second_row, 2 AS rows FROM part")
def parse_value_list(spark, sf):
    size = F.col("p_size")
    text = F.concat(F.lit("linspace("), size, F.lit(","), size + 4, F.lit(",3),"), size, F.lit(", 2; "), "p_partkey", F.lit(",1.5"))
    rows = _part(spark, sf).select("p_partkey", op.parse_value_list(text).alias("rows"))
    total = lambda k: F.aggregate(F.get("rows", F.lit(k)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("p_partkey", total(0).alias("first_row"), total(1).alias("second_row"), F.size("rows").alias("rows"))


@job(
    """WITH l AS (SELECT p_partkey, unnest([0, 1, 3]) AS n, unnest(['brand = ' || p_brand, 'size 0', 'plain text line']) AS line FROM part)
    SELECT l.p_partkey, CAST(n AS INT) AS n, CASE WHEN n = 1 AND l.p_partkey % 2 = 0 THEN 'size ' || p_size ELSE line END AS line FROM l JOIN part USING (p_partkey)"""
)
def apply_substitutions(spark, sf):
    lines = _part(spark, sf).select("p_partkey", F.posexplode(F.array(F.concat(F.lit("brand = "), "p_brand"), F.lit("size 0"), F.lit("  "), F.lit("plain text line"))).alias("n", "line"))
    new = _part(spark, sf).where("p_partkey % 2 = 0").select("p_partkey", F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value"))
    return op.apply_substitutions(lines, new, "p_partkey")[0]


@job('WITH t AS (SELECT max(o_orderkey) AS top FROM orders), s AS (SELECT unnest(range(CAST(top AS BIGINT), 100000 + 2 * top, 250)) AS start, 100000 + 2 * top AS total FROM t) SELECT start, least(start + 250, total) AS "end" FROM s')
def unscheduled_range(spark, sf):
    scheduled = c.table(spark, sf, "orders").select((F.col("o_orderkey") - 1).alias("start"), F.col("o_orderkey").alias("end"))
    top = scheduled.agg(F.max("end")).first()[0]
    return op.unscheduled_range(spark, scheduled, 100_000 + 2 * top, 250)


@job("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def scheduled_range_total(spark, sf):
    names = c.table(spark, sf, "orders").select(F.concat(F.col("o_orderkey"), F.lit("--"), F.col("o_orderkey") + F.col("o_custkey")).alias("name"))
    return op.scheduled_range_total(names, "name")


@job("SELECT 'run_' || (o_custkey % 50) AS run, max(o_orderkey) AS iteration, count(*) AS n FROM orders GROUP BY 1")
def max_iteration(spark, sf):
    return op.max_iteration(c.tasks(spark, sf), "jobname")


@job("SELECT count(*) AS files, max(o_orderkey) AS highest FROM orders WHERE o_orderkey % 3 <> 0")
def generation_progress(spark, sf):
    k = F.col("o_orderkey")
    return op.generation_progress(c.table(spark, sf, "orders").select(F.when(k % 3 == 0, "readme").otherwise(F.concat(F.lit("out/generation."), k)).alias("path")), "path")


@job(
    """WITH p AS (SELECT CAST(c_custkey % 40 AS BIGINT) AS grp, CASE WHEN c_custkey % 40 < 5 AND c_nationkey % 2 = 0 THEN 'diag' ELSE 'lowerTr' END AS r, CASE WHEN c_acctbal > 9000 THEN 'none' ELSE 'swIndicator' END AS prop FROM customer),
    a AS (SELECT grp, count(DISTINCT lower(r)) AS k, min(lower(r)) AS f, count(*) FILTER (prop <> 'swIndicator') AS n FROM p GROUP BY 1),
    x AS (SELECT grp AS "group", CASE WHEN k <> 1 THEN 'inconsistent' WHEN f = 'lowertr' AND n = 1 THEN 'lowertr on one variable' END AS problem FROM a) SELECT * FROM x WHERE problem IS NOT NULL"""
)
def check_group_restrictions(spark, sf):
    group = F.col("c_custkey") % 40
    params = c.table(spark, sf, "customer").select(
        group.alias("group"), F.when((group < 5) & (F.col("c_nationkey") % 2 == 0), "diag").otherwise("lowerTr").alias("restriction"), F.when(F.col("c_acctbal") > 9000, "none").otherwise("swIndicator").alias("property")
    )
    return op.check_group_restrictions(params)


QUERIES, ORACLES = job.queries, job.oracles
