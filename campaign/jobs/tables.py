"""Jobs on result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as op
from ..sources import canonical as c
from ..sources.scratch import new_folder
from ..sources.store import TaskStore
from .base import Jobs

job = Jobs()


def _t(spark, sf, name, *columns):
    return c.table(spark, sf, name).select(*columns)


@job("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def subset(spark, sf):
    return op.subset(_t(spark, sf, "part", "p_partkey", "p_size"), F.col("p_size") > 25)


@job("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity BETWEEN 10 AND 20")
def conditions_and_range(spark, sf):
    done = op.conditions_and_range(c.table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}, "l_quantity", 10, 20)
    return done.select("l_orderkey", "l_partkey", "l_quantity")


@job(
    """WITH t AS (SELECT s_suppkey, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
    SELECT t.s_suppkey, count(s.s_suppkey) AS matches FROM t LEFT JOIN supplier s ON abs(s.s_acctbal - x) < 5.0 AND abs(s.s_nationkey - y) < 5.0 GROUP BY 1"""
)
def match_within(spark, sf):
    s = _t(spark, sf, "supplier", F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    targets = _t(spark, sf, "supplier", "s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return op.match_within(s, targets, "s_suppkey", {"a": "x", "b": "y"}, 5.0)


@job("SELECT o_orderkey, row_idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) WHERE row_idx BETWEEN 100 AND 199")
def row_slice(spark, sf):
    return op.row_slice(op.numbered(_t(spark, sf, "orders", "o_orderkey"), ["o_orderkey"]), 100, 200)


@job("SELECT p_brand, p_size FROM part")
def keep(spark, sf):
    return op.keep(c.table(spark, sf, "part"), ["p_brand", "p_size"])


@job("SELECT * EXCLUDE (p_name, p_type) FROM part")
def drop(spark, sf):
    return op.drop(c.table(spark, sf, "part"), ["p_name", "p_type"])


@job("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def rename(spark, sf):
    return op.rename(c.table(spark, sf, "nation"), {"n_nationkey": "id", "n_name": "name"})


@job("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def order_columns(spark, sf):
    return op.order_columns(c.table(spark, sf, "nation"), ["n_name"])


@job("SELECT p_partkey, p_retailprice * 2 AS doubled FROM part")
def set_column(spark, sf):
    return op.set_column(_t(spark, sf, "part", "p_partkey", "p_retailprice"), "doubled", F.col("p_retailprice") * 2).drop("p_retailprice")


@job("SELECT p_partkey, CAST(NULL AS DOUBLE) AS y FROM part")
def empty_column(spark, sf):
    return op.empty_column(_t(spark, sf, "part", "p_partkey"), "y", "double")


@job(
    """WITH m AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1)
    SELECT o_custkey, round(pow(mean, 4), 0) AS mean_pow4, high - low AS spread, round(2 * mean, 9) AS mean_double FROM m"""
)
def derive_moments(spark, sf):
    m = c.table(spark, sf, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("mean"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return op.derive_moments(m, "mean", "low", "high").select("o_custkey", F.round("mean_pow4", 0).alias("mean_pow4"), "spread", F.round("mean_double", 9).alias("mean_double"))


@job("SELECT l_orderkey, l_partkey, l_discount, l_tax FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def drop_missing(spark, sf):
    return op.drop_missing(_t(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_discount", "l_tax"), "l_discount", "l_tax")


@job(
    """WITH l AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT k, c_name, n, CASE WHEN l.k IS NULL THEN 2 WHEN r.k IS NULL THEN 1 ELSE 3 END AS _merge FROM l FULL JOIN r USING (k)"""
)
def merge_indicator(spark, sf):
    left = _t(spark, sf, "customer", F.col("c_custkey").alias("k"), "c_name").where("k % 3 <> 0")
    right = c.table(spark, sf, "orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return op.merge_indicator(left, right, "k")


@job("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_one_to_one(spark, sf):
    nation = _t(spark, sf, "nation", F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return op.lookup_one_to_one(_t(spark, sf, "supplier", "s_suppkey", "s_nationkey"), nation, "s_nationkey", "n_name")


_SHIPPED = "SELECT l_shipdate AS age, l_returnflag AS run, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


@job(f"SELECT age, max(CASE WHEN run = 'A' THEN v END) AS \"A\", max(CASE WHEN run = 'N' THEN v END) AS \"N\", max(CASE WHEN run = 'R' THEN v END) AS \"R\" FROM ({_SHIPPED}) GROUP BY 1")
def wide_merge(spark, sf):
    long_ = c.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("age"), F.col("l_returnflag").alias("run")).agg(F.sum("l_quantity").alias("v"))
    return op.wide_merge(long_, "age", "run", "v", ["A", "N", "R"])


@job(
    """WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_acctbal AS v FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_acctbal AS v FROM supplier)
    SELECT row_idx, a.v AS customer, b.v AS supplier FROM a FULL JOIN b USING (row_idx)"""
)
def concat_columns(spark, sf):
    customer = op.numbered(_t(spark, sf, "customer", "c_custkey", F.col("c_acctbal").alias("v")), ["c_custkey"])
    supplier = op.numbered(_t(spark, sf, "supplier", "s_suppkey", F.col("s_acctbal").alias("v")), ["s_suppkey"])
    return op.concat_columns({"customer": customer, "supplier": supplier}, "v")


_LOG = c.with_("tasks") + """, i AS (SELECT l_orderkey AS task_id, l_linenumber AS row_idx, min(l_quantity) AS q, min(l_extendedprice) AS p, min(l_tax) AS t FROM lineitem GROUP BY 1, 2),
    l AS (SELECT task_id, row_idx, unnest([1, 2, 3]) AS column_no, unnest(['quantity', CASE WHEN task_id % 3 = 0 THEN 'l_cost' ELSE 'l_price' END, 'x_price']) AS name, unnest([q, p, t]) AS value FROM i),
    ok AS (SELECT task_id FROM tasks WHERE returncode = 0), k AS (SELECT unnest(['price', 'l_price', 'quantity', 'none']) AS key),
    h AS (SELECT task_id, key, min(column_no) AS column_no FROM l, k WHERE contains(name, key) AND task_id IN (SELECT task_id FROM ok) GROUP BY 1, 2)"""
_WANTED = ["price", "l_price", "quantity", "none"]


def _logs(spark, sf):
    item = c.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("row_idx")).agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("p"), F.min("l_tax").alias("t"))
    price = F.when(F.col("task_id") % 3 == 0, "l_cost").otherwise("l_price")
    cells = F.inline(F.array(*(F.struct(F.lit(k).alias("column_no"), n.alias("name"), F.col(v).alias("value")) for k, n, v in ((1, F.lit("quantity"), "q"), (2, price, "p"), (3, F.lit("x_price"), "t")))))
    return item.select("task_id", "row_idx", cells)


@job(_LOG + " SELECT key, task_id, row_idx, value FROM l JOIN h USING (task_id, column_no)")
def collect_log_columns(spark, sf):
    return op.collect_log_columns(_logs(spark, sf), c.tasks(spark, sf), _WANTED)[0]


@job(_LOG + " SELECT task_id, key FROM ok, k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.task_id = ok.task_id AND h.key = k.key)")
def missing_log_columns(spark, sf):
    return op.collect_log_columns(_logs(spark, sf), c.tasks(spark, sf), _WANTED)[1]


@job(
    """WITH p AS (SELECT DISTINCT CAST(p_partkey % 97 AS BIGINT) AS idx, 'par' || (p_partkey % 97) || '_v2.txt' AS param FROM part),
    d AS (SELECT s_suppkey % 101 AS idx, max('dir3/run1_data' || (s_suppkey % 101)) AS data FROM supplier GROUP BY 1) SELECT idx, param, data FROM p FULL JOIN d USING (idx)"""
)
def pair_by_index(spark, sf):
    params = _t(spark, sf, "part", F.concat(F.lit("par"), F.col("p_partkey") % 97, F.lit("_v2.txt")).alias("path")).distinct()
    return op.pair_by_index(params, _t(spark, sf, "supplier", F.concat(F.lit("dir3/run1_data"), F.col("s_suppkey") % 101).alias("path")))


@job("SELECT 'f' || p_partkey AS path FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def with_companion(spark, sf):
    part = c.table(spark, sf, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey"))
    files = part.where("p_partkey % 3 = 0").select(name.alias("path")).union(part.where("p_partkey % 2 = 0").select(F.concat(name, F.lit(".bai"))))
    return op.with_companion(files, ".bai")


@job(
    """WITH t AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'd/f' || (s_suppkey % 40) ELSE 'f' || (s_suppkey % 30) END AS key, s_suppkey AS n, s_name AS value FROM supplier),
    k AS (SELECT key, arg_max(value, n) AS value FROM t GROUP BY 1), p AS (SELECT p_partkey, 'd/f' || (p_partkey % 60) AS path FROM part)
    SELECT p_partkey, path, coalesce(a.value, b.value, 'none') AS value FROM p LEFT JOIN k a ON a.key = path LEFT JOIN k b ON b.key = regexp_extract(path, '[^/]*$')"""
)
def lookup_with_fallback(spark, sf):
    k = F.col("s_suppkey")
    table = _t(spark, sf, "supplier", F.when(k % 2 == 0, F.concat(F.lit("d/f"), k % 40)).otherwise(F.concat(F.lit("f"), k % 30)).alias("path"), k.alias("n"), F.col("s_name").alias("value"))
    return op.lookup_with_fallback(_t(spark, sf, "part", "p_partkey", F.concat(F.lit("d/f"), F.col("p_partkey") % 60).alias("path")), table, "none")


@job("SELECT c_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS labels FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def attach_labels(spark, sf):
    labels = _t(spark, sf, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return op.attach_labels(_t(spark, sf, "customer", "c_custkey"), labels, "c_custkey", "o_orderkey", "o_orderpriority")


@job("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def append_tables(spark, sf):
    top = _t(spark, sf, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return op.append_tables(top, _t(spark, sf, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("other")))


@job("SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def sort_table(spark, sf):
    return op.sort_table(_t(spark, sf, "supplier", "s_nationkey", "s_acctbal", "s_suppkey"), "s_nationkey", "s_acctbal")


@job("SELECT 'job.' || p_partkey AS id, 'job' AS prefix, p_partkey AS seqno FROM part")
def sort_ids(spark, sf):
    return op.sort_ids(_t(spark, sf, "part", F.concat(F.lit("job."), F.col("p_partkey")).alias("id")), "id")


@job("SELECT p_partkey, 'job.' || ((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY p_partkey)) AS id FROM part")
def assign_ids(spark, sf):
    known = _t(spark, sf, "supplier", F.concat(F.lit("job."), F.col("s_suppkey")).alias("id"))
    return op.assign_ids(_t(spark, sf, "part", "p_partkey"), known, ["p_partkey"], "job")


@job("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 * 250 AS chunk FROM orders")
def chunk_rows(spark, sf):
    return op.chunk_rows(_t(spark, sf, "orders", "o_orderkey"), ["o_orderkey"], 250)


@job(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
      row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS row_idx FROM lineitem"""
)
def number_rows(spark, sf):
    """All line items, with more columns than the leading ones of the order, as a ledger with line numbers."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return op.numbered(_t(spark, sf, "lineitem", *columns), columns)


@job("SELECT c_custkey AS a, c_name AS b, 0 AS slice FROM customer UNION ALL SELECT c_nationkey, CAST(c_acctbal AS VARCHAR), 1 FROM customer")
def chunk_columns(spark, sf):
    df = _t(spark, sf, "customer", "c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_acctbal").cast("string").alias("c_acctbal"))
    first, second = (df.select(*names).toDF("a", "b").withColumn("slice", F.lit(k)) for k, names in enumerate(op.chunk_columns(df.columns, 2)))
    return first.union(second)


@job(
    c.with_("listing_old", "listing_new")
    + """, d AS (SELECT path, CASE WHEN o.mtime IS NULL THEN 'created' WHEN n.mtime IS NULL THEN 'deleted' WHEN n.mtime > o.mtime THEN 'modified' END AS event
    FROM listing_old o FULL JOIN listing_new n USING (path)) SELECT * FROM d WHERE event IS NOT NULL"""
)
def snapshot_diff(spark, sf):
    return op.snapshot_diff(c.listing(spark, sf, False), c.listing(spark, sf, True))


_WRITES = """w AS (SELECT c_custkey AS id, 3::BIGINT AS version, 1 AS write_no, c_mktsegment AS state FROM customer
    UNION ALL SELECT o_custkey + 5, o_orderkey % 7, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END, o_orderpriority FROM orders)"""


@job(f"WITH {_WRITES} SELECT id, max(version) AS version, arg_max(state, (version, write_no > 1, state)) AS state FROM w GROUP BY 1")
def upsert_tasks(spark, sf):
    """Versions are few, so most writes of an id tie."""
    store, writes = _store_writes(spark, sf)
    return op.upsert_tasks(store, writes.drop("o_orderstatus"), "id", "version")


def _store_writes(spark, sf):
    store = _t(spark, sf, "customer", F.col("c_custkey").alias("id"), F.lit(3).cast("long").alias("version"), F.col("c_mktsegment").alias("state"))
    writes = _t(spark, sf, "orders", (F.col("o_custkey") + 5).alias("id"), (F.col("o_orderkey") % 7).alias("version"), F.col("o_orderpriority").alias("state"), "o_orderstatus")
    return store, writes


@job(
    f"""WITH {_WRITES}, a AS (SELECT id, max(version) AS version, arg_max(state, (version, write_no, state)) AS state, arg_max(write_no, (version, write_no)) AS n FROM w WHERE write_no < 3 GROUP BY 1),
    d AS (SELECT a.*, c_nationkey = 3 IS TRUE AS gone FROM a LEFT JOIN customer ON c_custkey = id),
    e AS (SELECT id, version, state, gone, 3 AS n FROM d WHERE gone UNION ALL SELECT id, version, state, false, n FROM d WHERE NOT gone UNION ALL SELECT id, version, state, false, 4 FROM w WHERE write_no = 3)
    SELECT id, max(version) AS version, arg_max(state, (version, n, state)) AS state FROM e GROUP BY 1 HAVING NOT arg_max(gone, (version, n))"""
)
def store_updates(spark, sf):
    """A store of customers after a batch of writes, a deletion of a nation's, and another batch, each of which rewrites the buckets it touches."""
    first, writes = _store_writes(spark, sf)
    store = TaskStore(spark, new_folder(spark, "store"), "id long, version long, state string", "id", "version", 16)
    store.upsert(first)
    store.upsert(writes.where("o_orderstatus = 'F'"))
    store.delete(_t(spark, sf, "customer", F.col("c_custkey").alias("id"), "c_nationkey").where("c_nationkey = 3"))
    store.upsert(writes.where("o_orderstatus <> 'F'"))
    return store.read()


@job("SELECT p_brand, min(p_partkey) AS first_at FROM part GROUP BY 1")
def distinct_names(spark, sf):
    return op.distinct_names(c.table(spark, sf, "part"), "p_brand", "p_partkey")


@job(c.with_("deps") + "SELECT DISTINCT depends_on AS task_id FROM deps WHERE depends_on NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)")
def missing_dependencies(spark, sf):
    return op.missing_dependencies(c.deps(spark, sf), _t(spark, sf, "part", F.col("p_partkey").alias("task_id")).where("task_id % 3 <> 0"))


@job("SELECT o_custkey, count(*) AS found FROM orders GROUP BY 1 HAVING count(*) <> 10")
def check_exact_count(spark, sf):
    return op.check_exact_count(c.table(spark, sf, "orders"), "o_custkey", 10)


QUERIES, ORACLES = job.queries, job.oracles
