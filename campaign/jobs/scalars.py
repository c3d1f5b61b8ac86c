"""Jobs that apply the column expressions to text derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..sources import canonical as c
from .base import Jobs

job = Jobs()


def _part(spark, sf):
    return c.table(spark, sf, "part")


@job(
    """SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1024 ELSE 1073741824 END AS bytes FROM part"""
)
def parse_memory(spark, sf):
    unit = F.get(F.array(*map(F.lit, ("B", "kB", " MB", "KiB", " GiB"))), (F.col("p_partkey") % 5).cast("int"))
    return _part(spark, sf).select("p_partkey", f.parse_memory(F.concat("p_size", unit)).alias("bytes"))


@job(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 3 THEN NULL
    WHEN 0 THEN (l_suppkey * 3600 + l_linenumber * 60 + l_partkey % 60) * 1000000000 WHEN 1 THEN (l_linenumber * 86400 + l_suppkey * 60) * 1000000000 ELSE l_partkey * 1000000 END AS ns FROM lineitem"""
)
def parse_duration(spark, sf):
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.concat_ws(":", F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey") % 60)).when(k == 1, F.concat("l_linenumber", F.lit("d "), "l_suppkey", F.lit("m")))
    text = text.when(k == 2, F.concat("l_partkey", F.lit(" ms"))).otherwise(F.concat("l_linenumber", F.lit(":"), "l_suppkey"))
    return c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f.parse_duration(text).alias("ns"))


@job(
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN ((o_custkey % 5) * 86400 + (o_custkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59) * 1000000000 + (o_orderkey % 10) * 100000000
    ELSE ((o_orderkey % 60) * 60 + o_orderkey % 59) * 1000000000 END AS ns FROM orders"""
)
def parse_elapsed(spark, sf):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    long_ = F.concat((k % 5).cast("string"), F.lit("-"), (k % 24).cast("string"), F.lit(":"), (o % 60).cast("string"), F.lit(":"), (o % 59).cast("string"), F.lit("."), (o % 10).cast("string"))
    text = F.when(k % 2 == 0, long_).otherwise(F.concat((o % 60).cast("string"), F.lit(":"), (o % 59).cast("string")))
    return c.table(spark, sf, "orders").select("o_orderkey", f.parse_elapsed(text).alias("ns"))


@job(
    """WITH p AS (SELECT p_partkey, p_partkey * p_size * 1000 AS n FROM part)
    SELECT p_partkey, CASE WHEN n >= 1e12 THEN round(n / 1e12, 3) || 'TB' WHEN n >= 1e9 THEN round(n / 1e9, 3) || 'GB' WHEN n >= 1e6 THEN round(n / 1e6, 3) || 'MB'
    WHEN n >= 1e3 THEN round(n / 1e3, 3) || 'kB' ELSE round(n / 1.0::DOUBLE, 3) || 'B' END AS text FROM p"""
)
def quantity_text(spark, sf):
    units = {u: n for u, n in f.MEMORY_UNITS.items() if u in ("B", "kB", "MB", "GB", "TB")}
    return _part(spark, sf).select("p_partkey", f.quantity_text(F.col("p_partkey") * F.col("p_size") * 1000, units).alias("text"))


@job("SELECT p_partkey, p_partkey / nullif(CAST(p_size % 7 AS DOUBLE), 0) AS ratio FROM part")
def quantity_ratio(spark, sf):
    return _part(spark, sf).select("p_partkey", f.quantity_ratio(F.col("p_partkey"), F.col("p_size") % 7).alias("ratio"))


@job("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) END AS epoch FROM orders")
def parse_timestamp_any(spark, sf):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("yesterday"))
    return c.table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(f.parse_timestamp_any(text, ["yyyy-MM-dd", "dd/MM/yyyy"])).alias("epoch"))


@job(
    """SELECT o_orderkey, make_timestamp(year(o_orderdate) - CASE WHEN 1 + o_custkey % 12 <= month(o_orderdate) THEN 0 ELSE 1 END, 1 + o_custkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, 0.0) AS t FROM orders"""
)
def infer_year(spark, sf):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x: x.cast("int")
    return c.table(spark, sf, "orders").select("o_orderkey", f.infer_year(n(1 + k % 12), n(1 + o % 28), n(o % 24), n(o % 60), F.col("o_orderdate")).alias("t"))


CODES = "codes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 256 AS INT) END AS e, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 128 AS INT) END AS s FROM lineitem)"


def _codes(spark, sf):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    return c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k % 5 != 0, k % 256).cast("int").alias("e"), F.when(s % 3 != 0, s % 128).cast("int").alias("s"))


@job(f"WITH {CODES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN e IS NULL AND s IS NULL THEN NULL ELSE ((coalesce(e, -1) & 255) << 8) | (coalesce(s, 0) & 127) END AS returncode FROM codes")
def encode_returncode(spark, sf):
    return _codes(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f.encode_returncode(F.col("e"), F.col("s")).alias("returncode"))


@job("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey * 37 % 65536 AS INT) // 256 AS exitcode, CAST(l_partkey * 37 % 65536 AS INT) & 127 AS signal FROM lineitem")
def decode_returncode(spark, sf):
    rc = (F.col("l_partkey") * 37 % 65536).cast("int")
    return c.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", f.decode_exitcode(rc).alias("exitcode"), f.decode_signal(rc).alias("signal"))


@job(
    """WITH r AS (SELECT p_partkey, CAST(p_partkey % 512 AS INT) & 255 AS low FROM part)
    SELECT p_partkey, CASE WHEN low > 128 THEN low - 128 ELSE 0 END AS signal, CASE WHEN low > 128 THEN -1 ELSE low END AS exitcode FROM r"""
)
def shell_exit(spark, sf):
    signal, code = f.shell_exit((F.col("p_partkey") % 512).cast("int"))
    return _part(spark, sf).select("p_partkey", signal.alias("signal"), code.alias("exitcode"))


_SLURM = ["PENDING", "RUNNING", "SUSPENDED", "COMPLETED", "CANCELLED by 1000", "NODE_FAIL", "BOOT"]


@job(f"SELECT o_orderkey, ['SUBMITTED','RUNNING','STOPPED','TERMINATING','TERMINATING','TERMINATING','UNKNOWN'][o_orderkey % {len(_SLURM)} + 1] AS state FROM orders")
def map_batch_state(spark, sf):
    code = F.get(F.array(*map(F.lit, _SLURM)), (F.col("o_orderkey") % len(_SLURM)).cast("int"))
    return c.table(spark, sf, "orders").select("o_orderkey", f.map_batch_state("slurm", code).alias("state"))


_SIGNALS = ", ".join(f"(CAST({k} AS INT), '{v}')" for k, v in f.PSEUDO_SIGNALS.items())


@job(f"SELECT o_orderkey, description FROM orders LEFT JOIN (VALUES {_SIGNALS}) s(signal, description) ON signal = 118 + o_orderkey % 9")
def signal_description(spark, sf):
    return c.table(spark, sf, "orders").select("o_orderkey", f.signal_description((118 + F.col("o_orderkey") % 9).cast("int")).alias("description"))


@job("SELECT o_orderkey, o_orderkey % 6 < 4 AS value FROM orders")
def parse_boolean(spark, sf):
    text = F.get(F.array(*map(F.lit, (" True", "YES", "on ", "1", "no", "maybe"))), (F.col("o_orderkey") % 6).cast("int"))
    return c.table(spark, sf, "orders").select("o_orderkey", f.parse_boolean(text).alias("value"))


@job("SELECT p_partkey, CAST(p_size AS DOUBLE) AS percent FROM part")
def parse_percent(spark, sf):
    return _part(spark, sf).select("p_partkey", f.parse_percent(F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(""))).alias("percent"))


@job("SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size * pow(10.0::DOUBLE, -(p_partkey % 5)) WHEN p_partkey % 3 = 1 THEN p_size * pow(10.0::DOUBLE, p_partkey % 5) ELSE p_size END, 9) AS value FROM part")
def parse_power_notation(spark, sf):
    k, n = F.col("p_partkey") % 3, (F.col("p_partkey") % 5).cast("string")
    text = F.when(k == 0, F.concat("p_size", F.lit("x10min"), n)).when(k == 1, F.concat("p_size", F.lit("x10"), n)).otherwise(F.col("p_size").cast("string"))
    return _part(spark, sf).select("p_partkey", F.round(f.parse_power_notation(text), 9).alias("value"))


@job("SELECT o_orderkey, CAST(o_custkey % 5 AS VARCHAR) AS gamma, CAST(o_custkey % 3 AS VARCHAR) AS beta_disc FROM orders")
def split_run_name(spark, sf):
    run = F.concat(F.lit("gamma="), F.col("o_custkey") % 5, F.lit("_beta="), F.col("o_custkey") % 3)
    m = c.table(spark, sf, "orders").select("o_orderkey", f.split_run_name(run).alias("m"))
    return m.select("o_orderkey", F.try_element_at("m", F.lit("gamma")).alias("gamma"), F.try_element_at("m", F.lit("beta_disc")).alias("beta_disc"))


@job("SELECT p_partkey, replace(replace(array_to_string(list_transform(string_split_regex(trim(p_type || '. ' || p_name), '\\s+'), lambda w: lower(w[1]) || w[2:]), '_'), '.', ''), '-', '_') AS name FROM part")
def normalise_name(spark, sf):
    return _part(spark, sf).select("p_partkey", f.normalise_name(F.concat("p_type", F.lit(". "), "p_name")).alias("name"))


@job("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN printf('%.15f', p_size + 0.5::DOUBLE) ELSE p_brand END AS value FROM part")
def format_value(spark, sf):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_brand"))
    return _part(spark, sf).select("p_partkey", f.format_value(text).alias("value"))


@job(
    """SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages"""
)
def url_parts(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", f.url_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.query")


@job("SELECT page_id, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || '/data.txt' || regexp_extract(url, '([?#].*)$', 1) AS url FROM pages")
def url_adjoin(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", f.url_adjoin(F.col("url"), "data.txt").alias("url"))


@job("SELECT o_orderkey, '/in/a' || (o_custkey % 9) || '=a' || (o_custkey % 9) || ';out/b' || (o_custkey % 7) || '=b' || (o_custkey % 7) AS names FROM orders")
def io_map(spark, sf):
    paths = F.array(F.concat(F.lit("/in/a"), F.col("o_custkey") % 9), F.concat(F.lit("out/b"), F.col("o_custkey") % 7))
    m = c.table(spark, sf, "orders").select("o_orderkey", f.io_map(paths).alias("m"))
    return m.select("o_orderkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("names"))


@job("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'caf' || chr(233) || ' ' || chr(8364) || '!' WHEN 2 THEN 'caf' || chr(233) || chr(129) ELSE text END AS text FROM documents")
def decode_bytes(spark, sf):
    """Texts as UTF-8 or UTF-16 with a byte order mark, words as Windows-1252, and bytes that only Latin-1 takes."""
    k = F.col("doc_id") % 4
    utf16 = F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))
    data = F.when(k == 0, F.col("text").cast("binary")).when(k == 1, utf16).when(k == 2, F.lit(b"caf\xe9\x81")).otherwise(F.lit(b"caf\xe9 \x80!"))
    return c.table(spark, sf, "documents").select("doc_id", f.decode_bytes(data, ["utf-8", "utf-16", "cp1252", "latin-1"]).alias("text"))


@job("SELECT p_partkey, 'run ' || p_brand || ' with ${other} size=' || p_size AS text FROM part")
def substitute_template(spark, sf):
    values = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return _part(spark, sf).select("p_partkey", f.substitute_template(F.lit("run ${brand} with ${other} size=${size}"), values).alias("text"))


QUERIES, ORACLES = job.queries, job.oracles
