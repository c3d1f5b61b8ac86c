"""Jobs on readers and writers: Spark writes text derived from the given tables to the shared folder, and the reader reads it."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..sources import canonical as c
from ..sources import io
from ..sources.scratch import new_folder
from ..sources.tail import store
from .base import Jobs
from .streams import drain

job = Jobs()


def _part(spark, sf):
    return c.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")


def _by_nation(spark, sf):
    """A text per nation, each in a file of its own: its customers' keys and balances, a line each."""
    line = F.concat_ws(" ", F.col("c_custkey"), F.when(F.col("c_custkey") % 5 == 0, "--").otherwise(F.col("c_acctbal").cast("string")))
    texts = c.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    path = new_folder(spark, "nations")
    texts.select("c_nationkey", F.concat(F.lit("key balance\n"), "lines", F.lit("\n\nfoot note")).alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


@job("SELECT p_partkey, p_brand, p_size FROM part")
def read_param_csv(spark, sf):
    _part(spark, sf).write.csv(path := new_folder(spark, "csv"), header=True)
    return io.read_param_csv(spark, path, "p_partkey long, p_brand string, p_size int")


@job(
    """SELECT CASE WHEN p_partkey % 10 > 1 THEN p_partkey END AS key, CASE WHEN p_partkey % 10 > 1 THEN p_size END AS size,
    CASE p_partkey % 10 WHEN 0 THEN 'fields: 1' WHEN 1 THEN 'bad value: size' END AS reason FROM part"""
)
def read_commented_table(spark, sf):
    k = F.col("p_partkey") % 10
    line = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat("p_partkey", F.lit(", many"))).otherwise(F.concat("p_partkey", F.lit(" , "), "p_size"))
    _part(spark, sf).select(F.concat(F.lit("# note\n\n"), line)).write.text(path := new_folder(spark, "table"))
    good, bad = io.read_commented_table(spark, path, {"key": "long", "size": "int"})
    return good.unionByName(bad.select("reason"), allowMissingColumns=True)


@job("SELECT CAST(p_partkey AS VARCHAR) AS name, p_size || '+' || p_brand || ', \"new\"' AS xs, CAST(p_size + 1 AS VARCHAR) AS y FROM part")
def read_grouped_header(spark, sf):
    cells = _part(spark, sf).select("p_partkey", "p_size", F.concat("p_brand", F.lit(', "new"')), F.col("p_size") + 1)
    cells.toDF("name", "xs", " ", "y").write.csv(path := new_folder(spark, "grouped"), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.read_grouped_header(spark, path).select("name", F.array_join("xs", "+").alias("xs"), "y")


@job("SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance FROM customer")
def read_space_table(spark, sf):
    return io.read_space_table(spark, _by_nation(spark, sf))


@job("SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part")
def read_xml_rows(spark, sf):
    part = _part(spark, sf).withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size")))
    part.write.format("xml").option("rootTag", "ROWSET").option("rowTag", "ROW").save(path := new_folder(spark, "xml"))
    return io.read_xml_rows(spark, path, "p_partkey long, p_brand string, p_size int")


@job("SELECT p_partkey, p_brand FROM part WHERE p_partkey % 7 <> 0")
def read_json_lines(spark, sf):
    line = F.when(F.col("p_partkey") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("p_partkey", "p_brand")))
    _part(spark, sf).select(line).write.option("compression", "bzip2").text(path := new_folder(spark, "json"))
    return io.read_json_lines(spark, path, "p_partkey long, p_brand string")


@job("SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) + 3 AS lines FROM customer GROUP BY c_nationkey")
def read_outputs(spark, sf):
    found = io.read_outputs(spark, _by_nation(spark, sf), "*.txt")
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).alias("nation"), F.size(F.split(F.rtrim("text", F.lit("\n")), "\n")).cast("long").alias("lines"))


@job("SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(*) AS members, CAST(sum(length(c_name)) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def read_archive_members(spark, sf):
    """Zip archives of customers' names, a member each, that tasks write to the shared folder: one by nation and thousand of keys."""
    folder = new_folder(spark, "archives")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        nation, part = frame["nation"].iloc[0], frame["part"].iloc[0]
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{nation}-{part}.zip", compression=None) as out, zipfile.ZipFile(out, "w") as z:
            z.writestr("empty", "")
            for key, name in zip(frame["c_custkey"], frame["c_name"], strict=True):
                z.writestr(f"names/{key}.txt", name)
        return pd.DataFrame({"members": [len(frame)]})

    customers = c.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_custkey") / 1000).alias("part"), "c_custkey", "c_name")
    customers.groupBy("nation", "part").applyInPandas(pack, "members long").agg(F.sum("members")).collect()
    found = io.read_archive_members(spark, folder, "*.zip")
    return found.groupBy(F.regexp_extract("archive", r"(\d+)-\d+\.zip$", 1).alias("nation")).agg(F.count("*").alias("members"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@job(c.with_("tasks") + "SELECT task_id, state, coalesce(exitcode, -1) AS code, CASE WHEN class = '5-LOW' THEN jobname END AS low_name FROM tasks")
def task_store(spark, sf):
    from ..operators.tasks import accessor

    store = io.task_store(c.tasks(spark, sf), {"code": accessor(F.col("exitcode"), -1), "low_name": accessor(F.col("jobname"), only="5-LOW")})
    store.select("task_id", "state", "code", "low_name").write.parquet(path := new_folder(spark, "store"))
    return spark.read.parquet(path)


@job(c.with_("tasks") + "SELECT CAST(task_id AS VARCHAR) AS task_id, jobname, coalesce(CAST(exitcode AS VARCHAR), 'N/A') AS exitcode FROM tasks")
def export_attrs_csv(spark, sf):
    io.export_attrs_csv(c.tasks(spark, sf), ["jobname", "exitcode"], path := new_folder(spark, "export"))
    return spark.read.csv(path, header=True)


@job(c.with_("tasks") + "SELECT state AS stat, count(*) AS n FROM tasks GROUP BY 1")
def export_json(spark, sf):
    io.export_json(c.tasks(spark, sf).groupBy(F.col("state").alias("stat")).agg(F.count("*").alias("n")), path := new_folder(spark, "counts"))
    return spark.read.schema("stat string, n long").json(path)


@job("SELECT vec_id AS member_id, it AS iteration FROM embeddings, (VALUES (1), (2)) v(it)")
def write_generation(spark, sf):
    population = c.table(spark, sf, "embeddings").select(F.col("vec_id").alias("member_id"), F.col("embedding").alias("x"))
    path = new_folder(spark, "generations")
    for iteration in (1, 2):
        io.write_generation(population, iteration, path)
    return spark.read.parquet(path).select("member_id", "iteration")


@job("SELECT CAST(c_nationkey AS VARCHAR) AS nation, count(DISTINCT c_nationkey) AS events FROM customer GROUP BY c_nationkey")
def inbox_created(spark, sf):
    from ..streaming.events import inbox_created as inbox

    arrived = drain(inbox(spark, _by_nation(spark, sf), "*.txt"))
    return arrived.groupBy(F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).alias("nation")).agg(F.count("*").alias("events"))


QUERIES, ORACLES = job.queries, job.oracles
