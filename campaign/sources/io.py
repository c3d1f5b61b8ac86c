"""Readers and writers of the files that campaigns leave behind."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_param_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """One row per parameter set."""
    return spark.read.csv(path, schema=schema, header=header)


def read_commented_table(spark: SparkSession, path: str, fields: dict[str, str], separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason): # and blank lines are skipped; fields maps names to types."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    cells = lines.select("value", F.transform(F.split("value", separator), lambda x: F.trim(x)).alias("cells"))
    typed = [F.get("cells", F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(fields.items())]
    parsed = cells.select("value", "cells", *typed)
    wrong = F.when(F.size("cells") != len(fields), F.concat(F.lit("fields: "), F.size("cells").cast("string")))
    for k, name in enumerate(fields):
        wrong = wrong.when(F.col(name).isNull() & (F.get("cells", F.lit(k)) != ""), f"bad value: {name}")
    checked = parsed.withColumn("reason", wrong)
    return checked.where("reason is null").select(*fields), checked.where("reason is not null").select("value", "reason")


def read_grouped_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose first line names groups of columns (a name, then empty cells): an array column per group. Cells may be quoted; each file has the same header."""
    head = spark.read.csv(path).first()
    raw = spark.read.csv(path, header=True)
    groups: dict[str, list[str]] = {}
    for k, name in enumerate(head):
        groups.setdefault((name or "").strip() or list(groups)[-1], []).append(f"c{k}")
    cells = raw.toDF(*(f"c{k}" for k in range(len(head))))
    return cells.select(*(F.array(*c).alias(g) if len(c) > 1 else F.col(c[0]).alias(g) for g, c in groups.items()))


def read_space_table(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """A delimited text table per file with a header line; `--` is null, a blank line ends it.

    A column is long or double only if all its values are; types come from all rows, in one pass.
    """
    text = spark.read.text(path, wholetext=True)
    body = F.split(F.regexp_extract("value", r"(?s)^(.*?)(?:\n\s*\n|\s*$)", 1), "\n")
    head = text.select(F.split(F.trim(F.get(body, F.lit(0))), separator)).first()[0]
    rows = text.select(F.explode(F.slice(body, 2, F.size(body))).alias("line")).select(F.split(F.trim("line"), separator).alias("c"))
    cells = rows.select(*(F.nullif(F.get("c", F.lit(k)), F.lit("--")).alias(n) for k, n in enumerate(head)))
    fits = cells.agg(*(F.bool_and(F.col(n).isNull() | F.col(n).try_cast(t).isNotNull()).alias(f"{n}_{t}") for n in head for t in ("long", "double"))).first()
    kind = lambda n: "long" if fits[f"{n}_long"] else "double" if fits[f"{n}_double"] else "string"
    return cells.select(*(F.col(n).cast(kind(n)).alias(n) for n in head))


def read_xml_rows(spark: SparkSession, path: str, schema: str, row_tag: str = "ROW") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_outputs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, text): one row per file below the folder whose name matches; hidden files and folders are skipped."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"/\.[^/]+"))


def read_archive_members(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(archive, member, content): regular, non-empty members of tar and zip files. One archive is read by one task; the members are dealt out anew."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                data = io.BytesIO(content)
                if zipfile.is_zipfile(data):
                    with zipfile.ZipFile(data) as z:
                        for m in z.infolist():
                            if not m.is_dir() and m.file_size:
                                yield pd.DataFrame({"archive": [path], "member": [m.filename], "content": [z.read(m)]})
                else:
                    data.seek(0)
                    with tarfile.open(fileobj=data) as t:
                        for m in t:
                            if m.isfile() and m.size:
                                yield pd.DataFrame({"archive": [path], "member": [m.name], "content": [t.extractfile(m).read()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInPandas(members, "archive string, member string, content binary")


def task_store(tasks: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Tasks with extra columns from accessors."""
    return tasks.withColumns(extra)


def export_attrs_csv(tasks: DataFrame, columns: list[str], path: str) -> None:
    """The id and chosen attributes as CSV with a header, `N/A` for null, in the order of ids."""
    tasks.select("task_id", *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in columns)).orderBy("task_id").write.csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_generation(population: DataFrame, iteration: int, path: str) -> None:
    """A population snapshot, in a folder of its own."""
    population.withColumn("iteration", F.lit(iteration)).write.mode("append").partitionBy("iteration").parquet(path)
