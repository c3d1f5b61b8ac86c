"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder that does not exist yet, in the folder in spark.checkpoint.dir.

    Only where that is unset on a single machine, as in tests, a temporary folder takes its place.
    """
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, without their lineage."""
    new_folder(df.sparkSession, "cut")
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """The same rows from a table in the shared folder.

    For loops: a checkpoint keeps the constraints of its plan, which grow with each round until planning takes longer than the work,
    and a table has none; its sizes also tell Spark which sides are small.
    """
    df.write.parquet(path := new_folder(df.sparkSession, kind))
    return df.sparkSession.read.schema(df.schema).parquet(path)
