"""A table of tasks that is updated in place: rows lie in buckets by a hash of their id, and a write replaces the buckets it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

BUCKETS = 64


class TaskStore:
    """Rows by id, of which the newest write counts: the greatest version, of equal ones the later call, and within one call the row whose JSON text is greatest.

    `buckets` is fixed for a store and sets how much a small write rewrites: a bucket holds a share of 1 / buckets of the ids. A deleted id leaves a mark with its
    version, so older writes that arrive after it don't bring it back, while a newer or later one does. One writer at a time; readers see
    a bucket before or after a write.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path, key, version, buckets
        self.columns = spark.createDataFrame([], schema).schema
        self._whole = f"`{key}` {self.columns[key].dataType.simpleString()}, row {self.columns.simpleString()}, version {self.columns[version].dataType.simpleString()}, write_no long, deleted boolean, bucket int"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self._whole)
        return self.spark.read.schema(self._whole).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().where("not deleted").select("row.*")

    def upsert(self, writes: DataFrame) -> list[int]:
        """Takes in rows by name; those without an id are left out, columns that the store does not have too. Gives the buckets that were rewritten."""
        rows = writes.where(F.col(self.key).isNotNull()).select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in self.columns))
        new = rows.select(self.key, F.struct(*self.columns.names).alias("row"), F.col(self.version).alias("version"), F.lit(None).cast("long").alias("write_no"), F.lit(False).alias("deleted"), self._bucket().alias("bucket"))
        return self._replace(new)

    def delete(self, ids: DataFrame) -> list[int]:
        """Marks the given ids as deleted; unknown ones are passed over. Gives the buckets that were rewritten."""
        gone = ids.select(F.col(self.key).cast(self.columns[self.key].dataType).alias(self.key)).distinct().withColumn("bucket", self._bucket())
        there = self._stored().where("not deleted").join(gone, ["bucket", self.key], "left_semi")
        return self._replace(there.withColumn("write_no", F.lit(None).cast("long")).withColumn("deleted", F.lit(True)).select(self.key, "row", "version", "write_no", "deleted", "bucket"))

    def _replace(self, new: DataFrame) -> list[int]:
        new = written(new, "writes")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets` rows
        if not touched:
            return []
        old = self._stored().where(F.col("bucket").isin(touched))  # only these folders are read
        number = (old.agg(F.max("write_no")).first()[0] or 0) + 1
        both = old.unionByName(new.withColumn("write_no", F.lit(number).cast("long"))).repartition(min(len(touched), self.buckets), "bucket")
        newest = F.struct("version", "write_no", F.col("deleted"), F.to_json("row"))
        kept = both.groupBy("bucket", self.key).agg(F.max_by(F.struct("row", "version", "write_no", "deleted"), newest).alias("x"))
        # written apart first, since the table cannot be read while its buckets are replaced
        done = written(kept.select(self.key, "x.*", "bucket"), "buckets")
        done.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched
