"""One document from the rows of many tasks: a header, the rows in order, and a footer, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder

XML_HEAD = '<?xml version="1.0"?>'


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_parts(rows: DataFrame, path: str, order: list[str], kind: str = "xml", row_tag: str = "row", root_tag: str = "ROWSET", parts: int | None = None) -> None:
    """Writes part files which, one after the other by name, are one document of `kind` xml or csv: the first begins with the header, the last ends with the footer.

    Rows are sorted by ranges, so tasks write in parallel and none sees more than its range. The parts are written under a
    name of their own and take their place by one renaming, so a document is there whole or not at all; an existing one is not replaced.
    """
    spark = rows.sparkSession
    if kind == "xml":
        body, head, foot = F.to_xml(F.struct(*rows.columns), {"rowTag": row_tag}), f"{XML_HEAD}\n<{root_tag}>", f"</{root_tag}>"
    elif kind == "csv":
        body, head, foot = F.to_csv(F.struct(*rows.columns)), ",".join(rows.columns), None
    else:
        raise ValueError(kind)
    fs, target = _files(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    ends = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(text).alias("text")) for k, text in ((0, head), (2, foot)) if text is not None))).alias("e")).select("e.*")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(f"o{k}") for k, c in enumerate(order)]
    lines = rows.select(F.lit(1).alias("place"), body.alias("text"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order))).union(ends.select("place", "text", *none))
    by = ["place", *(f"o{k}" for k in range(len(order))), "text"]
    ranged = lines.repartitionByRange(parts, *by) if parts else lines.repartitionByRange(*by)
    staged = new_folder(spark, "staged")
    ranged.sortWithinPartitions(*by).select("text").write.text(staged)
    fs.mkdirs(target.getParent())
    if not fs.rename(_files(spark, staged)[1], target):
        raise OSError(f"{staged} could not be renamed to {path}")


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file from the parts in a folder, in the order of their names, under a temporary name until it is whole.

    The bytes are copied by the driver's JVM in blocks, which takes constant memory but the time of one writer: for results that people open, not for terabytes.
    """
    fs, place = _files(spark, folder)
    jvm = spark._jvm
    names = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    target_fs, target = _files(spark, path)
    _, temporary = _files(spark, f"{path}.{new_folder(spark, 'part').rpartition('/')[2]}")
    out = target_fs.create(temporary, False)
    try:
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    if not target_fs.rename(temporary, target):
        target_fs.delete(temporary, False)
        raise FileExistsError(path)


def read_document(spark: SparkSession, path: str, schema: str, row_tag: str = "row") -> DataFrame:
    """The rows of an XML document as written here, of any size: it is split at the ends of rows, where the XML source gives a whole file to one task.

    No element within a row may have the tag of the rows.
    """
    ends = spark.read.text(path, lineSep=f"</{row_tag}>")
    # a row without values may be a single empty tag, so a piece holds any number of these and then a row, or what follows the last one
    pieces = ends.select(F.explode(F.split("value", rf"(?=<{row_tag}[\s/>])")).alias("text")).where(F.col("text").rlike(rf"^<{row_tag}[\s/>]"))
    empty = F.col("text").rlike(rf"^<{row_tag}[^<>]*/>")
    whole = F.when(empty, F.regexp_extract("text", r"^<[^<>]*/>", 0)).otherwise(F.concat("text", F.lit(f"</{row_tag}>")))
    return pieces.select(F.from_xml(whole, schema).alias("r")).select("r.*")
