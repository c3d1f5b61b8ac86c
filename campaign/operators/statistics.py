"""Statistics of paths, series, points and iterated searches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matching import BROADCAST_ROWS, checked


def path_statistics(paths: DataFrame) -> DataFrame:
    """(step, mean, highest): over paths, at every step."""
    return paths.groupBy("step").agg(F.avg("value").alias("mean"), F.max("value").alias("highest"))


def path_totals(paths: DataFrame) -> DataFrame:
    """(highest, mean_final): of all steps, and of each path's last step."""
    last = paths.groupBy("path_id").agg(F.max_by("value", "step").alias("final"), F.max("value").alias("top"))
    return last.agg(F.max("top").alias("highest"), F.avg("final").alias("mean_final"))


def cumulative_path(draws: DataFrame, start: float, mu: float, sigma: float, dt: float) -> DataFrame:
    """(path_id, step, value): geometric Brownian paths from standard draws z by path and step, with step 0."""
    drift = (mu - sigma**2 / 2) * dt
    log = F.sum(drift + sigma * dt**0.5 * F.col("z")).over(Window.partitionBy("path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    moved = draws.select("path_id", "step", (start * F.exp(log)).alias("value"))
    first = draws.select("path_id").distinct().select("path_id", F.lit(0).cast(draws.schema["step"].dataType).alias("step"), F.lit(float(start)).alias("value"))
    return first.union(moved)


def describe_series(df: DataFrame, *columns: str) -> DataFrame:
    """(series, mean, sd, skew): sample standard deviation and bias-corrected skewness; one pass."""
    aggs = [f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("g", F.skewness), ("n", F.count))]
    one = df.agg(*aggs)
    def row(k: int, c: str):
        n = F.col(f"n{k}").cast("double")
        skew = F.when(n > 2, F.col(f"g{k}") * F.sqrt(n * (n - 1)) / (n - 2))
        return F.struct(F.lit(c).alias("series"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("sd"), skew.alias("skew"))
    return one.select(F.inline(F.array(*(row(k, c) for k, c in enumerate(columns)))))


def correlations(df: DataFrame, *columns: str) -> DataFrame:
    """(a, b, r) for all pairs of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))))


def var1_persistence(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """(target, source, coefficient): each series regressed on all series one row earlier, with an intercept.

    Spark sums the cross products; the k x k system is solved on the driver.
    """
    w = Window.partitionBy(key).orderBy(order)
    lags = [f"lag_{c}" for c in columns]
    pairs = df.select(*columns, *(F.lag(c).over(w).alias(n) for c, n in zip(columns, lags, strict=True))).dropna()
    terms = [F.lit(1.0), *(F.col(n) for n in lags)]
    k = len(terms)
    sums = pairs.agg(*(F.coalesce(F.sum(a * b), F.lit(0.0)).alias(f"x{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)), *(F.coalesce(F.sum(a * F.col(c)), F.lit(0.0)).alias(f"y{i}_{j}") for i, a in enumerate(terms) for j, c in enumerate(columns))).first()
    xx = np.array([[sums[f"x{i}_{j}"] for j in range(k)] for i in range(k)])
    xy = np.array([[sums[f"y{i}_{j}"] for j in range(len(columns))] for i in range(k)])
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    rows = [(c, s, float(beta[i + 1, j])) for j, c in enumerate(columns) for i, s in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "target string, source string, coefficient double")


def _packed(df: DataFrame, columns: list[str], size: int, keep: str | None = None) -> DataFrame:
    """(points binary[, keys]): up to `size` rows as one, their columns as rows of doubles (null: NaN) and the values of `keep` as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                points = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
                out = [pa.array([points.tobytes()], pa.binary())]
                if keep:
                    keys = part.column(keep)
                    out.append(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.concat_arrays([keys])))
                yield pa.RecordBatch.from_arrays(out, names=["points", "keys"][: len(out)])

    kinds = [T.StructField("points", T.BinaryType())] + ([T.StructField("keys", T.ArrayType(df.schema[keep].dataType))] if keep else [])
    return df.select(*([keep] if keep else []), *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, T.StructType(kinds))


def idw_interpolate(queries: DataFrame, samples: DataFrame, axes: list[str], power: int = 4, value: str = "f", block: int = 2048) -> DataFrame:
    """(query_id, value): inverse-distance weighting over all sample points; an exact hit gives that sample's value (the mean of several).

    Rows are packed into blocks of points on either side and blocks meet blocks, so there is a row for each pair of blocks, not of points; their
    distances are matrices in Arrow batches, of which a sum for each query and block of samples remains. Samples with a null
    coordinate or value are left out; queries with one, or without samples, have a null value.
    """
    n = len(axes)
    known = samples.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*axes, value])))
    few = checked(_packed(known, [*axes, value], block).withColumnRenamed("points", "samples"), max(1, BROADCAST_ROWS // block))
    pairs = _packed(queries, axes, block, "query_id").crossJoin(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, keys, others in zip(batch.column("points"), batch.column("keys"), batch.column("samples"), strict=True):
                q, s = np.frombuffer(points.as_py()).reshape(-1, n), np.frombuffer(others.as_py()).reshape(-1, n + 1)
                square = np.zeros((len(q), len(s)))
                for k in range(n):
                    square += (q[:, k, None] - s[:, k]) ** 2
                with np.errstate(divide="ignore"):
                    weight = np.where(square > 0, 1 / np.sqrt(square) ** power, 0)
                hit = square == 0
                sums = [weight @ s[:, n], weight.sum(axis=1), hit @ s[:, n], hit.sum(axis=1).astype(float)]
                yield pa.RecordBatch.from_arrays([keys.values, *(pa.array(x) for x in sums)], names=["query_id", "wf", "w", "hits", "n"])

    kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("wf", "w", "hits", "n"))]
    total = pairs.mapInArrow(run, T.StructType(kinds)).groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("wf", "w", "hits", "n")))
    found = total.select("query_id", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).when(F.col("w") > 0, F.col("wf") / F.col("w")).alias("value"))
    return queries.select("query_id").distinct().join(found, "query_id", "left") if samples.isEmpty() else found


def best_member(population: DataFrame, key: list[str] = ()) -> DataFrame:
    """The member with the least y (ties: the lowest id), by key or overall."""
    grouped = population.groupBy(*key)
    return grouped.agg(F.min_by("member_id", F.struct("y", "member_id")).alias("member_id"), F.min("y").alias("y"))


def has_converged(population: DataFrame, dx: float, y_limit: float | None = None) -> DataFrame:
    """(converged,): the best y is below the limit (if one is given), or no coordinate is further than dx from member 0's."""
    first = population.where("member_id = 0").select(F.col("x").alias("x0"))
    near = population.join(F.broadcast(first)).agg(F.bool_and(F.forall(F.zip_with("x", "x0", lambda a, b: F.abs(a - b)), lambda d: d <= dx)).alias("near"), F.min("y").alias("best"))
    return near.select((F.col("near") | ((F.col("best") < y_limit) if y_limit is not None else F.lit(False))).alias("converged"))


def target_bracket(df: DataFrame, value: str, target: float, k: int) -> DataFrame:
    """(below, above, straddles): counts on either side of the target, and whether its k nearest values are on both."""
    nearest = df.orderBy(F.abs(F.col(value) - target), value).limit(k).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    counts = df.agg(F.count_if(F.col(value) < target).alias("below"), F.count_if(F.col(value) > target).alias("above"))
    return counts.join(F.broadcast(nearest)).select("below", "above", ((F.col("low") < target) & (F.col("high") > target)).alias("straddles"))


def draw_population(spark: SparkSession, size: int, low: list[float], high: list[float], seed: int) -> DataFrame:
    """(member_id, x): uniform in a box."""
    x = [F.lit(a) + (b - a) * F.rand(seed + k) for k, (a, b) in enumerate(zip(low, high, strict=True))]
    return spark.range(size).select(F.col("id").alias("member_id"), F.array(*x).alias("x"))
