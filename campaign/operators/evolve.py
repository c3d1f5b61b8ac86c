"""Differential evolution over population tables: draw, evaluate, evolve, select, repeat.

A population is (member_id 0.., x array<double>[, y]). All randomness is in columns that are given or
come from a seed, so a generation can be checked and repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .statistics import best_member, draw_population, has_converged
from .tables import numbered

STRATEGIES = ("rand", "local_to_best", "best_with_jitter", "per_vector_dither", "per_generation_dither", "either_or")


def evaluate_population(population: DataFrame, target: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds y, the target of each member, in Arrow batches: target takes (members, dimensions)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["y"] = target(np.stack(frame["x"].to_numpy())) if len(frame) else np.zeros(0)
            yield frame[["member_id", "x", "y"]]

    return population.select("member_id", "x").mapInPandas(run, "member_id long, x array<double>, y double")


def with_partners(population: DataFrame, size: int, order: Column, shifts: tuple[int, int] = (1, 2)) -> DataFrame:
    """Each member with three others: a permutation by the order column, and rotations of it by the shifts."""
    # places in the permutation: ids only are sorted, by ranges
    ids = numbered(population.select("member_id", order.alias("order_")), ["order_", "member_id"], "place")
    place = cut(ids.select("member_id", "place")).join(population.select("member_id", "x"), "member_id")
    out = population
    shift = 0
    for name, by in zip(("p1", "p2", "p3"), (0, *shifts), strict=True):
        shift += by
        other = place.select(F.pmod(F.col("place") - shift, F.lit(size)).alias("member_id"), F.col("x").alias(name))
        out = out.join(other, "member_id")
    return out


def evolve(members: DataFrame, strategy: str, step: float, mask: str = "mask", best: str = "best", jitter: str = "jitter") -> DataFrame:
    """(member_id, x): trial vectors from members with partners p1, p2, p3, the best vector, a crossover mask
    (array of 0 and 1: 1 takes the trial's value) and, for the dithered strategies, random numbers in `jitter`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    plus = lambda a, b, by: F.zip_with(a, b, lambda u, v: u + by * v)
    gap = F.zip_with("p1", "p2", lambda a, b: a - b)
    if strategy == "rand":
        trial = plus("p3", gap, F.lit(step))
    elif strategy == "local_to_best":
        trial = plus(plus("x", F.zip_with(best, "x", lambda a, b: a - b), F.lit(step)), gap, F.lit(step))
    elif strategy == "best_with_jitter":
        trial = F.zip_with(best, F.zip_with(gap, jitter, lambda g, j: g * (step + 0.0001 * j)), lambda a, b: a + b)
    elif strategy in ("per_vector_dither", "per_generation_dither"):
        trial = plus("p3", gap, step + (1 - step) * F.get(jitter, F.lit(0)))
    else:
        middle = F.zip_with(F.zip_with("p1", "p2", lambda a, b: a + b), "p3", lambda s, c: s - 2 * c)
        trial = F.when(F.get(jitter, F.lit(0)) < 0.5, plus("p3", gap, F.lit(step))).otherwise(plus("p3", middle, F.lit(0.5 * (step + 1))))
    crossed = F.zip_with(F.arrays_zip(F.col("x").alias("old"), trial.alias("new")), mask, lambda v, m: F.when(m == 1, v["new"]).otherwise(v["old"]))
    return members.select("member_id", crossed.alias("x"))


def crossover_mask(dimensions: int, probability: float, seed: int, exponential: bool = False) -> Column:
    """Zeros and ones: independent (binomial), or the same number of ones in a run that starts anywhere (exponential)."""
    bits = F.array(*(F.when(F.rand(seed + k) < probability, 1).otherwise(0) for k in range(dimensions)))
    if not exponential:
        return bits
    start = F.floor(F.rand(seed + dimensions) * dimensions).cast("int")
    ones = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(F.pmod(i - start, F.lit(dimensions)) < ones, 1).otherwise(0))


def select_survivors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Member by member the strictly lower y wins."""
    fresh = new.select("member_id", F.col("x").alias("x_"), F.col("y").alias("y_"))
    wins = F.coalesce(F.col("y_") < F.col("y"), F.lit(False))
    return old.join(fresh, "member_id", "left").select("member_id", F.when(wins, F.col("x_")).otherwise(F.col("x")).alias("x"), F.when(wins, F.col("y_")).otherwise(F.col("y")).alias("y"))


def resample_invalid(population: DataFrame, draws: Callable[[int], DataFrame], valid: Column, rounds: int = 10) -> DataFrame:
    """Invalid members replaced by further draws, in order and round by round, until all are valid or the rounds are over.

    draws(k) gives the members (member_id, x) of round k, of which the valid ones are taken; members that
    find none stay as they are. Ids alone are numbered, by ranges.
    """
    now = cut(population.select("member_id", "x"))
    for k in range(rounds):
        bad = now.where(~valid).select("member_id")
        if bad.isEmpty():
            break
        wanted = cut(numbered(bad, ["member_id"], "k_"))
        more = draws(k).where(valid).select(F.col("member_id").alias("other"), F.col("x").alias("x_"))
        spare = cut(numbered(more.select("other"), ["other"], "k_")).join(more, "other").select("k_", "x_")
        mended = wanted.join(spare, "k_").select("member_id", "x_")
        now = cut(now.join(mended, "member_id", "left").select("member_id", F.coalesce("x_", "x").alias("x")))
    return now


def optimise(
    spark: SparkSession, target: Callable[[np.ndarray], np.ndarray], low: list[float], high: list[float], size: int, rounds: int, seed: int = 1,
    strategy: str = "local_to_best", step: float = 0.85, probability: float = 1.0, dx: float = 1e-8, y_limit: float | None = None,
) -> DataFrame:
    """The population after at most rounds + 1 evaluations; each generation is written to the shared folder."""
    d = len(low)
    now = cut(evaluate_population(draw_population(spark, size, low, high, seed), target))
    for k in range(1, rounds + 1):
        if has_converged(now, dx, y_limit).first()[0]:
            break
        top = best_member(now).select(F.col("member_id").alias("top"))
        best = now.join(F.broadcast(top), F.col("member_id") == F.col("top")).select(F.col("x").alias("best"))
        noise = seed + 1000 * k
        ready = with_partners(now, size, F.rand(noise)).join(F.broadcast(best)).select(
            "*", crossover_mask(d, probability, noise + 1).alias("mask"), F.array(*(F.rand(noise + 500 + j) for j in range(d))).alias("jitter")
        )
        trial = evaluate_population(evolve(cut(ready), strategy, step), target)
        now = cut(select_survivors(now, trial))
    return now


def optimise_groups(groups: DataFrame, key: str, target: Callable[[np.ndarray, object], np.ndarray], low: list[float], high: list[float], size: int, rounds: int, seed: int = 1) -> DataFrame:
    """(key, x, y): an independent search for each key, one task group each; a search is bounded by size and rounds."""

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        value = frame[key].iloc[0]
        rng = np.random.default_rng([seed, abs(hash(str(value))) % 2**31 if not isinstance(value, (int, np.integer)) else int(value)])
        x = rng.uniform(low, high, (size, len(low)))
        y = target(x, value)
        for _ in range(rounds):
            order = rng.permutation(size)
            a, b, c = (x[np.roll(order, k)] for k in (0, 1, 3))
            trial = np.where(rng.random(x.shape) < 0.9, c + 0.7 * (a - b), x)
            t = target(trial, value)
            better = t < y
            x[better], y[better] = trial[better], t[better]
        k = int(y.argmin())
        return pd.DataFrame({key: [value], "x": [x[k]], "y": [float(y[k])]})

    kind = groups.schema[key].dataType.simpleString()
    return groups.select(key).distinct().groupBy(key).applyInPandas(search, f"`{key}` {kind}, x array<double>, y double")
