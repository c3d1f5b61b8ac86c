"""Classifying texts and extracting records from run outputs."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import split_run_name

#: The exit codes of a software error and of the two messages that mean too little memory.
SOFTWARE_ERROR = 70
MEMORY_ERROR = 11
#: Bytes of text that a scorer gets at once (one text may have more), after which garbage is collected, and of an Arrow batch.
PIECE_BYTES, COLLECT_BYTES, BATCH_BYTES = 2 << 20, 16 << 20, 16 << 20


class Rule(NamedTuple):
    """A class, its expression and the part of the text, from start to end (0 to 1), in which it counts."""

    name: str
    pattern: str
    start: float = 0.0
    end: float = 1.0


def classify_first_match(texts: DataFrame, rules: list[Rule], text: str = "text", name: str = "class") -> DataFrame:
    """Adds the class of the first rule that matches in its part of the text, else of the first that matches the whole text, else none_found.

    Rules are few, so they are one expression; parts are counted in characters.
    """
    size = F.char_length(text)

    def inside(r: Rule) -> Column:
        first = F.floor(size * r.start).cast("int")
        return F.substring(F.col(text), first + 1, F.floor(size * (r.end - r.start)).cast("int") + 1).rlike(r.pattern)

    parts = [F.when(inside(r), r.name) for r in rules]
    whole = [F.when(F.col(text).rlike(r.pattern), r.name) for r in rules]
    return texts.withColumn(name, F.coalesce(*parts, *whole, F.lit("none_found")))


def class_summary(classified: DataFrame, name: str = "class") -> DataFrame:
    return classified.groupBy(name).agg(F.count("*").alias("n"))


def _first(text: str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_fields(texts: DataFrame, key: str, fields: dict[str, tuple[str, int]], text: str = "text") -> DataFrame:
    """One column per (pattern, group): the first match in the text, null if none."""
    return texts.select(key, *(_first(text, pattern, group).alias(name) for name, (pattern, group) in fields.items()))


def lines_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))


def termination_outcome(texts: DataFrame, key: str, outcomes: list[tuple[str, int]], text: str = "text") -> DataFrame:
    """(key, outcome): by the first line that matches one of the expressions; SOFTWARE_ERROR if none does."""
    any_of = "|".join(f"(?:{p})" for p, _ in outcomes)
    line = F.regexp_extract(text, f"(?m)^.*(?:{any_of}).*$", 0)
    code = reduce(lambda rest, x: F.when(line.rlike(x[0]), x[1]).otherwise(rest), reversed(outcomes), F.lit(SOFTWARE_ERROR))
    return texts.select(key, F.when(line != "", code).otherwise(SOFTWARE_ERROR).alias("outcome"))


def ends_normally(text: Column, last: str) -> Column:
    return F.coalesce(F.rtrim(text).endswith(last), F.lit(False))


def time_used(text: Column) -> Column:
    """Seconds of `Time used: [H:]M:S` as text, `invalid` for another form, `no file` for null."""
    pattern = r"Time used:\s*(?:(\d+):)?(\d+):(\d+)\s*(?:\n|$)"
    n = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("long"), F.lit(0))
    return F.when(text.isNull(), "no file").when(text.rlike(pattern), (n(1) * 3600 + n(2) * 60 + n(3)).cast("string")).otherwise("invalid")


def overview_long(texts: DataFrame, run: str, skip: list[str], text: str = "text") -> DataFrame:
    """(run, head, value) of `head: value` lines; vectors, unwanted heads and lines of another form are left out."""
    pattern = r"^\s*([^:]+?)\s*:\s*(\S+)\s*$"
    pairs = lines_of(texts, run, text).select(run, F.regexp_extract("line", pattern, 1).alias("head"), F.regexp_extract("line", pattern, 2).alias("value"))
    return pairs.where((F.col("head") != "") & ~F.col("head").isin(["Iteration", *skip]))


def overview_table(long_: DataFrame, run: str, heads: list[str], variables: list[str]) -> DataFrame:
    """One row per run with a column per head (numbers), and the run's name split into its variables."""
    number = F.col("value").try_cast("double")
    wide = long_.groupBy(run).agg(*(F.max(F.when(F.col("head") == h, number)).alias(h) for h in heads))
    parts = split_run_name(F.col(run))
    return wide.select(run, *(F.try_element_at(parts, F.lit(v)).alias(v) for v in variables), *heads)


def running_times(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, minutes) from `= <seconds>` at a line's end, by key."""
    seconds = _first(text, r"(?m)=\s*([0-9.]+)\s*$").try_cast("double")
    return texts.select(key, F.round(seconds / 60, 6).alias("minutes")).where("minutes is not null").orderBy(key)


def error_reclassify(tasks: DataFrame, least_seconds: int, text: str = "text") -> DataFrame:
    """(task_id, exitcode, retry): memory errors in the text give MEMORY_ERROR; reason to try again: `too short` or `memory`."""
    memory = F.col(text).rlike("Out of memory|exceeds maximum array size")
    retry = F.when(F.col("seconds") < least_seconds, "too short").when(F.col("used_memory") >= F.col("requested_memory"), "memory")
    return tasks.select("task_id", F.when(memory, MEMORY_ERROR).otherwise(F.col("exitcode")).alias("exitcode"), retry.alias("retry"))


def grep_lines(texts: DataFrame, key: str, pattern: str, literal: bool = False, text: str = "text") -> DataFrame:
    """(key, line_no, line): matching lines; texts without a match are passed over before lines become rows."""
    whole = F.col(text).contains(pattern) if literal else F.col(text).rlike(f"(?m){pattern}")
    found = lines_of(texts.where(whole), key, text)
    return found.where(F.col("line").contains(pattern) if literal else F.col("line").rlike(pattern))


def output_validity_bits(files: DataFrame, key: str) -> DataFrame:
    """(key, bits) of files (key, hypothesis 0 or 1, valid): 16 no H0, 8 H0 not valid, 4 no H1, 2 H1 not valid."""
    has = lambda h: F.coalesce(F.bool_or(F.col("hypothesis") == h), F.lit(False))
    good = lambda h: F.coalesce(F.bool_or((F.col("hypothesis") == h) & F.col("valid")), F.lit(False))
    bit = lambda test, value: F.when(test, 0).otherwise(value)
    return files.groupBy(key).agg((bit(has(0), 16) + bit(good(0), 8) + bit(has(1), 4) + bit(good(1), 2)).alias("bits"))


def group_sentiment(scored: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """Mean scores per group over rows with a text, and how many rows had none."""
    return scored.groupBy(group).agg(*(F.avg(F.when(F.col("text").isNotNull(), F.col(s))).alias(s) for s in scores), F.count_if(F.col("text").isNull()).alias("skipped"))


def scored_texts(texts: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], scores: list[str], text: str = "text", body: str = "body") -> DataFrame:
    """The table with `text` (from `body` where it is null) and the scores that a given scorer finds.

    The scorer takes a piece of a batch, texts of about PIECE_BYTES, and returns a column for each score; it sees no nulls. Scores of rows without a
    text are null. What a scorer leaves behind in cycles, as pandas does with a series whose `str` was used, is collected after each COLLECT_BYTES.
    """
    whole = F.coalesce(text, body) if body in texts.columns else F.col(text)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.arrow_udf(", ".join(f"`{s}` double" for s in scores))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        left = 0
        for batch in batches:
            found = np.full((len(scores), len(batch)), np.nan)
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(), dtype=np.int64)
            first = 0
            while first < len(batch):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
                piece = batch[first:last]
                known = first + np.flatnonzero(piece.is_valid().to_numpy(zero_copy_only=False))
                if len(known):
                    found[:, known] = scorer(piece.drop_null().to_pandas())[scores].to_numpy(float).T
                left += ends[last - 1] - before
                first = last
                if left >= COLLECT_BYTES:
                    gc.collect()
                    left = 0
            yield pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in found], names=scores)

    rest = [c for c in texts.columns if c not in (text, body, *scores)]
    found = texts.select(*rest, whole.alias("text")).withColumn("s_", run("text"))
    return found.select(*rest, "text", *(F.when(F.col("text").isNotNull(), F.col(f"s_.{s}")).alias(s) for s in scores))


def lexicon_scores(text: Column, positive: list[str], negative: list[str]) -> dict[str, Column]:
    """Shares of positive, negative and other words, and their balance (pos - neg) / (pos + neg)."""
    total = F.regexp_count(text, F.lit(r"\W+")) + 1
    # words are counted in the text as it is; no array of them is made
    count = lambda names: F.regexp_count(F.lower(text), F.lit(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)"))
    pos, neg = count(positive), count(negative)
    return {"pos": pos / total, "neg": neg / total, "neu": (total - pos - neg) / total, "compound": F.coalesce(F.try_divide(pos - neg, pos + neg), F.lit(0.0))}
