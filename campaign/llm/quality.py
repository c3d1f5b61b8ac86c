"""Quality rules: simple counts, and a log-likelihood ratio between a trusted target and the raw corpus.

Words, and pairs of the endings of neighbouring words, are hashed into BUCKETS; endings are dense enough
to tell prose from markup where nearly every pair of whole words is unique. The
target's and the corpus's bucket counts give two multinomials with add-one smoothing; a document's ratio
is the mean of log(target / raw) over its hashed n-grams. Documents below the threshold go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, upto, window_hashes

BUCKETS = 10_000
TARGET_ROWS = 20_000
THRESHOLD = -0.8
SPAN = 8
ENDING = 2
LEAST_WORDS = 20
MOST_REPEATED = 30
SPACES = "[\\x20\\x09-\\x0D]"


def _repeated(windows: Column) -> Column:
    """Words inside windows (hashes by start) that occur twice or more."""
    def places(ordered: Column) -> Column:
        same = lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: F.coalesce(same(x, j), (F.get(ordered, j + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = lambda j: F.least(F.lit(SPAN), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(SPAN)))
        return F.aggregate(upto(F.lit(0), F.size(at) - 1), F.lit(0), lambda total, j: total + step(j))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, places), covered)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def hashed(words: Column) -> Column:
    """Buckets of all words and then of all pairs of neighbouring words' endings."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = lambda e: F.slice(F.zip_with(e, F.slice(e, 2, F.size(e)), lambda a, b: bucket(F.xxhash64(a, b))), 1, F.greatest(F.size(e) - 1, F.lit(0)))
    ends = F.transform(words, lambda w: F.substring(w, -ENDING, ENDING))
    return F.concat(F.transform(words, lambda w: bucket(F.xxhash64(w))), let(ends, pairs))


def measures(text: Column, weights: list[float] | None = None) -> Column:
    """n_words, word_chars and n_repeat_words (long), and with weights the ratio (0 for a text without words), as a struct."""
    repeated = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeated(h)).cast("long")

    def found(w: Column) -> Column:
        out = [F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), let(window_hashes(w, SPAN), repeated).alias("n_repeat_words")]
        if weights:
            table = F.split(F.lit(",".join(f"{x:.5f}" for x in weights)), ",").cast("array<double>")  # folded into one literal
            total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x))
            out.append(F.when(F.size(w) > 0, total(hashed(w)) / (2 * F.size(w) - 1)).otherwise(0.0).alias("ratio"))
        return F.struct(*out)

    return let(split_words(text), found)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def train(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> list[float]:
    """Log ratio by bucket. The corpus's counts are those of all rows; the target is a sample of about
    `target_rows` of the target ids at most, those with the least hash. Without target rows all ratios are 0."""
    ids = target_ids.select(F.col(id_col).alias("target_id")).where("target_id is not null").distinct()
    n = ids.count()
    share = int((1 << 30) * min(1.0, target_rows / max(1, n)))
    ids = F.broadcast(ids.where(F.pmod(F.xxhash64("target_id"), F.lit(1 << 30)) < share))  # about target_rows rows
    marked = docs.join(ids, docs[id_col] == ids["target_id"], "left").select(F.col("target_id").isNotNull().cast("int").alias("t"), docs[text_col].alias("text"))
    # explode_outer, since Spark would evaluate the array of explode a second time to filter empty ones
    buckets = marked.select("t", F.explode_outer(let(split_words(F.col("text")), hashed)).alias("bucket")).where("bucket is not null")
    rows = buckets.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not any(target):
        return [0.0] * BUCKETS
    all_raw, all_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / all_target) - math.log((r + 1) / all_raw) for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and ratio.

    Whole texts count, null as empty. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = own.select(
        "id_", measures(F.col("text_"), weights).alias("m"), F.regexp_count("text_", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    failed = base_failed(F.col("m.n_words"), F.col("m.n_repeat_words"))
    return found.select(
        F.col("id_").alias(id_col), "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("m.ratio") >= threshold)).alias("kept"), "m.ratio",
    )


def keep_good(docs: DataFrame, weights: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    return docs.where(let(measures(F.col(text_col), weights), lambda m: ~base_failed(m["n_words"], m["n_repeat_words"]) & (m["ratio"] >= threshold)))
