"""Stupid-backoff language model scores over the corpus's own n-gram counts.

Count tables of all orders are partitioned by the hash of the n-gram. Documents are dealt into
blocks of bounded size; a block explodes its texts into n-grams and asks every partition for the
counts of its distinct n-grams. Such a request travels as one row (partition, block, order, n-grams,
own counts), not as a row for each n-gram, since nearly every n-gram of prose is rare and a corpus has
as many as words. Partitions add up all requests and answer each; the block joins the answers to its
n-grams and sums by document.

There are blocks times partitions such rows for each order. An n-gram takes four to five bytes in them while they hold
many, up to about a terabyte of text; towards a hundred terabytes a row holds few, and a row for each n-gram would cost as much.

An n-gram is known by its partition and 40 bits of its hash, about one in a million of which collide,
at every size of the corpus up to MOST_PARTS partitions, since these grow in number with it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix, ngrams, utf8, words
from .shared import cut

ORDER = 3
BACKOFF = 0.4
LEAST_COUNT = 2
BLOCK_BYTES = 6 << 20
PART_BYTES = 6 << 20
_BITS = np.uint64(40)
_LOW = np.uint64((1 << 40) - 1)
_SEED = np.uint64(0x6C62272E07BB0142)
#: as many as fit above the 40 bits; partitions of more than about 100 TB of text hold more than PART_BYTES each
MOST_PARTS = (1 << 24) - 1


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition, from all bits of each hash mixed once more, and its lower 40 bits as one number."""
    return (mix(hashes ^ _SEED) % np.uint64(parts)) << _BITS | (hashes & _LOW)


def _starts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition starts in sorted keys."""
    return np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << _BITS)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys of one partition: gaps in four bytes each where they fit, else the keys in five."""
    low = keys & _LOW
    gaps = np.diff(low, prepend=np.uint64(0))
    if gaps.max() < 1 << 32:
        return b"\4" + gaps.astype("<u4").tobytes()
    return b"\5" + np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0] == 4:
        return np.cumsum(np.frombuffer(data, "<u4", offset=1), dtype=np.uint64)
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 5)
    return out.view("<u8").ravel()


def _words(table: pa.Table) -> Words:
    return words(*utf8(table.column("text")))


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT,
    block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The id, n_words, n_known (words whose highest order was known) and lm_score of every row.

    For each word the longest n-gram that ends there and occurs at least `least` times in the corpus
    (one word always counts) gives count(n-gram) / count(its first n - 1 words), or count / words of the
    corpus for one word, times `backoff` for each order skipped below the longest that the row's start
    allows. lm_score is the mean natural logarithm; null for a row without words. Rows that repeat
    count as often as they occur. Columns other than the two named are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-total_bytes // block_bytes)), min(MOST_PARTS, max(1, -(-total_bytes // part_bytes)))
    # with the partition that a row is read in, so that equal rows are dealt out too
    dealt = own.withColumn("block", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")).repartition(min(blocks, 100_000), "block")

    def ask(table: pa.Table) -> pa.Table:
        block, found = table.column("block")[0].as_py(), _words(table)
        out: dict[str, list] = {"part": [], "block": [], "n": [], "grams": [], "times": []}
        for n in range(1, order + 1):
            distinct, times = np.unique(_keys(ngrams(found, n).hashes, parts), return_counts=True)
            start, times = _starts(distinct, parts), times.astype("<u4")
            for p in np.flatnonzero(np.diff(start)):
                own = slice(start[p], start[p + 1])
                for name, value in (("part", int(p)), ("block", block), ("n", n), ("grams", _packed(distinct[own])), ("times", zlib.compress(times[own].tobytes(), 1))):
                    out[name].append(value)
        return pa.table(out, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("times", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "part": [], "n": [], "totals": []}
        orders = table.column("n").to_numpy()
        part = table.column("part")[0].as_py()
        for n in np.unique(orders):
            rows = table.filter(pa.array(orders == n))
            keys = [_unpacked(x.as_py()) for x in rows.column("grams")]
            times = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<u4") for x in rows.column("times")])
            _, where = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(where, times)[where].astype("<u4")
            at = 0
            for block, k in zip(rows.column("block").to_pylist(), keys, strict=True):
                out["block"].append(block)
                out["part"].append(part)
                out["n"].append(int(n))
                out["totals"].append(zlib.compress(totals[at : at + len(k)].tobytes(), 1))
                at += len(k)
        return pa.table(out, pa.schema([("block", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("totals", pa.binary())]))

    kind = docs.schema[id_col].dataType.simpleString()

    def add_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        found = _words(texts)
        rows, n_words = texts.num_rows, len(found.hashes)
        row = np.repeat(np.arange(rows), np.diff(found.bounds))
        place = np.arange(n_words) - np.repeat(found.bounds[:-1], np.diff(found.bounds))
        by_order: dict[int, list] = {}
        for n, part, totals in zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            by_order.setdefault(n, []).append((part, totals))
        # the count of the n-gram that ends at each word, by order; 0 where the row's start is too near
        counts = []
        for n in range(1, order + 1):
            ends = np.zeros(n_words, np.uint32)
            keys = _keys(ngrams(found, n).hashes, parts)
            if len(keys):
                _, where = np.unique(keys, return_inverse=True)  # in the order of the request
                totals = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for _, x in sorted(by_order.pop(n))])
                ends[place >= n - 1] = totals[where]
            counts.append(ends)
        log = np.zeros(n_words)
        level = np.zeros(n_words, np.int8)
        for n in range(order, 1, -1):
            hit = (level == 0) & (counts[n - 1] >= least)
            at = np.flatnonzero(hit)
            log[at] = np.log(counts[n - 1][at] / counts[n - 2][at - 1])
            level[at] = n
        rest = np.flatnonzero(level == 0)
        log[rest] = np.log(counts[0][rest]) if len(rest) else 0
        level[rest] = 1
        skipped = np.minimum(place + 1, order) - level
        log += skipped * np.log(backoff)
        return pa.table(
            {
                "id": texts.column("id"),
                "n_words": pa.array(np.diff(found.bounds)),
                "n_known": pa.array(np.bincount(row[skipped == 0], minlength=rows)),
                "n_single": pa.array(np.bincount(row[level == 1], minlength=rows)),
                "log_sum": pa.array(np.bincount(row, log, rows).astype(np.float64)),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block int, n int, grams binary, times binary")
    answers = asked.groupBy("part").applyInArrow(answer, "block int, part int, n int, totals binary")
    sums = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"id {kind}, n_words long, n_known long, n_single long, log_sum double")
    sums = cut(sums)
    corpus_words = sums.agg(F.sum("n_words")).first()[0] or 1
    mean = (F.col("log_sum") - F.col("n_single") * F.log(F.lit(float(corpus_words)))) / F.col("n_words")
    return sums.select(F.col("id").alias(id_col), "n_words", "n_known", F.when(F.col("n_words") > 0, mean).alias("lm_score"))
