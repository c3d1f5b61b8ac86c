"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is trained on a bounded sample and then
frozen. A byte costs -log2 of its probability in the longest known context, plus the cost of the
escapes from longer contexts that did not hold it (escape method C: distinct / (total + distinct)).
A text's language is the one whose tree codes the whole text in the fewest bits.

The trees of all languages share one table per order, so a byte is looked up once for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, mix, utf8
from .shared import small_batches

ORDER = 4
SAMPLE_BYTES = 400_000
CHUNK = 2000
#: Bytes of all tables, which have a column by language: with many languages each has a smaller sample.
TABLE_BYTES = 256 << 20
#: Bytes of costs at once, by byte of text and language.
WORK_BYTES = 16 << 20
PAD = 10  # before the first byte
_LETTER = re.compile(r"[^\W\d_]")


class Table:
    """Open addressing from 64-bit keys to row numbers, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            placed = left[free][first]
            self.keys[at], self.rows[at] = keys[placed], placed
            rest = ~np.isin(left, placed)
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number by key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.rows[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            at = slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.rows[at]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at] != keys[wrong])]
        return out


def padded(raw: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with `order` pad bytes before each, and where each row's own bytes start and end."""
    rows = len(bounds) - 1
    out = np.full(len(raw) + order * rows, PAD, np.uint8)
    size = np.diff(bounds)
    start = bounds[:-1] + order * np.arange(1, rows + 1)
    if len(raw):
        out[np.repeat(start - bounds[:-1], size) + np.arange(len(raw))] = raw
    return out, start


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """At each byte, the n bytes that end there as one number; the first n - 1 entries are not whole."""
    out = np.zeros(len(data), np.int64)
    for k in range(n - 1, -1, -1):
        out <<= 8
        if k < len(data):
            out[k:] |= data[: len(data) - k]
    return out


class Trees:
    """Frozen context trees of all languages."""

    def __init__(self, languages: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: for each length 1.. the grams and their counts (grams, languages)."""
        self.languages, self.order = languages, max(counts, default=1) - 1
        width = len(languages)
        self.cost: dict[int, np.ndarray] = {}
        self.escape: dict[int, np.ndarray] = {}
        self.table: dict[int, Table] = {}
        self.contexts: dict[int, Table] = {}
        self.nothing = np.full(width, 8.0, np.float32)
        for n in sorted(counts):
            keys, seen = counts[n]
            context, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            all_of = np.maximum(total + distinct, 1)
            self.escape[n - 1] = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / all_of), 0).astype(np.float32)
            self.contexts[n - 1] = Table(context)
            own = -np.log2(np.maximum(seen, 1) / all_of[of])
            lower = self.costs(keys & ((1 << 8 * (n - 1)) - 1), n - 1) if n > 1 else np.tile(self.nothing, (len(keys), 1))
            self.cost[n] = np.where(seen > 0, own, self.escape[n - 1][of] + lower).astype(np.float32)
            self.table[n] = Table(keys)

    def costs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Bits (keys, languages) for the last byte of each n-gram in the context of the others."""
        if n == 0:
            return np.tile(self.nothing, (len(keys), 1))
        row = self.table[n].find(keys)
        out = self.cost[n][row] if len(self.cost[n]) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            part = keys[miss]
            context = self.contexts[n - 1].find(part >> 8)
            escape = np.where((context >= 0)[:, None], self.escape[n - 1][context], 0)
            out[miss] = escape + self.costs(part & ((1 << 8 * (n - 1)) - 1), n - 1)
        return out

    def code_lengths(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits (rows, languages) for whole rows.

        Rows are taken together up to a number of bytes that falls with the number of languages; a longer row is coded in pieces of that size,
        each with the bytes before it as context, so memory depends neither on the length of a text nor on the languages.
        """
        sums = np.zeros((len(bounds) - 1, len(self.languages)))
        most = max(1024, WORK_BYTES // (16 + 12 * len(self.languages)))
        for first, last in chunks(bounds, most):
            low, high = int(bounds[first]), int(bounds[last])
            if high - low <= most:
                sums[first:last] = self._whole_rows(raw[low:high], bounds[first : last + 1] - low)
                continue
            before = np.full(self.order, PAD, np.uint8)
            for at in range(low, high, most):
                piece = raw[at : min(at + most, high)]
                data = np.concatenate([before, piece])
                sums[first] += self.costs(grams(data, self.order + 1)[self.order :], self.order + 1).sum(axis=0, dtype=np.float64)
                before = data[len(data) - self.order :]
        return sums

    def _whole_rows(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        data, start = padded(raw, bounds, self.order)
        size = np.diff(bounds)
        own = np.ones(len(data), bool)
        own[(start[:, None] - np.arange(1, self.order + 1)).ravel()] = False
        bits = self.costs(grams(data, self.order + 1)[own], self.order + 1)
        sums = np.zeros((len(size), len(self.languages)))
        full = np.flatnonzero(size)
        if len(full):
            sums[full] = np.add.reduceat(bits.astype(np.float64), bounds[:-1][full])
        return sums


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees from the rows with a text and a language.

    Texts are cut into chunks of CHUNK characters. Of each language the chunks with the least hash of id, text
    and place are taken until they hold `sample_bytes` bytes, so every language has its share, whether its texts are
    many or few and long. This bounds what the driver gathers by the number of languages; those with fewer bytes are taken whole. With
    many languages the sample of each is smaller, so that the tables, a cost by n-gram and language, stay within TABLE_BYTES.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_hash")
    )
    totals = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row by language
    languages = sorted(r["lang"] for r in totals)
    sample_bytes = min(sample_bytes, TABLE_BYTES // (6 * max(1, len(languages)) ** 2))
    places = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(CHUNK))
    hashes = F.transform(places, lambda at: F.struct(F.pmod(F.xxhash64("row_hash", at), F.lit(1 << 30)).alias("h"), at.alias("at")))
    # a first cut by hash leaves twice the sample and some more chunks, whose least hashes are then taken exactly
    part = lambda size: int((1 << 30) * min(1.0, (2 * sample_bytes + 80 * CHUNK) / max(1, size)))
    share = F.create_map(*(F.lit(x) for r in totals for x in (r["lang"], part(r["bytes"])))) if totals else F.lit(None).cast("map<string,int>")
    some = known.select("lang", "text", F.explode(F.filter(hashes, lambda x: x["h"] < share[F.col("lang")])).alias("x"))
    some = some.select("lang", F.col("x.h").alias("h"), F.substring("text", F.col("x.at"), F.lit(CHUNK)).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("text")
    sample = some.withColumn("before", before).where(F.col("before") < sample_bytes).select("lang", "text")
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            data, start = padded(raw, bounds, order)
            size = np.diff(bounds)
            owner = np.repeat(lang, size)
            at = np.repeat(start - bounds[:-1], size) + np.arange(len(raw))
            for n in range(1, order + 2):
                # at most five bytes of gram, so the language fits above them
                keys, times = np.unique(grams(data, n)[at] | owner << 48, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys), pa.array(times.astype(np.int64))], names=["n", "key", "times"])

    if order > 4:
        raise ValueError("an order of 4 at most")
    found = sample.mapInArrow(count, "n int, key long, times long").groupBy("n", "key").agg(F.sum("times").alias("times")).toArrow()
    n, key, times = (found.column(c).to_numpy() for c in ("n", "key", "times"))
    counts = {}
    for k in range(1, order + 2):
        own = n == k
        gram, row = np.unique(key[own] & ((1 << 48) - 1), return_inverse=True)
        table = np.zeros((len(gram), len(languages)))
        table[row, key[own] >> 48] = times[own]
        counts[k] = (gram, table)
    return Trees(languages, counts)


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of every row; the whole text counts.

    The score is the share of the best language when each language weighs 2 to the minus bits.
    `und` with score 0 for a text that is null or has no letter, or if no language was learned.
    Ties go to the language that sorts first. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            rows = len(bounds) - 1
            best, score = np.full(rows, len(own.languages)), np.zeros(rows)
            lettered = np.array([bool(t and _LETTER.search(t)) for t in batch.column(1).to_pylist()], bool)
            if own.languages:
                for first, last in chunks(bounds):
                    part = bounds[first : last + 1]
                    bits = own.code_lengths(raw[part[0] : part[-1]], part - part[0])
                    k = bits.argmin(axis=1)
                    weight = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
                    best[first:last] = np.where(lettered[first:last], k, len(own.languages))
                    score[first:last] = np.where(lettered[first:last], 1 / weight.sum(axis=1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
