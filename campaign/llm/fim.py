"""Fill-in-middle transformation: texts cut at two unit boundaries into prefix, middle and suffix, and put together anew.

Where units begin in a text's UTF-8 bytes is kept as a set of offsets in containers of 65,536 bytes each: a sorted
array, a bitmap or runs, whichever is smallest, with cumulative cardinalities. The byte offset of the k-th unit is found
by a search for its container and a select within it, so a text is cut without counting its units again, and
the set of a text of a few scripts is a fraction of the text's size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import utf8
from .columns import let
from .shared import small_batches

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BITS = 16
ARRAY_MOST = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class ArrayContainer:
    """Sorted offsets; select is a lookup."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """A bit by offset, with the counts of all words before each word."""

    def __init__(self, mask: np.ndarray):
        whole = np.zeros(1 << CHUNK_BITS, bool)
        whole[: len(mask)] = mask
        self.bits = np.packbits(whole, bitorder="little").view(np.uint64)
        self.upto = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.upto, k, "right"))
        before = int(self.upto[word - 1]) if word else 0
        bits = np.unpackbits(self.bits[word : word + 1].view(np.uint8), bitorder="little")
        return (word << 6) + int(np.flatnonzero(bits)[k - before])


class RunContainer:
    """Runs of consecutive offsets: where each begins, and how many offsets are before it."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]).astype(np.int64)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(mask: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of the offsets where the mask holds: 4 bytes a run, 2 an offset, or the bitmap's 8,192."""
    size = int(np.count_nonzero(mask))
    if size == len(mask):
        return RunContainer(np.zeros(1, np.int64), np.array([size]))
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    starts, ends = (edges[0::2], edges[1::2]) if not mask[0] else (np.concatenate([[0], edges[1::2]]), edges[0::2])
    ends = np.concatenate([ends, [len(mask)]]) if len(ends) < len(starts) else ends
    as_list = 2 * size if size <= ARRAY_MOST else 8192
    if 4 * len(starts) <= as_list:
        return RunContainer(starts, ends)
    return ArrayContainer(np.flatnonzero(mask)) if size <= ARRAY_MOST else BitmapContainer(mask)


def _characters(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    return (raw[low:high] & 0xC0) != 0x80


def _words(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    space = _SPACE[raw[max(low - 1, 0) : high]]
    return ~space[1:] & space[:-1] if low else ~space & np.concatenate([[True], space[:-1]])


def _lines(raw: np.ndarray, low: int, high: int) -> np.ndarray:
    ends = raw[max(low - 1, 0) : high] == 10
    return ends[:-1] if low else np.concatenate([[True], ends[:-1]])


#: What a text can be cut into: whether a unit begins at each byte of a range. A word goes to the next word's start, a line over its end.
UNITS: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {"characters": _characters, "words": _words, "lines": _lines}


class BoundarySet:
    """The offsets at which the units of a text begin."""

    def __init__(self, raw: np.ndarray, begins: Callable[[np.ndarray, int, int], np.ndarray] = _characters):
        self.end = len(raw)
        self.containers: list[ArrayContainer | BitmapContainer | RunContainer | None] = []
        self.before = [0]  # cumulative cardinalities
        for low in range(0, len(raw), 1 << CHUNK_BITS):
            mask = begins(raw, low, min(low + (1 << CHUNK_BITS), len(raw)))
            size = int(np.count_nonzero(mask))
            self.containers.append(container(mask) if size else None)
            self.before.append(self.before[-1] + size)

    def __len__(self) -> int:
        return self.before[-1]

    def cut(self, k: int) -> int:
        """The offset after the first k units: 0 before the first, the text's end after the last, else where unit k (from 0) begins."""
        if k <= 0 or k >= len(self):
            return 0 if k <= 0 else self.end
        at = bisect_right(self.before, k) - 1
        return (at << CHUNK_BITS) + self.containers[at].select(k - self.before[at])


def with_cuts(df: DataFrame, text: str, first: str, second: str, units: str = "characters") -> DataFrame:
    """(row, text, n, k1, k2, at1, at2): the other columns of each row as a struct, its text (null: empty) and number n of units, two cuts
    after k1 <= k2 units, which are the columns `first` and `second` modulo n + 1 in order, and their byte offsets.
    """
    begins = UNITS[units]
    small_batches(df.sparkSession)
    names = ["n", "k1", "k2", "at1", "at2"]
    rows = df.select(F.struct(*(x for x in df.columns if x != text)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(first).alias("first"), F.col(second).alias("second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            out = np.zeros((batch.num_rows, 5), np.int64)
            for i, (u, v) in enumerate(zip(batch.column("first").to_pylist(), batch.column("second").to_pylist(), strict=True)):
                found = BoundarySet(raw[bounds[i] : bounds[i + 1]], begins)
                n = len(found)
                low, high = sorted((u % (n + 1), v % (n + 1)))
                out[i] = n, low, high, found.cut(low), found.cut(high)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *(pa.array(out[:, k]) for k in range(5))], names=["row", "text", *names])

    schema = T.StructType([rows.schema["row"], rows.schema["text"], *(T.StructField(x, T.LongType()) for x in names)])
    return rows.mapInArrow(run, schema)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, units: str = "characters") -> DataFrame:
    """(id_col, n, form, prefix_units, middle_units, output): each row of docs transformed.

    Cuts and forms follow from a hash of the seed and the id alone, so they are the same at every run, order and partitioning; a null
    id counts as an empty one, rows that repeat an id share its hash. Of all texts `percent` in a hundred are cut, of these
    `spm_percent` are put suffix first; a text that is empty or holds one of the marks stays plain, with null units. Null texts are empty.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    part = docs.select(F.col(id_col).alias("id"), (h(3) % 100).alias("r3"), (h(4) % 100).alias("r4"), h(1).alias("h1"), h(2).alias("h2"), F.col(text_col).alias("given"))
    done = with_cuts(part, "given", "h1", "h2", units)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("row.r3") >= percent), "plain").when(F.col("row.r4") < spm_percent, "spm").otherwise("psm")
    bytes_ = F.col("text").cast("binary")
    piece = lambda low, high: F.substring(bytes_, (low + 1).cast("int"), (high - low).cast("int")).cast("string")
    prefix, middle, suffix = piece(F.lit(0), F.col("at1")), piece(F.col("at1"), F.col("at2")), piece(F.col("at2"), F.octet_length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_only = lambda x: F.when(F.col("form") != "plain", x)
    return done.withColumn("form", form).select(
        F.col("row.id").alias(id_col), "n", "form", cut_only(F.col("k1")).alias("prefix_units"), cut_only(F.col("k2") - F.col("k1")).alias("middle_units"), output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its three parts, which hold no mark, in their first order."""
    head = lambda x, mark: F.substring(x, len(mark) + 1, 2**31 - 1)
    psm = let(F.split(output, f"{SUFFIX}|{MIDDLE}", 3), lambda x: F.concat(head(F.get(x, F.lit(0)), PREFIX), F.get(x, F.lit(2)), F.get(x, F.lit(1))))
    spm = let(F.split(output, f"{PREFIX}|{MIDDLE}", 3), lambda x: F.concat(F.get(x, F.lit(1)), F.get(x, F.lit(2)), head(F.get(x, F.lit(0)), SUFFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, of code points as units."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select(
        id_col, "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
