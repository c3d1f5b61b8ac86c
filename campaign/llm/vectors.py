"""Vector code compression: each vector as the numbers of the nearest codebook entries of its parts.

Codebooks are found by Lloyd rounds over whole numbers. A part whose entry did not change in the last round keeps its
stored exact distance and compares only the entries that did; the other parts scan all entries. Among those left unchanged
its own entry stays the nearest, of least index, so this is the result of a full scan. Codes and distances
travel with the vectors in a table that each round writes anew to the shared folder, so a lost executor repeats tasks of one
round, and with them the sums of each entry's parts, a row a task, which is all that meets on the driver: ENTRIES rows for each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import remove, shared_folder, small_batches, unique

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components may be this large, so that squared distances of any part fit in 64 bits.
LARGEST = 1 << 26
BROADCAST_ROWS = 100_000
_BLOCK = 4096


class Codebooks(NamedTuple):
    """entries: (part, entry, position) whole numbers; moved: (part, entry) whether an entry changed in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries. Products in floating point are exact below 2**53; larger numbers go entry by entry."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of the nearest entry of each row, of equal ones the first."""
    code, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), _BLOCK):
        d = _distances(x[at : at + _BLOCK], entries)
        code[at : at + _BLOCK] = k = d.argmin(axis=1)
        best[at : at + _BLOCK] = np.take_along_axis(d, k[:, None], axis=1)[:, 0]
    return code, best


def rescan(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, from the entries and distances before: only moved entries are compared where a row's own entry stayed."""
    code, best, active = code.copy(), best.copy(), np.flatnonzero(moved)
    lost = moved[code]
    code[lost], best[lost] = scan(x[lost], entries)
    kept = np.flatnonzero(~lost)
    if len(kept) and len(active):
        k, d = scan(x[kept], entries[active])
        k = active[k]
        wins = (d < best[kept]) | ((d == best[kept]) & (k < code[kept]))
        code[kept[wins]], best[kept[wins]] = k[wins], d[wins]
    return code, best


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    _, bounds, data = column.buffers()
    first = int(np.frombuffer(bounds, np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset])
    return np.frombuffer(data, kind, len(column) * width, first).reshape(len(column), width)


def _binary(m: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(m)
    step = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * step
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def whole_vectors(df: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(row, x): rows as structs, with floor(scale * component) of their vectors. Null and empty vectors and those with null, infinite or NaN components are left out."""
    value = lambda c: c.cast("double")
    finite = (F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(value(c)) < float("inf")))
    fits = F.forall(vector_col, lambda c: F.abs(value(c)) * scale < LARGEST)
    x = F.transform(vector_col, lambda c: F.floor(value(c) * scale))
    rest = [c for c in df.columns if c != vector_col]
    return df.where(F.col(vector_col).isNotNull() & finite).select(F.struct(*rest).alias("row"), F.when(fits, x).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).alias("x"))


def _round(rows: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """(row, v, codes, dists, error, part, entry, n, sums): rows with what they are assigned to, and a row by task and entry with the number
    and sums of the parts assigned to it, for which `row` is null."""
    parts, _, width = books.entries.shape
    kind, entries, moved = np.int32, books.entries, books.moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(entries.shape[:2], np.int64)
        sums = np.zeros(entries.shape, np.int64)
        shape = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                x = batch.column("x")
                v = x.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, parts * width)
                code, dist = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
            else:
                v = _matrix(batch.column("v"), kind, parts * width)
                code, dist = _matrix(batch.column("codes"), np.uint8, parts).astype(np.int64), _matrix(batch.column("dists"), np.int64, parts).copy()
            for p in range(parts):
                x = v[:, p * width : (p + 1) * width].astype(np.int64)
                code[:, p], dist[:, p] = scan(x, entries[p]) if first else rescan(x, entries[p], moved[p], code[:, p], dist[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries.shape[1])
                np.add.at(sums[p], code[:, p], x)
            row = batch.column("row")
            shape = row.type
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([row, _binary(v), _binary(code.astype(np.uint8)), _binary(dist), pa.array(dist.sum(axis=1)), *none], names=names)
        used = np.argwhere(counts)
        if len(used):
            k = len(used)
            mine = [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[tuple(used.T)]), pa.array(list(sums[tuple(used.T)]), pa.list_(pa.int64()))]
            none = [pa.nulls(k, t) for t in (shape, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *mine], names=names)

    kinds = {"v": T.BinaryType(), "codes": T.BinaryType(), "dists": T.BinaryType(), "error": T.LongType(), "part": T.IntegerType(), "entry": T.IntegerType(), "n": T.LongType(), "sums": T.ArrayType(T.LongType())}
    names = ["row", *kinds]
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(k, t) for k, t in kinds.items())]))


def _moved_to(state: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    width = books.entries.shape[2]
    found = state.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width))).collect()  # a row by entry
    entries = books.entries.copy()
    for r in found:
        entries[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Codebooks(entries, (entries != books.entries).any(axis=2))


def compress(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): the other columns of each kept row with `codes` (binary, a byte for each part) and `error` (its final squared distances
    summed over parts); columns of these names in the input give way.

    Vectors are scaled to whole numbers and cut into equal consecutive parts. The codebooks start with the parts of the rows of least
    ids (nulls last, of equal ids the least vectors), at most 256. Rows are left out as whole_vectors says; vectors of
    unequal lengths, or lengths that parts do not divide, raise. Rows that repeat are assigned alike and each count. No rows give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes are single bytes")
    spark = vectors.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/{unique('vectors')}"
    whole = whole_vectors(vectors, vector_col, scale)
    sizes = whole.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    dims = sizes[0] or parts
    if sizes[0] != sizes[1] or dims % parts:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components cannot be cut into {parts} equal parts")
    start = whole.select(F.col(f"row.`{id_col}`").alias("id"), "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()  # at most 256 rows
    book = np.array([r["x"] for r in start], np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    books = Codebooks(book if len(start) else np.zeros((parts, 1, dims // parts), np.int64), np.ones((parts, max(1, len(start))), bool))
    state = whole
    for k in range(rounds + 1):
        _round(state, books, k == 0).write.parquet(f"{folder}/{k}")
        state = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        if k < rounds:
            books = _moved_to(state, books)
            if not books.moved.any():
                break  # further rounds would change nothing
        state = state.where("part is null").select("row", "v", "codes", "dists")
    rest = [c for c in vectors.columns if c not in (vector_col, "codes", "error")]
    final = spark.read.parquet(f"{folder}/{k}").where("part is null")
    return final.select(*(F.col(f"row.`{c}`").alias(c) for c in rest), "codes", "error"), books


def with_label_error(rows: DataFrame, label_col: str) -> DataFrame:
    """Adds label_error: the error summed over the rows of an equal label, nulls together. Totals are broadcast up to BROADCAST_ROWS labels; beyond, Spark joins by shuffle and splits frequent labels."""
    totals = rows.groupBy(F.col(label_col).alias("label_")).agg(F.sum("error").alias("label_error"))
    few = totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(totals) if few else totals, F.col(label_col).eqNullSafe(F.col("label_"))).drop("label_")


def digest(rows: DataFrame, books: Codebooks, id_col: str = "vec_id") -> DataFrame:
    """The contract's columns."""
    return rows.select(id_col, F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
