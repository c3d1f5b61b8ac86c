"""Best-fit packing of documents into token sequences, improved by swap-based local search.

The number of sequences depends only on how many pieces there are of each length, and there are
at most `capacity` lengths. So Spark counts pieces by length; the driver packs that histogram into
*patterns* (lists of lengths that share a sequence) with multiplicities; Spark then hands the places
of the patterns out to the pieces by their rank within their length. What reaches the driver is
bounded by the capacity, whatever the input, while the result is that of packing all pieces together.
"""

from __future__ import annotations

import array
import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small_batches

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
ROUNDS = 40
PARTNERS = 400
BROADCAST_ROWS = 500_000


def default_paths() -> tuple[str, str]:
    """The vocabulary as the tokenizers library has it, and the same one as byte-pair ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of a text in the 50k byte-level vocabulary.

    The ranks file gives the same ids as the JSON file for texts without the special token and is
    several times faster; texts that hold the special token go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32.

    A document is its ids and then END_ID; null texts count as empty, so each row has at least one
    token. Documents longer than the capacity are cut into full pieces, of which the first may be shorter.
    """
    json_path, ranks_path = paths or default_paths()
    small_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = array.array("I", encode(text.as_py() or ""))
                ids.append(END_ID)
                data, n = memoryview(ids).cast("B"), len(ids)
                at, end = 0, n % capacity or min(n, capacity)
                k = 0
                while at < n:
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * end]))
                    at, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(cut_up, schema)


# ---- packing of a histogram -------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: patterns (sorted lengths) with their multiplicities."""
    open_bins: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room][pattern] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                fit = capacity // size
                whole, rest = divmod(left, fit)
                if whole:
                    put(capacity - size * fit, (size,) * fit, whole)
                if rest:
                    put(capacity - size * rest, (size,) * rest, 1)
                break
            room = rooms[k]
            pattern = max(open_bins[room])
            n = min(left, open_bins[room][pattern])
            open_bins[room][pattern] -= n
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
            if not open_bins[room]:
                rooms.pop(k)
            put(room - size, pattern + (size,), n)
            left -= n
    found: Counter = Counter()
    for group in open_bins.values():
        found.update(group)
    return found


def _without(pattern: tuple, *items: int) -> tuple:
    rest = list(pattern)
    for x in items:
        rest.remove(x)
    return tuple(rest)


def _exchange(donor: tuple, taker: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The exchange that fills the taker most: a move, one for one, two for one, or one for two.

    Only exchanges that raise the sum of squared fills count.
    """
    room, given = capacity - sum(taker), sum(donor)
    need = given - sum(taker)  # a net gain above this raises the squares
    ones_d, ones_t = sorted(set(donor)), sorted(set(taker))
    twos = lambda p: sorted({(a + b, a, b) for i, a in enumerate(p) for b in p[i + 1 :]})
    twos_d, twos_t = twos(donor), twos(taker)
    out = [(x, (x,)) for x in ones_d] + [(s, (a, b)) for s, a, b in twos_d]
    back = [(0, ())] + [(x, (x,)) for x in ones_t] + [(s, (a, b)) for s, a, b in twos_t]
    best, choice = max(need, 0), None
    sums = sorted(out)
    keys = [s for s, _ in sums]
    for b, taken in back:
        k = bisect_left(keys, room + b + 1) - 1
        while k >= 0 and keys[k] - b > best:
            if len(sums[k][1]) + len(taken) <= 3:
                best, choice = keys[k] - b, (sums[k][1], taken)
                break
            k -= 1
        if best == room:
            break
    if choice is None:
        return None
    given_up, taken = choice
    return tuple(sorted(_without(donor, *given_up) + taken, reverse=True)), tuple(sorted(_without(taker, *taken) + given_up, reverse=True))


def local_search(patterns: Counter, capacity: int, rounds: int = ROUNDS, partners: int = PARTNERS) -> Counter:
    """Exchanges between underfull bins, emptiest first, until bins empty, none improves or the rounds are over.

    Bins of one pattern are alike, so an exchange between two patterns is applied to as many pairs
    of bins as both have. Stops at once when no packing can have fewer bins. `rounds` passes are made at most,
    each of the `partners` emptiest with the `partners` fullest of the underfull patterns; both bound the driver's
    work, not the items: all stay packed.
    """
    found = Counter(patterns)
    total = sum(sum(p) * n for p, n in found.items())
    least = -(-total // capacity)
    for _ in range(rounds):
        if sum(found.values()) <= least:
            break
        under = sorted((p for p in found if sum(p) < capacity), key=lambda p: (sum(p), p))
        changed = False
        for donor in under[:partners]:
            for taker in reversed(under[-partners:]):
                if not found[donor]:
                    break
                n = min(found[donor], found[taker]) if donor != taker else found[donor] // 2
                if n <= 0 or (new := _exchange(donor, taker, capacity)) is None:
                    continue
                found[donor] -= n
                found[taker] -= n
                for p in new:
                    if p:
                        found[p] += n
                changed = True
        found = Counter({p: n for p, n in found.items() if n > 0})
        if not changed:
            break
    return found


def slots(patterns: Counter) -> pd.DataFrame:
    """Places that patterns offer: for each length, ranks low.. of its pieces get sequences first.. at an offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in sorted(patterns.items(), reverse=True):
        offset = 0
        for size in pattern:
            rows.append((size, used[size], n, sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return pd.DataFrame(rows, columns=["length", "low", "n", "first", "offset"]).astype("int64").sort_values(["length", "low"], ignore_index=True)


def pack(parts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, rounds: int = ROUNDS, partners: int = PARTNERS) -> DataFrame:
    """The pieces with sequence_id and offset; as few sequences as the search finds in its rounds (see local_search).

    Pieces of one length are alike to the packing. They are ranked within the partition of the written table
    that they stand in, so neither a frequent length nor a repeated or null id gathers more rows than a
    partition holds; counts by length and partition give the ranks' offsets.
    """
    parts = cut(parts)
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    places = slots(local_search(best_fit(counts, capacity), capacity, rounds, partners))
    parts = parts.withColumn("part_", F.spark_partition_id())
    by_part = parts.groupBy("length", "part_").agg(F.count("*").alias("n_"))
    before = by_part.select("length", "part_", (F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before_"))
    if capacity * parts.rdd.getNumPartitions() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    order = Window.partitionBy("length", "part_").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32")
    ranked = parts.withColumn("rank_", F.row_number().over(order) - 1).join(before, ["length", "part_"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = int(places["low"].max() + places["n"].max()) + 1 if len(places) else 1
        keys = (places["length"] * width + places["low"]).to_numpy()
        low, first, offset = (places[c].to_numpy() for c in ("low", "first", "offset"))
        for frame in frames:
            k = np.searchsorted(keys, (frame["length"] * width + frame["rank_"]).to_numpy(), "right") - 1
            frame["sequence_id"] = first[k] + frame["rank_"].to_numpy() - low[k]
            frame["offset"] = offset[k]
            yield frame.drop(columns="rank_")

    kind = parts.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank_") + F.col("before_")).alias("rank_")).mapInPandas(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, rounds: int = ROUNDS, partners: int = PARTNERS) -> DataFrame:
    """All documents as pieces, packed. An empty table gives no rows; null texts count as empty, repeated rows are packed each.

    `rounds` and `partners` bound the local search on the histogram of lengths. Columns other than the two named are not read.
    """
    return pack(pieces(docs, id_col, text_col, capacity), id_col, capacity, rounds, partners)
