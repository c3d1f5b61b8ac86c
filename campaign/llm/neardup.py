"""Near-duplicate join on word n-grams: MinHash banding finds candidates, full n-gram sets verify them.

Rows with the same n-gram set are one *set*, with a count; only different sets are compared.
Buckets (equal band hashes) with two or more sets are dealt into tiles of bounded size; a tile
compares two blocks of one bucket on their full n-gram sets inside one task and returns one row per
set, not one per pair. A pair that meets in several buckets counts in the first. Classes are the
connected components of the links.

Work in a bucket of n similar sets is n * n / 2 comparisons, dealt over (n / block) ** 2 / 2 tiles;
no link is lost but by the banding, whose chance of a miss is at most 1 - recall at the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, chunks, mix, ngrams, utf8, words
from .shared import cut, small_batches

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 256
BLOCK = 512


def banding(similarity: float, recall: float, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows a band, so fewest false candidates, whose recall at the similarity reaches the target."""
    best = None
    for rows in range(1, most_hashes + 1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError("no banding within most_hashes reaches the recall")
    return best


def shingles(raw: np.ndarray, bounds: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes by row. A text of fewer words, but not none, has one shingle: all its words."""
    found = words(raw, bounds)
    grams = ngrams(found, n)
    out = []
    for row in range(len(bounds) - 1):
        a, b = grams.bounds[row], grams.bounds[row + 1]
        if a < b:
            out.append(np.unique(grams.hashes[a:b]))
            continue
        a, b = found.bounds[row], found.bounds[row + 1]
        if a < b:
            out.append(ngrams(Words(found.hashes[a:b], np.array([0, b - a])), int(b - a)).hashes)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) signed 64-bit band hashes; the sets must not be empty."""
    count = bands * rows
    multiply, add = _seeds(count)
    least = np.empty((len(sets), count), np.uint32)
    for k, hashes in enumerate(sets):
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for at in range(0, len(low), 4096):
            x = low[at : at + 4096][None, :] * multiply[:, None] + add[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            m = x.min(axis=1)
            least[k] = m if not at else np.minimum(least[k], m)
    out = np.zeros((len(sets), bands), np.uint64)
    parts = least.reshape(len(sets), bands, rows).astype(np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r] + np.uint64(r + 1))
    return mix(out + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


def signatures(docs: DataFrame, text_col: str, bands: int, rows: int, n: int, *keep: str) -> DataFrame:
    """The kept columns, set_key (null for a text without words) and the band hashes as an array."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(len(keep)))
            for first, last in chunks(bounds):
                part = bounds[first : last + 1]
                sets = shingles(raw[part[0] : part[-1]], part - part[0], n)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                hashes: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    made = band_hashes([sets[k] for k in full], bands, rows)
                    for k, row in zip(full, made, strict=True):
                        keys[k], hashes[k] = set_key(sets[k]), row
                sub = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(sub.column(i) for i in range(len(keep))), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=[*keep, "set_key", "bands"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "set_key binary, bands array<long>"])
    return kept.mapInArrow(run, schema)


def keyed_texts(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(set_key, text) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column(0))
            for first, last in chunks(bounds):
                part = bounds[first : last + 1]
                keys = [set_key(s) if len(s) else None for s in shingles(raw[part[0] : part[-1]], part - part[0], n)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).slice(first, last - first)], names=["set_key", "text"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "set_key binary, text string").where("set_key is not null")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.float32)
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # others are in one set only
    keep = shared[number]
    owner, number = owner[keep], (np.cumsum(shared) - 1)[number[keep]]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [low, low + 4096])
        block = np.zeros((n, 4096), np.float32)
        block[owner[a:b], number[a:b] - low] = 1
        out += block @ block.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each member the first member of its component."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile(frame: pd.DataFrame, n: int, similarity: float) -> pd.DataFrame:
    """Links between the sets of one tile: a row for each set that has some."""
    frame = frame.sort_values("set_key", ignore_index=True)
    raw, bounds = utf8(pa.array(frame["text"], pa.string()))
    sets = shingles(raw, bounds, n)
    size = np.array([len(s) for s in sets])
    common = _common(sets)
    # common / union >= similarity, in exact integers where the similarity is a decimal
    union = size[:, None] + size[None, :] - common
    linked = common >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    side_a, side_b = frame["in_a"].to_numpy(), frame["in_b"].to_numpy()
    linked &= (side_a[:, None] & side_b[None, :]) | (side_b[:, None] & side_a[None, :])
    counted = linked.copy()
    kept = np.stack(frame["kept"].to_numpy())
    band = int(frame["band"].iloc[0])
    for k in range(band):
        x = kept[:, k]
        counted &= ~((x[:, None] == x[None, :]) & (x != 0)[:, None])
    root = _roots(linked)
    has = linked.any(axis=1)
    keys = frame["set_key"].to_numpy()
    return pd.DataFrame({"set_key": keys[has], "root": keys[root[has]], "links": (counted @ frame["copies"].to_numpy())[has].astype("int64")})


def links(docs: DataFrame, reps: DataFrame, text_col: str, n: int, similarity: float, bands: int, block: int = BLOCK) -> DataFrame:
    """(set_key, root, links): the root is a set of the same component, links counts rows of linked sets; partial, by tile.

    `reps` has set_key, copies and bands.
    """
    rows = reps.select("set_key", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        rows.groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("x1"), F.bit_xor(F.xxhash64("set_key", F.lit(7))).alias("x2"))
        .where("n > 1")
    )
    # bands often gather the same sets; one bucket of each such group is enough
    buckets = buckets.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n")
    members = rows.join(buckets, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("set_key", F.lit(11)), F.col("blocks")).cast("int")))
    # the buckets that a set is in, by band; 0 stands for none. At most one a band.
    kept = members.groupBy("set_key").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("m"))
    kept = kept.select("set_key", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("kept"))
    texts = keyed_texts(docs, text_col, n).join(kept.select("set_key"), "set_key", "left_semi").groupBy("set_key").agg(F.first("text").alias("text"))
    whole = kept.join(reps.select("set_key", "copies"), "set_key").join(texts, "set_key")
    tiles = members.select(
        "set_key", "band", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("set_key", "band", "bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block")
    tiles = tiles.select("set_key", "band", "bucket", "a", "b", (F.col("block") == F.col("a")).alias("in_a"), (F.col("block") == F.col("b")).alias("in_b"))
    dealt = tiles.join(whole, "set_key").repartition("band", "bucket", "a", "b").sortWithinPartitions("band", "bucket", "a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            keys = frame[["band", "bucket", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], cuts]).astype(int)
            made = [_tile(frame.iloc[s:e], n, similarity) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            rest = frame.iloc[starts[-1] :]
            if made:
                yield pd.concat(made, ignore_index=True)
        if rest is not None and len(rest):
            yield _tile(rest, n, similarity)

    return dealt.mapInPandas(run, "set_key binary, root binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component; `edges` has u and v in either direction.

    Each round takes the least label among neighbours and then that label's own label, so rounds
    grow with the logarithm of a component's width. Each round is written to the shared folder.
    """
    both = cut(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = cut(step.join(jump, step["new"] == jump["at"], "left").select("node", "old", F.least("new", F.coalesce("further", "new")).alias("label")))
        moved = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows: the id, text_hash, set_key and bands; sets: set_key, links with copies, first).

    `first` is (id is null, id, text_hash) of the first row of the set's class.
    """
    bands, rows = banding(similarity, recall)
    own = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col))
    sig = cut(signatures(own, text_col, bands, rows, n, id_col, "text_hash"))
    keyed = sig.where("set_key is not null")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash"))
    reps = cut(keyed.groupBy("set_key").agg(F.count("*").alias("copies"), first.alias("least"), F.first("bands").alias("bands")))
    found = cut(links(docs, reps, text_col, n, similarity, bands, block))
    label = components(found.select(F.col("set_key").alias("u"), F.col("root").alias("v")))
    total = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    sets = reps.select("set_key", "copies", "least").join(label.select(F.col("node").alias("set_key"), "label"), "set_key", "left").join(total, "set_key", "left")
    sets = sets.select("set_key", "copies", "least", F.coalesce("label", "set_key").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    classes = sets.groupBy("label").agg(F.min("least").alias("first"))
    return sig, sets.join(classes, "label").select("set_key", "first", (F.col("links") + F.col("copies") - 1).alias("n_links"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: the id, class_id (least id of its class) and n_links.

    n_links counts the other rows whose n-gram sets have a Jaccard similarity of at least
    `similarity`, copies included. A row without words (null, empty, punctuation only) is a class of
    its own without links, as is a row with a null id and no links. Columns other than the two named
    are not read.
    """
    sig, sets = _classes(docs, id_col, text_col, n, similarity, recall, block)
    joined = sig.select(id_col, "set_key").join(sets.select("set_key", F.col("first.id").alias("class_id"), "n_links"), "set_key", "left")
    return joined.select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """The rows of docs, one of each class: that with the least id, null ids last and ties by the text's hash.

    Rows are told apart by id and text, so different texts under one id are judged each on its own; of
    rows that repeat both, one stays. Rows without words all stay.
    """
    sig, sets = _classes(docs, id_col, text_col, n, similarity, recall, block)
    rows = sig.where("set_key is not null").select(F.col(id_col).alias("id_"), "text_hash", "set_key").join(sets.select("set_key", "first"), "set_key")
    chosen = F.col("id_").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marks = cut(rows.groupBy("id_", F.col("text_hash").alias("hash_")).agg(F.bool_and(chosen).alias("chosen"), F.count("*").alias("rows")).where("not chosen or rows > 1"))
    gone, repeated = marks.where("not chosen"), marks.where("chosen")
    same = lambda df: docs[id_col].eqNullSafe(df["id_"]) & (F.xxhash64(docs[text_col]) == df["hash_"])
    kept = docs.join(gone, same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same(repeated), "left_anti").unionByName(docs.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col]))
