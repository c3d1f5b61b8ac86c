"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words. Both sides are fingerprinted with the least hash of the GRAM-word
n-grams in each window (of equal ones the first), at every place where such an n-gram stands, so every shared
window holds a fingerprint of both sides. Fingerprints are joined, which leaves the ids of documents that hold
some; only these documents are read again, and their windows around each hit n-gram are compared with the items'
windows word by word. Items of fewer words are one window; those are looked up by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, plain_words, sliding_least, upto, window_hashes
from .shared import cut

WINDOW = 10
GRAM = 5
BROADCAST_ROWS = 500_000
PLACE = (1 << 20) - 1


def _fingerprints(words: Column) -> Column:
    """(start, length, hash): each place, from 0, of an n-gram that is the first of least hash in some window. Texts of fewer words have none."""
    # one number holds the upper bits of a hash and its place, so that the least of some is also the first of equal ones; any of equal ones would do
    placed = lambda h: F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE))))
    at = lambda v, j: (F.pmod(v.bitwiseAND(F.lit(PLACE)) - j, F.lit(PLACE + 1)) + j).cast("int")
    far = lambda m: F.transform(F.filter(upto(F.lit(0), F.size(m) - 1), lambda j: (j == 0) | (F.get(m, j) != F.get(m, j - 1))), lambda j: at(F.get(m, j), j))
    near = lambda m: F.transform(F.array_distinct(m), lambda v: v.bitwiseAND(F.lit(PLACE)).cast("int"))
    places = lambda m: F.when(F.size(m) + WINDOW <= PLACE, near(m)).otherwise(far(m))
    mark = lambda h, i: F.struct(i.alias("start"), F.lit(WINDOW).alias("length"), F.get(h, i).alias("hash"))
    return let(window_hashes(words, GRAM), lambda h: F.transform(let(sliding_least(placed(h), WINDOW - GRAM + 1), places), lambda i: mark(h, i)))


def _whole(words: Column, length: int) -> Column:
    """(start, length, hash) of all windows of a short length."""
    return F.transform(upto(F.lit(1), F.size(words) - (length - 1)), lambda i: F.struct((i - 1).alias("start"), F.lit(length).alias("length"), F.xxhash64(F.slice(words, i, length)).alias("hash")))


def _no_marks() -> Column:
    return F.array().cast("array<struct<start:int,length:int,hash:bigint>>")


def _window(words: Column, start: Column, length: Column) -> Column:
    """The window that starts at a word (from 0), as text."""
    return F.array_join(F.slice(words, start + 1, length), " ")


def _around(mark: Column) -> Column:
    """(length, first, last, words): the first and last start of the windows that hold a mark, and the words of all of them."""
    reach = F.when(mark["length"] == WINDOW, WINDOW - GRAM).otherwise(0)
    ends = F.struct(F.greatest(F.lit(0), mark["start"] - reach).alias("first"), F.least(F.size("words") - mark["length"], mark["start"]).alias("last"))
    of = lambda x: F.struct(mark["length"].alias("length"), x["first"].alias("first"), x["last"].alias("last"), F.slice("words", x["first"] + 1, x["last"] - x["first"] + mark["length"]).alias("words"))
    return let(ends, of)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if that many rows are few enough; otherwise Spark chooses."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints: length, hash), (windows: length, window, set), (members: set, item), all distinct. Items without words have none.

    Items of equal words are fingerprinted once. A set stands for the items that share some windows: windows of the same items have the
    same set, known by a count and two hashes of them that do not depend on their order, so nothing is gathered by window, and a
    passage that many items share meets documents as often as it has windows, not as often as there are items.
    """
    words = items.select(F.col(id_col).alias("item"), plain_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("like", F.sha2(F.array_join("words", " "), 256))
    texts = words.select("like", "words").dropDuplicates(["like"])
    long_ = texts.where(F.size("words") >= WINDOW)
    short = texts.where(F.size("words") < WINDOW)
    # explode_outer, since Spark would evaluate the array of explode a second time to filter empty ones
    marks = long_.select(F.explode_outer(_fingerprints(F.col("words"))).alias("mark"))
    keys = marks.select("mark.length", "mark.hash").where("hash is not null")
    keys = keys.union(short.select(F.size("words"), F.xxhash64("words"))).distinct()
    each = long_.select(F.lit(WINDOW).alias("length"), F.explode_outer(F.transform(upto(F.lit(0), F.size("words") - WINDOW), lambda i: _window(F.col("words"), i, F.lit(WINDOW)))).alias("window"), "like")
    each = cut(each.union(short.select(F.size("words"), F.array_join("words", " "), "like")).distinct())
    of = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("like")), F.bit_xor(F.xxhash64("like", F.lit(1))))
    windows = cut(each.groupBy("length", "window").agg(of.alias("set")))
    one = windows.groupBy("set").agg(F.min(F.struct("length", "window")).alias("w")).select("set", "w.*")
    members = one.join(each, ["length", "window"]).join(words.select("like", "item").distinct(), "like").select("set", "item").distinct()
    return keys, windows, cut(members)


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"), *more)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["row_hash"].eqNullSafe(right["row_hash"]) & left["id"].eqNullSafe(right["id"])


def _met(docs: DataFrame, keys: DataFrame, counts: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(id, row_hash, start, length): places of fingerprints of documents that items have too, and a row of length 0 for each row of docs, whose start is its number of words.

    So one pass over the texts gives both. Computed once.
    """
    words = _rows(docs, id_col, text_col, plain_words(F.col(text_col)).alias("words"))
    parts = [_fingerprints(F.col("words"))] if counts.get(WINDOW) else []
    parts += [_whole(F.col("words"), k) for k in sorted(set(counts) - {WINDOW})]
    number = F.struct(F.size("words").alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("hash"))
    marks = F.concat(F.array(number), *(parts or [_no_marks()]))
    # explode_outer, since Spark would evaluate the array of explode a second time to filter empty ones
    sown = words.select("id", "row_hash", F.explode_outer(marks).alias("mark")).select("id", "row_hash", "mark.*")
    joined = sown.join(_sized(keys.withColumn("shared", F.lit(True)), sum(counts.values())), ["length", "hash"], "left")
    return cut(joined.where("shared or length = 0").select("id", "row_hash", "start", "length"))


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, row_hash, start, length, set): every place of a document where a window of an item occurs; (set, item): whose windows those are;
    and (id, row_hash, n_words) of each row of docs.

    Fingerprints of all documents meet those of items in a join, which is broadcast up to BROADCAST_ROWS
    of items and shuffled by hash beyond, where Spark splits frequent hashes. Only the places of those that meet are kept, so
    documents are hashed once; no text is shuffled but that around the hits. What is broadcast has been written and counted before.
    """
    keys, windows, members = item_windows(items, item_col, item_text)
    keys = cut(keys)
    counts = {r["length"]: r["n"] for r in keys.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    met = _met(docs, keys, counts, id_col, text_col)
    marked = met.where("length > 0").distinct()
    some = marked.groupBy("id", "row_hash").agg(F.collect_list(F.struct("start", "length")).alias("marks"))  # places within one text
    texts = _rows(docs, id_col, text_col, F.col(text_col).alias("text"))
    again = texts.join(_sized(some, marked.count()), _same(texts, some)).select(texts["id"], texts["row_hash"], "marks", plain_words(F.col("text")).alias("words"))
    # a mark takes along the words around it, not the whole text
    near = again.select("id", "row_hash", F.explode_outer(F.transform("marks", _around)).alias("mark")).select("id", "row_hash", "mark.*")
    places = near.select("id", "row_hash", "words", "length", "first", F.explode_outer(upto(F.col("first"), F.col("last"))).alias("start"))
    places = places.select("id", "row_hash", "start", "length", _window(F.col("words"), F.col("start") - F.col("first"), F.col("length")).alias("window")).distinct()
    found = places.join(_sized(windows, windows.count()), ["length", "window"]).select("id", "row_hash", "start", "length", "set")
    return found, members, met.where("length = 0").select("id", "row_hash", F.col("start").cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: the id, row_hash, n_words, n_hit (words inside windows of items), n_items, items (their ids as sorted text).

    Null and empty texts have no words and no hits. Rows that repeat each get the same result. Items
    with a null id count as one item without a name.
    """
    places, members, rows = hits(docs, items, id_col, text_col, item_col, item_text)
    found = cut(places)
    covered = found.select("id", "row_hash", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    n_hit = covered.groupBy("id", "row_hash").agg(F.count("*").alias("n_hit"))
    whose = found.select("id", "row_hash", "set").distinct().join(_sized(members, members.count()), "set")
    of = whose.groupBy("id", "row_hash").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items"))
    per = n_hit.join(of, _same(n_hit, of)).select(n_hit["id"], n_hit["row_hash"], "n_hit", "items")
    joined = rows.join(per, _same(rows, per), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        rows["id"].alias(id_col), rows["row_hash"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    return found.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    bad = cut(hits(docs, items, id_col, text_col, item_col, item_text)[0].select("id", "row_hash").distinct())
    return docs.join(_sized(bad, bad.count()), bad["id"].eqNullSafe(docs[id_col]) & (bad["row_hash"] == F.xxhash64(docs[id_col], docs[text_col])), "left_anti")
