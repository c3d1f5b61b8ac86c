"""Preference formatting: pairs of conversations as a shared prompt with two masked completions.

The longest common turn prefix (role and text alike) of the chosen and the rejected conversation is
rendered once as the prompt; what follows is rendered for either side, with the character ranges on
which a loss counts: the assistant's texts with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let
from .shared import cut

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): one row per conversation, turns as an array of (role, text) in order.

    Null roles and texts count as empty; a turn number that repeats with other content stays, ordered by
    role and text; equal rows count once. Rows with a null id are left out.
    """
    part = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    whole = part.distinct().groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    return whole.select("id", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """How many turns at the start are alike."""
    alike = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    return let(F.array_position(alike, False), lambda at: F.when(at > 0, at - 1).otherwise(F.size(alike))).cast("int")


def rendered(turns: Column) -> Column:
    """Turns as text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def loss_ranges(turns: Column) -> Column:
    """(start, end) of the learned texts with their end marks, in the characters of rendered(turns).

    Where each turn ends is a running sum, made by doubling: after step k an end is the sum of up to 2^k turns before it. So the work for n
    turns is n log n and no step copies what the steps before it made.
    """
    head = lambda t: F.char_length(t["role"]) + len(START) + 1
    size = lambda t: (head(t) + F.char_length(t["text"]) + len(END)).cast("long")
    step = lambda sums, by: F.transform(sums, lambda x, i: x + F.when(i >= by, F.get(sums, i - by)).otherwise(0))
    start = F.struct(F.transform(turns, size).alias("sums"), F.lit(1).alias("by"))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(turns), F.lit(1)))).cast("int")))
    summed = F.aggregate(rounds, start, lambda a, _: F.struct(step(a["sums"], a["by"]).alias("sums"), (a["by"] * 2).alias("by")), lambda a: a["sums"])
    place = lambda ends: F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), (F.get(ends, i) - F.char_length(t["text"]) - len(END)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end")))
    every = let(summed, place)
    return F.transform(F.filter(every, lambda x: x["role"] == LEARNED_ROLE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def format_pairs(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """`pairs` has an id and the turns of chosen and rejected. Gives prompt_turns, prompt, chosen, chosen_loss, rejected, rejected_loss.

    A pair whose sides are equal has empty completions without ranges; a null side counts as empty.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    step = pairs.select(id_col, F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    step = step.withColumn("prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("prompt_turns") + 1, F.size(side))
    step = step.select(id_col, "prompt_turns", F.slice("chosen", F.lit(1), F.col("prompt_turns")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return step.select(
        id_col, "prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), loss_ranges(F.col("c")).alias("chosen_loss"),
        rendered(F.col("r")).alias("rejected"), loss_ranges(F.col("r")).alias("rejected_loss"),
    )


def _numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Rows numbered from 0 in a global order, and how many there are. Ranges are written once, so both readings of them agree."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("within_", own))
    sizes = parts.groupBy("part_").agg(F.count("*").alias("n_"))  # a row by partition
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return parts.join(F.broadcast(before), "part_").withColumn("number", F.col("before_") + F.col("within_")).drop("part_", "within_", "before_"), parts.count()


def pairs_of_neighbours(whole: DataFrame) -> DataFrame:
    """Pairs from conversations alone: chosen is each conversation with a learned turn, rejected comes from the next
    one in the order of their texts (ties by id; the last one's next is the first), which shares the most turns at the start.

    Where the first turns are alike, the next conversation is rejected as it is; else the conversation itself
    with the last learned turn's text replaced by that of the next. Copies of one conversation
    give equal sides. A single conversation is its own next one. Conversations without a learned turn offer no pair.
    """
    last = lambda turns: F.element_at(F.filter(turns, lambda t: t["role"] == LEARNED_ROLE), -1)["text"]
    some = whole.where(F.exists("turns", lambda t: t["role"] == LEARNED_ROLE)).select("id", "turns", rendered(F.col("turns")).alias("shown"))
    placed, total = _numbered(some, "shown", "id")
    other = placed.select(F.pmod(F.col("number") - 1, F.lit(max(1, total))).alias("number"), F.col("turns").alias("other"))
    place = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED_ROLE, i)))
    put = lambda reply: F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == place, reply).otherwise(t["text"]).alias("text")))
    rejected = F.when(F.get("turns", F.lit(0)) == F.get("other", F.lit(0)), F.col("other")).otherwise(let(last(F.col("other")), put))
    return placed.select("id", "turns", "number").join(other, "number").select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def ranges_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
