"""Hierarchies of tasks: descendants, levels and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, written
from .tasks import rank_state, state_rank


def _apart(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled whatever its size: tables that are small as files are large once they are sent, and there is one in each round."""
    return df.hint("merge")


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, task_id, depth): all tasks at or below each root; depth 0 is the root itself. Equal roots count once.

    Each task points to its parent; in each round a pointer is replaced by that of the task it points to, so it reaches twice as far, until it
    stands at a root or at a task without a parent. The rounds are the logarithm of the depth, whatever it is. Roots below
    roots are few or many pairs by nature of the result; they are found by the same doubling. Tasks on a cycle without a root, and those
    below it, are below no root; a root that is below itself raises.
    """
    named = roots.select(F.col("task_id").alias("root")).distinct()
    is_root = lambda df, on: df.join(named.select(F.col("root").alias(on), F.lit(True).alias("at_root")), on, "left").withColumn("at_root", F.coalesce("at_root", F.lit(False)))
    links = tree.where("parent_id is not null").select("task_id", F.col("parent_id").alias("to")).distinct()
    inner = links.select(F.col("task_id").alias("to"), F.lit(True).alias("inner")).distinct()
    known = is_root(links, "to").join(_apart(inner), "to", "left")
    steps = written(known.select("task_id", "to", F.lit(1).alias("depth"), "at_root", (F.col("at_root") | F.col("inner").isNull()).alias("stands")))
    n = steps.count()
    for _ in range(n.bit_length() + 1):
        moving = steps.where("not stands")
        if moving.isEmpty():
            break
        ahead = steps.select(F.col("task_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("at_root").alias("r"), F.col("stands").alias("s"))
        doubled = moving.join(_apart(ahead), "to").select("task_id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("r").alias("at_root"), F.col("s").alias("stands"))
        steps = written(steps.where("stands").union(doubled))
    near = written(is_root(steps.where("stands and at_root").select("task_id", F.col("to").alias("root"), "depth"), "task_id"))
    own = named.select("root", F.col("root").alias("task_id"), F.lit(0).alias("depth"))
    base = near.where("not at_root").select("root", "task_id", "depth").union(own)
    above = written(near.where("at_root").select(F.col("task_id").alias("root"), F.col("root").alias("upper"), "depth"))
    size = above.count()
    while size:
        round_trip = above.where("root = upper").select("root").limit(10).collect()
        if round_trip:
            raise ValueError(f"a cycle through: {', '.join(str(r[0]) for r in round_trip)}")
        twice = above.join(above.select(F.col("root").alias("upper"), F.col("upper").alias("next"), F.col("depth").alias("more")), "upper").select("root", F.col("next").alias("upper"), (F.col("depth") + F.col("more")).alias("depth"))
        above = written(above.union(twice).distinct())
        before, size = size, above.count()
        if size == before:
            break
    return base.union(base.join(above.withColumnRenamed("depth", "more"), "root").select(F.col("upper").alias("root"), "task_id", (F.col("depth") + F.col("more")).alias("depth")))


def topological_levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """(task_id, level): the longest path from a task without dependencies; names only depended upon are at level 0.

    Each round settles the tasks on which no unsettled one bears, and takes the tasks with a single open dependency out of the way: what
    depends on them depends on theirs instead, over the sum of the two lengths. So a chain halves in each round, and the
    rounds are the logarithm of its length; layers of tasks with several open dependencies each take one round. The
    edges never grow in number. Self-loops are ignored; a cycle raises with some of the tasks on it or behind it.
    """
    edges = written(deps.where("task_id <> depends_on").select("task_id", F.col("depends_on").alias("on"), F.lit(1).alias("far")).distinct())
    names = nodes.select("task_id").union(edges.select("on")).union(edges.select("task_id")).distinct()
    left, done = written(names.select("task_id", F.lit(0).alias("least"))), []
    while not left.isEmpty():
        # of each task with open dependencies their number and, if it is one, which
        open_ = edges.groupBy("task_id").agg(F.count("*").alias("n"), F.first("on").alias("next"), F.first("far").alias("more"))
        state = written(left.join(_apart(open_), "task_id", "left"))
        free = state.where("n is null")
        if free.isEmpty():
            some = ", ".join(str(r[0]) for r in left.orderBy("task_id").limit(10).collect())
            raise ValueError(f"a cycle among: {some}")
        done.append(free.select("task_id", F.col("least").alias("level")))
        state = state.where("n is not null")
        if state.isEmpty():
            break
        # a task whose only open dependency is settled now stays in the way for a round, since that dependency is gone in the next one
        settled = free.select(F.col("task_id").alias("next"), F.lit(True).alias("settled"))
        short = state.where("n = 1").join(_apart(settled), "next", "left_anti").select(F.col("task_id").alias("on"), "next", "more")
        source = left.select(F.col("task_id").alias("on"), F.col("least").alias("base")).join(_apart(free.select(F.col("task_id").alias("on"), F.lit(True).alias("free"))), "on", "left").join(_apart(short), "on", "left")
        met = edges.join(_apart(source), "on")
        raised = met.where("free or next is not null").groupBy("task_id").agg(F.max(F.col("base") + F.col("far")).alias("new"))
        kept = met.where("free is null and next is null").select("task_id", "on", "far")
        moved = met.where("next is not null").select("task_id", F.col("next").alias("on"), (F.col("far") + F.col("more")).alias("far"))
        edges = written(kept.union(moved).groupBy("task_id", "on").agg(F.max("far").alias("far")))
        left = written(state.select("task_id", "least").join(_apart(raised), "task_id", "left").select("task_id", F.greatest("least", F.coalesce("new", F.lit(0))).alias("least")))
    return reduce(DataFrame.union, done) if done else names.select("task_id", F.lit(0).alias("level"))


def rollup_tree(tree: DataFrame, leaves: DataFrame, depths: DataFrame) -> DataFrame:
    """(task_id, state, exitcode) of all tasks: leaves as given, others from their children, deepest level first.

    `leaves`: task_id, state, exitcode; `depths`: task_id, depth. One aggregation per level.
    """
    nodes = cut(tree.join(depths.select("task_id", "depth"), "task_id").join(leaves, "task_id", "left"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("task_id")).distinct()
    columns = ["task_id", "parent_id", "state", "exitcode"]
    nodes = cut(nodes.join(parents.withColumn("inner", F.lit(True)), "task_id", "left"))
    level = nodes.where(F.col("depth") == deepest).select(*columns)
    out = level
    for depth in range(deepest - 1, -1, -1):
        children = level.groupBy(F.col("parent_id").alias("task_id")).agg(F.min(state_rank(F.col("state"))).alias("rank"), F.max("exitcode").alias("code"))
        here = nodes.where(F.col("depth") == depth).join(children, "task_id", "left")
        level = cut(here.select("task_id", "parent_id", F.when(F.col("inner"), rank_state(F.col("rank"))).otherwise(F.coalesce("state", F.lit("TERMINATED"))).alias("state"), F.when(F.col("inner"), F.col("code")).otherwise(F.coalesce("exitcode", F.when(F.col("state").isNull(), 0))).cast("int").alias("exitcode")))
        out = out.union(level)
    return out.select("task_id", "state", "exitcode")
