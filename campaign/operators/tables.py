"""Result tables: merging, pivoting, numbering, comparing and looking up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: Columns of the grid on which match_within joins.
GRID_COLUMNS = 3


def numbered(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in a global order, without a single-task window.

    The rows are sorted by ranges and written once, with their range and their place in it, to the shared folder; the
    counts of the ranges, one row each, give the offsets. Rows and counts are read from the same files, so a range
    means the same rows on both sides, however often and on whichever executor a task runs.
    """
    folder = new_folder(df.sparkSession, "numbered")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("range"), place.alias("place")).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "range").select("row.*", (F.col("before") + F.col("place")).alias(name))


def subset(df: DataFrame, test: Column) -> DataFrame:
    return df.where(test)


def conditions_and_range(df: DataFrame, equal: dict, x: str, low, high) -> DataFrame:
    """Rows equal to the given values with x in the closed range, by x."""
    tests = [F.col(c) == v for c, v in equal.items()] + [F.col(x).between(low, high)]
    return df.where(reduce(lambda a, b: a & b, tests)).orderBy(x)


def match_within(df: DataFrame, targets: DataFrame, key: str, pairs: dict[str, str], tolerance: float = 1e-8) -> DataFrame:
    """(key, matches): how many rows lie within the tolerance of each target in all pairs (column -> target column).

    Rows and targets meet on the cells of a grid over all columns, as wide as the tolerance times two: each row is in its own cell and each
    target in its neighbours as well, three for each column, so this is an equi-join that a column of equal values does not skew. Beyond
    GRID_COLUMNS pairs the others are only compared.
    """
    width = 2 * tolerance
    cell = lambda c: F.floor(F.col(c) / width)
    near, rows, on = targets, df, []
    for k, (c, t) in enumerate(list(pairs.items())[:GRID_COLUMNS]):
        near = near.withColumn(f"cell{k}_", F.explode(F.array(*(cell(t) + j for j in (-1, 0, 1)))))
        rows = rows.withColumn(f"cell{k}_", cell(c))
        on.append(f"cell{k}_")
    close = [F.abs(F.col(c) - F.col(t)) < tolerance for c, t in pairs.items()]
    hits = near.join(rows, on).where(reduce(lambda a, b: a & b, close)).groupBy(key).agg(F.count("*").alias("matches"))
    return targets.join(hits, key, "left").select(key, F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))


def row_slice(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first..last - 1 of a numbered table."""
    return df.where(F.col("row_idx").between(first, last - 1))


def keep(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns first, the others as they were."""
    return df.select(*first, *(c for c in df.columns if c not in first))


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def empty_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def derive_moments(df: DataFrame, mean: str, low: str, high: str) -> DataFrame:
    """The fourth power, the spread and twice the value."""
    return df.withColumns({f"{mean}_pow4": F.pow(F.col(mean), 4), "spread": F.col(high) - F.col(low), f"{mean}_double": 2 * F.col(mean)})


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose values are all there and not zero."""
    return df.dropna(subset=list(columns)).where(reduce(lambda a, b: a & b, (F.col(c) != 0 for c in columns)))


def _duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a unique key with _merge: 1 left only, 2 right only, 3 both. By key.

    Repeated keys raise when the rows are computed; other columns must not clash. Null keys never match.
    """
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    sides = [(left, 1), (right, 2)]
    # one grouping instead of a uniqueness check and a join: a side that has a key twice is found here
    every = list(dict.fromkeys([*left.columns, *right.columns]))
    tagged = [df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in every), F.lit(bit).alias("bit_")) for (df, bit), (other, _) in zip(sides, reversed(sides), strict=True)]
    both = tagged[0].union(tagged[1])
    nulls = both.where(F.col(key).isNull()).withColumnRenamed("bit_", "_merge").select(*every, "_merge")
    rows = both.where(F.col(key).isNotNull()).groupBy(key)
    merged = rows.agg(
        *(F.max(F.when(F.col("bit_") == (1 if c in left.columns else 2), F.col(c))).alias(c) for c in every if c != key),
        F.when(F.count_if(F.col("bit_") == 1) > 1, F.raise_error("key repeats on the left").cast("int")).when(F.count_if(F.col("bit_") == 2) > 1, F.raise_error("key repeats on the right").cast("int")).otherwise(F.bit_or("bit_")).alias("_merge"),
    )
    return merged.select(*every, "_merge").union(nulls).orderBy(key)


def lookup_one_to_one(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Adds a column from a table; a key that is missing or occurs twice on the right raises when computed."""
    found = right.groupBy(key).agg(F.first(column).alias(column), F.count("*").alias("n_"))
    value = F.when(F.col("n_").isNull(), F.raise_error("key is missing")).when(F.col("n_") > 1, F.raise_error("key repeats")).cast(right.schema[column].dataType)
    joined = left.join(found, key, "left")
    return joined.select(*left.columns, F.when(F.col("n_") == 1, F.col(column)).otherwise(value).alias(column))


def wide_merge(long_: DataFrame, key: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """(key, run, value) to one column per run, in one shuffle instead of a join per run."""
    return long_.groupBy(key).agg(*(F.max(F.when(F.col(run) == r, F.col(value))).alias(r) for r in runs))


def concat_columns(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """Numbered tables side by side by row number: one column for each."""
    tagged = [df.select("row_idx", F.lit(name).alias("source_"), F.col(value).alias("v_")) for name, df in tables.items()]
    return wide_merge(reduce(DataFrame.union, tagged), "row_idx", "source_", "v_", list(tables))


def collect_log_columns(log: DataFrame, tasks: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, task_id, row_idx, value) and (task_id, key): of each successful task and wanted key the first column whose name holds the key, from
    logs in long form (task_id, column_no, name, row_idx, value); and the successful tasks and keys without such a column, also where there is no log.

    All keys are matched in one pass, against each column's name once, not each row's.
    """
    ok = tasks.where("returncode = 0").select("task_id").distinct()
    ours = log.join(ok, "task_id", "left_semi")
    names = ours.select("task_id", "column_no", "name").distinct()
    keys = F.array(*map(F.lit, dict.fromkeys(wanted))).cast("array<string>")
    hits = names.select("task_id", "column_no", F.explode(F.filter(keys, lambda k: F.contains("name", k))).alias("key"))
    chosen = hits.groupBy("task_id", "key").agg(F.min("column_no").alias("column_no"))
    missing = ok.select("task_id", F.explode(keys).alias("key")).join(chosen.select("task_id", "key"), ["task_id", "key"], "left_anti")
    return ours.join(chosen, ["task_id", "column_no"]).select("key", "task_id", "row_idx", "value"), missing


def log_tables(collected: DataFrame, most: int = 5000) -> DataFrame:
    """Collected columns as one table by key and row, a column for each task (named by it); left in long form where there are more than `most` tasks, as so many columns cannot be planned."""
    tasks = [r["task_id"] for r in collected.select("task_id").distinct().orderBy("task_id").limit(most + 1).collect()]
    if len(tasks) > most:
        return collected
    return collected.groupBy("key", "row_idx").pivot("task_id", tasks).agg(F.first("value"))


def pair_by_index(params: DataFrame, data: DataFrame, path: str = "path") -> DataFrame:
    """(idx, param, data): parameter files by the first number in their name and data files by the last; null where unmatched."""
    number = lambda at: F.try_element_at(F.regexp_extract_all(F.regexp_extract(path, "[^/]*$", 0), F.lit(r"\d+"), F.lit(0)), F.lit(at)).try_cast("long")
    first = params.select(number(1).alias("idx"), F.col(path).alias("param")).where("idx is not null")
    last = data.select(number(-1).alias("idx"), F.col(path).alias("data")).where("idx is not null").groupBy("idx").agg(F.max("data").alias("data"))
    return first.join(last, "idx", "full")


def with_companion(files: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    """Files for which <name><suffix> exists as well."""
    others = files.where(F.col(path).endswith(suffix)).select(F.substring(path, 1, F.length(path) - len(suffix)).alias(path))
    return files.where(~F.col(path).endswith(suffix)).join(others, path, "left_semi")


def lookup_with_fallback(paths: DataFrame, table: DataFrame, default, path: str = "path", value: str = "value", order: str = "n") -> DataFrame:
    """The value by exact path, else by the last part of the path, else the default. The last of repeated keys counts."""
    known = table.groupBy(F.col(path).alias("key_")).agg(F.max_by(value, order).alias("v_"))
    exact = paths.join(known, F.col(path) == F.col("key_"), "left").drop("key_").withColumnRenamed("v_", "exact_")
    base = exact.withColumn("base_", F.regexp_extract(path, "[^/]*$", 0)).join(known, F.col("base_") == F.col("key_"), "left")
    return base.select(*paths.columns, F.coalesce("exact_", "v_", F.lit(default)).alias(value))


def attach_labels(rows: DataFrame, labels: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Rows with their labels in order, joined by commas; null without any."""
    joined = labels.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, label))), lambda x: x[label]), ",").alias("labels"))
    return rows.join(joined, key, "left")


def append_tables(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both, with the columns of the first; what the second lacks is null."""
    return top.unionByName(bottom.select(*(c for c in bottom.columns if c in top.columns)), allowMissingColumns=True)


def sort_table(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def sort_ids(df: DataFrame, column: str) -> DataFrame:
    """PREFIX.NNN in numeric order, with prefix and seqno as columns."""
    parts = df.withColumns({"prefix": F.substring_index(column, ".", 1), "seqno": F.substring_index(column, ".", -1).try_cast("long")})
    return parts.orderBy("prefix", "seqno")


def assign_ids(new: DataFrame, known: DataFrame, order: list[str], prefix: str, column: str = "id") -> DataFrame:
    """Consecutive ids PREFIX.NNN after the highest in use."""
    highest = known.agg(F.coalesce(F.max(F.substring_index(column, ".", -1).try_cast("long")), F.lit(0).cast("long")).alias("top_"))
    return numbered(new, order).join(F.broadcast(highest)).select(*new.columns, F.concat(F.lit(prefix + "."), F.col("top_") + F.col("row_idx") + 1).alias(column))


def chunk_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Consecutive chunks of n rows, labelled by the number of their first row."""
    return numbered(df, order).withColumn("chunk", (F.floor(F.col("row_idx") / n) * n).cast("long"))


def chunk_columns(columns: list[str], n: int) -> list[list[str]]:
    return [columns[k : k + n] for k in range(0, len(columns), n)]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, event): created, deleted, or modified where the time grew. Paths are unique on each side."""
    joined = old.select("path", F.col("mtime").alias("before")).join(new.select("path", F.col("mtime").alias("after")), "path", "full")
    event = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").when(F.col("after") > F.col("before"), "modified")
    return joined.select("path", event.alias("event")).where("event is not null")


def upsert_tasks(store: DataFrame, writes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest write of each id; ids in one of the tables only stay or come in. Of equal versions a write counts
    before what is stored, and of several writes the one whose JSON text is greatest. `sources.store.TaskStore` does the same in place.
    """
    columns = [c for c in store.columns if c != key]
    every = store.withColumn("late_", F.lit(0)).unionByName(writes.select(*store.columns).withColumn("late_", F.lit(1)))
    newest = every.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "late_", F.to_json(F.struct(*columns)))).alias("r"))
    return newest.select(key, "r.*").select(*store.columns)


def distinct_names(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with where they first occur."""
    return df.groupBy(column).agg(F.min(order).alias("first_at"))


def missing_dependencies(deps: DataFrame, known: DataFrame, name: str = "task_id") -> DataFrame:
    """Names that are depended upon but not listed."""
    return deps.select(F.col("depends_on").alias(name)).distinct().join(known.select(name), name, "left_anti")


def check_exact_count(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with another number of rows than n."""
    return df.groupBy(key).agg(F.count("*").alias("found")).where(F.col("found") != n)
