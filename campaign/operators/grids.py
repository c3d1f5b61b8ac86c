"""Parameter grids: products, ranges, restricted grids, slices and substitutions.

Grids are built from small factor tables by joins; nothing is collected, and filters are put on the
product as soon as their columns are there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matching import checked
from .tables import numbered

#: Values of a range that one row of a plan holds at once.
RANGE_BLOCK = 1 << 16


def parse_range(text: str) -> tuple:
    """(low, high, step) of LOW[:HIGH[:STEP]]; any dot makes all three floats; one number is [x, x + 1)."""
    parts = text.split(":")
    if not 1 <= len(parts) <= 3:
        raise ValueError(text)
    kind = float if "." in text else int
    low = kind(parts[0])
    high = kind(parts[1]) if len(parts) > 1 else low + 1
    step = kind(parts[2]) if len(parts) > 2 else kind(1)
    if step == 0:
        raise ValueError("a step of zero")
    return low, high, step


def expand_range(spark: SparkSession, text: str, name: str = "value", closed: bool = False) -> DataFrame:
    """The values of a half-open range, or of one that holds its end; floats are low + i * step."""
    low, high, step = parse_range(text)
    if isinstance(low, int):
        end = high + (1 if step > 0 else -1) * closed
        return spark.range(low, end, step).select(F.col("id").alias(name))
    count = max(0, int((high - low) / step) + 2)
    value = F.lit(low) + F.col("id") * F.lit(step)
    inside = (value <= high if closed else value < high) if step > 0 else (value >= high if closed else value > high)
    return spark.range(count).where(inside).select(value.alias(name))


def expand_ranges(df: DataFrame, low: str, high: str, step: str, name: str = "value", block: int = RANGE_BLOCK) -> DataFrame:
    """Half-open integer ranges of a table, a row for each value; none where the range is empty or a bound is null. A step of zero raises.

    A range is cut into blocks of so many values, and the blocks of ranges that have several are dealt out anew: one range may
    have more values than an array or a task can hold.
    """
    by = F.when(F.col(step) == 0, F.raise_error(F.lit("a step of zero")).cast("long")).otherwise(F.col(step).cast("long"))
    rest = [c for c in df.columns if c != name]
    ends = df.select(F.struct(*rest).alias("row"), F.col(low).cast("long").alias("low"), F.col(high).cast("long").alias("high"), by.alias("by"))
    sized = ends.withColumn("size", F.expr("greatest(0, if(by > 0, (high - low + by - 1) div by, (low - high - by - 1) div -by))")).where("size > 0").drop("high")
    whole, large = sized.where(F.col("size") <= block).withColumn("at", F.lit(0).cast("long")), sized.where(F.col("size") > block)
    dealt = large.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))).repartition(F.xxhash64("low", "at"))
    values = F.sequence(F.col("at"), F.least(F.col("at") + block, F.col("size")) - 1)
    return whole.unionByName(dealt).select("row", "low", "by", F.explode(values).alias("k")).select("row.*", (F.col("low") + F.col("k") * F.col("by")).alias(name))


def expand_grid(factors: list[DataFrame], valid: Column | None = None) -> DataFrame:
    """The product of factor tables, limited to valid combinations; Spark pushes the parts of the test to the factors."""
    grid = reduce(DataFrame.crossJoin, factors)
    return grid.where(valid) if valid is not None else grid


def expand_dependent_grid(outer: DataFrame, inner: DataFrame, fits: Column) -> DataFrame:
    """Inner values that see the outer ones."""
    return outer.join(checked(inner), fits)


def index_grid(spark: SparkSession, base: list[int], restriction: str = "none", direction: str = "rowwise") -> DataFrame:
    """(i0, i1, ..): index tuples of a nested loop with n, their number in the loop's order.

    `lowertr` keeps tuples with some index below the next one, `diag` equal indices up to the shortest side.
    """
    names = [f"i{k}" for k in range(len(base))]
    if restriction in ("diag", "diagnol"):
        return spark.range(min(base)).select(*(F.col("id").alias(n) for n in names), F.col("id").alias("n"))
    grid = reduce(DataFrame.crossJoin, (spark.range(size).select(F.col("id").alias(n)) for n, size in zip(names, base, strict=True)))
    weights = {}
    size = 1
    for n, b in reversed(list(zip(names, base, strict=True))) if direction == "rowwise" else zip(names, base, strict=True):
        weights[n], size = size, size * b
    place = reduce(lambda a, b: a + b, (F.col(n) * w for n, w in weights.items()))
    if restriction == "lowertr":
        grid = grid.where(reduce(lambda a, b: a | b, (F.col(a) < F.col(b) for a, b in zip(names[:-1], names[1:], strict=True))))
    elif restriction != "none":
        raise ValueError(restriction)
    return grid.withColumn("n", place)


def grouped_grid(spark: SparkSession, groups: dict[int, dict[str, list[str]]], restrictions: dict[int, str] | None = None) -> DataFrame:
    """(run_no, run, one column per variable): a restricted grid inside each group, all combinations between groups.

    The variable of group -1 follows the run number and then stays on its last value; the run's name is
    made from the variables of the other groups.
    """
    restrictions = restrictions or {}
    parts, weight = [], 1
    for g in sorted((k for k in groups if k >= 0), reverse=True):
        variables = groups[g]
        grid = index_grid(spark, [len(v) for v in variables.values()], restrictions.get(g, "none"))
        width = reduce(lambda a, b: a * b, (len(v) for v in variables.values()))
        values = [F.get(F.array(*map(F.lit, v)), F.col(f"i{k}").cast("int")).alias(name) for k, (name, v) in enumerate(variables.items())]
        parts.insert(0, grid.select(*values, (F.col("n") * weight).alias(f"n{g}_")))
        weight *= width
    grid = reduce(DataFrame.crossJoin, parts)
    names = [n for g in sorted(groups) if g >= 0 for n in groups[g]]
    place = reduce(lambda a, b: a + b, (F.col(c) for c in grid.columns if c.endswith("_")))
    if restrictions:  # which leave gaps in the loop's numbers
        grid = numbered(grid.select(*names, place.alias("place_")), ["place_"], "run_no")
    else:
        grid = grid.select(*names, place.cast("long").alias("run_no"))
    out = grid.select(*names, "run_no")
    out = out.withColumn("run", F.concat(F.lit("para_"), F.concat_ws("_", *(F.concat(F.lit(n + "="), n) for n in names))))
    for name, values in groups.get(-1, {}).items():
        out = out.withColumn(name, F.get(F.array(*map(F.lit, values)), F.least(F.col("run_no"), F.lit(len(values) - 1)).cast("int")))
    return out


def remap_groups(df: DataFrame, group: str, key: str | None = None) -> DataFrame:
    """Groups renumbered 0, 1, 2.. in order; the distinct groups alone are ranked."""
    keys = [key] if key else []
    distinct = df.select(*keys, group).distinct()
    if key:
        ranked = distinct.withColumn("new_group", F.row_number().over(Window.partitionBy(key).orderBy(group)) - 1)
    else:
        ranked = numbered(distinct, [group], "new_group").withColumn("new_group", F.col("new_group").cast("int"))
    return df.join(checked(ranked), [*keys, group])


def slice_range(spark: SparkSession, low: int, high: int, step: int, chunk: int) -> DataFrame:
    """[low, high) in steps, with the start of the chunk of `chunk` steps."""
    return spark.range(low, high, step).select(F.col("id").alias("value"), (low + F.floor((F.col("id") - low) / (step * chunk)) * (step * chunk)).cast("long").alias("chunk"))


def split_total(df: DataFrame, total: str, k: int) -> DataFrame:
    """A total in parts of k and the remainder: part and size."""
    n = F.ceil(F.col(total) / k).cast("long")
    parts = df.where(F.col(total) > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return parts.withColumn("size", F.least(F.lit(k).cast("long"), F.col(total) - F.col("part") * k))


def slices_with_last(df: DataFrame, total: str, k: int) -> DataFrame:
    """start and end of slices of k, end inclusive: least(start + k - 1, total)."""
    starts = df.where(F.col(total) > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1, F.lit(k).cast("long"))))
    return starts.withColumn("end", F.least(F.col("start") + k - 1, F.col(total)))


def replicate_seeds(models: DataFrame, model: str, repeats: int, salt: int = 0) -> DataFrame:
    """model x repeat with a seed that depends on both and the salt alone: 31 bits of their MD5 sum, which is the same everywhere."""
    seed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(model).cast("string"), F.col("repeat").cast("string"), F.lit(str(salt))).cast("binary")), 1, 8), 16, 10).cast("long")
    return models.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("seed", F.pmod(seed, F.lit(2**31)))


def select_models(models: DataFrame, column: str, text: str) -> DataFrame:
    """Models of `a:b` (half-open), `a,b,c` or `a`."""
    if ":" in text:
        low, high, step = parse_range(text)
        test = (F.col(column) >= low) & (F.col(column) < high) & ((F.col(column) - low) % step == 0)
    else:
        test = F.col(column).isin([int(x) for x in text.split(",")])
    return models.where(test)


def parse_value_list(text: Column) -> Column:
    """Rows of numbers: `linspace(a,b,n)` within comma lists, rows parted by semicolons."""
    space = r"^\s*linspace\(\s*([-0-9.eE+]+)\s*,\s*([-0-9.eE+]+)\s*,\s*(\d+)\s*\)\s*$"

    def item(x: Column) -> Column:
        number = lambda k: F.regexp_extract(x, space, k).try_cast("double")
        n = F.regexp_extract(x, space, 3).try_cast("int")
        step = F.coalesce(F.try_divide(number(2) - number(1), (n - 1).cast("double")), F.lit(0.0))
        points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(1) + i * step)
        return F.when(x.rlike(space), points).otherwise(F.array(F.trim(x).try_cast("double")))

    cells = lambda row: F.regexp_extract_all(row, F.lit(r"linspace\([^)]*\)|[^,]+"), F.lit(0))
    return F.transform(F.split(text, ";"), lambda row: F.flatten(F.transform(cells(row), item)))


def apply_substitutions(lines: DataFrame, substitutions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(lines, not found): lines `name = value` or `name value` of parameter files with new values for the named variables.

    `lines`: key, n, line; `substitutions`: key, name, value. Blank lines go.
    """
    pattern = r"^(\s*)([A-Za-z_]\w*)(\s*=\s*|\s+)(.*?)\s*$"
    named = lines.where(F.trim("line") != "").withColumn("name", F.regexp_extract("line", pattern, 2))
    joined = named.join(substitutions, [key, "name"], "left")
    new = F.concat(F.regexp_extract("line", pattern, 1), "name", F.regexp_extract("line", pattern, 3), "value")
    missing = substitutions.join(named.select(key, "name"), [key, "name"], "left_anti").select(key, "name")
    return joined.select(key, "n", F.coalesce(new, "line").alias("line")), missing


def unscheduled_range(spark: SparkSession, scheduled: DataFrame, total: int, k: int) -> DataFrame:
    """(start, end): slices of k of what is left of 0..total after the highest scheduled end; end exclusive. Slices are made by tasks, however many there are."""
    top = scheduled.agg(F.coalesce(F.max("end"), F.lit(0).cast("long"))).first()[0]
    starts = spark.range(top, total, k) if top < total else spark.range(0)
    return starts.select(F.col("id").alias("start"), F.least(F.col("id") + k, F.lit(total).cast("long")).alias("end"))


def scheduled_range_total(names: DataFrame, column: str) -> DataFrame:
    """(total,): the sum of end - start over names `start--end`."""
    part = lambda k: F.split_part(column, F.lit("--"), F.lit(k)).try_cast("long")
    return names.agg(F.sum(part(2) - part(1)).alias("total"))


def max_iteration(names: DataFrame, column: str) -> DataFrame:
    """(run, iteration, n): the highest number after # per run name, and how many there are."""
    part = lambda k: F.split_part(column, F.lit("#"), F.lit(k))
    return names.groupBy(part(1).alias("run")).agg(F.max(part(2).try_cast("long")).alias("iteration"), F.count("*").alias("n"))


def generation_progress(files: DataFrame, column: str) -> DataFrame:
    """(files, highest): generation files and the highest generation."""
    number = F.nullif(F.regexp_extract(column, r"generation\.?(\d+)", 1), F.lit("")).try_cast("long")
    return files.select(number.alias("g")).where("g is not null").agg(F.count("*").alias("files"), F.max("g").alias("highest"))


def check_group_restrictions(params: DataFrame) -> DataFrame:
    """(group, problem): groups with several restrictions, or with lowertr on one variable that is no switch."""
    agg = params.groupBy("group").agg(F.count_distinct(F.lower("restriction")).alias("kinds"), F.min(F.lower("restriction")).alias("first"), F.count_if(F.col("property") != "swIndicator").alias("n"))
    problem = F.when(F.col("kinds") != 1, "inconsistent").when((F.col("first") == "lowertr") & (F.col("n") == 1), "lowertr on one variable")
    return agg.select("group", problem.alias("problem")).where("problem is not null")
