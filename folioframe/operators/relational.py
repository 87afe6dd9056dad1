"""Joins, distinct forms and keyed picks that document rules are made of.

Picks go by aggregates (`max_by`), whose partial results combine before the shuffle, rather than by windows over whole
keys; broadcasts are left to Catalyst's size checks, but for lists of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest `order` of each key; `order` must break all ties."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of least `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def last_wins_collisions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, n_definitions, the last value, and whether a redefinition differs from the one right before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(value)).over(w)
    flagged = df.withColumn("__diff", before.isNotNull() & ~before.eqNullSafe(F.struct(value)))
    return flagged.groupBy(*keys).agg(F.count("*").alias("n_definitions"), F.max_by(value, F.struct(*order)).alias(value), F.bool_or("__diff").alias("collided"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Every row whose key occurs more than once. The counts combine before the shuffle; rows join only repeated keys."""
    keyed = df.withColumn("__key", key)
    often = keyed.groupBy("__key").agg(F.count("*").alias("n_same")).where("n_same > 1")
    return keyed.join(often, "__key").drop("__key")


def inconsistent(df: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Keys with more than one distinct signature, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*signature)).alias("n_signatures")).where("n_signatures > 1")


def mixed(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Keys that have a row of either kind."""
    both = df.groupBy(*keys).agg(F.bool_or(a).alias("__a"), F.bool_or(b).alias("__b"))
    return both.where("__a AND __b").select(*keys)


def not_listed(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose value is not in the list; null values are kept."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def listed(df: DataFrame, column: str, denied: list) -> DataFrame:
    return df.where(F.col(column).isin(denied))


def not_exactly_one(parents: DataFrame, children: DataFrame, on: Column, parent_key: str, matches: Column) -> DataFrame:
    """Parents that do not have exactly one matching child, and how many they have (zero included)."""
    joined = parents.join(children.where(matches), on, "left")
    child = children.columns[0]
    return joined.groupBy(parent_key).agg(F.count(child).alias("n_matches")).where("n_matches <> 1")


def first_match(df: DataFrame, key: str, lookups: list[tuple[DataFrame, Column]], pick: list[str], order: list[str]) -> DataFrame:
    """An OR-join as a union of equi-joins: for each row of df the least match over all lookups, null without one."""
    found = None
    for rank, (side, on) in enumerate(lookups):
        m = df.join(side, on).select(df[key], F.struct(F.lit(rank).alias("__rank"), *[side[c].alias(c) for c in order], *[side[c].alias(f"__{c}") for c in pick]).alias("__m"))
        found = m if found is None else found.unionByName(m)
    best = found.groupBy(key).agg(F.min("__m").alias("__m"))
    return df.join(best, key, "left").select(*[df[c] for c in df.columns], *[F.col("__m")[f"__{c}"].alias(c) for c in pick])


def asof_backward(probe: DataFrame, labels: DataFrame, time: str, label_time: str, label: str, key: str | None = None, buckets: int = 64) -> DataFrame:
    """Each probe row with the label of greatest label_time at or before its time (null: none).

    Both sides are one sequence over which the last label is carried on. Without a key the sequence is cut into ranges
    of time that are scanned side by side; a range's first probes take the last label of all ranges before it, from a
    table of one row a range.
    """
    marks = labels.groupBy(*([key] if key else []), label_time).agg(F.max(label).alias(label))
    p = probe.withColumn("__t", F.col(time)).withColumn("__kind", F.lit(1)).withColumn("__label", F.lit(None).cast(marks.schema[label].dataType))
    m = marks.select(F.col(label_time).alias("__t"), F.lit(0).alias("__kind"), F.col(label).alias("__label"), *([F.col(key)] if key else []))
    both = p.unionByName(m, allowMissingColumns=True)
    if key:
        w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(label, F.last("__label", True).over(w)).where("__kind = 1").drop("__t", "__kind", "__label")
    bounds = cut_points(both.select("__t"), "__t", buckets)
    both = both.withColumn("__b", range_number(F.col("__t"), bounds))
    w = Window.partitionBy("__b").orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    scanned = both.withColumn("__here", F.last("__label", True).over(w))
    last = both.where("__kind = 0").groupBy("__b").agg(F.max_by("__label", "__t").alias("__l"))
    spine = both.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__b")).join(last, "__b", "left")
    carried = spine.withColumn("__carried", F.last("__l", True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", "__carried")
    out = scanned.where("__kind = 1").join(F.broadcast(carried), "__b", "left")
    return out.withColumn(label, F.coalesce("__here", "__carried")).drop("__t", "__kind", "__label", "__b", "__here", "__carried")


def cut_points(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 values that cut a column into ranges of about the same number of rows."""
    kind = df.schema[column].dataType.typeName()
    number = F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)
    row = df.agg(F.percentile_approx(number, [i / buckets for i in range(1, buckets)], 1000).alias("p")).first()
    values = sorted(set(row.p or []))
    if kind.startswith("timestamp"):
        return [F.timestamp_micros(F.lit(v)).cast(kind) for v in values]
    return [F.lit(v) for v in values]


def range_number(column: Column, bounds: list) -> Column:
    """How many bounds a value has reached: 0 for those below the first, nulls too."""
    out = F.lit(0)
    for i, b in enumerate(bounds):
        out = F.when(column >= b, F.lit(i + 1)).otherwise(out)
    return out


def explode_ranges(ranges: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each integer of each range, so that a range join becomes an equi-join."""
    return ranges.withColumn(name, F.explode(F.sequence(start, end)))


def best_match(left: DataFrame, right: DataFrame, left_on: Column, right_on: Column, left_key: str, score: Column, order: list[str], pick: list[str]) -> DataFrame:
    """For each left row the right row of highest score among those of its join value, ties by `order`; rows without a
    match are left out. The score is of right columns, so that each join value keeps its best row before the join."""
    rank = F.struct((-score).alias("s"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    best = right.groupBy(right_on.alias("__on")).agg(F.min_by(F.struct(rank.alias("r"), F.struct(*pick).alias("m"), score.alias("score")), rank).alias("b"))
    joined = left.select(left_key, left_on.alias("__on")).join(best, "__on")
    best = joined.groupBy(left_key).agg(F.min_by("b", "b.r").alias("b"))
    return best.select(left_key, *[F.col("b")["m"][c].alias(c) for c in pick], F.col("b")["score"].alias("score"))


def numbered(df: DataFrame, key: str, name: str, first: Column | int = 1, buckets: int = 64) -> DataFrame:
    """Consecutive numbers in ascending order of a unique key, without gathering all rows in one task: rows are numbered
    within ranges of the key, and each range starts after the counts of those before it."""
    bounds = cut_points(df.select(key), key, buckets)
    cut = df.withColumn("__b", range_number(F.col(key), bounds))
    counts = cut.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__b", before.alias("__base"))
    start = F.lit(first) if isinstance(first, int) else first
    own = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return cut.withColumn("__own", own).join(F.broadcast(base), "__b").withColumn(name, (start + F.col("__base") + F.col("__own") - 1).cast("bigint")).drop("__b", "__own", "__base")


def merge_without_collisions(a: DataFrame, b: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Both inputs; the second and later rows of a name get a suffix `_2`, `_3`, ..."""
    both = a.unionByName(b)
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return both.withColumn("new_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), nth.cast("string"))))
