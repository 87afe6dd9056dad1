"""Ordered folds as windows, each within one document (conversation, user), so that no order is global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def skipped_levels(df: DataFrame, keys: list[str], order: list[str], level: Column) -> DataFrame:
    """Headings that are not 1 as the first, or that go more than one level deeper than the one before."""
    out = df.withColumn("level", level)
    out = out.withColumn("previous", F.lag("level").over(_w(keys, order)))
    return out.where(F.when(F.col("previous").isNull(), F.col("level") != 1).otherwise(F.col("level") > F.col("previous") + 1))


def forbidden_pairs(df: DataFrame, keys: list[str], order: list[str], column: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose (previous, current) value pair is not allowed; first rows have no pair."""
    out = df.withColumn("previous", F.lag(column).over(_w(keys, order))).where("previous IS NOT NULL")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("previous") == a) & (F.col(column) == b))
    return out.where(~ok)


def separators(df: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, small: float, large: float) -> DataFrame:
    """The separator before each row, by the gap to the end of the row before: newline, space or nothing."""
    out = df.withColumn("gap", start - F.lag(end).over(_w(keys, order)))
    return out.withColumn("separator", F.when(F.col("gap") > large, F.lit("\n")).when(F.col("gap") > small, F.lit(" ")).otherwise(F.lit("")))


def running_offset(df: DataFrame, keys: list[str], order: list[str], size: Column) -> DataFrame:
    """Where each row begins when all rows of a key are laid end to end."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def lengths_from_offsets(df: DataFrame, keys: list[str], order: list[str], offset: str, total: Column) -> DataFrame:
    """The next row's offset less this one's; the last row reaches to the total."""
    return df.withColumn("length", F.coalesce(F.lead(offset).over(_w(keys, order)), total) - F.col(offset))


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str) -> DataFrame:
    """Texts of a key joined in order; blank ones are skipped."""
    kept = df.where(F.trim(F.col(text)) != "")
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return kept.groupBy(*keys).agg(F.concat_ws(separator, F.transform(parts, lambda p: p[text])).alias("joined"))


def unset_before_use(df: DataFrame, keys: list[str], order: list[str], sets: Column, uses: Column) -> DataFrame:
    """Rows that use a state that no row at or before them has set."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("was_set", F.coalesce(F.max(sets).over(w), F.lit(False))).where(uses & ~F.col("was_set"))


def first_offender(df: DataFrame, keys: list[str], place: str, offends: Column) -> DataFrame:
    """The least offending place of each key, or -1."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(offends, F.col(place))), F.lit(-1).cast("bigint")).alias("first_offender"))
