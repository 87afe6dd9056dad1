"""Reconciling two validators' verdicts: pairs, confusion, clause coverage, leverage and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sides(reference: DataFrame, engine: DataFrame, key: str) -> DataFrame:
    """Full outer join on the key with the side that each row was found on."""
    a, b = reference.withColumn("__a", F.lit(1)), engine.withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side).drop("__a", "__b")


def percent(part: Column, whole: Column) -> Column:
    """Half-even rounded percentage; of nothing, 100."""
    return F.when(whole == 0, F.lit(100)).otherwise(F.bround(100.0 * part / whole, 0)).cast("int")


def confusion(df: DataFrame, keys: list[str], reference: Column, engine: Column) -> DataFrame:
    """Counts of the four outcomes and the agreement in percent, by key."""
    counted = df.groupBy(*keys).agg(
        F.count_if(reference & engine).alias("both_pass"),
        F.count_if(~reference & ~engine).alias("both_fail"),
        F.count_if(~reference & engine).alias("missed"),
        F.count_if(reference & ~engine).alias("false_alarm"),
    )
    whole = F.col("both_pass") + F.col("both_fail") + F.col("missed") + F.col("false_alarm")
    return counted.withColumn("agreement", percent(F.col("both_pass") + F.col("both_fail"), whole))


def coverage(df: DataFrame, clause: str, matched: Column) -> DataFrame:
    """Per clause: total, matched, percent and whether it is matched in full, in part or not at all."""
    tallied = df.groupBy(clause).agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"))
    status = F.when(F.col("matched") == F.col("total"), "full").when(F.col("matched") == 0, "none").otherwise("partial")
    return tallied.withColumn("percent", percent(F.col("matched"), F.col("total"))).withColumn("status", status)


def leverage(df: DataFrame, expected: str, found: str) -> DataFrame:
    """How many sets miss a clause (appears), and how many miss nothing else or in which fixing it would do (flips: the
    set misses it at all), ranked. df: a row a file with two arrays."""
    missing = df.select(F.array_distinct(F.array_except(expected, found)).alias("gap"))
    each = missing.select(F.explode("gap").alias("clause"), (F.size("gap") == 1).alias("alone"))
    counted = each.groupBy("clause").agg(F.count("*").alias("appears"), F.count_if("alone").alias("alone"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.col("appears").desc(), "clause")))


def top_gaps(df: DataFrame, gap: str, key: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.col(gap).desc(), key).limit(k)
