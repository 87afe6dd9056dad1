"""Connected components by alternating large and small stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import in_files, persisted

MAX_ROUNDS = 100


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    over = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component), the least node of its component, for every node of a link but the roots'
    own links. Nulls are ignored; an empty input gives an empty result. Rounds grow with the logarithm of the longest
    path; a hub's links are split among tasks by adaptive skew joins, and counts are combined before they move. No round
    has more links than the one before, so its count tells how many files it takes."""
    now = persisted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        now = persisted(in_files(_small(_large(now).distinct()).distinct(), mark[0]), "stars")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return in_files(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own), 2 * mark[0])
