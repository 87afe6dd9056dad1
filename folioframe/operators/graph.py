"""Reachability, inheritance and cycles over edges (doc, src, dst), by rounds of joins on the frontier alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.runtime import written


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(doc, node, depth) of all nodes reachable from the roots (doc, node); depth is the least number of edges.

    Semi-naive: a round joins only the nodes found last, drops those seen before and writes what is new, so cycles end
    and lineage stays short. Edges are given once, partitioned by (doc, src).
    """
    frontier = written(roots.select("doc", "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_rounds):
        step = frontier.join(edges.select("doc", F.col("src").alias("node"), "dst"), ["doc", "node"]).select("doc", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, ["doc", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.head(1):
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("reachability did not end")


def inherited(nodes: DataFrame, value: str, max_rounds: int = 1000) -> DataFrame:
    """nodes (doc, node, parent, value): each node with its own value or its nearest ancestor's.

    Pointer doubling: a node without a value takes its parent's value and grandparent, so rounds grow with the logarithm
    of the depth; parents in a cycle without any value end with null.
    """
    now = nodes.select("doc", "node", "parent", F.col(value).alias("value"))
    for _ in range(max_rounds):
        open_ = now.where("value IS NULL AND parent IS NOT NULL")
        if not open_.head(1):
            break
        up = now.select("doc", F.col("node").alias("parent"), F.col("value").alias("up_value"), F.col("parent").alias("up_parent"))
        next_ = written(now.join(up, ["doc", "parent"], "left").select("doc", "node", F.when(F.col("value").isNull(), F.col("up_parent")).otherwise(F.col("parent")).alias("parent"), F.coalesce("value", "up_value").alias("value")))
        same = next_.join(now, ["doc", "node"]).where(~next_["parent"].eqNullSafe(now["parent"]) | ~next_["value"].eqNullSafe(now["value"]))
        now = next_
        if not same.head(1):
            break
    return now.select("doc", "node", F.col("value").alias(value))


def _doubled(jump: DataFrame) -> DataFrame:
    """A function (doc, src, dst) applied more often than a document has nodes: pointer doubling, rounds by the logarithm
    of the largest document. Where a node has no row, the chain has left the function."""
    size = jump.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(size).bit_length()):
        nxt = jump.select("doc", F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = written(jump.join(nxt, ["doc", "dst"]).select("doc", "src", F.col("far").alias("dst")))
    return jump


def on_cycles(edges: DataFrame) -> DataFrame:
    """Sources of a functional graph (doc, src, dst: one dst a src) whose chain never ends: they lie on a cycle or lead
    into one."""
    return _doubled(edges.select("doc", "src", "dst")).select("doc", "src").distinct()


def closure(edges: DataFrame, stop: DataFrame) -> DataFrame:
    """(doc, src, final): where a chain of mappings (one dst a src) first meets a standard name (stop: name) after its
    start, or a dead end; null where it never ends."""
    known = stop.select(F.col("name").alias("dst"))
    first = edges.select("doc", "src", "dst")
    # The rest of a chain stays where it is: at standard names and at names that map to nothing.
    ends = first.select("doc", "dst").distinct()
    ends = ends.join(known, "dst", "left_semi").unionByName(ends.join(first.select("doc", F.col("src").alias("dst")), ["doc", "dst"], "left_anti")).distinct()
    ends = written(ends.select("doc", F.col("dst").alias("src")))
    moves = first.join(ends, ["doc", "src"], "left_anti")
    steps = moves.unionByName(ends.select("doc", "src", F.col("src").alias("dst")))
    last = _doubled(written(steps)).select("doc", F.col("src").alias("dst"), F.col("dst").alias("final"))
    last = last.join(ends.select("doc", F.col("src").alias("final")), ["doc", "final"], "left_semi")
    return first.join(last, ["doc", "dst"], "left").select("doc", "src", "final")


def preorder(nodes: DataFrame) -> DataFrame:
    """nodes (doc, node, parent, ord): (doc, node, pos), the place of each node in preorder, for trees of a modest depth."""
    paths = nodes.where("parent IS NULL").select("doc", "node", F.array("ord").alias("path"))
    out = frontier = written(paths)
    while True:
        kids = nodes.select("doc", F.col("parent").alias("p"), F.col("node").alias("kid"), "ord")
        frontier = written(frontier.join(kids, (frontier["doc"] == kids["doc"]) & (frontier["node"] == kids["p"])).select(frontier["doc"], F.col("kid").alias("node"), F.concat("path", F.array("ord")).alias("path")))
        if not frontier.head(1):
            break
        out = out.unionByName(frontier)
    return out.select("doc", "node", F.row_number().over(Window.partitionBy("doc").orderBy("path")).alias("pos"))
