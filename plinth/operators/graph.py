"""Bounded traversal of the dependency graph.

Each level joins the edges with the frontier alone, the nodes that the level before reached
first; it is stored, and a traversal ends as soon as nothing new is reached.  Depth is at most
five.  Edges are a table, which costs a pass a level, or a stored
:class:`plinth.sources.adjacency.Adjacency`, of which a level reads the buckets of its frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UNAVAILABLE_GRADE, UNKNOWN, PlinthError
from ..scratch import store
from ..sources.adjacency import Adjacency

Edges = DataFrame | Adjacency

MAX_DEPTH = 5
_PATH = "array<struct<relation:string,target_id:string,source_id:string,producer:string>>"


def check_depth(depth: int) -> None:
    if isinstance(depth, bool) or not isinstance(depth, int) or not 0 <= depth <= MAX_DEPTH:
        raise PlinthError(UNKNOWN, f"depth must be 0..{MAX_DEPTH}")


def require_elaborated(producer_kind: str) -> None:
    if producer_kind == "lexical_only":
        raise PlinthError(UNAVAILABLE_GRADE, "the graph has no elaborated edges")


def leaving(edges: Edges, frontier: DataFrame, *, reverse: bool = False) -> DataFrame:
    """The edges at the nodes of a frontier, with the columns of both."""
    if isinstance(edges, Adjacency):
        return edges.leaving(frontier, reverse=reverse)
    return edges.join(frontier, F.col("target_id" if reverse else "source_id") == F.col("node"))


def distances(edges: Edges, start: str, depth: int, *, reverse: bool = False) -> DataFrame:
    """node, dist of all nodes within ``depth`` edges of the start (itself at 0)."""
    check_depth(depth)
    spark = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    near = frontier = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("dist"))
    for k in range(1, depth + 1):
        met = leaving(edges, frontier.select("node"), reverse=reverse)
        reached = met.select(F.col("source_id" if reverse else "target_id").alias("node")).distinct()
        frontier = store(reached.join(near.select("node"), "node", "left_anti").withColumn("dist", F.lit(k)), "level")
        if frontier.isEmpty():
            break
        near = near.unionAll(frontier)
    return near


def dependencies(edges: Edges, start: str, depth: int = 1, *, reverse: bool = False) -> DataFrame:
    """Every edge that leaves a node nearer than ``depth``, once, with its 1-based depth.

    Edges into nodes already reached are emitted too.  Depth 0 gives no edges.
    """
    check_depth(depth)
    if depth == 0:
        whole = edges.edges if isinstance(edges, Adjacency) else edges
        return whole.withColumn("depth", F.lit(0)).where("false")
    near = distances(edges, start, depth - 1, reverse=reverse)
    return leaving(edges, near, reverse=reverse).withColumn("depth", F.col("dist") + 1).select(*edges.columns, "depth")


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("depth", "relation", "target_id", "source_id", "producer")


def shortest_path(edges: Edges, source: str, target: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row: found, hops and the path as an array of edges.

    Of the shortest paths it is the one whose edge keys (relation, target, source, producer)
    come first; a level keeps the least path of each node it reaches first, so rows never
    multiply.
    """
    check_depth(max_depth)
    spark = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    frontier = spark.range(1).select(F.lit(source).alias("node"), F.array().cast(_PATH).alias("path"))
    met, seen = frontier.where(F.col("node") == target), frontier.select("node")
    for _ in range(0 if source == target else max_depth):
        longer = F.concat("path", F.array(F.struct("relation", "target_id", "source_id", "producer")))
        steps = leaving(edges, frontier).select(F.col("target_id").alias("next"), longer.alias("path"))
        reached = steps.groupBy(F.col("next").alias("node")).agg(F.min("path").alias("path"))
        frontier = store(reached.join(seen, "node", "left_anti"), "level")
        met = frontier.where(F.col("node") == target)
        if not met.isEmpty() or frontier.isEmpty():
            break
        seen = seen.unionAll(frontier.select("node"))
    best = met.agg(F.first("path").alias("path"))
    found = F.col("path").isNotNull()
    return best.select(found.alias("found"), F.when(found, F.size("path")).alias("hops"), F.coalesce("path", F.array().cast(_PATH)).alias("path"))
