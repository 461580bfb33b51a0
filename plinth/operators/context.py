"""Context: the chunks of a declaration and its dependency cone within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .binding import node_to_chunk
from .graph import dependencies, distances
from .resolve import one

DEFAULT_BUDGET = 4000
ESTIMATE = "ceil(chars/4)"


def within_budget(rows: DataFrame, budget: int, *order: str, length="text") -> DataFrame:
    """The longest prefix of the rows in order whose texts fit the budget.

    The running sum only grows, so a filter equals stopping at the first that overflows.  A
    chunk has a character at least, so a top-k bounds the rows that the sum runs over, however
    large the cone is.
    """
    first = rows.orderBy(*order).limit(4 * max(0, budget) + 1)
    running = F.sum(F.length(length)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("chars", running).where(token_estimate(F.col("chars")) <= budget)


def cone_chunks(nodes: DataFrame, edges: DataFrame, sources: DataFrame, start: str, depth: int) -> DataFrame:
    """The chunk of each node of the cone that has one, with the node's distance."""
    near = distances(edges, start, depth)
    cone = nodes.join(near.select(F.col("node").alias("id"), F.col("dist").alias("distance")), "id")
    chunk = node_to_chunk(cone.select(*nodes.columns), sources).where("chunk_id is not null").drop("tier")
    at = sources.select(F.col("id").alias("chunk_id"), "source_revision", "source_path", "source_start_line", "source_end_line", "declaration_hint", "text")
    return chunk.join(cone.select("id", "distance"), "id").join(at, "chunk_id").withColumnRenamed("id", "declaration_id")


def context(nodes: DataFrame, edges: DataFrame, sources: DataFrame, name: str, *, depth: int = 1, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Chunks by distance, path, line and id, with the running character count.

    The cone starts at what the graph's rules resolve the name to.
    """
    rows = cone_chunks(nodes, edges, sources, one(nodes, name), depth)
    return within_budget(rows, budget, "distance", "source_path", "source_start_line", "declaration_id")


def context_envelope(nodes: DataFrame, edges: DataFrame, sources: DataFrame, name: str, *, depth: int = 1, budget: int = DEFAULT_BUDGET, roots: list[str], boundary: str = "internal_only") -> DataFrame:
    """One row: the query and its target, chunks and graph edges in order, the estimate of the
    chunks' tokens and the scope.

    Target and distances follow the search's rules for names, edges the graph's.
    """
    start, target = one(nodes, name), one(nodes, name, search=True)
    walked = dependencies(edges, start, depth)
    near = walked.groupBy(F.col("target_id").alias("id")).agg(F.min("depth").alias("distance")).where(F.col("id") != target)
    near = near.unionAll(nodes.sparkSession.range(1).select(F.lit(target).alias("id"), F.lit(0).alias("distance")))
    cone = nodes.join(near, "id")
    chunk = node_to_chunk(cone.select(*nodes.columns), sources).where("chunk_id is not null").drop("tier")
    at = sources.select(F.col("id").alias("chunk_id"), "source_revision", "source_path", "source_start_line", "source_end_line", "declaration_hint", "text")
    rows = chunk.join(near, "id").join(at, "chunk_id").withColumnRenamed("id", "declaration_id")
    fit = within_budget(rows, budget, "distance", "source_path", "source_start_line", "declaration_id")
    order = F.struct("distance", "source_path", "source_start_line", "declaration_id", "source_end_line", "source_revision", "declaration_hint", "text")
    chunks = fit.agg(F.sort_array(F.collect_list(order)).alias("chunks"), F.coalesce(F.max("chars"), F.lit(0)).alias("chars"))
    found = walked.agg(F.sort_array(F.collect_list(F.struct("depth", "relation", "target_id", "source_id", "producer", "evidence_grade"))).alias("graph_edges"))
    return chunks.crossJoin(F.broadcast(found)).select(
        F.lit(name).alias("query"), F.lit(target).alias("target_id"), "chunks", "graph_edges", token_estimate(F.col("chars")).alias("estimated_tokens"), F.lit(ESTIMATE).alias("token_estimate_method"),
        F.array(*[F.lit(r) for r in roots]).alias("scope_root_modules"), F.lit(boundary).alias("dependency_boundary"), F.lit(True).alias("complete_within_scope"),
    )
