"""Raw dependency graph to scoped, deduplicated nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..functions.text import in_scope
from ..schemas import EDGE_KEY, ID_PREFIX, RELATIONS
from ..scratch import sent, store


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scoped_nodes(raw_nodes: DataFrame, roots: list[str], revision: str) -> DataFrame:
    kept = raw_nodes.where(in_scope(F.col("module"), roots))
    none = F.lit(None)
    return kept.select(
        F.concat(F.lit(ID_PREFIX), "fullName").alias("id"), F.col("fullName").alias("full_name"), "name", "kind", "module",
        none.cast("string").alias("source_path"), none.cast("int").alias("source_start_line"), none.cast("int").alias("source_end_line"),
        F.lit(revision).alias("source_revision"),
    )


def _short_names(raw_nodes: DataFrame) -> DataFrame:
    """endpoint, short, n of every short name: the node that it stands for, if one does, and how
    many have it; they are counted and not listed."""
    named = raw_nodes.select(F.col("name").alias("endpoint"), "fullName", (F.col("fullName") == F.concat("module", F.lit("."), "name")).alias("own"))
    per = named.groupBy("endpoint", "fullName").agg(F.max("own").alias("own")).groupBy("endpoint")
    only = lambda c: F.when(F.count_if(c) == 1, F.min(F.when(c, F.col("fullName"))))
    return per.agg(F.coalesce(only(F.lit(True)), only(F.col("own"))).alias("short"), F.count("*").cast("int").alias("n"))


def resolve_endpoints(raw_nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """endpoint, full_name (null if unknown or ambiguous), n_candidates.

    A full name wins; else a short name that one node has; else, of several, the node whose
    full name is its module, a dot and the endpoint.  Equi-joins on the name; the endpoints, of
    which there are far more than nodes, are read once.
    """
    wanted = endpoints.select("endpoint").distinct()
    full = raw_nodes.select(F.col("fullName").alias("endpoint"), F.col("fullName").alias("exact")).distinct()
    met = wanted.join(full, "endpoint", "left").join(_short_names(raw_nodes), "endpoint", "left")
    count = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0)))
    return met.select("endpoint", F.coalesce("exact", "short").alias("full_name"), count.alias("n_candidates"))


def _aliases(raw_nodes: DataFrame, raw_edges: DataFrame, roots: list[str]) -> DataFrame:
    """endpoint, full_name, inside of the edge ends that are not themselves the full name of a node
    in scope; full_name is null for unknown ones."""
    wanted = raw_edges.select(F.explode(F.array("source", "target")).alias("endpoint")).distinct()
    full = raw_nodes.groupBy(F.col("fullName").alias("endpoint")).agg(F.lit(True).alias("exact"), F.min("module").alias("module"))
    inside = F.coalesce(in_scope(F.col("module"), roots), F.lit(False))
    odd = store(wanted.join(full, "endpoint", "left").where(F.col("exact").isNull() | ~inside).select("endpoint", "exact"), "ends")
    asked = sent(odd.where("exact is null").select(F.col("endpoint").alias("name")))
    short = _short_names(raw_nodes.join(asked, "name", "left_semi")).select("endpoint", "short")
    named = store(odd.join(short, "endpoint", "left").select("endpoint", F.when(F.col("exact"), F.col("endpoint")).otherwise(F.col("short")).alias("full_name")), "named")
    modules = full.where(F.col("endpoint").isNotNull()).select(F.col("endpoint").alias("full_name"), "module")
    known = modules.join(sent(named.where("full_name is not null").select("full_name").distinct()), "full_name", "left_semi")
    return store(named.join(known, "full_name", "left").select("endpoint", "full_name", inside.alias("inside")), "aliases")


def scoped_edges(raw_nodes: DataFrame, raw_edges: DataFrame, roots: list[str], producer: str) -> tuple[DataFrame, DataFrame]:
    """The canonical edges, and the raw edges that break a rule (unknown kind or endpoint).

    The raw source is the dependency and the raw target depends on it; canonical edges go
    from the dependent to its dependency.  Only the ends that don't stand for themselves are
    stored and joined, so edges move once, to drop repeated ones.
    """
    aliases = _aliases(raw_nodes, raw_edges, roots)
    lost, odd = sent(aliases.where("full_name is null").select("endpoint")), sent(aliases.where("full_name is not null"))
    kinds = F.create_map(*[x for k, (rel, grade) in RELATIONS.items() for x in (F.lit(k), F.struct(F.lit(rel).alias("relation"), F.lit(grade).alias("grade")))])
    unknown = raw_edges.where(~F.col("kind").isin(*RELATIONS) | F.col("kind").isNull()).select("source", "target", "kind")
    kept = raw_edges.where("source is not null and target is not null").where(F.col("kind").isin(*RELATIONS))
    for c, name in (("source", "dep"), ("target", "own")):
        gone = lost.withColumnRenamed("endpoint", c)
        unknown = unknown.unionAll(raw_edges.join(gone, c, "left_semi").select("source", "target", "kind"))
        side = odd.select(F.col("endpoint").alias(c), F.col("full_name").alias(f"{name}_full"), F.col("inside").alias(f"{name}_in"))
        kept = kept.join(gone, c, "left_anti").join(side, c, "left").where(F.coalesce(f"{name}_in", F.lit(True))).withColumn(f"{name}_name", F.coalesce(f"{name}_full", c))
    # the other columns follow from the kind
    edges = kept.select("own_name", "dep_name", "kind").distinct().withColumn("as", kinds[F.col("kind")]).select(
        F.concat(F.lit(ID_PREFIX), "own_name").alias("source_id"), F.concat(F.lit(ID_PREFIX), "dep_name").alias("target_id"),
        F.col("as.relation").alias("relation"), F.col("as.grade").alias("evidence_grade"), F.lit(producer).alias("producer"),
    )
    return edges, unknown.distinct()


def _blank(*names: str):
    return F.greatest(*[F.coalesce(F.col(n), F.lit("")) == "" for n in names])


def raw_violations(raw_nodes: DataFrame, raw_edges: DataFrame) -> list[str]:
    """What is wrong with the raw relations, by one aggregate over each."""
    n = raw_nodes.agg(F.count_if(_blank("name", "module", "kind", "fullName")).alias("blank"), F.count("fullName").alias("names"), F.countDistinct("fullName").alias("distinct")).first()
    e = raw_edges.agg(F.count_if(_blank("source", "target", "kind")).alias("blank"), F.count_if(~F.col("kind").isin(*RELATIONS)).alias("kinds")).first()
    found = {"a raw node has an empty field": n["blank"], "a full name occurs twice": n["names"] - n["distinct"], "a raw edge has an empty field": e["blank"], "a raw edge is of unknown kind": e["kinds"]}
    return [f"{what} ({count})" for what, count in found.items() if count]


def normalize(raw_nodes: DataFrame, raw_edges: DataFrame, roots: list[str], *, producer: str, revision: str, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges; raises before anything is returned if the raw graph breaks a rule.

    ``ordered`` sorts them by their keys, as canonical members are.
    """
    if broken := raw_violations(raw_nodes, raw_edges):
        raise PlinthError(BLOCKED_ARTIFACT, "; ".join(broken))
    edges, bad = scoped_edges(raw_nodes, raw_edges, roots, producer)
    if (row := bad.first()) is not None:
        raise PlinthError(BLOCKED_ARTIFACT, f"edge can't be resolved: {row['source']} -> {row['target']} ({row['kind']})")
    nodes = scoped_nodes(raw_nodes, roots, revision)
    return (nodes.orderBy("id"), edges.orderBy(*EDGE_KEY)) if ordered else (nodes, edges)
