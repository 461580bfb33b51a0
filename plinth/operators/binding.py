"""Binding nodes to source chunks, and lexical hits to declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BLOCKED_MISMATCH, PlinthError
from ..functions.text import module_path, parent_name
from ..scratch import store

_PLACE = ["source_path", "source_start_line", "source_end_line"]
_SALTS = 32


def bind_unique(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes with the place of the one chunk of their module's file that has their name.

    None or several matching chunks leave the node unbound; a node with a path keeps its place.
    """
    by = sources.where("declaration_hint is not null").groupBy("source_path", F.col("declaration_hint").alias("name"))
    one = by.agg(F.count("*").alias("c"), F.first("source_start_line").alias("a"), F.first("source_end_line").alias("b")).where("c = 1").drop("c")
    keyed = nodes.withColumn("_path", module_path(F.col("module")))
    out = keyed.join(one.withColumnRenamed("source_path", "_path"), ["_path", "name"], "left")
    free = F.col("source_path").isNull()
    place = {"source_start_line": F.when(free, F.col("a")).otherwise(F.col("source_start_line")), "source_end_line": F.when(free, F.col("b")).otherwise(F.col("source_end_line")), "source_path": F.when(free & F.col("a").isNotNull(), F.col("_path")).otherwise(F.col("source_path"))}
    return out.withColumns(place).select(*nodes.columns)


def _endings(name):
    """The name and all that follows each of its dots."""
    parts = F.split(name, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def bind_by_suffix(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Archive binding: chunks of the module's file whose hint ends the full name.

    Two steps: the node's own name, and for nodes without a match the immediate parent's
    chunk if its text declares the member.  Nodes without a chunk go; several chunks, a
    module without chunks or another revision raise.
    """
    keyed = nodes.drop(*_PLACE).withColumn("_path", module_path(F.col("module")))
    chunks = sources.select(F.col("source_path").alias("_path"), F.col("declaration_hint").alias("hint"), "text", F.col("source_start_line").alias("a"), F.col("source_end_line").alias("b"), F.col("source_revision").alias("_rev"))
    chunks = chunks.where("hint is not null")
    bare = keyed.join(chunks.select("_path").distinct(), "_path", "left_anti").first()
    if bare is not None:
        raise PlinthError(BLOCKED_MISMATCH, f"no source for module {bare['module']}")
    # the hint is one of the name's dotted endings, which are keys of an equi-join; what is
    # found is stored, as two checks and the result read it
    ended = keyed.withColumn("hint", F.explode(_endings(F.col("full_name"))))
    direct = ended.join(chunks, ["_path", "hint"])
    rest = keyed.join(direct.select("id").distinct(), "id", "left_anti")
    parent = rest.withColumn("_parent", parent_name(F.col("full_name"))).where("_parent is not null").withColumn("hint", F.explode(_endings(F.col("_parent")))).join(chunks, ["_path", "hint"])
    member = F.regexp_like("text", F.concat(F.lit(r"(?m)^[ \t]*\Q"), F.element_at(F.split("full_name", r"\."), -1), F.lit(r"\E[ \t]*:")))
    found = store(direct.unionByName(parent.where(member).drop("_parent")).drop("text"), "bound")
    several = found.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").first()
    if several is not None:
        raise PlinthError(BLOCKED_MISMATCH, f"several chunks for {several['id']}")
    if (other := found.where(~F.col("_rev").eqNullSafe(F.col("source_revision"))).first()) is not None:
        raise PlinthError(BLOCKED_MISMATCH, f"revision differs for {other['id']}")
    placed = found.withColumn("source_path", F.col("_path")).withColumnsRenamed({"a": "source_start_line", "b": "source_end_line"})
    return placed.select(*nodes.columns)


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are there.  The ids of a partition are hashed, so the far more
    numerous edges aren't sorted."""
    ids = nodes.select("id").distinct().hint("shuffle_hash")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def _pick(out: DataFrame, keys: list[str], value: str, tiers: list[str]) -> DataFrame:
    pick = F.coalesce(*[F.when(F.col(f"n_{t}") == 1, F.col(f"v_{t}")) for t in tiers])
    tier = F.coalesce(*[F.when(F.col(f"n_{t}") == 1, F.lit(t)) for t in tiers])
    return out.select(*keys, pick.alias(value), tier.alias("tier"))


def hit_to_declaration(hits: DataFrame, nodes: DataFrame, *, within: list[str] | None = None) -> DataFrame:
    """Hits (with source_path, source_start_line, source_end_line, declaration_hint) and the
    declaration_id they stand for, or null, and the tier that told.

    Among the nodes named like the hint: exactly this place, else starting within the chunk,
    else in the same file, else anywhere; each only if one node qualifies.  Hits meet nodes of
    their name and file; all nodes of a name are counted once for the last tier.  ``within``
    names columns, such as the corpus, that must agree.
    """
    same = within or []
    keys = [*same, "source_path", "source_start_line", "source_end_line", "declaration_hint"]
    named = nodes.select(*same, F.col("name").alias("declaration_hint"), F.col("id").alias("declaration_id"), "source_path", F.col("source_start_line").alias("na"), F.col("source_end_line").alias("nb"))
    asked = hits.select(*keys).distinct()
    at = F.col("na").eqNullSafe(F.col("source_start_line")) & F.col("nb").eqNullSafe(F.col("source_end_line"))
    tiers = {"exact": at, "inside": F.coalesce(F.col("na").between(F.col("source_start_line"), F.col("source_end_line")), F.lit(False)), "file": F.lit(True)}
    near = asked.join(named, [*same, "source_path", "declaration_hint"])
    counts = [F.count_if(c).alias(f"n_{t}") for t, c in tiers.items()] + [F.min(F.when(c, F.col("declaration_id"))).alias(f"v_{t}") for t, c in tiers.items()]
    local = near.groupBy(*keys).agg(*counts)
    wanted = asked.select(*same, "declaration_hint").distinct()
    everywhere = named.join(wanted, [*same, "declaration_hint"], "left_semi").groupBy(*same, "declaration_hint").agg(F.count("*").alias("n_global"), F.min("declaration_id").alias("v_global"))
    found = _pick(asked.join(local, keys, "left").join(everywhere, [*same, "declaration_hint"], "left"), keys, "declaration_id", [*tiers, "global"])
    return hits.join(found, keys, "left")


def node_to_chunk(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """id of the node and chunk_id: the one chunk of the node's file that contains its start,
    else the file's only chunk, else the one named like it in its (or its module's) file.

    Nodes of a file without chunks go.  Equal intervals count once, with their number."""
    lines = [F.col(f"source_{c}_line").cast("long").alias(a) for c, a in (("start", "ca"), ("end", "cb"))]
    chunks = sources.select(F.col("source_path").alias("cp"), *lines, F.col("declaration_hint").alias("name"), F.col("id").alias("chunk_id"))
    keyed = nodes.select("id", "name", F.col("source_start_line").cast("long").alias("na"), F.coalesce("source_path", module_path(F.col("module"))).alias("cp"), F.col("source_path").isNotNull().alias("placed"))
    counted = [F.count("*").alias("n"), F.min("chunk_id").alias("v")]
    # an interval is in one or two blocks of the first power of two that it fits in; a place
    # meets it in its own block of that size, so no file's nodes and chunks all meet
    spans = chunks.where("ca <= cb").groupBy("cp", "ca", "cb").agg(*counted).withColumn("level", F.length(F.bin(F.col("cb") - F.col("ca"))))
    spans = spans.withColumn("block", F.explode(F.expr("sequence(shiftright(ca, level), shiftright(cb, level))")))
    levels = spans.agg(F.collect_set("level").alias("levels"))
    starts = keyed.where("placed and na is not null").select("id", "cp", "na").crossJoin(F.broadcast(levels)).select("id", "cp", "na", F.explode("levels").alias("level"))
    inside = starts.withColumn("block", F.expr("shiftright(na, level)")).join(spans, ["cp", "level", "block"]).where("na between ca and cb")
    # a file of very many nodes is dealt over several keys
    salted = keyed.withColumn("salt", F.pmod(F.hash("id"), F.lit(_SALTS)))
    files = chunks.groupBy("cp").agg(*counted).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    only = salted.join(files, ["cp", "salt"]).select("id", F.when(F.col("placed"), F.col("n")).otherwise(0).alias("n"), F.when(F.col("placed"), F.col("v")).alias("v"))
    named = keyed.join(chunks.groupBy("cp", "name").agg(*counted), ["cp", "name"])
    tiers = {"inside": inside, "only": only, "named": named}
    found = [part.select("id", F.lit(t).alias("t"), "n", "v") for t, part in tiers.items()]
    mine = [F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in tiers] + [F.min(F.when(F.col("t") == t, F.col("v"))).alias(f"v_{t}") for t in tiers]
    return _pick(found[0].unionAll(found[1]).unionAll(found[2]).groupBy("id").agg(*mine), ["id"], "chunk_id", list(tiers))
