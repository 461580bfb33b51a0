"""Expectations: each gives the rows that break it; a check fails closed on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..functions.text import hex_digest, in_scope, module_path
from ..schemas import EDGE_KEY, ID_PREFIX, RELATIONS
from ..scratch import sent, store
from .normalize import duplicates


def _rows(df: DataFrame, rule: str, key: Column, broken: Column, detail: str) -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(detail).alias("detail"))


def unique_violations(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Keys that occur more than once.  Hashes of keys are counted first, which are a fraction of the
    keys; only the rows of repeated hashes are counted by the keys themselves."""
    told = df.select(*keys, F.xxhash64(*keys).alias("_h"))
    twice = store(told.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"), "twice")
    met = told.join(sent(twice), "_h", "left_semi")
    return duplicates(met, *keys).select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), F.lit("occurs more than once").alias("detail"))


def id_violations(nodes: DataFrame) -> DataFrame:
    full = F.col("full_name")
    good = (F.col("id") == F.concat(F.lit(ID_PREFIX), full)) & (full != "") & ((full == F.col("name")) | F.endswith(full, F.concat(F.lit("."), "name")))
    return _rows(nodes, "V7", F.col("id"), ~good, "id is not canonical")


def revision_violations(df: DataFrame, revision: str) -> DataFrame:
    return _rows(df, "V8", F.col("id"), F.col("source_revision") != revision, "revision differs")


def scope_violations(nodes: DataFrame, roots: list[str]) -> DataFrame:
    return _rows(nodes, "V9", F.col("id"), ~in_scope(F.col("module"), roots), "module out of scope")


def range_violations(sources: DataFrame) -> DataFrame:
    a, b = F.col("source_start_line"), F.col("source_end_line")
    return _rows(sources, "V10", F.col("id"), (a < 1) | (b < a), "line range is empty")


def hash_violations(sources: DataFrame) -> DataFrame:
    return _rows(sources, "V11", F.col("id"), hex_digest(F.col("text")) != F.col("content_sha256"), "content hash differs")


def unbound_violations(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes with a place that is not one chunk's; nothing where there are no chunks at all."""
    keys = ["source_path", "source_start_line", "source_end_line", "name"]
    n = sources.where("declaration_hint is not null").groupBy(*keys[:3], F.col("declaration_hint").alias("name")).agg(F.count("*").alias("n"))
    placed = nodes.where("source_path is not null and source_start_line is not null and source_end_line is not null")
    some = F.broadcast(sources.select(F.lit(True).alias("some")).limit(1))
    return _rows(placed.join(n, keys, "left").crossJoin(some), "V12", F.col("id"), F.coalesce("n", F.lit(0)) != 1, "not one chunk")


def edge_violations(edges: DataFrame, producer: str) -> DataFrame:
    grades = F.create_map(*[F.lit(x) for pair in RELATIONS.values() for x in pair])
    good = (F.col("producer") == producer) & (grades[F.col("relation")] == F.col("evidence_grade"))
    return _rows(edges, "V15", F.concat_ws("|", *EDGE_KEY), ~good, "producer, relation or grade is wrong")


def dangling_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    # the ids of a partition are hashed, so the far more numerous edges aren't sorted
    ids = nodes.select("id").distinct().hint("shuffle_hash")
    lost = [edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select(F.lit("V16").alias("rule"), F.col(c).alias("key"), F.lit(f"{c} is no node").alias("detail")) for c in ("source_id", "target_id")]
    return lost[0].unionAll(lost[1])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with multiplicity, and the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def member_violations(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Members (path, sha256, bytes) that are extra, missing or different."""
    e = expected.select("path", F.col("sha256").alias("want"), F.col("bytes").alias("size"))
    both = found.join(e, "path", "full_outer")
    state = F.when(F.col("want").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when((F.col("sha256") != F.col("want")) | (F.col("bytes") != F.col("size")), "different")
    return both.select("path", state.alias("state")).where("state is not null")


def field_differences(actual: Column, expected: list[str]) -> tuple[Column, Column]:
    """Fields that are missing and that are unknown, of an array of names."""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    return F.array_sort(F.array_except(want, actual)), F.array_sort(F.array_except(actual, want))


def _rules(df: DataFrame, key: Column, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Rows of rule, key, detail for every broken rule, by one pass."""
    broken = [F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(detail).alias("detail"))) for rule, bad, detail in rules]
    return df.select(F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("x")).select("x.*")


def artifact_violations(nodes: DataFrame, edges: DataFrame, sources: DataFrame, *, roots: list[str], revision: str, producer: str, authoritative_archive: bool = False) -> DataFrame:
    """All row rules over the three relations: one pass of each, a count of keys each, and the
    joins between them.

    The nodes of an authoritative archive must all have a place, which is checked against a
    new binding and not against single chunks.
    """
    full, path, a, b = (F.col(c) for c in ("full_name", "source_path", "source_start_line", "source_end_line"))
    given = path.isNotNull().cast("int") + a.isNotNull().cast("int") + b.isNotNull().cast("int")
    whole = given == 3
    canonical = (F.col("id") == F.concat(F.lit(ID_PREFIX), full)) & (full != "") & ((full == F.col("name")) | F.endswith(full, F.concat(F.lit("."), "name")))
    grades = F.create_map(*[F.lit(x) for pair in RELATIONS.values() for x in pair])
    node_rules = [
        ("V7", ~canonical, "id is not canonical"), ("V8", F.col("source_revision") != revision, "revision differs"), ("V9", ~in_scope(F.col("module"), roots), "module out of scope"),
        ("V12", ~given.isin(0, 3), "location is partial"), ("V12", whole & ((a < 1) | (b < a) | (path != module_path(F.col("module")))), "location is wrong"),
    ]
    if authoritative_archive:
        node_rules.append(("V13", ~whole, "node of an authoritative archive has no place"))
    source_rules = [
        ("V8", F.col("source_revision") != revision, "revision differs"), ("V10", (a < 1) | (b < a), "line range is empty"), ("V11", hex_digest(F.col("text")) != F.col("content_sha256"), "content hash differs"),
    ]
    edge_rules = [("V15", ~((F.col("producer") == producer) & (grades[F.col("relation")] == F.col("evidence_grade"))), "producer, relation or grade is wrong")]
    parts = [
        _rules(nodes, F.col("id"), node_rules), _rules(sources, F.col("id"), source_rules), _rules(edges, F.concat_ws("|", *EDGE_KEY), edge_rules),
        unique_violations(nodes, "V6", ["id"]), unique_violations(edges, "V6", EDGE_KEY), unique_violations(sources, "V6", ["id"]), dangling_violations(edges, nodes),
    ]
    if not authoritative_archive:
        parts.append(unbound_violations(nodes, sources))
    return reduce(DataFrame.unionAll, parts)


def require(violations: DataFrame, code: str = BLOCKED_ARTIFACT) -> None:
    """Raises on the first violation, before any result is used."""
    if (row := violations.first()) is not None:
        raise PlinthError(code, " ".join(str(x) for x in row))
