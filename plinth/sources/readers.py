"""Readers with explicit schemas; malformed input fails instead of being coerced."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import BLOCKED_ARTIFACT, BLOCKED_BINDING, BLOCKED_MISMATCH, PlinthError
from ..functions.text import is_hex64, is_inside, without_prefixes
from ..schemas import RAW_EDGE, RAW_NODE
from .contract import strict_json
from .splitjson import BLOCK, read_arrays

__all__ = ["read_bounded", "read_listed", "read_raw_graph", "read_rows", "read_tree", "strict_json", "strict_json_rows"]


def strict_json_rows(rows: DataFrame, column: str) -> DataFrame:
    """The column parsed as VARIANT, which is null for duplicate keys, NaN and bad JSON."""
    return rows.withColumn("parsed", F.try_parse_json(column))


def read_raw_graph(spark: SparkSession, path: str, *, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Raw nodes and edges of graph documents, one JSON object with both lists per file.  A
    document is read by blocks in many tasks."""
    found = read_arrays(spark, path, ["nodes", "edges"], block=block)

    def rows(name: str, schema: StructType) -> DataFrame:
        parsed = found.where(F.col("name") == name).select(F.from_json("element", schema, {"mode": "FAILFAST"}).alias("x"))
        return parsed.select("x.*")

    return rows("nodes", RAW_NODE), rows("edges", RAW_EDGE)


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines in a fixed schema; blank lines are skipped, a null in a required field fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for f in schema.fields:
        if not f.nullable:
            rows = rows.withColumn(f.name, F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{BLOCKED_ARTIFACT}: {f.name} is missing")).cast(f.dataType)))
    return rows


def _relative(root: str):
    """Path of a file below ``root``, from the column path."""
    clean = re.escape(re.sub(r"^file:/*", "/", root.rstrip("/")))
    return F.regexp_replace("path", f"^(file:/*)?/?{clean.lstrip('/')}/", "")


def read_tree(spark: SparkSession, root: str, *, suffix: str = ".lean", excluded: list[str] | None = None, listed: DataFrame | None = None, most_bytes: int | None = None) -> DataFrame:
    """source_path, text, sha256, bytes of all files below a folder.

    Build folders are skipped.  ``listed`` (column source_path), such as a version control
    listing, restricts the files; it goes before contents are read.  A file longer than
    ``most_bytes`` raises.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    rel = raw.withColumn("source_path", _relative(root))
    rel = rel.where(~F.col("source_path").rlike(r"(^|/)\.lake/")).where(without_prefixes(F.col("source_path"), excluded or []))
    if listed is not None:
        wanted = listed.select("source_path").distinct()
        names = rel.select("path", "source_path").join(wanted, "source_path", "left_semi")
        return _contents(spark, [r["path"] for r in names.select("path").collect()], root, most_bytes)
    return _told(rel, most_bytes)


def _told(rel: DataFrame, most_bytes: int | None) -> DataFrame:
    content = F.col("content")
    if most_bytes is not None:
        content = F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.lit("EVIDENCE_TOO_LARGE: "), "source_path")).cast("binary")).otherwise(content)
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.raise_error(F.concat(F.lit(f"{BLOCKED_MISMATCH}: no UTF-8: "), "source_path")).cast("string"))
    return rel.select("source_path", utf8.alias("text"), F.sha2(content, 256).alias("sha256"), F.col("length").alias("bytes"))


def _contents(spark: SparkSession, paths: list[str], root: str, most_bytes: int | None) -> DataFrame:
    """Of named files alone; the listing of names is small next to their contents."""
    if not paths:
        return spark.createDataFrame([], "source_path string, text string, sha256 string, bytes long")
    return _told(spark.read.format("binaryFile").load(paths).withColumn("source_path", _relative(root)), most_bytes)


def read_bounded(spark: SparkSession, path: str, most: int) -> bytes:
    """A file's bytes; of a longer one no more than ``most`` + 1 are read before it raises."""
    from ..scratch import hadoop

    target, system = hadoop(spark, path)
    stream = system.open(target)
    try:
        data = bytes(stream.readNBytes(most + 1))
    finally:
        stream.close()
    if len(data) > most:
        raise ValueError(f"EVIDENCE_TOO_LARGE: {path} exceeds {most} bytes")
    return data


def read_listed(spark: SparkSession, root: str, members: DataFrame, *, suffix: str = ".lean", excluded: list[str] | None = None) -> DataFrame:
    """Files named by a manifest (source_path, sha256); no other file is opened.

    Members without source_path, with another ending or below an excluded prefix are left
    out.  Unsafe or repeated paths, digests that are none, missing files, other contents and
    contents that are no UTF-8 raise.
    """
    named = members.where("source_path is not null")
    bad = named.where(~is_inside(F.col("source_path"))).first()
    if bad is not None:
        raise PlinthError(BLOCKED_BINDING, f"unsafe path {bad['source_path']}")
    if not named.groupBy("source_path").count().where("count > 1").isEmpty():
        raise PlinthError(BLOCKED_BINDING, "a path is listed twice")
    wanted = named.where(F.endswith("source_path", F.lit(suffix))).where(without_prefixes(F.col("source_path"), excluded or [])).select("source_path", "sha256")
    if (bad := wanted.where(~is_hex64(F.coalesce("sha256", F.lit("")))).first()) is not None:
        raise PlinthError(BLOCKED_BINDING, f"no digest for {bad['source_path']}")
    names = {r["source_path"] for r in wanted.select("source_path").collect()}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path", _relative(root).alias("source_path"))
    paths = {r["source_path"]: r["path"] for r in found.collect() if r["source_path"] in names}
    if lost := sorted(names - set(paths)):
        raise PlinthError(BLOCKED_MISMATCH, f"{lost[0]} is missing")
    files = _contents(spark, list(paths.values()), root, None).withColumnRenamed("sha256", "found")
    both = wanted.join(files, "source_path")
    differs = F.raise_error(F.concat(F.lit(f"{BLOCKED_MISMATCH}: differs: "), "source_path")).cast("string")
    return both.select("source_path", F.when(F.col("found") == F.col("sha256"), F.col("text")).otherwise(differs).alias("text"), "sha256", "bytes")
