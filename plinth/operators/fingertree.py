"""Stored digests of a relation by ranges of its key, in levels.

    meta.json                  key, columns, lower bounds of the ranges, fan, version folder
    <version>/level=<k>/       node, parent, rows, digest; level 0 are the ranges

A range's digest is that of sums of hashes of its rows' SHA-256 values, so it depends on neither
order nor layout and is made by partial sums.  A node's digest is that of its children's.  Two trees
over the same ranges are compared from the top, reading only the children of nodes that differ,
so one changed row is found by one path.  After a change only the ranges that hold changed keys
are read again.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BLOCKED_PROJECTION, PlinthError
from ..scratch import delete, read_text, write_text
from .fingerprint import digest_sums, row_digests

#: Rows that a range is to hold at first, ranges at most (their bounds are kept on the driver) and
#: children of a node.
_RANGE_ROWS, _MOST_RANGES, _FAN = 1 << 16, 1 << 16, 64
#: How digests are summed, and bounds that a key is compared with in the JVM.
_SUMS, _FEW_BOUNDS = "xxhash64x4", 64


def split_points(df: DataFrame, key: str, *, range_rows: int = _RANGE_ROWS) -> list[str]:
    """Lower bounds of about equal ranges, from the relation as it is; the first is empty."""
    n = min(_MOST_RANGES, max(1, -(-df.count() // range_rows)))
    if n == 1:
        return [""]
    dealt = df.select(F.col(key).cast("string").alias("k")).repartitionByRange(n, "k")
    found = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).orderBy("k").collect()
    return ["", *sorted({r["k"] for r in found[1:] if r["k"]})]


def range_of(key: Column, bounds: list[str]) -> Column:
    """The number of the range that a key lies in, by code points; null keys lie in the first."""
    if len(bounds) <= _FEW_BOUNDS:
        above = [F.coalesce((key.cast("string") >= F.lit(b)).cast("int"), F.lit(0)) for b in bounds[1:]]
        return sum(above, F.lit(0))
    points = [b.encode() for b in bounds]

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: 0 if k is None else bisect_right(points, k.encode()) - 1).astype("int32")

    return find(key.cast("string"))


def _ranges(df: DataFrame, key: str, columns: list[str], bounds: list[str]) -> DataFrame:
    """node, rows, digest of each range that has rows."""
    at = unique_name(df, "_node")
    marked = df.withColumn(at, range_of(F.col(key), bounds))
    hashed = row_digests(marked, *columns, keep=at).withColumnRenamed(at, "node")
    return hashed.groupBy("node").agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *digest_sums(F.col("digest"))), 256).alias("digest"))


def unique_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def build(df: DataFrame, key: str, folder: str, *, columns: list[str] | None = None, bounds: list[str] | None = None, fan: int = _FAN, range_rows: int = _RANGE_ROWS) -> FingerTree:
    """Writes the tree of a relation; ``bounds`` are its ranges if they are to be given ones."""
    bounds = sorted({"", *bounds}) if bounds is not None else split_points(df, key, range_rows=range_rows)
    if len(bounds) > _MOST_RANGES:
        raise ValueError(f"more than {_MOST_RANGES} ranges")
    columns = sorted(columns or df.columns)
    tree = FingerTree(df.sparkSession, folder, {"key": key, "columns": columns, "bounds": bounds, "fan": fan, "sums": _SUMS})
    tree._write(_ranges(df, key, columns, bounds))
    return tree


class FingerTree:
    """A stored tree."""

    def __init__(self, spark: SparkSession, folder: str, meta: dict | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        if meta is None:
            text = read_text(spark, f"{self.folder}/meta.json")
            if text is None:
                raise PlinthError(BLOCKED_PROJECTION, f"no fingerprint tree in {folder}")
            meta = json.loads(text)
        if meta.get("sums") != _SUMS:
            raise PlinthError(BLOCKED_PROJECTION, f"the tree in {folder} sums digests in another way")
        self.meta = meta

    @property
    def levels(self) -> int:
        """How many levels there are; the last has one node."""
        n, width = 1, len(self.meta["bounds"])
        while width > 1:
            n, width = n + 1, -(-width // self.meta["fan"])
        return n

    def level(self, k: int) -> DataFrame:
        kind = "node int, parent int, rows long, digest string"
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{self.meta['version']}/level={k}")

    @property
    def root(self) -> str:
        """The digest of the whole relation over these ranges."""
        row = self.level(self.levels - 1).first()
        return row["digest"] if row else ""

    def range(self, node: int) -> tuple[str, str | None]:
        """Lower bound and upper bound (not in it; None for the last) of a range."""
        bounds = self.meta["bounds"]
        return bounds[node], bounds[node + 1] if node + 1 < len(bounds) else None

    def _write(self, ranges: DataFrame) -> None:
        version, fan = uuid.uuid4().hex, self.meta["fan"]
        old = self.meta.get("version")
        rows = ranges
        for k in range(self.levels):
            path = f"{self.folder}/{version}/level={k}"
            rows.select("node", F.floor(F.col("node") / fan).cast("int").alias("parent"), "rows", "digest").coalesce(1).sortWithinPartitions("node").write.parquet(path)
            stored = self.spark.read.schema("node int, parent int, rows long, digest string").parquet(path)
            # a node has ``fan`` children at most
            told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), ",")
            rows = stored.groupBy(F.col("parent").alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(told, 256).alias("digest"))
        self.meta = {**self.meta, "version": version}
        write_text(self.spark, f"{self.folder}/meta.json", json.dumps(self.meta, sort_keys=True), replace=True)
        if old:
            delete(self.spark, f"{self.folder}/{old}")

    def within(self, df: DataFrame, nodes: list[int]) -> DataFrame:
        """The rows of a relation that lie in the given ranges, as a filter on its key."""
        key, keep = F.col(self.meta["key"]), F.lit(False)
        for node in nodes:
            low, high = self.range(node)
            part = key >= F.lit(low) if node else (key >= F.lit(low)) | key.isNull()
            keep = keep | (part if high is None else part & (F.coalesce(key < F.lit(high), F.lit(True))))
        return df.where(keep)

    def update(self, df: DataFrame, changed: DataFrame) -> list[int]:
        """Brings the tree up to the relation ``df`` as it is now, where ``changed`` has the key
        of every row that came, went or changed.  Returns the ranges that were read again."""
        key, bounds = self.meta["key"], self.meta["bounds"]
        touched = sorted(r["n"] for r in changed.select(range_of(F.col(key), bounds).alias("n")).distinct().collect())
        if touched:
            fresh = _ranges(self.within(df, touched), key, self.meta["columns"], bounds)
            rest = self.level(0).where(~F.col("node").isin(touched)).select("node", "rows", "digest")
            self._write(rest.unionAll(fresh.select("node", "rows", "digest")))
        return touched

    def drift(self, other: FingerTree) -> DataFrame:
        """node, low, high, rows, other_rows of the ranges whose rows differ, found from the top;
        rows of the upper levels are read for differing nodes alone."""
        if any(self.meta[k] != other.meta[k] for k in ("key", "columns", "bounds", "fan")):
            raise PlinthError(BLOCKED_PROJECTION, "trees over different ranges can't be compared")
        parents: list[int] | None = None
        told: list[tuple] = []
        for k in reversed(range(self.levels)):
            a, b = (t.level(k) if parents is None else t.level(k).where(F.col("parent").isin(parents)) for t in (self, other))
            b = b.select(F.col("node").alias("node"), F.col("rows").alias("other_rows"), F.col("digest").alias("other"))
            rows = a.join(b, "node", "full").where(~F.col("digest").eqNullSafe(F.col("other"))).orderBy("node").collect()
            parents = [r["node"] for r in rows]
            told = [(r["node"], *self.range(r["node"]), r["rows"] or 0, r["other_rows"] or 0) for r in rows] if k == 0 else []
            if not parents:
                break
        return self.spark.createDataFrame(told, "node int, low string, high string, rows long, other_rows long")
