"""The dependency edges stored twice, in order of either end.

    out/bucket=.../    by source_id
    in/bucket=.../     by target_id
    layout.json        how many buckets, and which of the two orders there are

Edges lie in buckets by the hash of the node they are looked up by, sorted by it.  A node of very
many edges lies in many files, as its bucket is split between tasks and a file holds so many edges.  A step of a traversal reads the buckets of its frontier only; what travels for that is a
list of bucket numbers, never the nodes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BLOCKED_PROJECTION, PlinthError
from ..schemas import EDGES
from ..scratch import read_text, write_text

#: Edges that a bucket or a file is to hold.
_BUCKET_ROWS = 1 << 20
#: A frontier of at most so many nodes is a filter on them, which Parquet's row groups answer.
_FEW_NODES = 64
_SIDES = {"out": "source_id", "in": "target_id"}


def bucket_of(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def build(edges: DataFrame, folder: str, *, bucket_rows: int = _BUCKET_ROWS, sides: tuple[str, ...] = tuple(_SIDES)) -> Adjacency:
    """Writes both orders of the edges, or the one that is asked for.  Repeated edges stay; an
    empty table is no fault."""
    spark, folder = edges.sparkSession, folder.rstrip("/")
    total = edges.count()
    buckets = max(16, -(-total // bucket_rows))
    for side in sides:
        node = _SIDES[side]
        marked = edges.withColumn("bucket", bucket_of(F.col(node), buckets))
        spread = marked.hint("rebalance", int(min(buckets, 20_000)), F.col("bucket")).sortWithinPartitions("bucket", node)
        spread.write.partitionBy("bucket").option("maxRecordsPerFile", bucket_rows).parquet(f"{folder}/{side}")
    write_text(spark, f"{folder}/layout.json", json.dumps({"buckets": int(buckets), "rows": int(total), "columns": edges.columns, "sides": list(sides)}))
    return Adjacency(spark, folder)


class Adjacency:
    """Stored edges, read by the ends of a frontier."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        text = read_text(spark, f"{self.folder}/layout.json")
        if text is None:
            raise PlinthError(BLOCKED_PROJECTION, f"no adjacency in {folder}")
        layout = json.loads(text)
        self.buckets, self.rows, self.columns = layout["buckets"], layout["rows"], layout["columns"]
        self.sides = layout.get("sides", list(_SIDES))

    @property
    def edges(self) -> DataFrame:
        """All edges, once."""
        return self._side(self.sides[0]).select(*self.columns)

    def _side(self, side: str) -> DataFrame:
        if side not in self.sides:
            raise PlinthError(BLOCKED_PROJECTION, f"the adjacency in {self.folder} has no order by {_SIDES[side]}")
        kinds = {f.name: f.dataType.simpleString() for f in EDGES.fields}
        if not self.rows:
            return self.spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in self.columns) + ", bucket int")
        return self.spark.read.parquet(f"{self.folder}/{side}")

    def leaving(self, frontier: DataFrame, *, reverse: bool = False) -> DataFrame:
        """The edges that leave the nodes in column node of a stored frontier (that enter them,
        with ``reverse``), with all its columns."""
        side = "in" if reverse else "out"
        end = _SIDES[side]
        nodes = frontier.select("node")
        hit = nodes.select(bucket_of(F.col("node"), self.buckets).alias("b")).distinct()
        buckets = sorted(r["b"] for r in hit.collect())
        rows = self._side(side)
        if len(buckets) < self.buckets:
            rows = rows.where(F.col("bucket").isin(buckets))
        if len(buckets) <= _FEW_NODES:
            few = [r["node"] for r in nodes.distinct().limit(_FEW_NODES + 1).collect()]
            if len(few) <= _FEW_NODES:
                rows = rows.where(F.col(end).isin(few))
        return rows.select(*self.columns).join(frontier, F.col(end) == F.col("node"))
