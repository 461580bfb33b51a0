"""An ordered sink: rows of a relation as lines of text, in order, however many there are.

    <folder>/part-<number>-<attempt>.txt    lines of one range of the order
    <folder>/_parts.json                    the parts in order: name, rows, bytes, sha256

Rows are dealt by ranges of their order and each task writes its range; none passes through the
driver.  A task writes under a name of its own attempt and reports name, size and digest; the
commit writes the list, and only what it names counts.  So a task that fails, or runs twice,
leaves nothing behind in the result: what the list doesn't name is deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import BLOCKED_ARTIFACT, PlinthError
from ..scratch import read_text

FORMAT, LIST = "ordered_lines", "_parts.json"
_BUFFER = 4 << 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int
    bytes: int
    sha256: str


class LineWriter(DataSourceWriter):
    """Writes the column line; a partition is a part."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.txt"
        system, root = _system(self.folder)
        system.create_dir(root, recursive=True)
        sha, rows, size, held, pending = hashlib.sha256(), 0, 0, [], 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                held.append(row[0].encode() + b"\n")
                rows, pending = rows + 1, pending + len(held[-1])
                if pending >= _BUFFER:
                    data = b"".join(held)
                    sha.update(data), out.write(data)
                    size, held, pending = size + len(data), [], 0
            data = b"".join(held)
            sha.update(data), out.write(data)
        return Part(number, name, rows, size + len(data), sha.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _system(self.folder)
        system.create_dir(root, recursive=True)
        told = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        self._keep({m.name for m in told})
        with system.open_output_stream(f"{root}/.{LIST}") as out:
            out.write(json.dumps([{"name": m.name, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in told]).encode())
        system.move(f"{root}/.{LIST}", f"{root}/{LIST}")

    def abort(self, messages: list[Part | None]) -> None:
        self._keep(set())

    def _keep(self, names: set[str]) -> None:
        from pyarrow import fs

        system, root = _system(self.folder)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("part-") and info.base_name not in names:
                system.delete_file(info.path)


class LineSink(DataSource):
    """``df.select("line").write.format("ordered_lines").option("path", folder)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def write_lines(df: DataFrame, line: Column, order: list[str | Column], folder: str, *, parts: int | None = None) -> list[dict]:
    """Writes ``line`` of each row in order and returns the list of parts.

    Rows that are equal in the order are next to each other in any order.  A folder that has a
    list already is refused; an empty relation gives an empty list.
    """
    spark = df.sparkSession
    if read_text(spark, f"{folder.rstrip('/')}/{LIST}") is not None:
        raise PlinthError(BLOCKED_ARTIFACT, f"{folder} has lines already")
    spark.dataSource.register(LineSink)
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(line.alias("line")).write.format(FORMAT).mode("append").option("path", folder).save()
    return listed(spark, folder)


def listed(spark: SparkSession, folder: str) -> list[dict]:
    """The parts in order, as committed."""
    text = read_text(spark, f"{folder.rstrip('/')}/{LIST}")
    if text is None:
        raise PlinthError(BLOCKED_ARTIFACT, f"{folder} has no committed lines")
    return json.loads(text)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """part, value: the committed lines; parts are numbered in order."""
    folder = folder.rstrip("/")
    parts = listed(spark, folder)
    if not parts:
        return spark.createDataFrame([], "part int, value string")
    names = spark.createDataFrame([(p["name"], k) for k, p in enumerate(parts)], "name string, part int")
    rows = spark.read.text([f"{folder}/{p['name']}" for p in parts], lineSep="\n").withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    # a row a part
    return rows.join(F.broadcast(names), "name").select("part", "value")


def changed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """name of the parts whose bytes are no more those that were committed, found in tasks."""
    folder = folder.rstrip("/")
    parts = listed(spark, folder)
    want = spark.createDataFrame([(p["name"], p["sha256"], p["bytes"]) for p in parts], "name string, sha256 string, bytes long")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            lost = []
            for name, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, root = _system(folder)
                sha, n = hashlib.sha256(), 0
                try:
                    with system.open_input_stream(f"{root}/{name}") as file:
                        while data := file.read(_BUFFER):
                            sha.update(data)
                            n += len(data)
                except FileNotFoundError:
                    n = -1
                if (n, sha.hexdigest()) != (size, digest):
                    lost.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(lost, pa.string())], ["name"])

    return want.repartition(max(1, min(len(parts), 10_000))).mapInArrow(check, "name string")
