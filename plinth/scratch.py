"""Stored intermediate relations in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may travel to all tasks.
_MOST_SENT = 1 << 16
_own: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def hadoop(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.  Unset on one machine it is a temporary folder; a
    cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plinth-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/plinth-core/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows written once; what reads them has no lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """Rows of a stored relation, marked to travel to all tasks if they are few."""
    return F.broadcast(df) if df.limit(_MOST_SENT + 1).count() <= _MOST_SENT else df


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target, system = hadoop(spark, path)
        system.delete(target, True)
    _left.pop(path, None)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_left.items()):
        delete(spark, path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, read through its file system, without a job."""
    target, system = hadoop(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if there is none."""
    target, system = hadoop(spark, path)
    return read_bytes(spark, path).decode() if system.exists(target) else None


def write_text(spark: SparkSession, path: str, text: str, *, replace: bool = False) -> None:
    target, system = hadoop(spark, path)
    out = system.create(target, replace)
    out.write(text.encode())
    out.close()
