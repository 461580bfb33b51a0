"""Intermediate tables in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is
unset and the session runs on one machine, as in tests, a temporary folder is made; on a
cluster without it nothing is written.  Written tables cut lineage and outlive lost
executors.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: The list that the stage of this thread notes its paths in, and the lists by stage.
_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)
_of_stage: dict[tuple[str, str], list[str]] = {}
_left: dict[str, SparkSession] = {}
#: Tables that a pipeline stage stores between two collections of the driver's garbage.
_SWEEP = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables; raises on a cluster that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plinth-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


@atexit.register
def _sweep() -> None:
    for path, spark in list(_left.items()):
        discard(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/plinth/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    noted = _noted.get()
    if noted is not None:
        noted.append(path)
    return path


@contextlib.contextmanager
def stage(spark: SparkSession, name: str, before: str | None):
    """A pipeline stage: notes what it writes and, as the stage before has been stored by
    then, deletes what that one left."""
    app = spark.sparkContext.applicationId
    discard(spark, *_of_stage.pop((app, before), []))
    token = _noted.set(_of_stage.setdefault((app, name), []))
    try:
        yield
    finally:
        _noted.reset(token)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number behind it where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made, k = name, 0
        while made.lower() in taken:
            k += 1
            made = f"{name}{k}"
        taken.add(made.lower())
        out.append(made)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet and returns the stored table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    noted = _noted.get()
    if noted is not None and len(noted) % _SWEEP == 0:
        # a pipeline runs hundreds of jobs in one driver: Spark lets go of the shuffles and
        # broadcasts of finished ones when their handles are collected
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return stored


def discard(spark: SparkSession, *stored: str | DataFrame) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for item in stored:
        path = item if isinstance(item, str) else getattr(item, "scratch_path", None)
        if path is None:
            continue
        with contextlib.suppress(Exception):
            target, system = _hadoop(spark, path)
            system.delete(target, True)
        _left.pop(path, None)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Rows and bytes (as stored) of a table that may travel to every executor.  The tables hold
#: ids and hashes, which Parquet hardly shrinks, so what is stored tells what travels.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 48 << 20


def is_small(stored: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table may travel to every executor.  Counting reads Parquet footers
    only."""
    path = getattr(stored, "scratch_path", None)
    if path is not None:
        target, system = _hadoop(stored.sparkSession, path)
        if system.getContentSummary(target).getLength() > most_bytes:
            return False
    return stored.count() <= most


def small_side(stored: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table for one side of a join: broadcast if its counted rows and its stored
    bytes are few, else as it is, which leaves a shuffled join."""
    return F.broadcast(stored) if is_small(stored, most, most_bytes) else stored


#: Rows of a key from which on it is dealt over several tasks, and over how many at most.
HOT_ROWS = 1 << 19
_SALTS = 256


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, by: list[str], *, count: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a stored ``lookup`` of one row per key.

    Column ``count`` of the lookup, which goes, tells how many rows have the key.  A lookup
    too large to travel is joined by key; keys of more than ``HOT_ROWS`` rows are dealt over
    several tasks by the hash of the columns ``by`` and meet a copy of their row in each.
    Such keys are at most one in ``HOT_ROWS`` rows, so their list may travel.
    """
    plain = lookup.drop(count)
    if is_small(lookup, most):
        return rows.join(F.broadcast(plain), key)
    parts = F.least(F.ceil(F.col(count) / F.lit(HOT_ROWS)), F.lit(_SALTS)).cast("int")
    hot = lookup.where(F.col(count) > HOT_ROWS).select(key, parts.alias("_parts"))
    if hot.isEmpty():
        return rows.join(plain, key)
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copied = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return salted.join(copied, [key, "_salt"]).drop("_salt")
