"""Rows that move in packed blocks, each of one bucket.

A shuffle of many narrow rows is mostly keys that repeat.  Blocks of a task's rows, sorted by bucket
and key and compressed, are a fraction of it; the bucket's reader unpacks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "bucket int, block binary"
#: Rows that are packed at once.
_MOST_ROWS = 1 << 19


def dealt(blocks: DataFrame, buckets: int, schema) -> DataFrame:
    """The rows of blocks, those of a bucket in one task; one that is too large for a task is split
    between blocks."""
    return blocks.hint("rebalance", int(min(buckets, 20_000)), F.col("bucket")).mapInArrow(unpacked, schema)


def deal(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with a column bucket, dealt by it."""
    return dealt(rows.mapInArrow(lambda batches: _sorted(batches, key), BLOCKS), buckets, rows.schema)


def _sorted(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _MOST_ROWS:
            yield _ordered(held, key)
            held, n = [], 0
    if n:
        yield _ordered(held, key)


def _ordered(held: list[pa.RecordBatch], key: str) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    return packed(rows.sort_by([("bucket", "ascending"), (key, "ascending")]).combine_chunks().to_batches()[0])


def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Blocks of rows that are sorted by bucket."""
    bucket = rows["bucket"].to_numpy()
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    blocks = []
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        part, out = rows.slice(a, b - a), pa.BufferOutputStream()
        small = pa.RecordBatch.from_pydict({c: part[c].dictionary_encode() if pa.types.is_string(part[c].type) else part[c] for c in rows.schema.names})
        with pa.ipc.new_stream(out, small.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_batch(small)
        blocks.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts]), "block": pa.array(blocks, pa.binary())})


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch["block"]:
            for rows in pa.ipc.open_stream(block.as_buffer()):
                plain = {c: rows[c].dictionary_decode() if pa.types.is_dictionary(rows[c].type) else rows[c] for c in rows.schema.names}
                yield pa.RecordBatch.from_pydict(plain)
