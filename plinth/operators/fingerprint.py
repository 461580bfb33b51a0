"""Fingerprints of relations that don't depend on row order or partitioning."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digests(df: DataFrame, *columns: str, keep: str | None = None) -> DataFrame:
    """A digest per row over the named columns (with the column ``keep`` as it is); nulls differ
    from empty texts."""
    cells = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in (columns or sorted(df.columns))]
    return df.select(*([keep] if keep else []), F.sha2(F.concat_ws("\x1f", *cells), 256).alias("digest"))


#: Rows that a bucket is to hold, and buckets that are joined to one in a step.
_BUCKET_ROWS, _FAN = 1 << 16, 4096


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, fingerprint).

    Digests are sorted and hashed within buckets of their leading bits, then the buckets'
    hashes in order, in as many steps as keep every list short: the number of buckets grows
    with the rows, so no task holds more than a bucket.
    """
    spark = df.sparkSession
    rows, levels = df.count(), 1
    while _FAN**levels * _BUCKET_ROWS < rows:
        levels += 1
    lead = F.conv(F.substring("digest", 1, 3 * levels), 16, 10).cast("long")
    # digests move as bytes, which sort as their texts do
    digests = row_digests(df, *columns).select(lead.alias("b"), F.unhex("digest").alias("digest"))
    texts = F.transform(F.sort_array(F.collect_list("digest")), lambda x: F.lower(F.hex(x)))
    state = digests.groupBy("b").agg(F.sha2(F.array_join(texts, ""), 256).alias("d"))
    for _ in range(levels):
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: F.concat((x["b"] % _FAN).cast("string"), F.lit(":"), x["d"])), ",")
        state = state.groupBy(F.floor(F.col("b") / _FAN).alias("up")).agg(F.sha2(parts, 256).alias("d")).withColumnRenamed("up", "b")
    empty = spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("empty"))
    return empty.join(F.broadcast(state.select("d")), F.lit(True), "left").select(F.lit(rows).cast("long").alias("rows"), F.coalesce("d", "empty").alias("fingerprint"))


def digest_sums(digest: Column) -> list[Column]:
    """Sums over rows of four hashes of a digest as texts, in three parts each so that the sums of
    any number of rows are exact."""
    hashes = [F.xxhash64(F.lit(k), digest) for k in range(4)]
    low, mid = (1 << 22) - 1, (1 << 21) - 1
    sums = [F.sum(x) for h in hashes for x in (F.shiftright(h, 43), F.shiftright(h, 22).bitwiseAND(F.lit(mid)), h.bitwiseAND(F.lit(low)))]
    return [F.coalesce(x, F.lit(0)).cast("string") for x in sums]


def content_sum(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, fingerprint) of a very large relation, without moving a row.

    Four hashes of each row's digest are summed; repeated rows count.
    """
    told = F.concat_ws(",", F.count("*").cast("string"), *digest_sums(F.col("digest")))
    return row_digests(df, *columns).agg(F.count("*").alias("rows"), F.sha2(told, 256).alias("fingerprint"))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def artifact_identity(manifest: dict) -> str:
    """Identity of an artifact: its schema, source, producer, scope, authority and member
    hashes; row counts are not part of it."""
    keys = ["schema", "source", "producer", "scope", "members", *[k for k in manifest if k.startswith("created_from_authoritative_")]]
    return digest({k: manifest[k] for k in keys})


def catalog_digest(catalog: dict) -> str:
    """Independent of the order of corpora and of keys."""
    return digest({**catalog, "corpora": sorted(catalog["corpora"], key=lambda c: c["source_id"])})


def tree_digest(members: list[tuple[str, str]]) -> str:
    """Of (path, sha256) pairs, whatever their order."""
    return digest(sorted(map(list, members)))
