"""Importance resampling of documents towards a target distribution.

Features are runs of one to three words, hashed into buckets by CRC-32.  A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus; a document weighs the sum of
its features' gains.  Noise of its own, fixed by its id, is added, and the best are drawn.

Identical texts are grouped by the whole text first.  Their features and weight are computed
once and count as often as the text occurs; the weights go back to the documents by the text's
SHA-256, hot texts dealt over tasks, and only then comes the noise.  What the driver gets is one
row a bucket and one a partition of the ranking.

CRCs of word runs are joined from those of the words: CRC-32 is linear, so appending n bytes
maps the former value by a matrix that depends on n alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, is_small, materialize, spread_join
from .textkernel import NON_ALNUM, Texts, blocks, owners

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Longer words are hashed one by one.
_SHORT = 63
_ZERO = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _appending() -> np.ndarray:
    """What each byte of a CRC contributes once n bytes follow, by (n, byte's place, byte)."""
    out = np.empty((_SHORT + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _SHORT + 2):
        out[n] = _TABLE[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_APPEND = _appending()
#: CRC of a space followed by n bytes, without their own.
_SPACE = zlib.crc32(b" ")


def _shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = _APPEND[n, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= _APPEND[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _crc_words(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.full(len(starts), _ZERO)
    capped = np.minimum(sizes, _SHORT + 1)
    order = np.argsort((_SHORT + 1 - capped).astype(np.uint8), kind="stable")
    ordered = capped[order]
    state, begin = crc[order], starts[order]
    long_ = int(np.searchsorted(-ordered, -_SHORT, side="left"))
    for j in range(int(min(_SHORT, ordered[long_] if long_ < len(ordered) else 0))):
        n = int(np.searchsorted(-ordered, -(j + 1), side="right"))
        state[long_:n] = _TABLE[(state[long_:n] ^ flat[begin[long_:n] + j]) & np.uint32(255)] ^ (state[long_:n] >> np.uint32(8))
    crc[order] = state ^ _ZERO
    for k in order[:long_]:
        crc[k] = zlib.crc32(flat[starts[k] : starts[k] + sizes[k]])
    return crc


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: words per text, and bucket and text of every feature."""
    low = texts.lower()
    starts, ends, first = low.spans(NON_ALNUM)
    sizes = ends - starts
    counts = np.diff(first)
    owner = owners(first)
    crc = _crc_words(low.flat, starts, sizes)
    short = np.minimum(sizes, _SHORT)
    spaced = _shift(np.full(len(crc), _SPACE, np.uint32), short) ^ crc  # a space and the word
    long_words = np.flatnonzero(sizes > _SHORT)
    runs, places = [crc], [owner]
    for n in range(1, LONGEST_RUN):
        at = np.flatnonzero(owner[n:] == owner[: max(0, len(owner) - n)]) if len(owner) > n else np.zeros(0, np.int64)
        former = np.zeros(len(crc), np.uint32)
        former[: len(runs[-1])] = runs[-1]
        made = np.zeros(len(crc), np.uint32)
        made[at] = _shift(former[at], short[at + n] + 1) ^ spaced[at + n]
        for k in long_words[long_words >= n]:
            made[k - n] = zlib.crc32(b" " + low.flat[starts[k] : ends[k]].tobytes(), int(former[k - n]))
        runs.append(made)
        places.append(at)
    return counts, np.concatenate([crc, *[r[at] for r, at in zip(runs[1:], places[1:])]]) % np.uint32(BUCKETS), np.concatenate([owner, *[owner[at] for at in places[1:]]])


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """text, key, copies: the stored different texts.  Null is a text of its own."""
    grouped = docs.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    return materialize(grouped.select(_key(F.col("text")).alias("key"), "copies", "text"), "texts")


def _key(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: how many features of all copies fall into each bucket.  A task adds up its
    own, so what moves is at most a row a bucket and task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for rows, block in blocks(batch.column(0)):
                _, bucket, owner = features(block)
                # a block's sums are far below 2^53, so exact, but for copies that are not
                times = copies[rows][owner]
                if len(times) and int(times.max()) * len(times) < 1 << 53:
                    total += np.bincount(bucket, weights=times, minlength=BUCKETS).astype(np.int64)
                else:
                    np.add.at(total, bucket, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return texts.select("text", "copies").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket in thousandths of a nat, rounded down."""
    spark = corpus.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = both.select("bucket", "s", "t").collect()  # a row a bucket
    s, t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        ratio = float(r["t"] + 1) * float(s + BUCKETS) / (float(r["s"] + 1) * float(t + BUCKETS))
        out[r["bucket"]] = math.floor(1000 * math.log(ratio))
    return out


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features, weight of the different texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, block in blocks(batch.column(2)):
                words[rows], bucket, owner = features(block)
                counts[rows] = np.bincount(owner, minlength=len(block))
                # sums of whole numbers, exact as long as they stay below 2^53
                weights[rows] = np.bincount(owner, weights=gain[bucket], minlength=len(block)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (words, counts, weights))], ["key", "copies", "n_words", "n_features", "weight"])

    return texts.select("key", "copies", "text").mapInArrow(task, "key binary, copies long, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from SHA-256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], eligible: str, percent: int = PERCENT) -> DataFrame:
    """The rows with column rank: 1, 2, 3 ... in the given order for the first ``percent`` of a
    hundred of those that are eligible, rounded down; null for all others.

    Rows are dealt by ranges of the order and stored sorted; a row's rank is the number of rows
    in the ranges before its own plus its place there, so no task sees them all.
    """
    spark = rows.sparkSession
    whole = [F.desc(eligible), *order]
    placed = rows.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(placed, "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"], r["e"]) for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col(eligible)).alias("e")).collect())
    before, offsets, total = 0, [], 0
    for p, n, e in sizes:
        offsets.append((p, before))
        before, total = before + n, total + e
    told = spark.createDataFrame(offsets, "_p long, _before long")
    # a row a partition
    joined = stored.withColumn("_p", part).join(F.broadcast(told), "_p")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return joined.withColumn("rank", F.when(place <= percent * total // 100, place)).drop("_at", "_p", "_before")


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document.

    A null or empty text has no words, no features and weight 0; a null id takes the noise of the
    empty one and comes behind others in ties.  Documents of fewer than 20 words are scored, but
    never drawn.  Repeated rows stay and are drawn one by one.  An empty corpus gives no rows; an
    empty target is smoothed like any.  Only the two named columns are read.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    texts = distinct_texts(rows, "text")
    aim = distinct_texts(target.select(F.col(text).alias("text")), "text")
    gain = gains(bucket_counts(texts), bucket_counts(aim))
    weights = materialize(weigh(texts, gain), "weights")
    keyed = rows.select("doc_id", _key(F.col("text")).alias("key"))
    met = keyed.join(F.broadcast(weights.drop("copies")), "key") if is_small(weights) else spread_join(keyed, weights, "key", ["doc_id"], count="copies")
    scored = materialize(met.drop("key").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    discard(scored.sparkSession, texts, aim, weights)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    out = ranked(scored.withColumn("_eligible", F.col("n_words") >= LEAST_WORDS), order, "_eligible", percent)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
