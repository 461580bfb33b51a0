"""Boolean posting lists of a frozen generation.

    docs/                 the documents, numbered and sorted in order of corpus and candidate
    blocks/bucket=.../    term, named, span, n, docs: per term and span of documents its sorted
                          document numbers; sorted by term and span

A span is a fixed run of document numbers, the same for all terms, so lists meet span by span:
they are merged (any term) or intersected (every term) in order of the documents, which is the
order of the result, and reading stops once the limit is reached.  Lists of documents with and
without an exact identity are apart, as the latter come last.  What a row is exactly, its
identity and its candidate, are lists too, under names that no word has.

A query reads the buckets of its terms only.  Texts are cut once, and lists move as packed blocks
of some documents; they are put together by bucket and part of the documents, so neither a task nor
a file holds all of a term of very many documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import hadoop

WORD_BREAK = r"[^\p{L}\p{N}_]+"
#: Before exact keys; no word begins with it.
_EXACT = "="
#: Documents of a span, postings that a bucket or a file is to hold, and spans read at first
#: when lists are intersected.
_SPAN, _BUCKET_ROWS, _FIRST_SPANS = 1 << 16, 4 << 20, 8
#: Spans of a part: lists of a bucket are put together in parts, so no task holds all of a hot
#: term.  Bytes of text that a posting stands for, and lists that are handed over at once.
_PART_SPANS, _POSTING_BYTES, _MOST_LISTS = 16, 8, 1 << 14
BLOCKS = "term string, named boolean, span long, n long, docs array<long>, bucket int"


def words(text: Column) -> Column:
    """The different lower-cased words of a text; null has none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)), "")


def build(docs: DataFrame, folder: str, *, words: Callable[[Column], Column] = words, span: int = _SPAN, bucket_rows: int = _BUCKET_ROWS) -> dict:
    """Writes the index of one generation's rows and returns what a reader needs of it.

    Rows may repeat and any column may be null.  ``words`` cuts a text into its terms.
    """
    spark = docs.sparkSession
    order = ["source_id", "candidate_id"]
    # ids of the sorted partitions ascend in the order of the rows
    docs.orderBy(*order).withColumn("doc", F.monotonically_increasing_id()).write.parquet(f"{folder}/docs")
    stored = spark.read.parquet(f"{folder}/docs")
    keys = F.array_compact(F.array(*[F.concat(F.lit(_EXACT), F.col(c)) for c in ("exact_identity", "candidate_id")]))
    size = stored.agg(F.sum(F.octet_length(F.coalesce("body_text", F.lit(""))).cast("long")).alias("bytes"), F.count("*").alias("docs")).first()
    buckets = int(max(8, -(-((size["bytes"] or 0) // _POSTING_BYTES + 2 * size["docs"]) // bucket_rows)))
    cut = stored.select("doc", F.col("exact_identity").isNotNull().alias("named"), F.concat(words(F.col("body_text")), F.array_distinct(keys)).alias("terms"))
    cut = cut.withColumn("buckets", F.transform("terms", lambda t: bucket_of(t, buckets)))
    moved = cut.mapInArrow(lambda batches: _gather(batches, span * _PART_SPANS), "bucket int, part long, block binary")
    spread = moved.repartition(min(buckets, 20_000), "bucket", "part").sortWithinPartitions("bucket", "part")
    blocks = spread.mapInArrow(lambda batches: _merge(batches, span), BLOCKS)
    blocks.sortWithinPartitions("bucket", "term", "named", "span").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    total = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").agg(F.sum("n").alias("n")).first()["n"] or 0
    return {"buckets": buckets, "postings": int(total)}


def _gather(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the lists that a batch's documents have, each of one bucket and of one part of
    ``width`` document numbers: term, named and the numbers, as differences."""
    for batch in batches:
        lengths = pc.list_value_length(batch["terms"]).to_numpy()
        encoded = batch["terms"].flatten().dictionary_encode()
        if not len(encoded):
            continue
        code, bucket = encoded.indices.to_numpy(), batch["buckets"].flatten().to_numpy()
        doc = np.repeat(batch["doc"].to_numpy(), lengths)
        named, part = np.repeat(batch["named"].to_numpy(zero_copy_only=False), lengths), doc // width
        order = np.lexsort((doc, named, code, part, bucket))
        code, bucket, doc, named, part = (x[order] for x in (code, bucket, doc, named, part))
        group = _starts(bucket, part)
        for a, b in zip(group, [*group[1:], len(code)], strict=True):
            first = _starts(code[a:b], named[a:b])
            step = pa.array(np.diff(doc[a:b], prepend=0))
            docs = pa.ListArray.from_arrays(pa.array(np.append(first, b - a).astype(np.int32)), step)
            rows = pa.RecordBatch.from_pydict({"term": encoded.dictionary.take(pa.array(code[a:b][first])), "named": pa.array(named[a:b][first]), "docs": docs})
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(rows)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[a])], pa.int32()), "part": pa.array([int(part[a])], pa.int64()), "block": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _merge(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """The lists by spans, of blocks in order of bucket and part."""
    rows = ((b, p, x) for batch in batches for b, p, x in zip(batch["bucket"].to_pylist(), batch["part"].to_pylist(), batch["block"], strict=True))
    for (bucket, _), group in groupby(rows, key=lambda r: r[:2]):
        held = [part for _, _, x in group for part in pa.ipc.open_stream(x.as_buffer())]
        encoded = pa.concat_arrays([x["term"] for x in held]).dictionary_encode()
        lengths = np.concatenate([pc.list_value_length(x["docs"]).to_numpy() for x in held])
        doc = np.concatenate([np.cumsum(x["docs"].flatten().to_numpy()) for x in held])
        code = np.repeat(encoded.indices.to_numpy(), lengths)
        named = np.repeat(np.concatenate([x["named"].to_numpy(zero_copy_only=False) for x in held]), lengths)
        order = np.lexsort((doc, named, code))
        code, doc, named = code[order], doc[order], named[order]
        first = _starts(code, named, doc // span)
        offsets = np.append(first, len(doc)).astype(np.int32)
        made = {
            "term": encoded.dictionary.take(pa.array(code[first])), "named": pa.array(named[first]), "span": pa.array(doc[first] // span), "n": pa.array(np.diff(offsets).astype(np.int64)),
            "docs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc)), "bucket": pa.array(np.full(len(first), bucket, np.int32)),
        }
        whole = pa.RecordBatch.from_pydict(made)
        yield from (whole.slice(k, _MOST_LISTS) for k in range(0, whole.num_rows, _MOST_LISTS))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TermIndex:
    """A stored index.  Queries bring at most ``limit`` rows a list to the driver."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def exists(self) -> bool:
        path, fs = hadoop(self.spark, f"{self.folder}/blocks")
        return fs.exists(path)

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/docs")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/blocks")

    def lists(self, terms: list[str]) -> DataFrame:
        """Blocks of the terms' lists: their buckets, and there their row groups."""
        known = self.spark.range(1).select(F.explode(F.array(*[bucket_of(F.lit(t), self.buckets) for t in sorted(set(terms))])).alias("b"))
        buckets = sorted({r["b"] for r in known.collect()})
        return self.blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(sorted(set(terms))))

    def first_of_any(self, terms: list[str], limit: int, *, named_first: bool = True) -> list[tuple[bool, int]]:
        """(named, doc) of the first documents that any list has, with an identity first or in
        their own order.

        The leading blocks of each list that hold ``limit`` documents between them are enough.
        """
        blocks = self.lists(terms)
        order = Window.partitionBy("term", "named").orderBy("span")
        # every block holds a document, so ``limit`` blocks of a list are enough
        lead = blocks.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("term", "named", "span", "n").collect()
        spans, held = set(), defaultdict(int)
        for r in sorted(lead, key=lambda r: r["span"]):
            if held[r["term"], r["named"]] < limit:
                held[r["term"], r["named"]] += r["n"]
                spans.add(r["span"])
        if not spans:
            return []
        found = blocks.where(F.col("span").isin(sorted(spans))).select("named", F.explode(F.slice("docs", 1, limit)).alias("doc")).distinct()
        order = [F.desc("named"), F.asc("doc")] if named_first else [F.asc("doc")]
        return [(r["named"], r["doc"]) for r in found.orderBy(*order).limit(limit).collect()]

    def first_of_all(self, terms: list[str], limit: int) -> list[tuple[bool, int]]:
        """(named, doc) of the first documents that every list has, with an identity first.

        Spans that all lists share are met in order, more of them each time, until there are
        enough documents.
        """
        blocks, found, last, many = self.lists(terms), [], None, _FIRST_SPANS
        wanted = len(set(terms))
        shared = blocks.groupBy("named", "span").agg(F.count("*").alias("c")).where(F.col("c") == wanted).select("named", "span")
        while len(found) < limit:
            rest = shared if last is None else shared.where((F.col("named") < F.lit(last[0])) | ((F.col("named") == F.lit(last[0])) & (F.col("span") > last[1])))
            batch = [(r["named"], r["span"]) for r in rest.orderBy(F.desc("named"), "span").limit(many).collect()]
            if not batch:
                break
            picked = blocks.where(F.col("span").isin(sorted({s for _, s in batch})) & F.struct("named", "span").isin([F.struct(F.lit(n), F.lit(s).cast("long")) for n, s in batch]))
            both = picked.groupBy("named", "span").agg(F.collect_list("docs").alias("d"))
            met = both.select("named", F.explode(F.aggregate(F.slice("d", 2, wanted), F.col("d")[0], F.array_intersect)).alias("doc"))
            found += [(r["named"], r["doc"]) for r in met.orderBy(F.desc("named"), "doc").limit(limit - len(found)).collect()]
            last, many = batch[-1], many * 8
        return found[:limit]

    def hits(self, query: str, terms: list[str], limit: int, mode: str) -> DataFrame:
        """What a scan of the documents would give: see
        :func:`plinth.operators.generations.generation_hits`."""
        exact = [d for _, d in self.first_of_any([_EXACT + query], limit, named_first=False)]
        first = self.first_of_any if mode == "discovery" else self.first_of_all
        # an exact row may be among the others too
        other = [(named, d) for named, d in first(terms, limit + len(exact)) if d not in set(exact)]
        exact = sorted(exact)[:limit]
        rest = sorted(other, key=lambda x: (not x[0], x[1]))[: limit - len(exact)]
        told = [(d, True) for d in exact] + [(d, False if named else None) for named, d in rest]
        rows = self.docs.where(F.col("doc").isin([d for d, _ in told]))
        marks = self.spark.createDataFrame(told, "doc long, is_exact boolean")
        kind = F.when(F.col("is_exact"), "exact").otherwise("lexical")
        return rows.join(F.broadcast(marks), "doc").withColumn("match_kind", kind).orderBy(F.desc_nulls_last("is_exact"), "doc").drop("doc")
