"""The stored search index: the relations, postings by term and statistics per corpus.

    meta.json                      key-values of the projection, with its fingerprint
    nodes/ sources/                relations; sources are numbered in order of path and line
    edges/                         the edges by either end
    postings/bucket=.../           corpus, term, doc, dl, col, first, positions; sorted by term
    corpora/                       corpus, documents, tokens

A query reads the buckets of its terms, and of those the row groups that hold them.  Texts are
cut into terms once, and the places of a term are gathered within their document, before rows
move; a bucket that very common terms make large is dealt over files.  The index is written to a
staging folder, checked there and published whole.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BLOCKED_PROJECTION, PlinthError
from ..functions.text import tokens
from ..operators import federation, search
from ..operators.fingerprint import content_sum, digest, fingerprint
from ..operators.integrity import require
from ..scratch import delete, read_text, write_text
from . import adjacency
from .adjacency import Adjacency
from .blocks import BLOCKS, dealt, packed
from .publish import publish

VERSION = "plinth.index.v2"
#: Postings that a bucket is to hold, and bytes of text that one stands for.
_BUCKET_ROWS, _POSTING_BYTES = 4 << 20, 6
#: Tokens whose places are gathered at once.
_MOST_TOKENS = 1 << 20
POSTINGS = "corpus string, term string, doc long, dl int, col string, first boolean, positions array<int>, bucket int"
RELATIONS = ("nodes", "edges", "sources", "postings", "corpora")
#: Fields that only the other kind of source authority may have.
_GIT_ONLY = {"source_commit", "created_from_authoritative_commit"}
AUTHORITY = ["format", "kind", "sha256", "subdir", "url"]


def build(relations: dict[str, DataFrame], target: str, *, meta: dict, corpus: str | None = None) -> str:
    """Writes the index of nodes, edges and sources and returns its fingerprint.

    ``corpus`` names the column of sources that tells corpora apart; without it all are one.
    """
    spark = relations["sources"].sparkSession
    staged = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        _write(spark, relations, staged, corpus)
        made = Index(spark, staged, checked=False)
        made.check_orphans()
        whole = {**{k: meta[k] for k in sorted(meta)}, "index_version": VERSION, "corpus": corpus}
        check_provenance(whole)
        print_ = made.fingerprint(whole)
        write_text(spark, f"{staged}/meta.json", json.dumps({**whole, "fingerprint": print_}, sort_keys=True))
        publish(spark, staged, target, replace=True)
    finally:
        delete(spark, staged)
    return print_


def _write(spark: SparkSession, relations: dict[str, DataFrame], folder: str, corpus: str | None) -> None:
    if "nodes" in relations:
        relations["nodes"].write.parquet(f"{folder}/nodes")
    if "edges" in relations:
        adjacency.build(relations["edges"], f"{folder}/edges")
    own = F.col(corpus).cast("string") if corpus else F.lit("")
    sources = relations["sources"]
    order = [c for c in ("source_path", "source_start_line", "id") if c in sources.columns]
    # rows that these don't tell apart get numbers by what they hold, so numbers follow the rows
    numbered = sources.orderBy(*order, F.xxhash64(*sources.columns)).withColumn("doc", F.monotonically_increasing_id())
    numbered.write.parquet(f"{folder}/sources")
    stored = spark.read.parquet(f"{folder}/sources")
    held = F.octet_length(F.coalesce("declaration_hint", F.lit(""))) + F.octet_length(F.coalesce("text", F.lit("")))
    size = stored.agg(F.sum(held.cast("long")).alias("n")).first()["n"] or 0
    buckets = max(8, -(-size // (_POSTING_BYTES * _BUCKET_ROWS)))
    posts = _postings(stored.withColumn("corpus", own), int(buckets))
    posts.sortWithinPartitions("bucket", "term", "doc", "col").write.partitionBy("bucket").parquet(f"{folder}/postings")
    write_text(spark, f"{folder}/buckets.json", json.dumps({"buckets": buckets}))
    parts = stored.select(own.alias("corpus"), F.lit(1).alias("d"), F.lit(0).alias("t"))
    if size:
        kept = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        parts = parts.unionAll(kept.select("corpus", F.lit(0), F.size("positions")))
    parts.groupBy("corpus").agg(F.sum("d").alias("documents"), F.sum("t").alias("tokens")).write.parquet(f"{folder}/corpora")


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per document, column and term, dealt by bucket; ``first`` marks one row of a
    document's term.  What moves are packed blocks, each of one bucket and some documents."""
    cut = docs.select("corpus", "doc", tokens(F.col("declaration_hint")).alias("h"), tokens(F.col("text")).alias("t"))
    blocks = cut.mapInArrow(lambda batches: _gather(batches, buckets), BLOCKS)
    return dealt(blocks, buckets, POSTINGS)


def _gather(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(sum(pc.list_value_length(batch[c]).to_numpy() for c in "ht"))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + _MOST_TOKENS, "right")))
            rows = _places(batch.slice(at, end - at), buckets)
            if rows.num_rows:
                yield packed(rows)
            at = end


def _places(docs: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The places of each document's terms, in order of bucket, term, document and column."""
    n = docs.num_rows
    encoded = pa.concat_arrays([docs[c].flatten() for c in "ht"]).dictionary_encode()
    bucket = np.array([zlib.crc32(t) % buckets for t in encoded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    code = encoded.indices.to_numpy().astype(np.int64)
    lengths = np.concatenate([pc.list_value_length(docs[c]).to_numpy() for c in "ht"])
    doc, col = np.repeat(np.tile(np.arange(n), 2), lengths), np.repeat(np.repeat([0, 1], n), lengths)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # stable: within a term and document the hint's places come first, all in order
    order = np.argsort((bucket[code] * len(bucket) + code) * n + doc, kind="stable")
    code, doc, col = code[order], doc[order], col[order]
    new = np.ones(len(code), bool)
    new[1:] = (np.diff(code) != 0) | (np.diff(doc) != 0)
    apart = new.copy()
    apart[1:] |= np.diff(col) != 0
    starts = np.flatnonzero(apart)
    offsets = np.append(starts, len(code)).astype(np.int32)
    code, doc, dl = code[starts], doc[starts], (lengths[:n] + lengths[n:]).astype(np.int32)
    made = {
        "corpus": docs["corpus"].take(pa.array(doc)), "term": encoded.dictionary.take(pa.array(code)), "doc": docs["doc"].take(pa.array(doc)), "dl": pa.array(dl[doc]),
        "col": pa.array(["declaration_hint", "text"]).take(pa.array(col[starts])), "first": pa.array(new[starts]),
        "positions": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[order].astype(np.int32))), "bucket": pa.array(bucket[code].astype(np.int32)),
    }
    return pa.RecordBatch.from_pydict(made)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def check_provenance(meta: dict) -> None:
    """Projections of a git source name a commit; those of an archive name its authority, and
    nothing in them is named like git's."""

    def fail(what: str):
        raise PlinthError(BLOCKED_PROJECTION, what)

    kind = meta.get("source_kind")
    if kind == "git":
        if not meta.get("source_commit") or "source_revision" in meta:
            fail("a git projection needs source_commit alone")
        if not isinstance(meta.get("created_from_authoritative_commit"), bool):
            fail("created_from_authoritative_commit must be a boolean")
    elif kind == "archive":
        if named := sorted(_GIT_ONLY & set(meta)):
            fail(f"an archive projection has fields of git: {', '.join(named)}")
        authority = meta.get("source_authority")
        if not isinstance(authority, dict) or sorted(authority) != AUTHORITY or authority["kind"] != "archive":
            fail("source_authority must be an exact archive object")
        if authority["sha256"] != meta.get("source_revision"):
            fail("source_revision differs from the archive")
        if not isinstance(meta.get("created_from_authoritative_source"), bool):
            fail("created_from_authoritative_source must be a boolean")
    else:
        fail(f"unknown source_kind {kind}")
    roots = meta.get("root_modules")
    if not isinstance(roots, list) or not all(isinstance(r, str) for r in roots):
        fail("root_modules must be a list of texts")
    for name in ("dependency_boundary", "producer_kind"):
        if not isinstance(meta.get(name), str):
            fail(f"{name} is missing")


class Index:
    """A published index.  ``checked=False`` opens one that is being built."""

    def __init__(self, spark: SparkSession, folder: str, *, checked: bool = True):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.meta: dict = {}
        if checked:
            text = read_text(spark, f"{self.folder}/meta.json")
            if text is None:
                raise PlinthError("UNAVAILABLE_PROJECTION", f"no index in {folder}")
            self.meta = json.loads(text)
            if self.meta.get("index_version") != VERSION:
                raise PlinthError(BLOCKED_PROJECTION, f"unknown index version {self.meta.get('index_version')}")
            check_provenance(self.meta)
        self.buckets = json.loads(read_text(spark, f"{self.folder}/buckets.json") or '{"buckets": 1}')["buckets"]

    @property
    def adjacency(self) -> Adjacency:
        """The edges by either end, for traversals."""
        return Adjacency(self.spark, f"{self.folder}/edges")

    def table(self, name: str) -> DataFrame:
        if name == "edges":
            return self.adjacency.edges
        if name == "postings":
            return self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in RELATIONS:
            return self.table(name)
        raise AttributeError(name)

    # ------------------------------------------------------------ checks

    def orphans(self, known: DataFrame | None = None) -> DataFrame:
        """Documents of postings that sources lack, or that ``known`` rows of it do."""
        rows = self.sources if known is None else known
        # 64 documents a word, so what moves doesn't grow with postings or buckets
        doc = F.coalesce("doc", F.lit(-1))
        words = self.postings.groupBy(F.shiftright(doc, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(coalesce(doc, -1) & 63 as int))")).alias("bits"))
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("bits", b) == 1)
        held = words.select("w", F.explode(bits).alias("b")).select((F.col("w") * 64 + F.col("b")).alias("doc"))
        return held.join(rows.select("doc"), "doc", "left_anti")

    def check_orphans(self) -> None:
        require(self.orphans().select(F.lit("orphan posting").alias("rule"), "doc"), BLOCKED_PROJECTION)

    def fingerprint(self, meta: dict | None = None) -> str:
        """Of the logical content: rows in any order and files of any layout give the same.
        Document numbers stand for the rows' places in their order."""
        parts = {name: fingerprint(self.table(name)).first()["fingerprint"] for name in ("nodes", "edges") if self._has(name)}
        parts["sources"] = fingerprint(self.sources.drop("doc")).first()["fingerprint"]
        parts["postings"] = content_sum(self._ranked_postings()).first()["fingerprint"]
        parts["corpora"] = fingerprint(self.corpora).first()["fingerprint"]
        own = {k: v for k, v in (self.meta if meta is None else meta).items() if k != "fingerprint"}
        return digest({"meta": own, "relations": parts})

    def _ranked_postings(self) -> DataFrame:
        """Postings with their document's place among sources: numbers begin anew in each file
        of sources, so a file's first place is all that is added."""
        part = F.shiftright("doc", 33)
        files = self.sources.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        before = list(accumulate((r["n"] for r in files), initial=0))
        rows = [(r["part"], n) for r, n in zip(files, before, strict=False)]
        places = self.spark.createDataFrame(rows, "part long, before long")
        posts = self.postings.drop("bucket").withColumn("part", part).join(F.broadcast(places), "part", "left")
        rank = F.col("before") + F.col("doc").bitwiseAND(F.lit((1 << 33) - 1))
        return posts.withColumn("doc", rank).drop("part", "before")

    def _has(self, name: str) -> bool:
        from ..scratch import hadoop

        path, system = hadoop(self.spark, f"{self.folder}/{name}")
        return system.exists(path)

    def verify(self) -> None:
        """Raises where the content is not what was published."""
        self.check_orphans()
        if self.fingerprint() != self.meta["fingerprint"]:
            raise PlinthError(BLOCKED_PROJECTION, "the index differs from its fingerprint")

    # ------------------------------------------------------------ reading

    def term_postings(self, terms: list[str]) -> DataFrame:
        """Postings of the terms: their buckets, and there their row groups."""
        terms = sorted(set(terms))
        pick = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(bucket_of(F.col("t"), self.buckets).alias("b"))
        buckets = sorted({r["b"] for r in pick.collect()})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def term_stats(self) -> DataFrame:
        """corpus, term, df (documents), cf (occurrences)."""
        return self.postings.groupBy("corpus", "term").agg(F.count_if("first").alias("df"), F.sum(F.size("positions")).alias("cf"))

    def scores(self, query: str, mode: str = "discovery", *, per_corpus: bool = False) -> DataFrame:
        """corpus, doc, score, n_terms of the matching documents, as a scan would give."""
        real = search.usable(query, mode)
        if not real:
            return self.spark.createDataFrame([], "corpus string, doc long, score double, n_terms int")
        rows = self.term_postings([t for p in real for t in p])
        held = rows.groupBy("corpus", "doc", "dl", "col").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
        none = F.array().cast("array<int>")
        places = lambda t: F.coalesce(F.try_element_at("m", F.lit(t)), none)

        def back(k: int):
            return lambda x: x - F.lit(k)

        def times(p: list[str]):
            first = places(p[0])
            for k, t in enumerate(p[1:], 1):
                first = F.array_intersect(first, F.transform(places(t), back(k)))
            return F.size(first)

        counts = held.select("corpus", "doc", "dl", *[times(p).alias(f"_f{i}") for i, p in enumerate(real)])
        names = [f"_f{i}" for i in range(len(real))]
        counted = counts.groupBy("corpus", "doc", F.col("dl").alias("_dl")).agg(*[F.sum(n).alias(n) for n in names])
        by = ["corpus"] if per_corpus else []
        sizes = self.corpora.groupBy(*by).agg(F.sum("documents").alias("_n"), F.sum("tokens").alias("_all"))
        found = counted.groupBy(*by).agg(*search.document_counts(len(real)))
        totals = sizes.join(found, by) if by else sizes.crossJoin(F.broadcast(found))
        return search.scored(counted, totals, len(real), mode, by, ["corpus", "doc"])

    def lexical(self, query: str, limit: int = search.DEFAULT_LIMIT, mode: str = "discovery") -> DataFrame:
        """The best ``limit`` rows of sources, as :func:`plinth.operators.search.lexical`;
        documents are numbered by path and line, so ties are told without reading them."""
        best = self.scores(query, mode).orderBy("score", "doc").limit(max(0, limit))
        # so few rows that their numbers are a filter of the scan
        rows = best.select("doc", "score", "n_terms").collect()
        told = self.spark.createDataFrame([tuple(r) for r in rows], "doc long, score double, n_terms int")
        hits = self.sources.where(F.col("doc").isin([r["doc"] for r in rows])).join(F.broadcast(told), "doc")
        return search.tagged(hits, query, mode).orderBy("score", "doc")

    def search(self, query: str, limit: int = search.DEFAULT_LIMIT, mode: str = "discovery") -> DataFrame:
        return search.search(self.nodes, self.sources, query, limit=limit, mode=mode, ranked=lambda *a: self.lexical(*a).drop("doc", "n_terms"))

    def federated(self, unavailable: DataFrame, query: str, *, limit: int = federation.DEFAULT_LIMIT, mode: str = "discovery") -> DataFrame:
        """Search over the corpora of this index, ranked within each."""
        corpus = self.meta["corpus"]
        rank = F.struct("score", "doc")
        scored = self.scores(query, mode, per_corpus=True)
        # only rows that can be among a corpus' best are read from sources
        from pyspark.sql import Window

        near = scored.withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy(rank))).where(F.col("r") <= limit).drop("r")
        scores = self.sources.join(F.broadcast(near.select("doc", "score", "n_terms")), "doc")
        return federation.federated(self.nodes, self.sources, unavailable, query, corpus=corpus, limit=limit, mode=mode, scores=scores.drop("doc"))
