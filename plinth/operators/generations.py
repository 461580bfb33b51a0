"""Published generations: immutable snapshots, a guarded READY step and compare-and-swap.

A generation is a folder.  Writers stage rows under a name of their own; READY freezes the list
of staged tables that it counted in a marker, and readers read just those.  So a writer that
is there before READY is in it, and one that comes later is not, whatever it still writes.
Markers and pointers are entries of a commit log: they come whole and once, and a writer that
dies on the way blocks nobody.  The active generation is the highest numbered pointer, so of two
writers who saw the same predecessor one loses.  With READY a generation gets its term index,
and searches read that alone.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import is_hex64
from ..scratch import delete, hadoop
from . import termindex
from .commitlog import CommitLog
from .termindex import TermIndex

SCHEMA_VERSION, FOLDED_VERSION = "plinth.query.v1", "plinth.query.v2"
MOST_CHARS, MOST_TERMS, MOST_ROWS = 512, 16, 100
#: What a corpus of a generation may be.
AVAILABILITY = ["SEARCHABLE", "UNAVAILABLE"]


class StateError(ValueError):
    """A step that the state machine does not allow."""


class InputError(ValueError):
    """A query outside its bounds."""


@dataclass(frozen=True)
class Version:
    """How texts and queries of one schema version are cut into terms."""

    words: Callable[[Column], Column]
    terms: Callable[[str], list[str]]


#: A generation keeps the terms of its version for good; new versions are added beside it.
VERSIONS: dict[str, Version] = {
    SCHEMA_VERSION: Version(termindex.words, lambda q: [t for t in re.split(r"[^\w]+", q.strip().lower()) if t]),
    # without diacritics, cut at every character that is no letter or digit
    FOLDED_VERSION: Version(lambda c: F.array_distinct(tx.tokens(c)), tx.token_list),
}


def version_of(name: str) -> Version:
    if name not in VERSIONS:
        raise StateError(f"unknown schema version {name}")
    return VERSIONS[name]


def check_input(query: str | None, limit: int, mode: str, version: str = SCHEMA_VERSION) -> list[str]:
    """The terms of a query within the server's bounds."""
    if query is None or not query.strip() or len(query) > MOST_CHARS:
        raise InputError("query must have 1..512 characters")
    terms = version_of(version).terms(query)
    if not terms or len(terms) > MOST_TERMS:
        raise InputError("query must have 1..16 terms")
    if limit is None or not 1 <= limit <= MOST_ROWS:
        raise InputError("limit must be 1..100")
    if mode not in ("discovery", "evidence"):
        raise InputError("unknown mode")
    return terms


def generation_hits(docs: DataFrame, query: str, limit: int = 20, mode: str = "discovery", version: str = SCHEMA_VERSION) -> DataFrame:
    """Rows of one generation that hold any (discovery) or all (evidence) terms or are exactly
    the query, without ranking, by one pass over the texts; a frozen generation has an index.

    Exact rows come first, then the others, and rows whose exact identity is null last; among
    each by corpus and candidate.  So it is for the limit and in the result.
    """
    terms = check_input(query, limit, mode, version)
    have = version_of(version).words(F.col("body_text"))
    want = F.array(*[F.lit(t) for t in terms])
    lexical = F.arrays_overlap(have, want) if mode == "discovery" else F.size(F.array_except(want, have)) == 0
    # null where neither is the query and the identity is null
    exact = (F.col("exact_identity") == query) | (F.col("candidate_id") == query)
    rows = docs.where(lexical | F.coalesce(exact, F.lit(False))).withColumn("is_exact", exact)
    rows = rows.withColumn("match_kind", F.when(F.col("is_exact"), "exact").otherwise("lexical"))
    return rows.orderBy(F.desc_nulls_last("is_exact"), "source_id", "candidate_id").limit(limit)


def availability(corpora: DataFrame) -> DataFrame:
    """One row per generation: searchable corpora, and the unavailable ones in order."""
    gone = F.when(F.col("availability") == "UNAVAILABLE", F.struct("source_id", "unavailable_reason"))
    return corpora.groupBy("generation_id").agg(F.count_if(F.col("availability") == "SEARCHABLE").alias("searchable"), F.array_sort(F.collect_list(gone)).alias("unavailable"))


def corpus_violations(corpora: DataFrame, docs: DataFrame) -> DataFrame:
    """rule, key of what breaks the keys and references of a generation's tables."""
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))
    keys = ["generation_id", "source_id"]
    twice = corpora.groupBy(*keys).count().where("count > 1")
    again = docs.groupBy(*keys, "candidate_id").count().where("count > 1")
    digests = [c for c in ("artifact_sha256", "source_descriptor_sha256") if c in corpora.columns]
    bad = ~F.col("availability").isin(AVAILABILITY)
    for c in digests:
        bad = bad | ~is_hex64(F.coalesce(F.col(c), F.lit("")))
    return (
        row(twice, "corpus occurs twice", F.col("source_id")).unionAll(row(again, "candidate occurs twice", F.col("candidate_id")))
        .unionAll(row(docs.join(corpora.select(*keys).distinct(), keys, "left_anti"), "document without corpus", F.col("candidate_id")))
        .unionAll(row(corpora.where(bad), "corpus is malformed", F.col("source_id"))).unionAll(row(docs.where("source_line <= 0"), "line is not positive", F.col("candidate_id")))
    )


def envelope_hits(docs: DataFrame, term: str, limit: int = 10, *, descending: bool = False, listed: bool = True) -> DataFrame:
    """One row: all candidates whose text holds the term, in order and joined by commas, and the
    first ``limit`` of them as a list; that alone without ``listed``.

    Bounds: 64 characters, 4 words, 10 results.
    """
    if not term or not term.strip() or len(term) > 64 or len(term.split()) > 4:
        raise InputError("term must have 1..64 characters and 1..4 words")
    if limit is None or not 1 <= limit <= 10:
        raise InputError("limit must be 1..10")
    order = F.desc("candidate_id") if descending else F.asc("candidate_id")
    rows = docs.where(F.contains("body_text", F.lit(term))).select("candidate_id").where("candidate_id is not null")
    first = rows.orderBy(order).limit(limit)
    hits = first.agg(F.sort_array(F.collect_list("candidate_id"), asc=not descending).alias("hits"))
    if not listed:
        return hits
    # ranges of the order are joined by themselves; only their texts meet
    placed = rows.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    parts = placed.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("candidate_id"), asc=not descending), ",").alias("text"))
    whole = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), ",").alias("listed"))
    return whole.crossJoin(F.broadcast(hits))


class Store:
    """Generations under one root folder."""

    def __init__(self, spark: SparkSession, root: str, *, log: CommitLog | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = log or CommitLog(spark, self.root)

    def _path(self, name: str):
        return hadoop(self.spark, f"{self.root}/{name}")

    def begin(self, generation: str, content: str, catalog: str, version: str = SCHEMA_VERSION) -> None:
        """A new generation; its identity never changes."""
        if not self.log.create(f"{generation}/meta.json", {"generation_id": generation, "generation_content_sha256": content, "catalog_sha256": catalog, "projection_schema_version": version}):
            raise StateError("generation exists")

    def state(self, generation: str) -> str | None:
        if self.log.read(f"{generation}/meta.json") is None:
            return None
        return "READY" if self.log.read(f"{generation}/ready.json") else "BUILDING"

    def write(self, generation: str, table: str, rows: DataFrame, *, attempt: str | None = None) -> None:
        """Stages rows of a BUILDING generation.  A named attempt that is made again replaces
        what it staged before.  Raises if the generation became READY without the rows."""
        if self.state(generation) != "BUILDING":
            raise StateError("only a BUILDING generation takes rows")
        other = rows.where(~F.col("generation_id").eqNullSafe(F.lit(generation)))
        if not other.isEmpty():
            raise StateError("rows belong to another generation")
        name = attempt or uuid.uuid4().hex
        staged, fs = self._path(f"{generation}/.staged/{name}")
        rows.write.mode("overwrite").parquet(f"{self.root}/{generation}/.staged/{name}")
        place, _ = self._path(f"{generation}/{table}/{name}")
        fs.mkdirs(place.getParent())
        fs.delete(place, True)
        if not fs.rename(staged, place):
            raise OSError("rows can't be put in place")
        ready = self.log.read(f"{generation}/ready.json")
        if ready is not None and name not in ready["tables"].get(table, []):
            fs.delete(place, True)
            raise StateError("the generation became READY without these rows")

    def table(self, generation: str, table: str) -> DataFrame:
        """The frozen rows of a READY generation, or all staged ones of a BUILDING one."""
        ready = self.log.read(f"{generation}/ready.json")
        names = self.log.names(f"{generation}/{table}") if ready is None else ready["tables"].get(table, [])
        if not names:
            raise StateError(f"generation has no {table}")
        return self.spark.read.parquet(*[f"{self.root}/{generation}/{table}/{n}" for n in names])

    def mark_ready(self, generation: str, catalog: str, corpora: int) -> None:
        """Freezes a BUILDING generation with just so many corpora and sound references."""
        if self.state(generation) != "BUILDING":
            raise StateError("generation is not BUILDING")
        if self.log.read(f"{generation}/meta.json")["catalog_sha256"] != catalog:
            raise StateError("catalog differs")
        tables = {t: self.log.names(f"{generation}/{t}") for t in ("corpora", "search_docs")}
        read = lambda t: self.spark.read.parquet(*[f"{self.root}/{generation}/{t}/{n}" for n in tables[t]])
        found = read("corpora").count() if tables["corpora"] else 0
        if corpora is None or corpora < 1 or found != corpora:
            raise StateError(f"{found} corpora instead of {corpora}")
        if tables["search_docs"] and (bad := corpus_violations(read("corpora"), read("search_docs")).first()) is not None:
            raise StateError(f"{bad['rule']}: {bad['key']}")
        index = self._index(generation, tables["search_docs"], read) if tables["search_docs"] else None
        if not self.log.create(f"{generation}/ready.json", {"ready_at": time.time(), "tables": tables, "index": index}):
            if index is not None:
                delete(self.spark, f"{self.root}/{generation}/{index['name']}")
            raise StateError("generation is READY already")

    def _index(self, generation: str, names: list[str], read: Callable[[str], DataFrame]) -> dict:
        """The term index of the rows that are about to be frozen, in a folder of its own."""
        name = f".index-{uuid.uuid4().hex}"
        version = version_of(self.log.read(f"{generation}/meta.json")["projection_schema_version"])
        return {"name": name, **termindex.build(read("search_docs"), f"{self.root}/{generation}/{name}", words=version.words)}

    def active(self) -> str | None:
        names = self.log.names("active")
        return self.log.read(f"active/{names[-1]}")["generation_id"] if names else None

    def activate(self, generation: str, previous: str | None) -> None:
        """Makes a READY generation active if ``previous`` still is; raises for the loser."""
        if self.state(generation) != "READY":
            raise StateError("candidate is not READY")
        names = self.log.names("active")
        now = self.log.read(f"active/{names[-1]}")["generation_id"] if names else None
        if now != previous or not self.log.create(f"active/{int(names[-1][:12]) + 1 if names else 0:012d}.json", {"generation_id": generation}):
            raise StateError("stale activation")

    def try_activate(self, generation: str, previous: str | None) -> bool:
        try:
            self.activate(generation, previous)
        except StateError:
            return False
        return True

    def reference(self, generation: str, holder: str) -> None:
        """Keeps a generation from being collected."""
        if self.state(generation) is None:
            raise StateError("generation does not exist")
        self.log.create(f"references/{generation}/{holder}.json", {"holder": holder})

    def collect_garbage(self, generation: str, content: str) -> None:
        """Deletes a READY generation that is neither active nor referenced."""
        if self.state(generation) != "READY" or self.active() == generation or self.log.names(f"references/{generation}"):
            raise StateError("generation is in use or not READY")
        if self.log.read(f"{generation}/meta.json")["generation_content_sha256"] != content:
            raise StateError("content differs")
        path, fs = self._path(generation)
        fs.delete(path, True)

    def try_collect(self, generation: str, content: str) -> bool:
        try:
            self.collect_garbage(generation, content)
        except StateError:
            return False
        return True

    def search(self, query: str, limit: int = 20, mode: str = "discovery", generation: str | None = None) -> DataFrame:
        """One envelope row of a READY generation (the active one if none is named): metadata,
        availability and hits, all from the same immutable snapshot."""
        check_input(query, limit, mode)
        generation = generation or self.active()
        if generation is None or self.state(generation) != "READY":
            raise StateError("no READY generation")
        meta = self.log.read(f"{generation}/meta.json")
        hits = self.hits(generation, query, limit, mode)
        later = F.when(F.col("is_exact"), 0).when(F.col("is_exact").isNull(), 2).otherwise(1)
        packed = F.sort_array(F.collect_list(F.struct(later.alias("later"), "source_id", "candidate_id", "match_kind", "declaration_id", "source_row_id", "source_path", "source_line")))
        corpora = availability(self.table(generation, "corpora")).drop("generation_id")
        named = [F.lit(meta[k]).alias(k) for k in ("generation_id", "catalog_sha256", "generation_content_sha256", "projection_schema_version")]
        return self.spark.range(1).select(*named).crossJoin(corpora).crossJoin(hits.agg(packed.alias("hits")))

    def hits(self, generation: str, query: str, limit: int = 20, mode: str = "discovery") -> DataFrame:
        """The hits of a READY generation, cut into terms as its version has it."""
        version = self.log.read(f"{generation}/meta.json")["projection_schema_version"]
        terms = check_input(query, limit, mode, version)
        index = (self.log.read(f"{generation}/ready.json") or {}).get("index")
        if index is None:  # frozen without documents, or not yet
            return generation_hits(self.table(generation, "search_docs"), query, limit, mode, version)
        found = TermIndex(self.spark, f"{self.root}/{generation}/{index['name']}", index["buckets"])
        return found.hits(query, terms, limit, mode)

    def search_all(self, generations: list[str], query: str, limit: int = 20, mode: str = "discovery") -> DataFrame:
        """Hits of several READY generations, each by the terms of its own version: columns
        generation_id and projection_schema_version with those of :meth:`hits`."""
        out: DataFrame | None = None
        for g in generations:
            if self.state(g) != "READY":
                raise StateError(f"{g} is not READY")
            version = self.log.read(f"{g}/meta.json")["projection_schema_version"]
            rows = self.hits(g, query, limit, mode).withColumns({"generation_id": F.lit(g), "projection_schema_version": F.lit(version)})
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise StateError("no generation")
        return out

    def envelope(self, term: str, limit: int = 10) -> DataFrame:
        """One row: metadata and availability of the active generation with the candidates
        that hold the term; none while nothing is active."""
        active = self.active()
        if active is None:
            return self.spark.createDataFrame([], "generation_id string, hits array<string>")
        meta = self.log.read(f"{active}/meta.json")
        named = [F.lit(meta[k]).alias(k) for k in ("generation_id", "catalog_sha256", "generation_content_sha256", "projection_schema_version")]
        corpora = availability(self.table(active, "corpora")).drop("generation_id")
        hits = envelope_hits(self.table(active, "search_docs"), term, limit, listed=False)
        return self.spark.range(1).select(*named).join(F.broadcast(corpora), F.lit(True), "left").crossJoin(hits)

    def status(self) -> dict:
        """The active generation with its metadata; all null before the first activation."""
        active = self.active()
        meta = self.log.read(f"{active}/meta.json") if active else {}
        return {"active": active, "state": self.state(active) if active else None, **{k: meta.get(k) for k in ("catalog_sha256", "generation_content_sha256", "projection_schema_version")}}
