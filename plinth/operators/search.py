"""Exact lookup and ranked lexical search.

Over a table without an index, one pass counts each phrase of the query per document,
statistics are one partially aggregated row per corpus, and ranking is a top-k.  Over a
stored index (:mod:`plinth.sources.index`) only the postings of the query's terms are read;
counts, scores and hits are then the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_path, phrases, query_terms, tokens
from ..schemas import LEXICAL_HIT

#: Fixed values of the ranking formula.
K1, B, FLOOR = 1.2, 0.75, 1e-6
DEFAULT_LIMIT = 10
MODES = ("discovery", "evidence")


def postings(sources: DataFrame, *, key="id", hint="declaration_hint", text="text") -> DataFrame:
    """key, col, pos, term for every token of both indexed columns."""
    parts = [sources.select(key, F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in (hint, text) if c]
    return reduce(DataFrame.unionAll, parts)


def doc_lengths(posts: DataFrame, key="id") -> DataFrame:
    return posts.groupBy(key).agg(F.count("*").alias("dl"))


def term_stats(posts: DataFrame, key="id") -> DataFrame:
    """term, df (documents), cf (occurrences)."""
    per = posts.groupBy("term", key).agg(F.count("*").alias("f"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf"))


def _occurrences(toks: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    want, n = F.array(*[F.lit(t) for t in phrase]), len(phrase)
    starts = F.filter(F.transform(toks, lambda t, i: F.when(t == phrase[0], i)), lambda i: i.isNotNull())
    return F.size(F.filter(starts, lambda i: F.slice(toks, i + 1, n) == want))


def match_mode(query: str, mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"search mode must be one of {MODES}")
    n = len(query_terms(query))
    return "single_term" if n == 1 else "any_terms" if mode == "discovery" else "all_terms"


def score(sources: DataFrame, query: str, mode: str = "discovery", *, hint: str | None = "declaration_hint", text="text", corpus: str | None = None) -> DataFrame:
    """Matching rows with score (lower is better) and n_terms, the phrases that matched.

    With ``corpus``, all statistics are per value of that column.  A repeated word counts
    twice; a word without tokens matches nothing and so leaves an evidence query empty.
    """
    real = usable(query, mode)
    if not real:
        return sources.withColumns({"score": F.lit(0.0), "n_terms": F.lit(0)}).where("false")
    columns = [c for c in (hint, text) if c]
    toks = sources.withColumns({f"_t{k}": tokens(F.col(c)) for k, c in enumerate(columns)})
    # an exploded one-element array keeps the token arrays from being made once per phrase
    packed = toks.select(*sources.columns, F.explode(F.array(F.struct(*[F.col(f"_t{k}") for k in range(len(columns))]))).alias("_t"))
    size = reduce(Column.__add__, [F.size(f"_t._t{k}") for k in range(len(columns))])
    hits = [reduce(Column.__add__, [_occurrences(F.col(f"_t._t{k}"), p) for k in range(len(columns))]) for p in real]
    counted = packed.select(*sources.columns, size.alias("_dl"), *[h.alias(f"_f{i}") for i, h in enumerate(hits)])
    by = [corpus] if corpus else []
    totals = counted.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_dl").alias("_all"), *document_counts(len(real)))
    return scored(counted, totals, len(real), mode, by, sources.columns)


def document_counts(n: int) -> list[Column]:
    """Per phrase the documents that hold it."""
    return [F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(n)]


def scored(counted: DataFrame, totals: DataFrame, n: int, mode: str, by: list[str], columns: list[str]) -> DataFrame:
    """Score and n_terms of the matching rows.

    ``counted`` has _dl and the counts _f0.. of the phrases; ``totals``, one row per corpus,
    _n documents, _all tokens and _d0.. documents that hold a phrase.
    """
    matched = [F.col(f"_f{i}") > 0 for i in range(n)]
    keep = reduce(Column.__and__ if mode == "evidence" else Column.__or__, matched)
    rows = counted.where(keep)
    rows = rows.join(F.broadcast(totals), by) if by else rows.crossJoin(F.broadcast(totals))
    mean = F.col("_all") / F.col("_n")
    total = F.lit(0.0)
    for i in range(n):
        f, d = F.col(f"_f{i}").cast("double"), F.col(f"_d{i}").cast("double")
        idf = F.log((F.col("_n") - d + F.lit(0.5)) / (d + F.lit(0.5)))
        idf = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)
        total = total + idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / mean))
    return rows.select(*columns, (-total).alias("score"), reduce(Column.__add__, [m.cast("int") for m in matched]).alias("n_terms"))


def usable(query: str, mode: str) -> list[list[str]]:
    """The query's phrases that have tokens; none if nothing can match."""
    match_mode(query, mode)
    found = phrases(query)
    real = [p for p in found if p]
    return [] if mode == "evidence" and len(real) < len(found) else real


def tagged(rows: DataFrame, query: str, mode: str) -> DataFrame:
    return rows.withColumns({"query_mode": F.lit(mode), "match_mode": F.lit(match_mode(query, mode)), "evidence_grade": F.lit(LEXICAL_HIT)})


def lexical(sources: DataFrame, query: str, *, limit: int = DEFAULT_LIMIT, mode: str = "discovery", **columns) -> DataFrame:
    """The best ``limit`` rows, by score, then path and start line."""
    return tagged(score(sources, query, mode, **columns), query, mode).orderBy("score", "source_path", "source_start_line").limit(max(0, limit))


HIT = [
    "declaration_id", "source_row_id", "declaration_hint", "source_revision", "source_path", "source_start_line", "source_end_line", "evidence_grade", "query_mode", "match_mode", "score", "text",
]


def exact_hit(nodes: DataFrame, sources: DataFrame, ident: str, mode: str) -> DataFrame:
    """One row: the declaration with the place and text of its chunk, or its own place."""
    from .binding import node_to_chunk

    node = nodes.where(F.col("id") == ident)
    first = node.select(F.coalesce("source_path", module_path(F.col("module"))).alias("p")).first()
    near = sources.where(F.col("source_path") == first["p"])
    chunk = node_to_chunk(node, near).where("chunk_id is not null")
    columns = ["source_revision", "source_path", "source_start_line", "source_end_line", "declaration_hint", "text"]
    at = near.select(F.col("id").alias("chunk_id"), *[F.col(c).alias("c_" + c) for c in columns])
    row = node.join(chunk.drop("tier").join(at, "chunk_id"), "id", "left")
    has = F.col("chunk_id").isNotNull()
    of = lambda c, else_: F.when(has, F.col("c_" + c)).otherwise(else_).alias(c)
    places = [of(c, F.col(c)) for c in ("source_path", "source_start_line", "source_end_line", "source_revision")]
    return row.select(
        F.col("id").alias("declaration_id"), F.col("chunk_id").alias("source_row_id"), of("declaration_hint", F.col("name")), *places, of("text", F.lit(None)),
        F.lit(LEXICAL_HIT).alias("evidence_grade"), F.lit(mode).alias("query_mode"), F.lit("exact").alias("match_mode"), F.lit(0.0).alias("score"),
    ).select(*HIT)


def search(nodes: DataFrame, sources: DataFrame, query: str, *, limit: int = DEFAULT_LIMIT, mode: str = "discovery", ranked: Callable[[str, int, str], DataFrame] | None = None) -> DataFrame:
    """The exact declaration alone if the query resolves to one, else lexical hits with the
    declarations they stand for.  ``ranked`` gives the hits of a stored index."""
    from .binding import hit_to_declaration
    from .resolve import one

    match_mode(query, mode)
    exact = one(nodes, query, search=True, soft=True) if limit > 0 else None
    if exact is not None:
        return exact_hit(nodes, sources, exact, mode)
    hits = ranked(query, limit, mode) if ranked else lexical(sources, query, limit=limit, mode=mode)
    return hit_to_declaration(hits.withColumnRenamed("id", "source_row_id"), nodes).select(*HIT).orderBy("score", "source_path", "source_start_line")


def search_status(hits: DataFrame) -> DataFrame:
    """One row: UNKNOWN without hits, FOUND in evidence mode or for exact hits only, else
    CANDIDATE."""
    n = F.count("*")
    sure = F.bool_and((F.col("query_mode") == "evidence") | (F.col("match_mode") == "exact"))
    return hits.agg(F.when(n == 0, "UNKNOWN").when(sure, "FOUND").otherwise("CANDIDATE").alias("status"), n.alias("n_hits"))


def unique_paths(hits: DataFrame) -> DataFrame:
    """One row: how many source paths the hits have."""
    return hits.agg(F.countDistinct("source_path").alias("n_paths"))
