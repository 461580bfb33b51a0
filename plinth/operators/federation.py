"""Search over many corpora, whose statistics and scores never meet.

All corpora may lie in one table (:func:`federated`): exact names are found in one pass, lexical
hits are ranked within their corpus, and only ranks are compared.  Corpora with an index of
their own are searched one by one (:func:`search_states`); one that fails joins the unavailable
ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PlinthError
from ..functions.text import candidate_id
from ..schemas import ID_PREFIX
from .resolve import _ascii_lower
from .search import match_mode, score, tagged

DEFAULT_LIMIT = 20
UNAVAILABLE = "source_id string, code string, message string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_by_corpus(nodes: DataFrame, query: str, corpus: str) -> DataFrame:
    """corpus, id: what the query resolves to by the search's rules within each corpus.  One
    pass; corpora where no tier is unique have no row."""
    ident = F.col("id")
    if query.startswith(ID_PREFIX):
        tiers = [ident == query]
    else:
        low = query.translate(str.maketrans(_UPPER, _LOWER))
        ends = F.like(_ascii_lower(ident), F.lit("%." + low.replace("\\", "\\\\"))) if "_" in query or "%" in query else F.endswith(_ascii_lower(ident), F.lit("." + low))
        tiers = [ident == ID_PREFIX + query, ends, F.col("name") == query]
    matched = F.lit(False)
    for hit in tiers:
        matched = matched | hit
    picks = [F.when(F.min(F.when(hit, ident)) == F.max(F.when(hit, ident)), F.min(F.when(hit, ident))) for hit in tiers]
    return nodes.where(matched).groupBy(corpus).agg(F.coalesce(*picks).alias("id")).where("id is not null")


def merged(exact: DataFrame, ranked: DataFrame, corpus: str, limit: int) -> DataFrame:
    """Exact rows first, then by local rank, corpus and candidate; the best ``limit``."""
    both = exact.unionByName(ranked)
    named = both.withColumn("candidate_id", candidate_id(F.col(corpus), F.col("declaration_id"), F.col("source_row_id")))
    return named.orderBy(F.col("match_mode") != "exact", "local_rank", corpus, "candidate_id").limit(max(0, limit))


def federated(nodes: DataFrame, sources: DataFrame, unavailable: DataFrame, query: str, *, corpus="source_id", limit: int = DEFAULT_LIMIT, mode: str = "discovery", scores: DataFrame | None = None) -> DataFrame:
    """Hits of all corpora in one table each of nodes and sources.

    A corpus where the query names one declaration gives that alone, with local rank 1; any
    other its best ``limit`` lexical hits.  Corpora listed in ``unavailable`` give none.
    ``scores`` are the scored sources where an index has them.
    """
    from .binding import hit_to_declaration

    match_mode(query, mode)
    gone = F.broadcast(unavailable.select(corpus).distinct())
    named = exact_by_corpus(nodes.join(gone, corpus, "left_anti"), query, corpus)
    exact = named.select(
        corpus, F.lit(1).alias("local_rank"), F.col("id").alias("declaration_id"), F.lit(None).cast("string").alias("source_row_id"), F.lit("exact").alias("match_mode"), F.lit(0.0).alias("score"),
    )
    found = score(sources.join(gone, corpus, "left_anti"), query, mode, corpus=corpus) if scores is None else scores.join(gone, corpus, "left_anti")
    rank = F.row_number().over(Window.partitionBy(corpus).orderBy("score", "source_path", "source_start_line"))
    best = tagged(found.join(F.broadcast(named.select(corpus)), corpus, "left_anti"), query, mode).withColumn("local_rank", rank).where(F.col("local_rank") <= limit)
    told = hit_to_declaration(best.withColumnRenamed("id", "source_row_id"), nodes, within=[corpus])
    return merged(exact, told.select(*exact.columns), corpus, limit)


def search_states(spark: SparkSession, states: dict[str, Callable[[str, int, str], DataFrame]], unavailable: list[tuple[str, str, str]], query: str, *, limit: int = DEFAULT_LIMIT, mode: str = "discovery") -> tuple[DataFrame, DataFrame, int]:
    """Hits, unavailable corpora (source_id, code, message) and the number searched.

    ``states`` gives each corpus' own search, which yields at most ``limit`` hits.  A corpus
    whose search fails is unavailable with the code of its error; a wrong mode is no failure
    of a corpus and raises.
    """
    match_mode(query, mode)
    lost = list(unavailable)
    rows, columns, searched = [], None, 0
    for source_id, find in states.items():
        try:
            hits = find(query, limit, mode)
            mine = hits.collect()
        except PlinthError as e:
            lost.append((source_id, e.code, str(e)))
            continue
        except (PySparkException, OSError) as e:
            lost.append((source_id, "UNAVAILABLE_PROJECTION", f"projection unavailable: {str(e).splitlines()[0]}"))
            continue
        searched, columns = searched + 1, hits.schema
        rows += [(source_id, k, *row) for k, row in enumerate(mine, 1)]
    missing = spark.createDataFrame(lost, UNAVAILABLE)
    if columns is None:
        return spark.createDataFrame([], "source_id string, local_rank int, candidate_id string, match_mode string"), missing, 0
    schema = "source_id string, local_rank int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    every = spark.createDataFrame(rows, schema)
    named = every.withColumn("candidate_id", candidate_id(F.col("source_id"), F.col("declaration_id"), F.col("source_row_id")))
    return named.orderBy(F.col("match_mode") != "exact", "local_rank", "source_id", "candidate_id").limit(max(0, limit)), missing, searched


def federated_status(hits: DataFrame, searched: DataFrame, unavailable: DataFrame, mode: str) -> DataFrame:
    """UNAVAILABLE if nothing was searched and something is missing, DEGRADED if something is
    missing whatever the hits, else as for one corpus."""
    n, s, u = (df.agg(F.count("*").alias(k)) for df, k in ((hits, "n_hits"), (searched.distinct(), "searched"), (unavailable, "missing")))
    exact = hits.agg(F.coalesce(F.bool_and(F.col("match_mode") == "exact"), F.lit(False)).alias("all_exact"))
    row = n.crossJoin(s).crossJoin(u).crossJoin(exact)
    return row.select(status_of(F.col("n_hits"), F.col("searched"), F.col("missing"), F.lit(mode == "evidence") | F.col("all_exact")).alias("status"), "n_hits", "searched", "missing")


def status_of(n_hits, searched, missing, sure):
    return F.when((missing > 0) & (searched == 0), "UNAVAILABLE").when(missing > 0, "DEGRADED").when(n_hits == 0, "UNKNOWN").when(sure, "FOUND").otherwise("CANDIDATE")

