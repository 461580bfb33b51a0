"""The two name resolvers: tiers of candidates, of which the first unique one counts.

Many names resolve in one shuffled join: every dotted ending of an id is a key, so nothing is
compared pair by pair.  One name is a filter over the ids.  Endings are compared without
regard to the case of ASCII letters.

The search resolver takes ``_`` and ``%`` in a name as wildcards (any character, any run), the
graph resolver takes them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UNKNOWN, PlinthError
from ..schemas import ID_PREFIX

GRAPH = [["exact"], ["prefixed"], ["name", "suffix"]]
SEARCH = [["exact"], ["prefixed"], ["suffix"], ["name"]]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Candidates that a message names at most.
_NAMED = 20


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def suffixes(nodes: DataFrame) -> DataFrame:
    """id, suffix: the texts that follow each dot of an id, ASCII letters lower-cased."""
    parts = F.split(F.col("id"), r"\.")
    cuts = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return nodes.select("id", F.explode(F.when(F.size(parts) > 1, cuts).otherwise(F.array().cast("array<string>"))).alias("suffix")).select("id", _ascii_lower(F.col("suffix")).alias("suffix"))


def _pattern(name: Column) -> Column:
    """Of what ends like the name, as a LIKE pattern; only ``_`` and ``%`` are special."""
    return F.concat(F.lit("%."), F.replace(_ascii_lower(name), F.lit("\\"), F.lit("\\\\")))


def candidates(nodes: DataFrame, names: DataFrame, *, wildcards: bool = False) -> DataFrame:
    """query, tier (exact, prefixed, name, suffix), id for all matching nodes.

    With ``wildcards``, names that hold any are few and meet every id; the others are keys.
    """
    q = names.select("query").distinct()
    ids, plain = nodes.select("id").distinct(), ~F.startswith("query", F.lit(ID_PREFIX))
    exact = q.where(~plain).join(ids, F.col("id") == F.col("query")).select("query", F.lit("exact").alias("tier"), "id")
    prefixed = q.where(plain).join(ids, F.col("id") == F.concat(F.lit(ID_PREFIX), "query")).select("query", F.lit("prefixed").alias("tier"), "id")
    short = q.where(plain).join(nodes.select("id", "name"), F.col("name") == F.col("query")).select("query", F.lit("name").alias("tier"), "id")
    special = F.col("query").rlike("[_%]") if wildcards else F.lit(False)
    keys = q.where(plain & ~special)
    suffix = keys.join(suffixes(nodes), F.col("suffix") == _ascii_lower(F.col("query"))).select("query", F.lit("suffix").alias("tier"), "id")
    out = exact.unionAll(prefixed).unionAll(short).unionAll(suffix)
    if wildcards:
        like = q.where(plain & special).withColumn("pattern", _pattern(F.col("query")))
        met = ids.withColumn("low", _ascii_lower(F.col("id"))).join(like, F.like(F.col("low"), F.col("pattern")))
        out = out.unionAll(met.select("query", F.lit("suffix").alias("tier"), "id"))
    return out


def _unique(rows: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """query, id (of the first tier that has just one), n (candidates), candidates (the first
    ones in order)."""
    flags = [F.max(F.col("tier").isin(tier)).alias(f"t{k}") for k, tier in enumerate(tiers)]
    once = rows.groupBy("query", "id").agg(*flags)
    found = [F.when(F.count_if(F.col(f"t{k}")) == 1, F.min(F.when(F.col(f"t{k}"), F.col("id")))) for k in range(len(tiers))]
    counted = once.groupBy("query").agg(F.coalesce(*found).alias("id"), F.count("*").alias("n"))
    first = once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where(F.col("place") <= _NAMED)
    listed = first.groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("candidates"))
    return counted.join(listed, "query")


def resolve_graph(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """query, id (null unless unique), n, candidates: short names and suffixes are one tier."""
    return names.select("query").distinct().join(_unique(candidates(nodes, names), GRAPH), "query", "left")


def resolve_search(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """As :func:`resolve_graph`, but a unique suffix, with wildcards, decides before a unique
    short name."""
    return names.select("query").distinct().join(_unique(candidates(nodes, names, wildcards=True), SEARCH), "query", "left")


def one(nodes: DataFrame, query: str, *, search: bool = False, soft: bool = False) -> str | None:
    """Resolves one name by one pass over the ids, by the rules of the graph or the search.

    The hard form raises with the candidates; the soft one gives None.
    """
    ident = F.col("id")
    if query.startswith(ID_PREFIX):
        tiers = {"exact": ident == query}
        order = [["exact"]]
    else:
        low = query.translate(str.maketrans(_UPPER, _LOWER))
        ends = F.endswith(_ascii_lower(ident), F.lit("." + low))
        if search and ("_" in query or "%" in query):
            ends = F.like(_ascii_lower(ident), F.lit("%." + low.replace("\\", "\\\\")))
        tiers = {"prefixed": ident == ID_PREFIX + query, "name": F.col("name") == query, "suffix": ends}
        order = [t for t in (SEARCH if search else GRAPH) if t != ["exact"]]
    matched = F.lit(False)
    for hit in tiers.values():
        matched = matched | hit
    rows = nodes.where(matched)
    aggs = []
    for k, names in enumerate(order):
        hit = F.lit(False)
        for name in names:
            hit = hit | tiers[name]
        aggs += [F.min(F.when(hit, ident)).alias(f"lo{k}"), F.max(F.when(hit, ident)).alias(f"hi{k}")]
    row = rows.agg(*aggs).first()
    for k in range(len(order)):
        if row[f"lo{k}"] is not None and row[f"lo{k}"] == row[f"hi{k}"]:
            return row[f"lo{k}"]
    if soft:
        return None
    listed = [r["id"] for r in rows.select("id").distinct().orderBy("id").limit(_NAMED + 1).collect()]
    if not listed:
        raise PlinthError(UNKNOWN, f"declaration not found: {query}")
    more = ", ..." if len(listed) > _NAMED else ""
    raise PlinthError(UNKNOWN, f"ambiguous declaration {query}: {', '.join(listed[:_NAMED])}{more}")
