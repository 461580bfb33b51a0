"""URL rules by hashed expressions, as lists of unsafe addresses are looked up.

A url is expanded into expressions: each suffix of its host by whole labels, followed by each
prefix of its path.  Only pairs of (labels, path length) that some rule has can equal a rule, so
just those are made; none that could match is left out, however long a url is.  Expressions meet
the rules by the first four bytes of their SHA-256, and the whole digest confirms.  Of the rules
that fit, the longest wins.

A verdict depends on host and path alone, so each different address is expanded once, however
many rows repeat it.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import is_small, materialize, unused

#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for null and for a url without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def compile_rules(rules: DataFrame) -> DataFrame:
    """The stored rules by hash: short, digest, rule, length, verdict, labels, chars.

    A rule needs a host without ``/``, ``?`` or ``#``, a path that is empty or begins with ``/``
    and has no ``?`` or ``#``, and a verdict of allow or block; others can fit no url and are left
    out, nulls among them.  Of equal rules the blocking one counts.
    """
    host = F.translate("host", _UPPER, _LOWER)
    sound = (F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("path").rlike("^(/[^?#]*)?$") & F.col("verdict").isin(*VERDICTS)
    rows = rules.where(sound).select(host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    found = rows.select(_digest(text).alias("digest"), text.alias("rule"), F.length(text).alias("length"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    return materialize(found.select(_short(F.col("digest")).alias("short"), "*"), "rules")


def expressions(addresses: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """host, path, digest: one row per address and shape (labels, path length) that it has."""
    parts = F.split("host", r"\.")
    made = [
        F.when((F.size(parts) >= n) & (F.length("path") >= m), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)))
        for n, m in shapes
    ]
    spread = addresses.where("host != ''").select("host", "path", F.explode(F.array_compact(F.array(*made))).alias("expression"))
    return spread.select("host", "path", _digest(F.col("expression")).alias("digest"))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with columns host, path, rule and verdict.

    The longest fitting rule gives the verdict (``default`` where none fits and rule is null).
    Columns of these names are replaced, all others stay; repeated rows stay.  A null url has an
    empty host and path and fits no rule.  No rules, or no rows, is no fault.
    """
    spark = pages.sparkSession
    compiled = compile_rules(rules)
    shapes = sorted((r["labels"], r["chars"]) for r in compiled.select("labels", "chars").distinct().collect())
    clean = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    if not shapes:
        return clean.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    key, other, best = unused(clean, "host_", "path_", "best")
    distinct = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
    lookup = compiled.select("short", F.col("digest").alias("whole"), "length", "rule", "verdict")
    found = expressions(distinct, shapes).withColumn("short", _short(F.col("digest")))
    met = found.join(F.broadcast(lookup) if is_small(compiled) else lookup, "short").where(F.col("digest") == F.col("whole"))
    wins = met.groupBy(F.col("host").alias(key), F.col("path").alias(other)).agg(F.max(F.struct("length", "rule", "verdict")).alias(best))
    out = clean.join(wins, (F.col("host") == F.col(key)) & (F.col("path") == F.col(other)), "left")
    return out.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(f"{best}.verdict", F.lit(default))}).drop(key, other, best)
