"""Bounded samples of labelled texts for fitting classifiers on the driver.

Copies of a text count once, so a page that repeats a million times neither floods the driver
nor fills a label's sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30
#: Texts of more bytes teach nothing, so that a sample has a bound in bytes too; and so many
#: labels, the most frequent ones, are learned at most.
LONGEST, MOST_LABELS = 1 << 17, 200


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """Of each value of column label, about ``limit`` of its distinct values of column h (a
    hash): those in the label's share of the hash range.  Rows that repeat both may stay."""
    counts = rows.select("label", "h").distinct().groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    place = F.pmod("h", F.lit(_SPAN))
    # a quarter more than the share, as a hash range holds more or fewer by chance
    taken = [F.when((F.col("label") == F.lit(r["label"])) & (place <= F.lit(int(_SPAN * min(1.0, 1.25 * limit / r["n"])))), True) for r in counts]
    return rows.where(F.coalesce(*taken, F.lit(False)))


def cut(rows: list[tuple[int, object, str]], limit: int) -> list[tuple[str, object]]:
    """(text, label) of the ``limit`` lowest hashes of each label, from (hash, label, text)."""
    out: list[tuple[str, object]] = []
    for label in sorted({r[1] for r in rows}, key=str):
        out += [(text, label) for _, text in sorted((h, t) for h, other, t in rows if other == label)[:limit]]
    return out


def labelled_texts(rows: DataFrame, limit: int) -> list[tuple[str, object]]:
    """At most ``limit`` (text, label) pairs of each of the most frequent labels: its distinct
    texts of the lowest hashes, very long ones left out.  Columns text and label, no nulls."""
    hashed = rows.where(F.octet_length("text") <= LONGEST).select("label", F.xxhash64("text").alias("h"), "text")
    # one of each text's copies, picked before anything moves
    found = bounded(hashed, limit).groupBy("label", "h").agg(F.first("text").alias("text")).select("h", "label", "text").collect()
    return cut([tuple(r) for r in found], limit)
