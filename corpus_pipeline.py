"""A pipeline of corpus operators over the documents table.

Each stage reads all that the one before it kept, as stored, and its decisions take effect.
All stages but the last return the columns of documents; other columns are not read.  An empty
table gives no rows in any of them.  Null and repeated ids are allowed: rows that share an id are
told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontam, langid, linedup, ngramjoin, packing
from plinth.llm.storage import materialize, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or text, whose language can't be told.

    Where a label is missing, the predicted language is filled in.  Learns from the labelled
    documents themselves.
    """
    model = langid.learn(docs)
    named = langid.annotate(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    kept = named.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that a former document has; a document that loses all its lines goes.

    Of equal lines the one of the smallest doc_id stays (null ids last).  A null text stays as it
    is, and so does one that had no line of words before; very long texts are read in blocks.
    """
    cleaned = linedup.dedup_lines(docs)
    return _columns(cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by the n-gram Jaccard join.

    The smallest doc_id stays (null ids last, of equal ids the smaller hash of the text), and rows
    that repeat id and text stay once.  Texts without words, null among them, are all kept.
    """
    return ngramjoin.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of a benchmark.

    Null texts and texts without words hold none and stay.  Rows that repeat are judged alike.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of what is left.

    A null or empty text is its end token alone.  Repeated rows are packed as often as they occur.
    """
    return packing.pack(docs)


def _staged(name: str, apply, before: str | None):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage(spark, name, before):
            return apply(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = name, apply.__doc__
    return run_stage


_ORDER = [language_id, line_dedup, near_duplicates, decontamination, best_fit_packing]
#: Each stage is given what the one before it has stored.
STAGES = [(f.__name__, _staged(f.__name__, f, g and g.__name__)) for f, g in zip(_ORDER, [None, *_ORDER], strict=False)]

#: No SQL form: trained models, fuzzy components and packing are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = materialize(apply(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
