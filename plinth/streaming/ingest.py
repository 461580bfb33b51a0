"""Continuous ingest: each micro-batch of source files makes a generation of all files so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_sources
from ..operators.generations import Store


def publish_batch(store: Store, batch: DataFrame, number: int, *, source_id: str, revision: str, catalog: str) -> str:
    """Chunks one batch, joins what the active generation has of other files, freezes both as
    a generation and makes it active.

    A file that comes again replaces its former chunks; of a file that is in the batch more than
    once the last row counts.  A batch that is run again finishes
    what is missing: it stages under the same names, and a READY generation is activated
    unless it, or a later one, is already.
    """
    generation = f"{number:064x}"
    active = store.active()
    if store.state(generation) != "READY":
        if store.state(generation) is None:
            store.begin(generation, generation, catalog)
        # in the order of the batch's files and their rows
        last = batch.withColumn("_at", F.monotonically_increasing_id()).groupBy("source_path").agg(F.max_by("text", "_at").alias("text"))
        rows = chunk_sources(last, revision)
        docs = rows.select(
            F.lit(generation).alias("generation_id"), F.lit(source_id).alias("source_id"), F.concat(F.lit(source_id + "::"), "id").alias("candidate_id"), F.lit(None).cast("string").alias("declaration_id"),
            F.col("id").alias("source_row_id"), "source_path", F.col("source_start_line").alias("source_line"), F.col("declaration_hint").alias("exact_identity"), F.col("text").alias("body_text"),
        )
        if active is not None and active < generation:
            fresh = batch.select("source_path").distinct()
            kept = store.table(active, "search_docs").join(fresh, "source_path", "left_anti").withColumn("generation_id", F.lit(generation))
            docs = docs.unionByName(kept)
        store.write(generation, "search_docs", docs, attempt="batch")
        one = store.spark.range(1).select(F.lit(generation).alias("generation_id"), F.lit(source_id).alias("source_id"), F.lit("stream").alias("release_tag"), F.lit("SEARCHABLE").alias("availability"), F.lit(None).cast("string").alias("unavailable_reason"))
        store.write(generation, "corpora", one, attempt="batch")
        store.mark_ready(generation, catalog, 1)
    if active is None or active < generation:
        store.activate(generation, active)
    return generation


def start(files: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """Runs over a streaming DataFrame with columns source_path and text."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: publish_batch(store, batch, number, **options) and None).trigger(availableNow=True).start()
