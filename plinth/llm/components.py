"""Connected components of a link table by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest neighbour (large star) and
then every node and its smaller neighbours on the smallest of them (small star).  The number
of rounds grows with the logarithm of the longest path; a node of very many links is handled
by aggregation, never by a list in one task.  Every round is written to the shared folder,
so lineage stays short and lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(links: DataFrame, *, left="x", right="y", most_rounds: int = 60) -> DataFrame:
    """Columns node, component (smallest node reachable) of every node with a link.

    Self links, repeated links and both directions are allowed; null ends are ignored.  An
    empty table gives no rows.
    """
    spark = links.sparkSession
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x is not null and y is not null and x != y")
    pairs = materialize(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # large star: neighbours above a node go to its smallest neighbour or itself
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("p"))
        after = materialize(small.select("p.x", "p.y").where("x != y").distinct(), "links")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        discard(spark, pairs)
        pairs = after
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("component")).unionAll(roots)
