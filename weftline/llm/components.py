"""Connected components of a table of links: large-star and small-star by turns.

Each half round only groups by a node's smallest neighbour (partial minima
before the shuffle) and joins these back: rows of two numbers, of which adaptive execution splits a
hub's when they are many; every round the links are written to the shared folder and those of the round before deleted. Nothing
grows on the driver: it sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, label (the smallest node of its component) for every node of ``links`` (u, v); written to the shared folder."""
    e = written(links.filter("u != v").select("u", "v").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        fresh = written(_small_star(_large_star(e)).filter("u != v").distinct(), "links")
        discard(e)
        e = fresh
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels")
    discard(e)
    return out
