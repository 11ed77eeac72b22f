"""Connected components of a table of edges by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b), each undirected edge once. Large: links the larger neighbours of a node to its smallest; small: the others."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) if small else edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    if small:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if small:
        kept = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        kept = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return kept.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids, in any direction and number. Returns (node, root): every linked node and the smallest id it reaches.

    Self-loops and nulls count for nothing; an empty table gives an empty result. Each round is checkpointed; the number of rounds grows
    with the logarithm of the longest chain. Joins are equi-joins on a node, which Spark splits where a node has many links.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    state = None
    while True:
        edges = materialise(_stars(_stars(edges, small=False), small=True))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
