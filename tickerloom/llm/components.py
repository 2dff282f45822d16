"""Connected components by alternating large and small stars, as joins and aggregates.

No node's neighbours are gathered anywhere: the smallest neighbour comes from an aggregate that
combines map-side, and a hub is a skewed join key that adaptive execution splits. Each round is
written to the shared folder, and the folder of the round before is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (u, v: long); label is the smallest node reachable.

    Repeated edges, both directions and loops are allowed; loops alone give their node no row.
    The number of rounds grows with the logarithm of the longest path.
    """
    return labelled(edges, written)[0]


def labelled(edges: DataFrame, written: Callable[[DataFrame, str], tuple[DataFrame, str]]) -> tuple[DataFrame, str]:
    """As `connected_components`, and the folder that holds the result, to be discarded after use."""
    spark = edges.sparkSession
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars, folder = written(pairs.distinct(), "edges")
    sign = None
    while True:
        stars, following = written(_small_star(_large_star(stars)).distinct(), "edges")
        discard(spark, folder)
        folder = following
        total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        row = stars.agg(F.count("*").alias("n"), total.alias("t")).first()
        if (row["n"], row["t"]) == sign:
            labels = stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
            return labels, folder
        sign = (row["n"], row["t"])
