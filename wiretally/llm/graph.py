"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import staged


def _toward_least(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of its neighbourhood.

    Large: only neighbours above the node move. Small: the node and its neighbours below it move.
    """
    if large:
        out = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = out.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, undirected) to (node, root): root is the least node of its component.

    Nodes without an edge are not listed. A node may hold any share of the edges: each round
    aggregates per node before it shuffles, and joins that Spark can split. Rounds grow with the
    logarithm of the longest path, each is cut off by a table in the shared folder.
    """
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = state(now)
    while was["n"]:
        now = staged(_toward_least(_toward_least(now, True), False))
        seen = state(now)
        if seen == was:
            break
        was = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
