"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014).

Each round is a group minimum (combined on the map side) and an equi-join, and ends as a table in the
shared folder; nothing but two sums per round reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.common import stored

#: Shuffle partitions to a file of edges.
SHARE = 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v): component is the least node that can be reached.

    No links give no rows. Loops and repeated links change nothing.
    """
    edges, before = links.select("u", "v").where("u <> v"), None
    for _ in range(most):
        edges = stored(_small(_large(edges).distinct()).distinct(), "cc", SHARE)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.union(flat.select(F.col("component").alias("node"), "component").distinct())
