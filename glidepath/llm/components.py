"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of `edges` (a, b: long); component is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes, each one aggregate and join over the edges, whose
    number never grows; a node with very many neighbours is met by its pre-aggregated minimum only. Each round is written to the
    shared folder. Null nodes and loops are ignored.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    was = mark(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        hop = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(hop.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(links)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    flat = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.unionByName(flat.select(F.col("component").alias("node"), "component").distinct())
