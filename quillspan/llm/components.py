"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Rows with a null end and loops are ignored, repeated edges count once. Each round halves the depth of the trees
    at least, keeps no more edges than it got and cuts lineage with a written table. Hot nodes are safe: minima are
    combined before the shuffle, and the joins may be split by skew.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = edges.where(F.col(a) != F.col(b)).select(high.alias("hi"), low.alias("lo")).distinct()
    now = cut(now, "edges")
    was, size = None, _print(now)
    while was != size and size[0]:
        both = now.select("hi", "lo").union(now.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut(small.union(floor.toDF("hi", "lo")).distinct(), "edges")
        was, size = size, _print(now)
    return now.toDF("node", "component")
