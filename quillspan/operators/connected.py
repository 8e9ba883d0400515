"""Connected components by stars, for graphs of any size and any degree (J-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.sources.scratch import cut


def connected(edges: DataFrame, key: str = "source_id") -> DataFrame:
    """``edges`` (key, a, b) as ``key``, node, home: each node's smallest reachable one, of the nodes that an edge names.

    Rounds of two steps (large star, small star) hang every node's neighbours onto the smallest of them, above and then
    below the node, until only stars are left, after a number of rounds that grows with the square of the logarithm
    of the nodes at most. A step finds the smallest neighbour by a partial aggregate and brings it back by a join; no
    node's neighbours are ever in one group. Each round is written, so a lost executor costs no earlier round."""
    pair = edges.where("a != b").select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pair, told = cut(pair, "stars"), None
    while True:
        # large star: neighbours above a node go to the least of it and all its neighbours
        both = pair.unionAll(pair.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it go to the least of these
        least = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [key, "u"]).where("v != m").select(key, F.col("v").alias("u"), F.col("m").alias("v"))
        pair = cut(small.unionAll(least.select(key, "u", F.col("m").alias("v"))).distinct(), "stars")
        now = pair.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    return pair.select(key, F.col("u").alias("node"), F.col("v").alias("home")).unionAll(pair.select(key, F.col("v").alias("node"), F.col("v").alias("home")).distinct())
