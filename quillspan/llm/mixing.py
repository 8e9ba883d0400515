"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Leaves that the driver may plan; buckets of the first and of the second cut of a leaf's epoch.
MAX_LEAVES, BITS = 100_000, 10
LEVELS = ("domain", "language", "source")
#: Target weights of the query: a child's among its siblings, by level and name; 1 where it has none.
WEIGHTS = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "language": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
}
#: The query's budget as a share of all tokens, and how often a document may be taken at most.
SHARE, EPOCHS = 0.6, 2


def share_out(budget: int, room: list[int], weights: list[float]) -> list[int]:
    """Whole numbers that sum to the budget, or to all room, in proportion to the weights, none above its room: what
    one lacks goes to those that have room left, by their weights; remainders go to the largest fractions, then in
    order. Children of weight 0 get a share only when nobody else has room."""
    out, left = [0] * len(room), min(budget, sum(room))
    for tier in (lambda w: w > 0, lambda w: w <= 0):
        active = [k for k, w in enumerate(weights) if tier(w) and room[k] > 0]
        while left and active:
            total = sum(weights[k] if weights[k] > 0 else 1 for k in active)
            ideal = {k: left * ((weights[k] if weights[k] > 0 else 1) / total) for k in active}
            full = [k for k in active if ideal[k] >= room[k]]
            if full:
                for k in full:
                    out[k] = room[k]
                    left -= room[k]
                active = [k for k in active if k not in set(full)]
                continue
            for k in active:
                out[k] = int(ideal[k])
            rest = left - sum(out[k] for k in active)
            for k in sorted(active, key=lambda k: (out[k] - ideal[k], k))[:rest]:
                out[k] += 1
            left, active = 0, []
    return out


def budgets(leaves: Mapping[tuple[str, ...], int], budget: int, weights: Mapping[str, Mapping[str, float]], epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf, whose tokens are given. Budgets go down the tree by weight; a node never gets more than its
    leaves can give in ``epochs``, so a shortage is first made up among siblings and only then higher up."""
    names = sorted(leaves)

    def down(paths: list[tuple[str, ...]], depth: int, left: int) -> dict[tuple[str, ...], int]:
        if depth == len(LEVELS):
            return {paths[0]: left}
        children: dict[str, list] = {}
        for path in paths:
            children.setdefault(path[depth], []).append(path)
        room = [epochs * sum(leaves[p] for p in ps) for ps in children.values()]
        own = weights.get(LEVELS[depth], {})
        parts = share_out(left, room, [own.get(name, 1.0) for name in children])
        return {k: v for ps, part in zip(children.values(), parts, strict=True) for k, v in down(ps, depth + 1, part).items()}

    return down(names, 0, budget) if names else {}


def n_tokens(text: str | Column = "text") -> Column:
    """Words between ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _limits(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Where each leaf's epoch stops: the place and doc_id after the longest prefix that fits ``rest``. Of a leaf there are
    at most 2**BITS buckets to sum up in order, and what is sorted is a bucket of a bucket."""
    keys = list(LEVELS)
    open_ = docs.join(F.broadcast(rest), keys).where("rest > 0").select(*keys, "tokens", "rest", place("part"), "id")
    for shift in (63 - BITS, 63 - 2 * BITS):
        bucket = F.shiftright("place", shift)
        sums = open_.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
        running = F.expr(f"sum(n) over (partition by {', '.join(keys)} order by bucket)")
        sums = sums.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("n"))
        edge = sums.where("upto > rest and before <= rest").select(*keys, F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("left"))
        open_ = open_.join(F.broadcast(cut(edge, "edges-of-leaves")), keys).where(bucket == F.col("edge"))
        open_ = open_.select(*keys, "tokens", F.col("left").alias("rest"), "place", "id")
    running = F.expr(f"sum(tokens) over (partition by {', '.join(keys)} order by place, id)")
    last = open_.withColumn("upto", running).where("upto > rest")
    return last.groupBy(*keys).agg(F.min(F.struct("place", "id")).alias("stop"))


def place(epoch: str) -> Column:
    """A document's place in an epoch: 63 bits of a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64("seed", epoch, "id"), 1).alias("place")


def mix_documents(
    documents: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], budget: int | float, epochs: int, seed: int = 1
) -> DataFrame:
    """Every row of ``documents`` (doc_id, text, ...) as a struct ``row``, with its leaf, n_tokens and ``epochs``: how
    often it is taken.

    ``levels`` gives the columns of the tree's levels (domain, language, source); a null is the name ``?``. ``budget``
    is in tokens, or as a float a share of all. Leaves that need more than one epoch take whole epochs first; of the
    last, the longest prefix that fits, in the order of a hash of seed, epoch and doc_id.

    The tree's sums are planned on the driver: one row a leaf, at most MAX_LEAVES (more are refused). No leaf is sorted
    in one task: its epoch is cut at a bucket of hashes, that bucket again, and only the rest is sorted. Rows that share
    a doc_id are taken together. A text without words takes no tokens and is in every prefix that reaches it. A null
    doc_id is hashed as such. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    named = {k: F.coalesce(levels[k].cast("string"), F.lit("?")).alias(k) for k in LEVELS}
    spread = documents.select(F.struct("*").alias("row"), *named.values(), n_tokens("text").alias("tokens"), F.col("doc_id").cast("long").alias("id"))
    facts = cut(spread.select(*LEVELS, "tokens", "id"), "leaf-tokens")
    found = facts.groupBy(*LEVELS).agg(F.sum("tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[k] for k in LEVELS): r.n for r in found}
    tokens = int(budget * sum(leaves.values())) if isinstance(budget, float) else budget
    share = budgets(leaves, tokens, weights, epochs)
    rows = [(*leaf, share[leaf] // n if n else 0, share[leaf] % n if n else 0, seed) for leaf, n in leaves.items()]
    schema = ", ".join(f"{k} string" for k in LEVELS)
    table = spark.createDataFrame(rows, f"{schema}, part long, rest long, seed long")
    stops = _limits(facts, table).collect()
    stops = {tuple(r[k] for k in LEVELS): (r.stop.place, r.stop.id) for r in stops}
    rows = [(*r, *stops.get(r[: len(LEVELS)], (None, None)), r[: len(LEVELS)] in stops) for r in rows]
    table = spark.createDataFrame(rows, f"{schema}, part long, rest long, seed long, stop long, stop_id long, stops boolean")
    out = spread.join(F.broadcast(table), list(LEVELS))
    early = F.struct(place("part"), F.col("id")) < F.struct(F.col("stop").alias("place"), F.col("stop_id").alias("id"))
    taken = F.when(F.col("rest") == 0, 0).when(~F.col("stops") | early, 1).otherwise(0)
    return out.select("row", *LEVELS, F.col("tokens").alias("n_tokens"), (F.col("part") + taken).alias("epochs"))


def levels_of_documents() -> dict[str, Column]:
    """The tree of the documents table: the number in a source's name gives its domain."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)") % 4).cast("string")))
    return {"domain": domain, "language": F.col("lang"), "source": F.col("source")}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """mix_documents over the whole documents table."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_documents(documents, levels_of_documents(), WEIGHTS, SHARE, EPOCHS)
    return out.select("row.doc_id", *LEVELS, "n_tokens", "epochs")
