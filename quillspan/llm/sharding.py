"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

SHARDS = 24
#: Small groups share lots: so many a shard at least, more where one would hold more rows or bytes than these. A group above
#: 1/PARTS of a shard in any measure is placed by itself.
LOTS, LOT_ROWS, LOT_BYTES, PARTS = 256, 1_000_000, 256 << 20, 64
_MEASURES = ("size", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of measures): largest first, each where the dot product of the item with the
    residual capacity is highest, measures scaled by the capacity of a shard; ties go to the first shard."""
    total = items.sum(axis=0)
    scaled = items / np.where(total > 0, total / shards, 1)
    left, out = np.ones((shards, items.shape[1])), np.empty(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -scaled.max(axis=1))):
        out[i] = best = int(np.argmax(left @ scaled[i]))
        left[best] -= scaled[i]
    return out


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``documents`` (doc_id, text, ...) with size, text_crc32, shard and slot.

    Equal texts are a group, known by 128 bits of hash. Groups that fill over 1/PARTS of a shard are placed singly, in
    pieces of at most that; at most 3 * shards * PARTS groups can do so, whatever the input. All others are gathered
    by hash into lots: shards * LOTS, or as many as keep one at LOT_ROWS rows and LOT_BYTES bytes. Only these tables of
    sums reach the driver (for 100 TB, 400,000 rows), where the items are packed, and only they are broadcast. A group stays in one shard unless it exceeds a whole shard; then its pieces are
    packed singly. A slot is the piece's first slot plus the rank within it, so no task sorts a whole shard.

    size is the UTF-8 length plus 8 (null: 8), text_crc32 the CRC-32 of these bytes (null: 0). Null texts are one
    group. Rows that repeat get slots of their own. A null doc_id ranks first. Columns named like a new one are
    replaced; other extra columns stay. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    text = F.col("row.text")
    docs = documents.select(F.struct("*").alias("row")).select(
        "row",
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
    )
    tokens = F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    facts = cut(docs.select(F.col("row.doc_id").alias("doc_id"), "h1", "h2", "size", tokens.alias("tokens")), "sizes")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = [max(1, x or 0) for x in facts.agg(*sums).first()]
    share = F.greatest(*(F.col(m) / (t / shards) for m, t in zip(_MEASURES, total, strict=True)))
    large = facts.groupBy("h1", "h2").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / PARTS)
    lots = max(shards * LOTS, -(-total[2] // LOT_ROWS), -(-total[0] // LOT_BYTES))
    large, first = [r.asDict() for r in large.orderBy("h1", "h2").collect()], lots
    for group in large:
        group["first"], group["pieces"] = first, max(int(np.ceil(group["share"] * PARTS)), -(-group["rows"] // LOT_ROWS))
        first += group["pieces"]
    known = spark.createDataFrame([(g["h1"], g["h2"], g["first"], g["pieces"]) for g in large], "h1 long, h2 long, first long, pieces long")

    def celled(df: DataFrame, doc_id: str) -> DataFrame:
        piece = F.col("first") + F.pmod(F.xxhash64(doc_id, "h1"), F.col("pieces"))
        lot = F.pmod(F.xxhash64("h1", "h2"), F.lit(lots))
        return df.join(F.broadcast(known), ["h1", "h2"], "left").withColumn("cell", F.coalesce(piece, lot))

    cells = [r.asDict() for r in celled(facts, "doc_id").groupBy("cell").agg(*sums).orderBy("cell").collect()]
    whole = {g["first"] + k: g["first"] for g in large if g["share"] <= 1 for k in range(g["pieces"])}
    items: dict[int, np.ndarray] = {}
    for c in cells:
        unit = whole.get(c["cell"], c["cell"])
        items[unit] = items.get(unit, 0) + np.array([c[m] for m in _MEASURES], float)
    where = dict(zip(items, pack(np.array([*items.values()]), shards).tolist(), strict=True)) if items else {}
    filled, placed = [0] * shards, []
    for c in cells:
        shard = where[whole.get(c["cell"], c["cell"])]
        placed.append((c["cell"], shard, filled[shard]))
        filled[shard] += c["rows"]
    placed = spark.createDataFrame(placed, "cell long, shard int, base long")

    out = celled(docs, "row.doc_id").join(F.broadcast(placed), "cell")
    rank = F.expr("row_number() over (partition by cell order by row.doc_id, h1, h2)")
    new = {
        "size": F.col("size"),
        "text_crc32": F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long"),
        "shard": F.col("shard"),
        "slot": F.col("base") + rank - 1,
    }
    return out.select(*(F.col("row")[c].alias(c) for c in documents.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """shard_documents over the whole documents table, by the law of near equal bytes."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
