import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import sharding
from quillspan.llm.sharding import op9_sharding, pack, shard_documents


def test_pack_balances_every_measure():
    rng = np.random.default_rng(2)
    items = rng.exponential(1, (6000, 3)) * [100, 10, 1]
    sums = np.zeros((24, 3))
    np.add.at(sums, pack(items, 24), items)
    assert (np.abs(sums / sums.mean(axis=0) - 1) < 0.01).all()


def test_pack_is_the_naive_greedy():
    """Largest first, into the shard where the dot product with what is left of its capacity is highest, in plain loops."""
    rng = np.random.default_rng(4)
    items = rng.integers(1, 50, (300, 3)).astype(float)
    capacity = items.sum(axis=0) / 7
    left, want = [[1.0] * 3 for _ in range(7)], [None] * 300
    need = [[x / c for x, c in zip(row, capacity, strict=True)] for row in items.tolist()]
    for i in sorted(range(300), key=lambda i: (-max(need[i]), i)):
        fit = [sum(a * b for a, b in zip(need[i], own, strict=True)) for own in left]
        want[i] = max(range(7), key=lambda s: (round(fit[s], 12), -s))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], need[i], strict=True)]
    assert pack(items, 7).tolist() == want


def test_lots_grow_with_the_rows(spark, monkeypatch):
    """Where a lot would hold too many rows there are more lots; slots stay without gaps."""
    monkeypatch.setattr(sharding, "LOTS", 1)
    monkeypatch.setattr(sharding, "LOT_ROWS", 10)
    out = shard_documents(spark.createDataFrame([(i, f"text {i}") for i in range(1500)], "doc_id long, text string"), 3).collect()
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(3)}
    assert sum(map(len, slots.values())) == 1500 and all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) < 15


def test_documents(spark):
    out = op9_sharding(spark, "/root/testdata/sf0.1").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes, slots, homes = {}, {}, {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert max(sizes.values()) / min(sizes.values()) < 1.02


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text " * 5) for i in range(3000)] + [(3000 + i, f"{i} other text {i * i} " * 3) for i in range(5000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    sums = out.groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    assert len(sums) == 24
    assert max(r.n for r in sums) / min(r.n for r in sums) < 1.1
    assert all(r.last == r.rows - 1 for r in sums)


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a", 6), (2, "", 7), (2, "", 7)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int"))
    assert sorted(out.columns) == sorted(["doc_id", "text", "size", "text_crc32", "shard", "slot"])
    got = out.collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == [(8, 0), (8, 0), (8, 0), (9, zlib.crc32(b"a"))]
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
