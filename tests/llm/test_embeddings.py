import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import embeddings
from quillspan.llm.embeddings import COSINE, ENOUGH, near_vectors, plan


def brute(rows):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    ids = sorted(good)
    unit = {i: good[i] / np.linalg.norm(good[i]) for i in ids}
    label, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= COSINE]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, links[i], label[i], label[i] == i) for i, _ in rows}


def vectors(n=300, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dims))
    rows = [(i, (centres[rng.integers(60)] + rng.choice([0, 0.1, 0.25]) * rng.standard_normal(dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(10)] + [(n + 20, [2 * x for x in rows[0][1]])]
    rows += [(n + 30, None), (n + 31, []), (n + 32, [0.0] * dims), (n + 33, [float("nan")] * dims), (n + 34, [float("inf")] * dims)]
    return rows + [(n + 35, [1.0, 2.0]), (n + 36, [1.0, 2.01]), (n + 37, [None] * dims)]


def test_same_links_as_brute_force(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(embeddings, "CELL", 16)
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    assert plan(len(rows))[0] > 2
    out = near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, links long"))
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_recall_on_the_smallest_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    assert {tuple(r) for r in near_vectors(table).collect()} == brute(rows)
    assert 0 < ENOUGH < embeddings.PROJECTIONS


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True)], key=str)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).agg(F.count("*")).first()[0] == 0


def test_counts_are_those_of_windows():
    """Collisions by sorted projections against all differences."""
    z = np.random.default_rng(8).standard_normal((70, embeddings.PROJECTIONS)).astype("<f4")
    z[40:] = z[:30] + np.random.default_rng(9).standard_normal((30, embeddings.PROJECTIONS)).astype("<f4") * 0.3
    met = (np.abs(z[:, None, :].astype(float) - z[None, :, :]) <= embeddings.WINDOW + 1e-5).sum(axis=2)
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if met[a, b] >= ENOUGH}
    assert len(want) > 20 and set(zip(*map(np.ndarray.tolist, embeddings.colliding(z)), strict=True)) == want


def test_real_blocks_of_a_large_cell(spark):
    """A group of more vectors than a block holds, all near one another, beside others: every link is counted."""
    rng = np.random.default_rng(3)
    n, centre = embeddings.BLOCK + 500, rng.standard_normal(16)
    rows = np.concatenate([centre + 0.05 * rng.standard_normal((n, 16)), rng.standard_normal((300, 16))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {k: int((unit[k] @ unit.T >= COSINE).sum()) - 1 for k in range(0, len(rows), 50)}
    out = near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    got = {r.vec_id: r.n_links for r in out}
    assert len(out) == len(rows) and all(got[k] == m for k, m in want.items())
