"""Near-duplicate vectors by counting window collisions in one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .minhash import runs
from .storage import cut

#: Cosine from which vectors are linked, and the chance of missing such a pair at each of two steps.
COSINE, MISS = 0.95, 5e-4
#: Vectors that a cell holds on average, and above which it is compared in blocks; sorted projections of each vector.
CELL, BLOCK, PROJECTIONS = 128, 1024, 16
#: Pairs that a worker verifies at once.
PAIRS = 1 << 16
_DISTANCE = math.sqrt(2 - 2 * COSINE)
#: Half width of a vector's window in each projection, in units of unit vectors' Gaussian projections.
WINDOW = 1.9 * _DISTANCE


def _at_least(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


#: Collisions from which a pair is verified: the highest count that pairs at COSINE reach but for MISS.
ENOUGH = max(k for k in range(PROJECTIONS + 1) if _at_least(PROJECTIONS, math.erf(WINDOW / _DISTANCE / math.sqrt(2)), k) >= 1 - MISS)


def plan(n: int) -> tuple[int, int]:
    """Sign bits of a cell's key, and tables: a pair at COSINE shares a cell in one of them but for MISS."""
    bits = max(0, min(31, round(math.log2(max(n, 1) / CELL))))
    together = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - together))


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _coder(bits: int, tables: int):
    """Of each vector: its bytes, the places on its sorted projections, and its cell in each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy().astype("<f8")
            starts = np.cumsum(sizes) - sizes
            codes, places = np.zeros((len(sizes), tables), np.int32), np.zeros((len(sizes), PROJECTIONS), "<f4")
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = flat[starts[rows][:, None] + np.arange(size)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                places[rows] = x @ np.random.default_rng([23, size]).standard_normal((size, PROJECTIONS))
                axes = np.random.default_rng([17, size]).standard_normal((size, tables * bits))
                signs = (x @ axes >= 0).reshape(len(rows), tables, bits)
                codes[rows] = signs @ (1 << np.arange(bits, dtype=np.int64))
            vectors = [flat[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))
            columns = [batch.column("x"), batch.column("copies"), pa.array(vectors, pa.binary()), pa.array([z.tobytes() for z in places], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "copies", "v", "z", "codes"])

    return code


def colliding(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of vectors that lie in one another's windows in at least ENOUGH projections. Each projection is sorted;
    a vector's window is a range of the order around it, and all in that range get a collision with it. The windows are a
    little wider than calibrated, for what rounding to 32 bits can move."""
    n = len(z)
    count, rank, low, high = np.zeros((n, n), np.int8), *np.empty((3, n), np.int32)
    for k in range(z.shape[1]):
        order = np.argsort(z[:, k], kind="stable")
        line = z[order, k]
        rank[order] = np.arange(n)
        low[order], high[order] = np.searchsorted(line, line - WINDOW - 1e-5), np.searchsorted(line, line + WINDOW + 1e-5, side="right")
        count += (rank >= low[:, None]) & (rank < high[:, None])
    a, b = np.nonzero(count >= ENOUGH)
    return a[a < b], b[a < b]


def _new_pairs(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Colliding pairs of a cell, or of two blocks of one, that no earlier table has in a cell."""
    table, whole = run.column("t")[0].as_py(), run.column("i")[0] == run.column("j")[0]
    block = run.column("block").to_numpy()
    codes = run.column("codes").combine_chunks().flatten().to_numpy().reshape(run.num_rows, -1)[:, :table]
    a, b = colliding(np.frombuffer(b"".join(run.column("z").to_pylist()), "<f4").reshape(run.num_rows, -1))
    if not whole:
        a, b = a[block[a] != block[b]], b[block[a] != block[b]]
    parts = [slice(k, k + PAIRS) for k in range(0, len(a), PAIRS)]
    new = [~(codes[a[p]] == codes[b[p]]).any(axis=1) for p in parts]
    new = np.concatenate([np.empty(0, bool), *new])
    return a[new], b[new]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are in a colliding pair; their vectors are fetched then."""
    for run in runs(batches, KEYS):
        if run.num_rows > 1:
            some = np.unique(np.concatenate(_new_pairs(run)))
            if len(some):
                yield run.select([*KEYS, "block", "x"]).take(pa.array(some)).combine_chunks().to_batches()[0]


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and local component of each candidate of a cell: its colliding pairs, verified."""
    for run in runs(batches, KEYS):
        x, copies, v = run.column("x").to_numpy(), run.column("copies").to_numpy(), _unit(run.column("v").to_pylist())
        links, root, edges = np.zeros(len(x), np.int64), x.copy(), [np.empty((2, 0), np.int64)]
        a, b = _new_pairs(run)
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            near = np.einsum("ij,ij->i", v[p], v[q]) >= COSINE
            p, q = p[near], q[near]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            edges.append(np.stack([p, q]))
        a, b = np.concatenate(edges, axis=1)
        while len(a):
            least = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            if (was == root).all():
                break
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]), pa.array(links[some]), pa.array(root[some])], names=["x", "links", "root"])


KEYS = ["t", "size", "cell", "i", "j"]


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """One row for each row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of the same length whose cosine, in double precision, is at least 0.95 are linked, whatever their labels.

    1. Equal vectors form a class with a count, led by the smallest vec_id.
    2. Every leader has a place on each of PROJECTIONS one-dimensional projections. To count collisions for the pairs of
       all leaders would take time in the square of their number, as windows wide enough for recall hold a third of them;
       so they are counted within cells: signs of other projections, that is halves of their sorted ranges, give each
       leader a cell in each of several tables. Bits grow with the logarithm of the number of leaders, so a cell stays
       small, and the tables follow from the recall wanted.
    3. Within a cell each projection is sorted, each vector's window around it gives a collision to all inside, and
       pairs that reach a count calibrated for recall are candidates, in the first table where they meet. Only ids,
       places and cells are shuffled for this. Cells above BLOCK vectors are compared block by block, in tasks of their own.
    4. The vectors of candidates are fetched to their cells, and the pairs verified. Each cell returns a row a vector
       (its links, its local component), never pairs; these are summed and joined.

    The chance to miss a pair at exactly 0.95 is 2 * MISS; closer pairs are safer. A vector that is null, empty or
    zero or holds null or non-finite components links with nothing. Repeated rows are vectors of their own. A null
    vec_id takes no part: n_links is 0, component_id null, kept true. Extra columns are ignored; an empty table gives
    an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = "forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c != 0)"
    good = F.coalesce(F.expr(f"vec_id is not null and {good}"), F.lit(False))
    rows = rows.select("vec_id", F.when(good, F.transform("v", lambda c: c + F.lit(0.0))).alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    leaders = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("x"), F.count("*").alias("copies"), F.first("v").alias("v"))
    leaders = cut(leaders, "leaders")
    bits, tables = plan(leaders.count())
    coded = leaders.mapInArrow(_coder(bits, tables), "x long, copies long, v binary, z binary, codes array<int>")
    coded = cut(coded.select("*", F.length("v").alias("size")), "coded")
    cells = coded.select("size", F.posexplode("codes").alias("t", "cell")).groupBy("t", "size", "cell").agg(F.count("*").alias("n"))
    large = cut(cells.where(F.col("n") > BLOCK).select("t", "size", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-cells")
    placed = coded.select("x", "z", "codes", "size", F.posexplode("codes").alias("t", "cell"))
    placed = placed.join(large, ["t", "size", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "codes": F.expr("slice(codes, 1, t)")})
    placed = placed.select(*KEYS, "block", "x", "z", "codes").repartition(*KEYS).sortWithinPartitions(*KEYS, "x")
    # rows of a table t have t earlier cells, and a run is of one table, so its lists are of one length
    chosen = cut(placed.mapInArrow(_candidates, "t int, size int, cell int, i int, j int, block int, x long"), "candidates")
    fetched = chosen.join(coded.select("x", "copies", "v", "z", "codes"), "x").withColumn("codes", F.expr("slice(codes, 1, t)"))
    fetched = fetched.select(*KEYS, "block", "x", "copies", "v", "z", "codes").repartition(*KEYS).sortWithinPartitions(*KEYS, "x")
    found = cut(fetched.mapInArrow(_linker, "x long, links long, root long"), "links")
    label = components(found.select("x", "root"), "x", "root")
    total = found.groupBy("x").agg(F.sum("links").alias("links")).join(label.toDF("x", "label"), "x", "left")
    classes = cut(leaders.select("h1", "h2", "x", "copies").join(total, "x", "left"), "vector-classes")
    out = rows.select("vec_id", F.col("v").isNotNull().alias("valid"), "h1", "h2").join(classes, ["h1", "h2"], "left")
    links = F.when(F.col("valid"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    component = F.when(F.col("valid"), F.coalesce("label", "x")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_vectors over the whole embeddings table."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id < y.vec_id AND len(x.u) = len(y.u) WHERE list_dot_product(x.u, y.u) >= 0.95),
reach AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a), d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(d.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.id = vec_id
"""
