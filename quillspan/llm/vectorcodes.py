"""Vector codes by product quantisation on integers; nearest entries come from a vantage-point tree for each part."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Parts of a vector, entries of a codebook, rounds of refinement, and units of an integer component.
PARTS, ENTRIES, ROUNDS, UNITS = 16, 64, 2, 256
#: Entries of a leaf of the tree; distances are rounded to 1 / FINE.
LEAF, FINE = 8, 16
#: Components that a worker holds as integers at once, and bits of a limb of a sum.
SLICE, LIMB = 1 << 20, 32


def floors(x: np.ndarray) -> np.ndarray:
    """floor(UNITS * x), exactly: 64-bit integers, or Python's where those don't suffice."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(UNITS))
    if (np.abs(y) < 2.0**53).all():
        return y.astype(np.int64)
    exact = [int(b) if math.isfinite(b) else int(a) * UNITS for a, b in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(x.shape)


def _narrow(width: int) -> int:
    """Components below this in size have squared distances, with their fine units, within 64 bits."""
    return math.isqrt((1 << 60) // (4 * FINE * FINE * max(width, 1)))


def _down(square: np.ndarray) -> np.ndarray:
    """Square roots in units of 1 / FINE, rounded down."""
    x = square * (FINE * FINE)
    if x.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(x)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def _up(square: np.ndarray, down: np.ndarray) -> np.ndarray:
    return down + (down * down < square * (FINE * FINE))


class Tree:
    """A vantage-point tree over the entries of one codebook. A node is a list of entries, or a vantage entry with two
    balls around it: the nearer half of the others and the farther, each between two radii that are rounded outwards."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._grow(np.arange(len(entries)))

    def _squares(self, q: np.ndarray, entry: int) -> np.ndarray:
        return ((q - self.entries[entry]) ** 2).sum(axis=-1)

    def _grow(self, own: np.ndarray):
        if len(own) <= LEAF:
            return np.sort(own)
        point, rest = own[0], own[1:]
        square = self._squares(self.entries[rest], point)
        order, half, balls = np.argsort(square, kind="stable"), len(rest) // 2, []
        for part in (order[:half], order[half:]):
            low = _down(square[part])
            balls.append((low.min(), _up(square[part], low).max(), self._grow(rest[part])))
        return point, balls

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of ``q``, the lowest index among equals."""
        index, best = np.zeros(len(q), np.int64), self._squares(q, 0)

        def offer(rows: np.ndarray, entry: np.ndarray, square: np.ndarray) -> None:
            better = ((square < best[rows]) | ((square == best[rows]) & (entry < index[rows]))).astype(bool)
            best[rows[better]], index[rows[better]] = square[better], entry[better]

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if not isinstance(node, tuple):
                square = np.stack([self._squares(q[rows], e) for e in node])
                least = square.argmin(axis=0)
                offer(rows, node[least], square[least, np.arange(len(rows))])
                return
            point, balls = node
            square = self._squares(q[rows], point)
            offer(rows, np.full(len(rows), point), square)
            low = _down(square)
            high = _up(square, low)
            inner = (low - balls[0][1] <= balls[1][0] - high).astype(bool)
            for some, order in ((inner, (0, 1)), (~inner, (1, 0))):
                for k in order:
                    least, most, child = balls[k]
                    apart = np.maximum(np.maximum(low[some] - most, least - high[some]), 0)
                    # not strict: an entry at the very same distance may have the lower index
                    visit(child, rows[some][(apart * apart <= best[rows[some]] * (FINE * FINE)).astype(bool)])

        visit(self.top, np.arange(len(q)))
        return index, best


class Codebooks:
    """The codebooks of all part positions: integers of shape (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.count, self.width = entries.shape
        self.limit = _narrow(self.width)
        self.wide = bool((np.abs(entries) >= self.limit).any())
        self.entries = entries.astype(object) if self.wide else entries.astype(np.int64)
        self.trees = [Tree(e) for e in self.entries]
        self.exact = self.trees if self.wide else [Tree(e.astype(object)) for e in self.entries]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances, rows by parts, of integer vectors."""
        index, square = np.zeros((len(v), self.parts), np.int64), np.zeros((len(v), self.parts), object)
        wide = (np.abs(v) >= self.limit).any(axis=1).astype(bool) if not self.wide else np.ones(len(v), bool)
        for rows, trees, kind in ((np.flatnonzero(~wide), self.trees, np.int64), (np.flatnonzero(wide), self.exact, object)):
            if len(rows):
                own = v[rows].astype(kind).reshape(len(rows), self.parts, self.width)
                for p, tree in enumerate(trees):
                    index[rows, p], square[rows, p] = tree.nearest(own[:, p])
        return index, square

    def moved(self, sums: dict[tuple[int, int, int], int]) -> Codebooks:
        """Every entry that has parts replaced by floor(sum / count); component -1 of ``sums`` is the count."""
        new = self.entries.astype(object)
        for (p, e, c), total in sums.items():
            if c >= 0:
                new[p, e, c] = total // sums[p, e, -1]
        return Codebooks(new)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches: the rows whose vectors have that size, and these as integers."""
    step = max(1, SLICE // max(size, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            column = piece.column("v")
            rows = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == size)
            yield piece, rows, floors(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size))


def _summer(books: Codebooks):
    """Of all vectors of a task: the sum of the parts of each entry, component by component, and their count, in limbs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((books.parts, books.count, books.width + 1), object)
        for _, rows, v in _vectors(batches, books.parts * books.width):
            index, _ = books.assign(v)
            parts = v.reshape(len(rows), books.parts, books.width)
            for p in range(books.parts):
                order = np.argsort(index[:, p], kind="stable")
                entry, first, count = np.unique(index[order, p], return_index=True, return_counts=True)
                if len(entry):
                    # a slice has at most SLICE components below 2**53 as 64-bit integers, or Python's
                    sums = np.add.reduceat(parts[order, p].astype(object) if v.dtype == object or np.abs(parts).max() >= 1 << 42 else parts[order, p], first, axis=0)
                    total[p, entry, :-1] += sums.astype(object)
                    total[p, entry, -1] += count.astype(object)
        found: list[tuple[int, int, int, int, int]] = []
        for p, e in np.argwhere(total[:, :, -1] > 0).tolist():
            for c in range(-1, books.width):
                rest, limb = int(total[p, e, c]), 0
                while rest and not -(1 << LIMB) < rest < 1 << LIMB:
                    found.append((p, e, c, limb, rest & ((1 << LIMB) - 1)))
                    rest, limb = rest >> LIMB, limb + 1
                found.append((p, e, c, limb, rest))
        columns = zip(*found, strict=True) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], names=["p", "e", "c", "limb", "n"])

    return add


def _coder(books: Codebooks):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows, v in _vectors(batches, books.parts * books.width):
            index, square = books.assign(v)
            codes, errors = np.full(piece.num_rows, None, object), np.full(piece.num_rows, None, object)
            codes[rows] = [c.tobytes().hex() for c in index.astype(np.uint8)]
            sums = square.sum(axis=1).tolist()
            errors[rows] = [s if s < 1 << 63 else None for s in sums]
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return code


def encode_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Rows of ``embeddings`` (vec_id, embedding, label) as codes: vec_id, code, error, label_error, codebooks_sha256; and
    the codebooks, None without any vector.

    A component x counts as floor(256 x). A vector is cut into equal parts, each of which is replaced by the index of the
    nearest entry (squared Euclidean distance, the lower index among equals) of its position's codebook, two hex digits
    each. Codebooks start as the parts of the vectors with the smallest vec_ids and move, in every round, to the floor of
    the mean of what was assigned to them; unused entries stay. Tasks return sums, in limbs of 32 bits, which are exact
    for any input; at most parts * entries * (components + 1) sums of a few limbs reach the driver, and the codebooks go
    to the tasks, which search them through vantage-point trees: radii are rounded outwards to whole 1 / FINE, a ball
    is left out only where it can't hold an equally near entry, and distances are compared as integers.

    Rows whose vector is null or holds null or non-finite components are dropped. All codebooks are for one length: that
    of the vector with the smallest vec_id, among lengths that ``parts`` divides, above 0; a vector of another length
    stays with code and error null. Rows of equal vec_id are ordered by their vectors; a null vec_id is coded but starts
    no entry. With fewer vectors than entries the codebooks are as small. label_error is the sum of error over equal
    labels, nulls together. A sum beyond a long is null. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    finite = "forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    rows = rows.where(F.coalesce(F.expr(f"v is not null and {finite}"), F.lit(False)))
    able = rows.where(f"vec_id is not null and size(v) > 0 and size(v) % {parts} = 0").select("vec_id", "v")
    first = able.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if first is None:
        out = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return out.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.sha2(F.lit(""), 256).alias("codebooks_sha256")), None
    starts = [r.v for r in able.where(F.size("v") == first.n).orderBy("vec_id", "v").limit(entries).collect()]
    width = first.n // parts
    books = Codebooks(floors(np.array(starts, dtype=float)).reshape(len(starts), parts, width).swapaxes(0, 1))
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_summer(books), "p int, e int, c int, limb int, n long")
        sums: dict[tuple[int, int, int], int] = {}
        for r in found.groupBy("p", "e", "c", "limb").agg(F.sum("n").alias("n")).collect():
            sums[r.p, r.e, r.c] = sums.get((r.p, r.e, r.c), 0) + (r.n << (LIMB * r.limb))
        books = books.moved(sums)
    kind = rows.schema["label"].dataType.simpleString()
    coded = cut(rows.mapInArrow(_coder(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    beyond = F.max(F.col("code").isNotNull() & F.col("error").isNull())
    total = F.when(~beyond, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    labels = cut(coded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """encode_vectors over the whole embeddings table."""
    return encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


_ASSIGN = "(SELECT vec_id, p, min(d * 64 + i) AS best FROM (SELECT k.vec_id, k.p, c.i, list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k JOIN {books} c USING (p)) GROUP BY vec_id, p)"
_MOVE = """(SELECT p, i, coalesce(list(m ORDER BY j) FILTER (m IS NOT NULL), any_value(q)) AS q FROM (
  SELECT c.p, c.i, c.q, s.j, (s.total - (((s.total % s.n) + s.n) % s.n)) // s.n AS m FROM {books} c LEFT JOIN (
    SELECT k.p, a.best % 64 AS i, j, sum(k.q[j])::BIGINT AS total, count(*) AS n FROM k JOIN {assigned} a USING (vec_id, p), range(1, 5) t(j) GROUP BY ALL) s USING (p, i)) GROUP BY p, i)"""

#: For vectors of 64 components, as the given ones are.
OP12_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
k AS (SELECT vec_id, p, e[p * 4 + 1:p * 4 + 4] AS q FROM v, range(16) t(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, q FROM k QUALIFY i < 64),
a1 AS {_ASSIGN.format(books="c0")}, c1 AS {_MOVE.format(books="c0", assigned="a1")},
a2 AS {_ASSIGN.format(books="c1")}, c2 AS {_MOVE.format(books="c1", assigned="a2")},
a3 AS {_ASSIGN.format(books="c2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, i)) FROM c2) AS codebooks_sha256
FROM v JOIN coded USING (vec_id)
"""
