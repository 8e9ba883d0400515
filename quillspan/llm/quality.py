"""Document quality by a linear-chain conditional random field over lines, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .storage import cut, small_batches
from .textkernel import LOWER, NOT_SPACE, arrow_bytes, hash_words, slices, split_words

#: Labelled documents of each label that training may see, and consecutive lines of each, from anywhere in it.
SAMPLE_DOCS, SAMPLE_LINES = 2500, 40
#: How it is trained; scores of lines are held within CLIP.
STEPS, RATE, RIDGE, CLIP = 250, 0.1, 1e-3, 30.0
#: Score from which a document is predicted good.
GOOD = 0.7
#: Text bytes that a worker turns into features at once.
SLICE_BYTES = 1 << 20
#: Words up to which a repeat is looked for behind a word.
BEHIND = 3

#: Classes of bytes: 0 others, 1 capitals, 2 other letters and all bytes above ASCII, 3 digits, 4 blanks, 5 stops, 6 loud stops.
CLASS = np.zeros(256, np.int64)
CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:], CLASS[0x30:0x3A] = 1, 2, 2, 3
CLASS[[0x20, *range(0x09, 0x0E)]] = 4
CLASS[list(b".,;:'\"-()")] = 5
CLASS[list(b"!?")] = 6
#: Features of a line alone, and with those of its neighbours, whether it has them, and a constant.
OWN = 15
WIDTH = 3 * OWN + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts at ``offsets``, the text of each line, and its bytes with its end. A text has
    one line more than line ends, so an empty text has an empty line."""
    ends = np.flatnonzero(data == 0x0A)
    per_text = np.searchsorted(ends, offsets[1:]) - np.searchsorted(ends, offsets[:-1]) + 1
    row = np.repeat(np.arange(len(per_text)), per_text)
    first = np.cumsum(per_text) - per_text
    begin = np.empty(len(row), np.int64)
    inner = np.ones(len(row), bool)
    inner[first] = False
    begin[first], begin[inner] = offsets[:-1], ends + 1
    last = first + per_text - 1
    end = np.empty(len(row), np.int64)
    ahead = np.ones(len(row), bool)
    ahead[last] = False
    end[last], end[ahead] = offsets[1:], ends
    size = end - begin
    keep = np.ones(len(data), bool)
    keep[ends] = False
    of_byte = np.repeat(np.arange(len(row)), size)
    count = np.bincount(of_byte * 7 + CLASS[data[keep]], minlength=7 * len(row)).reshape(-1, 7).astype(np.float64)
    b, e, _ = split_words(data, offsets, NOT_SPACE)
    bounds = np.searchsorted(b, np.concatenate([begin, offsets[-1:] + 1]))
    words, line = np.diff(bounds), np.repeat(np.arange(len(row)), np.diff(bounds))
    h, again = hash_words(LOWER[data], b, e), np.zeros(len(b), bool)
    for k in range(1, BEHIND + 1):
        again[k:] |= (h[k:] == h[:-k]) & (line[k:] == line[:-k])
    letters = np.concatenate([[0], np.cumsum((CLASS[data] == 1) | (CLASS[data] == 2))])
    bare = letters[e] == letters[b]

    def per_line(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(words, 1)

    many = np.maximum(size, 1)
    shares = [count[:, 1] / np.maximum(count[:, 1] + count[:, 2], 1), count[:, 3] / many, count[:, 6] / many, count[:, 0] / many, per_line(again)]
    plain = [np.log1p(size) / 5, size == 0, count[:, 4] / many, count[:, 5] / many, per_line(e - b) / 10, per_line(bare)]
    own = np.stack([*shares, *(np.sqrt(s) for s in shares[1:]), *plain], axis=1)
    out = np.zeros((len(row), WIDTH), np.float32)
    out[:, :OWN], out[:, -1] = own, 1
    out[inner, OWN : 2 * OWN], out[inner, -3] = own[np.flatnonzero(inner) - 1], 1
    out[ahead, 2 * OWN : 3 * OWN], out[ahead, -2] = own[np.flatnonzero(ahead) + 1], 1
    return out, row, size + 1


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices that stand along the last axis, scaled to sums of 1."""
    out = np.stack([np.stack([a[i, 0] * b[0, j] + a[i, 1] * b[1, j] for j in (0, 1)]) for i in (0, 1)])
    return out / out.sum(axis=(0, 1))


def marginals(score: np.ndarray, row: np.ndarray, start: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over the chains that ``row`` names in order: of each line the probability of good, and of each
    pair of labels of the line before and it (2 x 2 x lines; zeros for first lines). ``score`` is in favour of good;
    ``start`` and ``steps`` are logarithms of potentials of first labels and of pairs.

    Products of transition matrices are taken over 1, 2, 4, ... lines at once, so that a text of any number of lines
    takes a logarithmic number of passes over arrays.
    """
    n = len(score)
    if n == 0:
        return np.empty(0), np.empty((2, 2, 0))
    half = np.clip(score, -CLIP, CLIP) / 2
    seen = np.exp(np.stack([-half, half]) - np.abs(half))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.concatenate([first, [n]]))
    place = np.arange(n) - np.repeat(first, length)
    left = np.repeat(length, length) - 1 - place
    step = np.exp(steps)[:, :, None] * seen[None]
    forward, backward = step.copy(), step
    forward[:, :, first] = (np.exp(start)[:, None] * seen[:, first])[None]
    forward /= forward.sum(axis=(0, 1))
    backward = backward / backward.sum(axis=(0, 1))
    d = 1
    while d < length.max():
        some = np.flatnonzero(place >= d)
        forward[:, :, some] = _times(forward[:, :, some - d], forward[:, :, some])
        some = np.flatnonzero(left >= d)
        backward[:, :, some] = _times(backward[:, :, some], backward[:, :, some + d])
        d *= 2
    alpha, beta = forward[0], np.ones((2, n))
    beta[:, left > 0] = backward.sum(axis=1)[:, np.flatnonzero(left > 0) + 1]
    both = alpha * beta
    pairs = np.zeros((2, 2, n))
    later = np.flatnonzero(place > 0)
    pairs[:, :, later] = alpha[:, None, later - 1] * step[:, :, later] * beta[None, :, later]
    pairs[:, :, later] /= pairs[:, :, later].sum(axis=(0, 1))
    return both[1] / both.sum(axis=0), pairs


class Chain:
    """The field: a weight for each feature, and potentials of first labels and of pairs of labels."""

    def __init__(self) -> None:
        self.weight, self.start, self.steps = np.zeros(WIDTH), np.zeros(2), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def gradient(self, x: np.ndarray, row: np.ndarray, good: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        """Of the log likelihood, where all lines of chain k have the label ``good[k]`` and the chain counts ``share[k]``."""
        p, pairs = marginals(x @ self.weight, row, self.start, self.steps)
        y, w = good[row], share[row]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        true = np.zeros((2, 2, len(row)))
        true[y, y, np.arange(len(row))] = ~first
        at = p[first], y[first], w[first]
        start = np.array([((1 - at[1]) - (1 - at[0])) @ at[2], (at[1] - at[0]) @ at[2]])
        return [x.T @ ((y - p) * w) - RIDGE * self.weight, start - RIDGE * self.start, (true - pairs) @ w - RIDGE * self.steps]

    def fit(self, x: np.ndarray, row: np.ndarray, good: np.ndarray, share: np.ndarray) -> None:
        """Ascends the mean log likelihood by Adam."""
        x, share = x.astype(np.float64), share / share.sum()
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        own = [self.weight, self.start, self.steps]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in own]
        for step in range(1, STEPS + 1):
            for p, (m, v), g in zip(own, moments, self.gradient(x, row, good, share), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the mean over its lines of the probability of good, weighted by their bytes."""
        x, row, size = line_features(data, offsets)
        p, _ = marginals(((x - self.mean) / self.scale) @ self.weight, row, self.start, self.steps)
        n = len(offsets) - 1
        return np.clip(np.bincount(row, p * size, n) / np.maximum(np.bincount(row, size, n), 1), 0, 1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of at most SAMPLE_LINES consecutive lines of each text, at the place that ``place`` gives."""
    for batch in batches:
        data, offsets = arrow_bytes(batch.column("text"))
        place = batch.column("place").to_numpy()
        for a, b in slices(offsets, SLICE_BYTES):
            x, row, _ = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            cuts = []
            for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                low += int(place[a + k] * (max(0, high - low - SAMPLE_LINES) + 1))
                cuts.append(x[low : min(high, low + SAMPLE_LINES)].tobytes())
            piece = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(cuts, pa.binary())], names=["doc_id", "quality", "x"])


def train(documents: DataFrame, labels: DataFrame) -> Chain | float:
    """A chain for ``documents`` (doc_id, text) by ``labels`` (doc_id, quality), all of which it may learn from; where there
    is one label only, or none, that label, or 0.5, which is everyone's score then.

    It learns from a bounded sample: of each label at most SAMPLE_DOCS labelled doc_ids, those with the smallest hashes,
    and of each at most SAMPLE_LINES consecutive lines from anywhere in the text; only their features come to the driver. In
    training each line has the label of its document, and documents count as much as their label has rows. Rows without
    doc_id, or with a quality other than 0 and 1, are left out; of repeated rows one counts; a doc_id with both labels
    counts as both. Scoring is not bounded by any of this.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    total = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    drawn = None
    for quality, n in sorted(total.items()):
        some = known.where((F.col("quality") == quality) & (place < 4.0 * SAMPLE_DOCS / n)).distinct()
        some = some.withColumn("place", place).orderBy("place", "doc_id").limit(SAMPLE_DOCS)
        drawn = some if drawn is None else drawn.unionAll(some)
    if drawn is None:
        return 0.5
    drawn = cut(drawn, "drawn-labels")
    # at most 2 * SAMPLE_DOCS short rows are broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    rows = small_batches(texts).select("doc_id", "quality", "text", F.pmod(F.col("place") * 65536, F.lit(1.0)).alias("place"))
    found = rows.mapInArrow(_windows, "doc_id long, quality int, x binary")
    found = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id", "quality").collect()
    seen = sorted({r.quality for r in found})
    if len(seen) < 2:
        return float(seen[0]) if seen else 0.5
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in found]
    good = np.array([r.quality for r in found])
    share = np.array([total[q] / (good == q).sum() for q in (0, 1)])[good]
    chain = Chain()
    chain.fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(f) for f in x]), good, share)
    return chain


def _scorer(chain: Chain | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                s = chain.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if isinstance(chain, Chain) else np.full(b - a, chain)
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(s), pa.array((s >= GOOD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return score


def judge(documents: DataFrame, chain: Chain | float) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted.

    Every line of the whole text gets features of its own and of the lines before and after it, the chain labels all
    lines of a text together, and the lines' probabilities of good are averaged, weighted by bytes and one more for the
    line end. predicted is 1 from GOOD on. A null text counts as empty: one empty line. Only the text decides, so
    repeated rows are treated alike. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_scorer(chain), "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels of documents that are not held out, then scores all documents."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(documents, train(documents, labels.where(~held_out(F.col("doc_id")))))
