"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, small_batches
from .textkernel import LOWER, arrow_bytes, slices

#: Labelled documents that training may see: of each language at most, and of all; passages cut from the whole of each
#: document, and characters of a passage.
SAMPLE_DOCS, SAMPLE_ROWS, PASSAGES, PASSAGE_CHARS = 300, 20_000, 4, 96
#: Passages with other letters in their places, by which the network learns what is no known language, for each real one.
SCRAMBLED = 0.25
#: Width of each direction, how it is trained on the sample, the rate at which it learns from all documents after that, and
#: how many of these a task learns from at once.
HIDDEN, STEPS, BATCH, RATE, RATE_OF_ALL, GROUP_DOCS = 12, 700, 128, 0.01, 0.002, 4_000
#: Bytes of a text that one window labels, and bytes before and after these that the directions have read by then.
SPAN, MARGIN = 512, 32
#: Text bytes that a worker cuts into windows at once, windows that run side by side (few enough that the linear algebra
#: library starts no threads of its own), and numbers that these may hold.
SLICE_BYTES, ROWS, CELLS = 1 << 20, 600, 1 << 22

#: Decimals of a score.
DECIMALS = 6

#: Bytes of letters from which a text counts as long, long texts that a calibration needs, the share of long known texts
#: below the least score, and that of short ones above their slack.
LONG, LEAST_LONG, LOST, WITHIN = 200, 50, 0.002, 0.99

#: Bytes of letters: ASCII ones and all above ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows that cover texts at ``offsets``: the row of each, its first and last byte read, and the range of its
    own bytes, which it labels; every byte is one window's own, and at a text's ends there is nothing more to read."""
    size = np.diff(offsets)
    count = -(-size // SPAN)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = offsets[row] + nth * SPAN, np.minimum(offsets[row] + (nth + 1) * SPAN, offsets[row + 1])
    return row, np.maximum(begin - MARGIN, offsets[row]), np.minimum(end + MARGIN, offsets[row + 1]), begin, end


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.tanh(x * np.float32(0.5))
    y *= np.float32(0.5)
    y += np.float32(0.5)
    return y


class Direction:
    """One direction of the network: a gated recurrent unit that reads a byte a step."""

    names = ("W", "U", "b")

    def __init__(self, rng: np.random.Generator):
        self.W = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.U = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(3 * HIDDEN, np.float32)

    def run(self, text: np.ndarray, at: np.ndarray, running: np.ndarray, backward: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Step after step over the bytes from ``at`` on, or back to it, the states of the first ``running[t]`` rows, a
        column each, so that every operation goes along whole rows of numbers. Gates are 1 / (1 + exp(-x)) and new states
        2 / (1 + exp(-2 x)) - 1; the factors are taken into the weights. An exp that overflows stands for 0 or -1."""
        factor = np.repeat(np.array([-1, -2], self.U.dtype), (2 * HIDDEN, HIDDEN))
        first, U = np.ascontiguousarray(((self.W + self.b) * factor).T), np.ascontiguousarray((self.U * factor).T)
        h, room = np.zeros((HIDDEN, len(at)), self.U.dtype), np.empty((2, 3 * HIDDEN * len(at)), self.U.dtype)
        for t in range(len(running))[:: -1 if backward else 1]:
            now, n = h[:, : running[t]], 3 * HIDDEN * running[t]
            x, both = room[0, :n].reshape(3 * HIDDEN, -1), room[1, :n].reshape(3 * HIDDEN, -1)
            first.take(text[at[: running[t]] + t], axis=1, out=x, mode="clip")
            np.matmul(U, now, out=both)
            gates, new = both[: 2 * HIDDEN], both[2 * HIDDEN :]
            gates += x[: 2 * HIDDEN]
            with np.errstate(over="ignore"):
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new *= gates[HIDDEN:]
                new += x[2 * HIDDEN :]
                np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            now -= new
            now *= gates[:HIDDEN]
            now += new
            yield t, now

    def forward(self, letters: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of ``letters`` (steps x rows); ``keep`` gets what the way back needs."""
        h = np.zeros((letters.shape[1], HIDDEN), np.float32)
        out = np.empty((*letters.shape, HIDDEN), np.float32)
        for t, byte in enumerate(letters):
            x = self.W[byte] + self.b
            both = h @ self.U
            z = _sigmoid(x[:, :HIDDEN] + both[:, :HIDDEN])
            r = _sigmoid(x[:, HIDDEN : 2 * HIDDEN] + both[:, HIDDEN : 2 * HIDDEN])
            n = np.tanh(x[:, 2 * HIDDEN :] + r * both[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, n, both[:, 2 * HIDDEN :]))
            h = out[t] = n + z * (h - n)
        return out

    def backward(self, letters: np.ndarray, keep: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients through time, from those of the states."""
        dU, db, dh, inputs = np.zeros_like(self.U), np.zeros_like(self.b), 0, []
        for t in reversed(range(len(letters))):
            h, z, r, n, un = keep[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx, du = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
            inputs.append(dx)
            db += dx.sum(axis=0)
            dU += h.T @ du
            dh = dh * z + du @ self.U.T
        read, dx, dW = letters[::-1].ravel(), np.concatenate(inputs), np.zeros_like(self.W)
        order = np.argsort(read, kind="stable")
        seen, heads = np.unique(read[order], return_index=True)
        dW[seen] = np.add.reduceat(dx[order], heads, axis=0)
        return {"W": dW, "U": dU, "b": db}


class Network:
    """Two directions and a soft-max over languages at every position. A last "language" None stands for none of them."""

    def __init__(self, languages: list[str | None], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.there, self.back = languages, Direction(rng), Direction(rng)
        self.known = [x for x in languages if x is not None]
        self.V = rng.normal(0, 0.2, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def positions(self, letters: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities at each position (steps x rows x languages), and the states; rows are full."""
        there, back = keep or (None, None)
        states = np.concatenate([self.there.forward(letters, there), self.back.forward(letters[::-1], back)[::-1]], axis=2)
        logits = states @ self.V + self.c
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), states

    def pooled(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The sum over all bytes of each text of their language probabilities. Both directions run along the windows of the
        texts side by side; what a window has read before its own bytes gives these their states."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        row, first, last, begin, end = windows_of(offsets)
        order = np.argsort(first - last, kind="stable")
        there, back = np.ascontiguousarray(self.V[:HIDDEN].T), np.ascontiguousarray(self.V[HIDDEN:].T)
        rows = max(16, min(ROWS, CELLS // ((SPAN + 2 * MARGIN) * len(self.languages))))
        for k in range(0, len(order), rows):
            own = order[k : k + rows]  # from the longest to the shortest, so those that go on stand first
            size, skip, to = (last - first)[own], (begin - first)[own], (end - first)[own]
            running = np.searchsorted(-size, -np.arange(size[0]), side="left")
            logits, total = [], np.zeros((len(self.languages), len(own)), np.float32)
            for _, h in self.there.run(text, first[own], running, False):
                logits.append(there @ h + self.c[:, None])
            for t, h in self.back.run(text, first[own], running, True):
                e = logits.pop()
                e += back @ h
                e -= e.max(axis=0)
                np.exp(e, out=e)
                n = h.shape[1]
                e *= ((skip[:n] <= t) & (t < to[:n])) / e.sum(axis=0)
                total[:, :n] += e
            total = total.T
            np.add.at(out, row[own], total)
        return out

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adam on the cross entropy of every position of passages; a step takes passages of all languages alike, cut at the
        shortest of them so that they run together."""
        rng, adam = np.random.default_rng(seed), _Adam(self)
        size = np.array([len(t) for t in texts])
        order = np.argsort(size, kind="stable")  # passages of about one length run together
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_label = [np.sort(place[labels == k]) for k in np.unique(labels)]
        for step in range(1, STEPS + 1):
            near, share = rng.random(), max(1, BATCH // len(by_label))
            rows = []
            for own in by_label if len(by_label) <= BATCH else [by_label[k] for k in rng.choice(len(by_label), BATCH, replace=False)]:
                some = own[np.clip((near * len(own) + rng.normal(0, 0.05 * len(own) + 1, share)).astype(int), 0, len(own) - 1)]
                rows.append(order[some])
            rows = np.concatenate(rows)
            adam.step([texts[r] for r in rows], labels[rows], RATE * min(1, 2 * (1 - step / (STEPS + 1))))

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 17) -> None:
        """Goes on learning from passages, each of which is in one step; in a step, those of a language count as much as those of
        any other, and all are about as long among the passages of their language."""
        rng, adam = np.random.default_rng(seed), _Adam(self)
        size, steps = np.array([len(t) for t in texts]), -(-len(texts) // BATCH)
        parts = []
        for k in np.unique(labels):
            own = np.flatnonzero(labels == k)
            parts.append(np.array_split(own[np.argsort(size[own], kind="stable")], steps))
        for done, step in enumerate(rng.permutation(steps)):
            own = [p[step] for p in parts if len(p[step])]
            rows = np.concatenate(own)
            weight = np.concatenate([np.full(len(p), len(rows) / (len(own) * len(p)), np.float32) for p in own])
            adam.step([texts[r] for r in rows], labels[rows], RATE_OF_ALL * (1 - done / steps), weight)

    def weights(self) -> np.ndarray:
        """All that is learned, one number after the other."""
        return np.concatenate([getattr(owner, name).ravel() for owner, name in self.held()])

    def set_weights(self, flat: np.ndarray) -> None:
        at = 0
        for owner, name in self.held():
            old = getattr(owner, name)
            setattr(owner, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def held(self) -> list[tuple[object, str]]:
        return [(self.there, n) for n in Direction.names] + [(self.back, n) for n in Direction.names] + [(self, "V"), (self, "c")]


class _Adam:
    """Adam on the cross entropy of every position of passages, which are cut at the shortest of a step."""

    def __init__(self, network: Network):
        self.network, self.held, self.steps = network, network.held(), 0
        self.first, self.second = [0.0] * len(self.held), [0.0] * len(self.held)

    def step(self, texts: list[np.ndarray], truth: np.ndarray, rate: float, weight: np.ndarray | None = None) -> None:
        net, self.steps = self.network, self.steps + 1
        n = min(map(len, texts))
        batch, keep = np.stack([t[:n] for t in texts]).T, ([], [])
        p, states = net.positions(batch, keep)
        p[:, np.arange(len(texts)), truth] -= 1
        p /= n * len(texts)
        if weight is not None:
            p *= weight[:, None]
        flat = states.reshape(-1, 2 * HIDDEN)
        dV, dc, dstates = flat.T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1)), p @ net.V.T
        there = net.there.backward(batch, keep[0], dstates[:, :, :HIDDEN])
        back = net.back.backward(batch[::-1], keep[1], dstates[::-1, :, HIDDEN:])
        for k, ((owner, name), g) in enumerate(zip(self.held, [*there.values(), *back.values(), dV, dc], strict=True)):
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            step_ = rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            setattr(owner, name, (getattr(owner, name) - step_).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4; false for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(labelled: DataFrame, counts: DataFrame) -> DataFrame:
    """Labelled rows to begin with, by the hash of doc_id: of each language about SAMPLE_DOCS to twice as many, fewer where
    there are so many languages that all would be more than SAMPLE_ROWS; with ``place``, the hash, and ``quota``."""
    quota = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // max(1, counts.count())))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    return labelled.join(counts, "lang").withColumns({"place": place, "quota": F.lit(quota)}).where(F.col("place") < 2.0 * F.col("quota") / F.col("n"))


def scrambled(texts: list[np.ndarray], seed: int = 13) -> list[np.ndarray]:
    """Passages that look like text and are none: the letters of every other one change places, or stand for others."""
    rng, out = np.random.default_rng(seed), []
    for k in rng.permutation(len(texts))[: int(SCRAMBLED * len(texts))]:
        text, own = texts[k].copy(), np.flatnonzero(LETTERS[texts[k]])
        if len(out) % 2:
            text[own] = rng.permutation(text[own])
        else:
            code = np.arange(256, dtype=np.uint8)
            code[0x61:0x7B] = rng.permutation(code[0x61:0x7B])
            text = code[text]
        out.append(text)
    return out


def _cuts(passages: int) -> Column:
    """So many passages of PASSAGE_CHARS characters from anywhere in a text, at places that a hash gives."""
    room = F.greatest(F.length("text") - PASSAGE_CHARS + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(passages)), lambda k: F.substring("text", (F.pmod(F.xxhash64("doc_id", k), room) + 1).cast("int"), F.lit(PASSAGE_CHARS))))


def _passages(rows: list[tuple[str, list[str]]], languages: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
    """Passages with letters of (language, cuts), and the number of the language of each."""
    number, texts, labels = {lang: k for k, lang in enumerate(languages)}, [], []
    for lang, cuts in rows:
        own = [LOWER[np.frombuffer(c.encode(), np.uint8)] for c in cuts]
        texts += [t for t in own if LETTERS[t].any()]
        labels += [number[lang]] * (len(texts) - len(labels))
    return texts, labels


def train(labelled: DataFrame, all_documents: bool = True) -> Network | None:
    """A network for ``labelled`` (doc_id, text, lang), all of which it learns from, or else the sample alone; None if no row has
    letters.

    It begins with a bounded sample on the driver: of each language at most SAMPLE_DOCS documents, those with the smallest
    hashes of doc_id, of all at most SAMPLE_ROWS. Then it learns from every document, by groups of about GROUP_DOCS in
    tasks of their own (``_learned_from_all``). Of a document it reads passages of PASSAGE_CHARS characters from anywhere in
    the text: PASSAGES where it is in the sample, and one in the pass over all. A language without a document in the sample is not learned, which only more than SAMPLE_ROWS
    languages can bring about. ``documents`` of the network says how many it has learned from.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    counts = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    lettered = F.col("text").rlike("\\p{L}")
    drawn = _drawn(labelled, counts).where(lettered)
    rows = drawn.select("lang", "place", "quota", _cuts(PASSAGES).alias("cuts")).orderBy("place", "lang", "cuts").limit(3 * SAMPLE_ROWS).collect()
    languages, taken, some = sorted({r.lang for r in rows}), {}, []
    for row in rows:
        taken[row.lang] = taken.get(row.lang, 0) + 1
        if taken[row.lang] <= row.quota:
            some.append((row.lang, row.cuts))
    texts, labels = _passages(some, languages)
    if not texts:
        return None
    # of few texts nothing can be learned about what is none of them, as nothing can be calibrated then
    others = scrambled(texts) if len(texts) >= PASSAGES * LEAST_LONG else []
    network = Network([*languages, None] if others else languages)
    network.fit(texts + others, np.array(labels + [len(languages)] * len(others)))
    network.documents = len(some)
    n, most = counts.agg(F.sum("n"), F.max("n")).first()
    if all_documents and most > rows[0].quota:  # else all were in the sample
        _learned_from_all(labelled.where(lettered & F.col("lang").isin(languages)), network, -(-n // GROUP_DOCS))
    return network


def _learned_from_all(labelled: DataFrame, network: Network, groups: int) -> None:
    """One pass over all documents: those of a group, by hash of doc_id, carry a copy of the network on, and the copies' mean,
    by their passages, is what is learned. Only sums of weights come to the driver, one row of a fixed size a partition."""
    seed = network.weights()

    def learned(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["cuts"].to_pylist(), strict=True))
        texts, labels = _passages([r[1:] for r in rows], network.languages)
        others = scrambled(texts) if network.languages[-1] is None else []
        network.set_weights(seed)
        if texts:
            network.learn(texts + others, np.array(labels + [len(network.known)] * len(others)))
        flat = network.weights().astype(np.float64) * len(texts)
        return pa.table({"documents": pa.array([len(rows)], pa.int64()), "passages": pa.array([len(texts)], pa.int64()), "weights": pa.array([flat.tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, passages, total = 0, 0, np.zeros(len(seed))
        for batch in batches:
            documents, passages = documents + sum(batch["documents"].to_pylist()), passages + sum(batch["passages"].to_pylist())
            for flat in batch["weights"].to_pylist():
                total += np.frombuffer(flat)
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([passages]), pa.array([total.tobytes()], pa.binary())], names=["documents", "passages", "weights"])

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", _cuts(1).alias("cuts"), F.pmod(F.xxhash64("doc_id", F.lit(GROUP_DOCS)), F.lit(groups)).alias("group"))
    schema = "documents long, passages long, weights binary"
    # a number of partitions that is given is kept; the few bytes of passages would else come together in one task
    sums = rows.repartition(groups, "group").groupBy("group").applyInArrow(learned, schema).mapInArrow(summed, schema).collect()
    network.documents = sum(r.documents for r in sums)
    network.set_weights(sum(np.frombuffer(bytes(r.weights)) for r in sums) / sum(r.passages for r in sums))


def _predictor(network: Network | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets, SLICE_BYTES):
                names, best = np.full(b - a, "und", dtype=object), np.zeros(b - a)
                some = np.flatnonzero(lettered[a:b])
                if network and some.size:
                    p = network.pooled(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])[some, : len(network.known)]
                    # sums of floats differ in their last bits by a window's place among others; rounded, equal texts have
                    # equal scores unless these lie at the very edge of two decimals
                    p = np.round(p / np.diff(offsets)[a:b][some][:, None], DECIMALS)
                    names[some] = np.array(network.known, dtype=object)[p.argmax(axis=1)]
                    best[some] = np.clip(p.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(names, pa.string()), pa.array(best)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return predict


def identify(documents: DataFrame, network: Network | None) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, held_out, lang_pred, score.

    The network reads the whole text as bytes, A-Z lower-cased, in windows of SPAN bytes that run side by side; each has
    read MARGIN bytes before and behind its own by the time it labels these. Every byte gets probabilities, which are
    averaged over the text; the best language and its average are the prediction. A text that is null or has no letter is
    ``und`` with score 0, and so is all where there was nothing to learn from. Only the text decides; repeated rows are treated alike, ties
    go to the first language in alphabetical order. Extra columns are ignored; an empty table gives an empty result.
    """
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"), lettered.alias("lettered"))
    return rows.mapInArrow(_predictor(network), "doc_id long, held_out boolean, lang_pred string, score double")


def _letters(column: pa.Array) -> np.ndarray:
    """Bytes of letters of each text."""
    data, offsets = arrow_bytes(column)
    return np.diff(np.concatenate([[0], np.cumsum(LETTERS[data])])[offsets])


def calibrate(labelled: DataFrame, network: Network | None) -> tuple[float, float] | None:
    """Least score and slack for in_known_language, from ``labelled`` (doc_id, text, lang) in the network's languages, which
    it has not learned from; None if fewer than LEAST_LONG of them are long.

    The least score is the LOST quantile of long texts. A mean over n letters strays by about 1 / sqrt(n), so shorter
    texts get a slack of that form, by which WITHIN of them reach it. All of the texts are scored, whole; of their scores,
    which are written, two ranks come to the driver.
    """
    if network is None:
        return None
    labelled = labelled.select("doc_id", "text", "lang").where(F.col("lang").isin(network.known) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    letters = F.octet_length(F.regexp_replace("text", "[^A-Za-z\\x{80}-\\x{10FFFF}]", ""))
    scored = identify(labelled.select(letters.alias("doc_id"), "text"), network).where("doc_id > 0")
    scored = cut(scored.select(F.col("doc_id").alias("n"), "score"), "scores")
    long_, short = scored.where(F.col("n") >= LONG), scored.where(F.col("n") < LONG)
    if len(long_.head(LEAST_LONG)) < LEAST_LONG:
        return None
    least = long_.agg(F.percentile("score", F.lit(LOST))).first()[0]
    below = short.select(((least - F.col("score")) * F.sqrt("n")).alias("x"))
    n = below.count()
    if not n:
        return least, 0.0
    # the rank that is not below WITHIN of the way from the first to the last
    rank = int(np.ceil(WITHIN * (n - 1)))
    return least, max(0.0, below.selectExpr(f"percentile_disc({(rank + 0.5) / n}) WITHIN GROUP (ORDER BY x)").first()[0])


def in_known_language(documents: DataFrame, network: Network | None, least: float, slack: float = 0.0) -> DataFrame:
    """The rows of ``documents`` (text, ...) with a predicted language of at least that score, with all their columns; a
    text with n bytes of letters may be below it by slack / sqrt(n)."""
    predict, schema = _predictor(network), documents.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def described() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held[:] = [batch, 0]
                row = batch.column("row")
                n = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([n, row.field("text"), pa.nulls(batch.num_rows, pa.bool_()), batch.column("lettered")], names=["doc_id", "text", "held_out", "lettered"])

        for part in predict(described()):
            batch, at = held
            held[1] = at + part.num_rows
            letters = _letters(batch.column("row").field("text").slice(at, part.num_rows))
            good = (part.column("score").to_numpy() >= least - slack / np.sqrt(np.maximum(letters, 1))) & (part.column("lang_pred").to_numpy(zero_copy_only=False) != "und")
            row = batch.slice(at, part.num_rows).filter(pa.array(good)).column("row")
            yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in schema])

    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return small_batches(documents).select(F.struct("*").alias("row"), lettered.alias("lettered")).mapInArrow(keep, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from a sample of the documents that are not held out, then predicts all."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, train(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), all_documents=False))
