"""Substring dedup: runs of words, by sentences or pieces of long ones, that other documents have too are removed but where they come first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, small_batches
from .textkernel import LOWER, NOT_SPACE, U64, arrow_bytes, hash_words, mix, slices, split_words

#: A run has at least so many words. A sentence of more is over-long: runs also start at its cuts.
MIN_WORDS = 20
#: Of so many consecutive words of an over-long sentence, runs start at those whose hash is smallest.
CUT_WORDS = 7
#: A run that would only end more than so many words on is also taken as its first MIN_WORDS words.
FAR_WORDS = 30
#: Text bytes that a worker holds in numpy at once.
SLICE_BYTES = 2 << 20
_NO_ID = -(2**63)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: What ends a sentence, and what may follow that within its word.
_ENDS = tuple(c.encode() for c in ".!?。！？．｡…।؟۔")
_CLOSERS = tuple(c.encode() for c in "\"')]}”’»›」』）】〉》〕］｝｣")


def _at(text: np.ndarray, end: np.ndarray, begin: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Bytes of the mark that stands before each end, not before its begin; 0 if none does."""
    out = np.zeros(len(end), np.int64)
    for size in {len(m) for m in marks}:
        k = np.flatnonzero(end - begin >= size)
        code = np.zeros(len(k), np.int64)
        for j in range(size):
            code = code << 8 | text[end[k] - size + j]
        out[k[np.isin(code, [int.from_bytes(m) for m in marks if len(m) == size])]] = size
    return out


def _words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """As split_words between white space, and each letter or mark of a script without spaces is a word, with the
    closing marks after it."""
    begin, end, bounds = split_words(text, offsets, NOT_SPACE)
    lead = np.flatnonzero(text >= 0xE0)
    after = text[np.minimum(lead + 1, len(text) - 1)]
    kind = text[lead]
    spaceless = (kind >= 0xE3) & (kind <= 0xE9) | (kind == 0xF0) & (after >= 0xA0) & (after <= 0xAF)
    spaceless |= (kind == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (kind == 0xE1) & np.isin(after, [0x80, 0x81, 0x82, 0x9E, 0x9F])
    lead = lead[spaceless]
    if not len(lead):
        return begin, end, bounds
    past = lead + np.where(text[lead] == 0xF0, 4, 3)
    more = np.unique(np.concatenate([lead, past]))
    more = more[more < len(text)]
    more = more[NOT_SPACE[text[more]]]
    width = np.where(text[more] < 0x80, 1, np.where(text[more] < 0xE0, 2, np.where(text[more] < 0xF0, 3, 4)))
    more = more[_at(text, np.minimum(more + width, len(text)), more, _CLOSERS) == 0]
    starts = np.union1d(begin, more)
    end = np.minimum(end[np.searchsorted(begin, starts, side="right") - 1], np.append(starts[1:], len(text)))
    return starts, end, np.searchsorted(starts, offsets)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts: hash and first byte of each word, the words where sentences begin and end, each text's range of
    sentences, each text's range of words. A sentence ends with a word that ends in one of _ENDS, closing marks aside,
    at a line feed, or with its text."""
    text = LOWER[data]
    begin, end, bounds = _words(text, offsets)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    closes = np.ones(len(begin), dtype=bool)
    if len(begin):
        bare, left = end.copy(), np.arange(len(end))
        while left.size:
            size = _at(text, bare[left], begin[left], _CLOSERS)
            left, size = left[size > 0], size[size > 0]
            bare[left] -= size
        closes[:-1] = (_at(text, bare, begin, _ENDS) > 0)[:-1] | (feeds[begin[1:]] > feeds[end[:-1]])
        closes[bounds[1:][np.diff(bounds) > 0] - 1] = True
    last = np.flatnonzero(closes) + 1
    first = np.concatenate([[0], last[:-1]]) if len(last) else last
    return hash_words(text, begin, end), begin, first, last, np.searchsorted(first, bounds), bounds


def cuts_of(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words of over-long sentences whose hash is smallest in a window of CUT_WORDS, ties included: they hang on no
    word farther off, and lie at most CUT_WORDS apart."""
    n = last - first
    at = np.flatnonzero(np.repeat(n > MIN_WORDS, n))
    if not len(at):
        return at
    h, sentence = mix(words[at]), np.repeat(np.arange(len(n)), n)[at]
    windows = len(at) - CUT_WORDS + 1
    least = h[:windows].copy()
    for j in range(1, CUT_WORDS):
        np.minimum(least, h[j : j + windows], out=least)
    whole = sentence[:windows] == sentence[CUT_WORDS - 1 :]
    chosen = np.zeros(len(at), dtype=bool)
    for j in range(CUT_WORDS):
        chosen[j : j + windows] |= whole & (h[j : j + windows] == least)
    return at[chosen]


def runs_of(words: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each run's text, first word within it, number of words and two hashes; runs stay within a text."""
    a = np.union1d(first, cuts_of(words, first, last)).astype(np.int64)
    row = np.searchsorted(bounds, a, side="right") - 1
    fits = a + MIN_WORDS <= bounds[row + 1]
    a, row = a[fits], row[fits]
    over = np.searchsorted(last, a + MIN_WORDS)
    b = last[over]
    far = b > a + FAR_WORDS
    closed = ~far | (b - first[over] <= MIN_WORDS)
    a, b, row = np.concatenate([a[closed], a[far]]), np.concatenate([b[closed], a[far] + MIN_WORDS]), np.concatenate([row[closed], row[far]])
    hashes = []
    for k, factor in enumerate(_FACTORS):
        power = np.cumprod(np.concatenate([[U64(1)], np.full(len(words), U64(factor))]))
        back = np.cumprod(np.concatenate([[U64(1)], np.full(len(words), U64(pow(factor, -1, 1 << 64)))]))
        sums = np.concatenate([[U64(0)], np.cumsum((mix(words + U64(k)) * power[:-1]))])
        hashes.append(mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64))
    return row, a - bounds[row], b - a, *hashes


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrow_bytes(batch.column("text"))
        for a, b in slices(offsets, SLICE_BYTES):
            words, _, first, last, _, bounds = sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row, start, n, h1, h2 = runs_of(words, first, last, bounds)
            order = np.lexsort((start, h2, h1, row))
            again = np.zeros(len(row), dtype=bool)
            same = [x[order][1:] == x[order][:-1] for x in (row, h1, h2)]
            again[order[1:]] = same[0] & same[1] & same[2]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1),
                    pa.array(h2),
                    batch.column("id").slice(a, b - a).take(pa.array(row)),
                    batch.column("version").slice(a, b - a).take(pa.array(row)),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(again),
                ],
                names=["h1", "h2", "id", "version", "start", "n", "again"],
            )


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrow_bytes(batch.column("text"))
        repeats = batch.column("repeats").to_pylist()
        for a, b in slices(offsets, SLICE_BYTES):
            own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, begin, first, last, rows, bounds = sentences(own, off)
            texts, dropped = [], []
            for k in range(b - a):
                whole, lost = own[off[k] : off[k + 1]], 0
                if repeats[a + k]:
                    n, at = bounds[k + 1] - bounds[k], bounds[k]
                    head, tail = first[rows[k] : rows[k + 1]] - at, last[rows[k] : rows[k + 1]] - at
                    change = np.zeros(n + 1, np.int64)
                    for start, length in ((r["start"], r["n"]) for r in repeats[a + k]):
                        change[start] += 1
                        change[start + length] -= 1
                    gone = np.cumsum(change)[:n] > 0
                    some = np.add.reduceat(gone, head, dtype=np.int64)
                    some[(some < tail - head) & (tail - head <= MIN_WORDS)] = 0
                    gone &= np.repeat(some > 0, tail - head)
                    edges = np.concatenate([begin[at : bounds[k + 1]] - off[k], [len(whole)]])
                    stays = np.concatenate([np.ones(edges[0], dtype=bool), np.repeat(~gone, np.diff(edges))])
                    whole, lost = whole[stays], int((some > 0).sum())
                texts.append(whole.tobytes().decode())
                dropped.append(lost)
            null = batch.column("text").slice(a, b - a).is_null().to_pylist()
            texts = [None if x else t for x, t in zip(null, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(rows)), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "text"],
            )


def drop_repeated_spans(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_sentences, n_removed, text (what stays).

    Words are what stands between ASCII white space, A-Z lower-cased, and single characters of scripts without spaces.
    From each sentence on, and from each cut of a sentence of over twenty words, the words up to the next end of a
    sentence, at least twenty, are hashed to 128 bits; where that end is more than thirty words off, the first twenty
    words also are, or instead if it is an over-long sentence's. Runs are joined globally. Words go that lie in a run
    which another document with a smaller doc_id has, or an earlier place of the same text; a sentence of up to twenty
    words goes as a whole or not at all. n_removed counts the sentences that lost words. What stays keeps its bytes.

    Whether words start a run hangs on near words only, so any fifty words that two documents share hold a common run.
    At the edges of a shared passage, words may stay: those of a short sentence that is shared in part, and those
    outside the first and last common run.

    Runs are counted with a combine before the shuffle, and come back by a join that skew handling may split. Texts of
    fewer words have no run. Rows that share a doc_id are one document: a run that comes first in it stays in
    each of its rows. A null doc_id is a document before all others; a null text stays null. Extra columns are ignored;
    an empty table gives an empty result.
    """
    docs = small_batches(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64("text").alias("version"),
    )
    schema = "h1 long, h2 long, id long, version long, start int, n int, again boolean"
    rows = docs.select("id", "version", "text").mapInArrow(_emit, schema)
    known = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max("again").alias("within"))
    known = cut(known.where("first < last or within").select("h1", "h2", "first"), "repeated-runs")
    later = rows.join(known, ["h1", "h2"]).where("id > first or again")
    later = later.groupBy("id", "version").agg(F.collect_set(F.struct("start", "n")).alias("repeats"))
    out = docs.join(later, ["id", "version"], "left").select("doc_id", "text", "repeats")
    return out.mapInArrow(_rebuild, "doc_id long, n_sentences long, n_removed long, text string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """drop_repeated_spans over the whole documents table."""
    return drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
