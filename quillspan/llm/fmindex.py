"""Benchmark decontamination with an FM-index of each training shard."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, remove, small_batches
from .textkernel import ALNUM, LOWER, U64, arrow_bytes, hash_words, slices, split_words

#: Words of a window; text bytes of an index; every so many text positions a suffix position is kept; benchmark
#: bytes that are searched in one pass over the documents.
WINDOW, SHARD_BYTES, SAMPLE, BENCHMARK_BYTES = 10, 2 << 20, 8, 32 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Wavelet:
    """Wavelet matrix over symbols below 2**levels: rank of many (symbol, position) pairs at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        for level in reversed(range(levels)):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.rows.append((words, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, row: tuple, at: np.ndarray) -> np.ndarray:
        words, ones, _ = row
        block = at >> 6
        return ones[block] + np.bitwise_count(words[block] & ((U64(1) << (at & 63).astype(np.uint64)) - U64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        low, high = np.zeros_like(at), at
        for k, row in enumerate(self.rows):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(row, low), self._ones(row, high)
            low, high = np.where(one, row[2] + a, low - a), np.where(one, row[2] + b, high - b)
        return high - low


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. ``rank`` orders the symbols; its last one is unique, and so is one at
    the end of every document, so no comparison runs on. Suffixes that are settled are not sorted again."""
    n, done = len(rank), 1
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    slots = np.arange(n)
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        slots = slots[~alone]
        if not slots.size:
            return order
        at = order[slots]
        key = rank[at] * n + rank[at + done]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        order[slots] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        done *= 2


class FMIndex:
    """FM-index over a shard's word numbers. Symbol 0 ends every document, so no match runs across two; in suffix order
    these ends differ, the first document's first, so order is total and walks back are exact."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        docs = len(bounds) - 1
        self.starts = bounds + np.arange(docs + 1)  # of documents, among words and ends
        symbols = np.zeros(len(words) + docs, np.int64)
        symbols[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(bounds))] = numbers + 1
        ends = symbols + docs - 1
        ends[self.starts[1:] - 1] = np.arange(docs)
        order = suffix_order(ends)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1))])
        self.last = symbols[order - 1]
        self.wavelet = Wavelet(self.last, max(1, int(len(self.vocabulary)).bit_length()))
        sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each pattern (rows of word hashes, right-aligned), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.last), np.int64)
        if not len(self.vocabulary):
            return low, low
        for k in range(patterns.shape[1]):
            todo = np.flatnonzero((lengths > k) & (low < high))
            if not todo.size:
                break
            word = patterns[todo, patterns.shape[1] - 1 - k]
            at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            symbol = at + 1
            a = self.before[symbol] + self.wavelet.rank(symbol, low[todo])
            b = self.before[symbol] + self.wavelet.rank(symbol, high[todo])
            known = self.vocabulary[at] == word
            low[todo], high[todo] = np.where(known, a, 0), np.where(known, b, 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back until a sampled one."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while todo.size:
            at = rows[todo]
            there = self.sampled[at + 1] > self.sampled[at]
            out[todo[there]] = self.positions[self.sampled[at[there]]] + steps
            todo, at = todo[~there], at[~there]
            symbol = self.last[at]
            rows[todo] = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


def _words(col: pa.Array, a: int, b: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text, own = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
    begin, end, bounds = split_words(text, own, ALNUM)
    return hash_words(text, begin, end), bounds


def windows_of(items: list[tuple[object, str | None]]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Distinct windows of all items as right-aligned word hashes, their lengths, and the item ids each belongs to."""
    col = pa.array([t for _, t in items], pa.string())
    data, offsets = arrow_bytes(col)
    words, bounds = _words(col, 0, len(items), data, offsets)
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
    owner, length = np.repeat(np.arange(len(n)), count), np.repeat(np.minimum(n, WINDOW), count)
    past = np.repeat(bounds[:-1] - np.cumsum(count) + count, count) + np.arange(len(owner)) + length
    rows = np.zeros((len(owner), WINDOW + 1), np.uint64)
    rows[:, WINDOW] = length
    for back in range(1, WINDOW + 1):
        some = np.flatnonzero(length >= back)
        rows[some, WINDOW - back] = words[past[some] - back]
    order = np.lexsort(rows.T)
    rows, owner = rows[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[: len(rows)])
    names = [None if item is None else str(item) for item, _ in items]
    owners = [sorted({names[k] for k in owner[x:y].tolist()} - {None}) for x, y in zip(head, np.append(head[1:], len(rows))[: len(head)], strict=True)]
    return rows[head, :WINDOW], rows[head, WINDOW].astype(np.int64), owners


def _pieces(text: str) -> Iterator[str]:
    """An item of over BENCHMARK_BYTES in pieces of about as much, which share WINDOW - 1 words with the next: every
    window of the item is one of a piece, and the other way round."""
    start, seen, recent = 0, 0, deque(maxlen=WINDOW - 1)
    for word in _WORD.finditer(text):
        if seen >= WINDOW and (word.end() - start) * 4 > BENCHMARK_BYTES:
            yield text[start : recent[-1][1]]
            start, seen = recent[0][0], len(recent)
        recent.append(word.span())
        seen += 1
    yield text[start:]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about BENCHMARK_BYTES of text at most, which come to the driver one after the other."""
    rows = benchmark.select("item_id", "text")
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BENCHMARK_BYTES:
        yield [(r.item_id, r.text) for r in rows.collect()]
        return
    block, size = [], 0
    for r in rows.where("text is not null").toLocalIterator():
        for text in _pieces(r.text) if len(r.text.encode()) > BENCHMARK_BYTES else [r.text]:
            own = len(text.encode())
            if block and size + own > BENCHMARK_BYTES:
                yield block
                block, size = [], 0
            block.append((r.item_id, text))
            size += own
    yield block


def _searcher(patterns: np.ndarray, lengths: np.ndarray, owners: list[list[str]], clean_rows: bool = False, more: bool = False):
    """Describes each text, and keeps it for one more pass, or passes the rows without an occurrence on as they are."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            for a, b in slices(offsets, SHARD_BYTES):
                words, bounds = _words(batch.column("text"), a, b, data, offsets)
                index = FMIndex(words, bounds)
                low, high = index.search(patterns, lengths)
                times = np.maximum(high - low, 0)
                which = np.repeat(np.arange(len(times)), times)
                rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
                at = index.locate(rows)
                doc = np.searchsorted(index.starts, at, side="right") - 1
                if clean_rows:
                    yield batch.slice(a, b - a).filter(pa.array(np.bincount(doc, minlength=b - a) == 0))
                    continue
                spans, items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
                for d, w in zip(doc.tolist(), which.tolist(), strict=True):
                    items[d].update(owners[w])
                end = at + lengths[which]
                if "spans" in batch.schema.names:  # what the passes before have found
                    before = batch.column("spans").slice(a, b - a).to_pylist()
                    for d, ids in enumerate(batch.column("items").slice(a, b - a).to_pylist()):
                        items[d].update(ids)
                    row = np.repeat(np.arange(b - a), [len(x) // 2 for x in before])
                    known = np.array([x for own in before for x in own], np.int64).reshape(-1, 2) + index.starts[row][:, None]
                    doc, at, end = np.concatenate([doc, row]), np.concatenate([at, known[:, 0]]), np.concatenate([end, known[:, 1]])
                change = np.zeros(len(index.last) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, end, -1)
                hit = np.cumsum(change) > 0
                turn = np.lexsort((at, doc))
                for d, start, past in zip(doc[turn].tolist(), at[turn].tolist(), end[turn].tolist(), strict=True):
                    start, past = start - int(index.starts[d]), past - int(index.starts[d])
                    if spans[d] and start <= spans[d][-1][1]:
                        spans[d][-1][1] = max(past, spans[d][-1][1])
                    else:
                        spans[d].append([start, past])
                counted = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(bounds)),
                        pa.array(counted[index.starts[1:]] - counted[index.starts[:-1]]),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([[x for span in s for x in span] for s in spans], pa.list_(pa.int64())),
                        *([batch.column("text").slice(a, b - a)] if more else []),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans", *(["text"] if more else [])],
                )

    return search


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, items, spans.

    Words are runs of letters and digits (every code point above ASCII is one), A-Z lower-cased. A window is ten
    consecutive words of an item of ``benchmark`` (item_id, text), or a shorter item's all. Each shard of documents
    gets an FM-index over its words: suffixes in order, their preceding words in a wavelet matrix.
    All windows are searched backward through its ranks, occurrences located by sampled suffix positions, and merged
    to removal spans: spans lists begin and end of each in turn, in words; n_hit counts the words inside; items holds
    the ids (as strings, sorted) of items with a window that occurs.

    Documents are not shuffled, and an index lives only while its shard is searched. Each task gets the windows of at
    most BENCHMARK_BYTES of text; a larger benchmark (it is measured) takes several passes over the documents, which are
    written between them with what was found. Null and empty texts have no words; items without words have no windows;
    repeated rows are treated alike, and so are null doc_ids. The windows of an item without id hit words like any other,
    but there is no id to list. Extra columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>"
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _in_passes(docs, benchmark, schema, f"{schema}, text string", False)


def _in_passes(rows: DataFrame, benchmark: DataFrame, schema, between, clean_rows: bool) -> DataFrame:
    """``rows`` searched for one block of the benchmark after the other; only the last pass is lazy."""
    spark, blocks, old = rows.sparkSession, _blocks(benchmark), None
    block = next(blocks)
    for following in blocks:
        path = new_path(spark, "decontamination")
        rows.mapInArrow(_searcher(*windows_of(block), clean_rows, True), between).write.parquet(path)
        if old:
            remove(spark, old)
        rows, old, block = spark.read.schema(between).parquet(path), path, following
    return rows.mapInArrow(_searcher(*windows_of(block), clean_rows), schema)


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` (text, ...) in whose text no window occurs, with all their columns, unshuffled."""
    return _in_passes(small_batches(documents), benchmark, documents.schema, documents.schema, True)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """contamination of the whole documents table by the whole benchmark."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contamination(read("documents"), read("benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
hits AS (SELECT doc_id, i, di.n AS n, item_id FROM di JOIN win ON di.n = win.n AND array_to_string(w[i:i + di.n - 1], ' ') = k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
