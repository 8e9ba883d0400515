"""Vectorised text primitives over Arrow string buffers: words, 64-bit word hashes, shingles.

All functions work on bytes of UTF-8. Separators are ASCII, so byte classes and code-point classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits; every byte above ASCII counts as a letter.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, a bijection on 64 bits."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n, wide = len(col), pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (a longest run of kept bytes within one row), and each row's range of words."""
    inside = keep[data]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[heads] = False
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded.data, strides=(1,))
    length = end - begin
    h = mix(length.astype(np.uint64) * _M3 + U64(seed))
    h = mix(h ^ (eight[begin] & _MASKS[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    done = 8
    while at.size:
        left = length[at] - done
        h[at] = mix(h[at] * _M3 ^ (eight[begin[at] + done] & _MASKS[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    return h


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long columns of hashes; their order counts."""
    acc = hashes[0]
    for h in hashes[1:]:
        acc = (acc ^ (acc >> U64(29))) * _M3 + h
    return mix(acc)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, repeats included, and each row's range of them. A row of fewer
    words has one, of all its words; a row of none has none."""
    n = np.diff(bounds)
    at = np.arange(len(h))
    room = np.repeat(bounds[1:], n) - at
    first = np.repeat(n < width, n) & (at == np.repeat(bounds[:-1], n))
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    out = fold([padded[j : j + len(h)] for j in range(width)]) if len(h) else h
    short = np.flatnonzero(first)
    if short.size:
        out[short] = fold([np.where(room[short] > j, padded[short + j], U64(j + 1)) for j in range(width)])
    chosen = first | (room >= width)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    return out[chosen], np.concatenate([[0], np.cumsum(count)])


def distinct_sorted(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, and each row's range of them."""
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])
