"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut, small_batches
from .textkernel import (
    LOWER,
    NOT_SPACE,
    U64,
    arrow_bytes,
    distinct_sorted,
    hash_words,
    mix,
    shingles,
    slices,
    split_words,
)

#: Shingle width in words, and the Jaccard similarity in hundredths from which documents are linked.
WIDTH, PERCENT = 5, 75
#: Bands and values a band. A pair at similarity s meets in one of them with 1 - (1 - s**ROWS)**BANDS: 0.9992 at 0.75.
BANDS, ROWS = 50, 7
#: Equal bytes of two signatures from which a pair is worth confirming: 3.1 standard deviations below the mean at 0.75.
_P = PERCENT / 100 + (1 - PERCENT / 100) / 256
ENOUGH = int(BANDS * ROWS * _P - 3.1 * (BANDS * ROWS * _P * (1 - _P)) ** 0.5)
#: Members of a bucket that one task compares with one another; larger buckets are compared in blocks.
BLOCK = 1024
#: Text bytes that a worker holds in numpy at once; candidate ids up to which a semi-join is broadcast (8 bytes each).
SLICE_BYTES, BROADCAST_IDS = 1 << 20, 1_000_000


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with the distinct shingle hashes of each row, sorted, and their bounds."""
    data, offsets = arrow_bytes(col)
    for a, b in slices(offsets, SLICE_BYTES):
        text, own = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        begin, end, bounds = split_words(text, own, NOT_SPACE)
        yield a, b, *distinct_sorted(*shingles(hash_words(text, begin, end), bounds, WIDTH))


def signatures(sets: np.ndarray, bounds: np.ndarray, values: int) -> np.ndarray:
    """Min-max signatures: each permutation (an odd multiplier on 64 bits) is evaluated once and gives two values, the
    least and the greatest. Rows without shingles get zeros."""
    full = np.flatnonzero(np.diff(bounds))
    starts, out = bounds[:-1][full], np.zeros((values, len(bounds) - 1), np.uint64)
    if full.size:
        factors = mix(np.arange(1, values // 2 + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)) | U64(1)
        for k, factor in enumerate(factors):
            image = sets * factor
            out[2 * k, full] = np.minimum.reduceat(image, starts)
            out[2 * k + 1, full] = np.maximum.reduceat(image, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Rows x BANDS keys. A band takes every BANDS-th value, so one permutation's two values go to different bands."""
    keys = []
    for band in range(BANDS):
        acc = np.full(signature.shape[1], band + 1, np.uint64)
        for value in signature[band::BANDS]:
            acc = mix(acc ^ value) + U64(band)
        keys.append(acc)
    return np.stack(keys, axis=1).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets, bounds in shingle_sets(batch.column("text")):
            sizes = np.diff(bounds)
            digests = [hashlib.blake2b(sets[x:y], digest_size=16).digest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            signature = signatures(sets, bounds, BANDS * ROWS)
            keys = band_keys(signature)
            short = pa.array([x.tobytes() for x in np.ascontiguousarray(mix(signature).astype(np.uint8).T)], pa.binary())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(digests, pa.binary()), bands, short],
                names=["doc_id", "n_shingles", "digest", "bands", "signature"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            left = [s[x:y] for _, _, s, o in shingle_sets(part.column("text_x")) for x, y in zip(o[:-1], o[1:], strict=True)]
            right = [s[x:y] for _, _, s, o in shingle_sets(part.column("text_y")) for x, y in zip(o[:-1], o[1:], strict=True)]
            for i, (p, q) in enumerate(zip(left, right, strict=True)):
                if 100 * min(len(p), len(q)) >= PERCENT * max(len(p), len(q), 1):
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    if both and 100 * both >= PERCENT * (len(p) + len(q) - both):
                        chosen.append(at + i)
        yield batch.select(["x", "y"]).take(pa.array(chosen, pa.int64()))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in columns)
        new[0] = last is not None and head != last
        edges = np.flatnonzero(new).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if held and new[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block pair with different labels whose signatures agree often enough, in the first band they share."""
    for run in runs(batches, ["band", "i", "j"]):
        x, label, n, block = (run.column(c).to_numpy() for c in ("x", "label", "n_shingles", "block"))
        bands = run.column("bands").combine_chunks().flatten().to_numpy().reshape(len(x), BANDS)
        bands = bands[:, : int(np.flatnonzero(bands[0] == run.column("band")[0].as_py())[0])]
        whole = run.column("i")[0] == run.column("j")[0]
        signature = np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint8).reshape(len(x), -1)
        left, right = [], []
        for k in range(len(x) - 1):
            rest = np.arange(k + 1, len(x))
            fit = label[rest] != label[k]
            if not whole:
                fit &= block[rest] != block[k]
            fit &= 100 * np.minimum(n[rest], n[k]) >= PERCENT * np.maximum(n[rest], n[k])
            rest = rest[fit]
            rest = rest[(signature[rest] == signature[k]).sum(axis=1) >= ENOUGH]
            rest = rest[~(bands[rest] == bands[k]).any(axis=1)]
            left.append(x[rest])
            right.append(np.full(len(rest), x[k]))
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["x", "y"])


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough. Only the texts of candidates are shuffled: where
    their ids are few, counted first, the filter is broadcast; else it is a shuffled semi-join."""
    ids = cut(pairs.select("x").union(pairs.select("y")).distinct().toDF("doc_id"), "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    both = pairs.join(texts.toDF("x", "text_x"), "x").join(texts.toDF("y", "text_y"), "y")
    return both.select("x", "y", "text_x", "text_y").mapInArrow(_confirm, pairs.select("x", "y").schema)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of
    five words, or all its words as one where they are fewer. Sets with Jaccard similarity >= 0.75 are linked.

    1. One pass over the texts gives a 128-bit digest of each set and the band keys of its min-max signature.
    2. Documents of equal digests form a class, led by its smallest doc_id; only leaders go on.
    3. In each band bucket all members are paired with the smallest: a row a member, however large the bucket.
       Pairs are confirmed on full sets and joined to components.
    4. Buckets whose members still lie in several components are compared across these, in blocks, by one byte of each
       signature value; only pairs that reach the count which three standard deviations below 0.75 calibrate become
       rows and are confirmed. Pairs within a component need no test any more.
    So no bucket is capped, and no group of copies is expanded into all its pairs.

    Null, empty or blank texts have an empty set and are linked with nothing. Rows that share a doc_id are one
    document and share its component. A null doc_id takes no part: component_id is null, kept is true. Extra columns
    are ignored; an empty table gives an empty result.
    """
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(docs.mapInArrow(_describe, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"), "minmax")
    full = described.where("n_shingles > 0 and doc_id is not null")
    once = (F.first(c).alias(c) for c in ("bands", "signature", "n_shingles"))
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("x"), *once)
    classes = cut(classes, "classes")
    rows = classes.select("x", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("x").alias("y"), F.max("x").alias("last")).where("y < last").select("band", "y")
    members = cut(rows.join(shared, "band"), "buckets")
    stars = cut(members.where("x != y").select("x", "y").distinct(), "stars")
    links = cut(confirmed(docs, stars), "links")
    label = components(links, "x", "y")

    named = members.select("band", "x").join(label.toDF("x", "label"), "x", "left")
    named = named.select("band", "x", F.coalesce("label", "x").alias("label"))
    mixed = named.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    mixed = cut(mixed.where("a < b").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    named = named.join(mixed, "band").join(classes.select("x", "signature", "bands", "n_shingles"), "x")
    named = named.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    named = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = named.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    named = named.select("band", "i", "j", "block", "x", "label", "n_shingles", "signature", "bands")
    named = named.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "x")
    across = named.mapInArrow(_compare, "x long, y long")
    across = cut(across.join(stars, ["x", "y"], "left_anti"), "across")
    if not across.isEmpty():
        links = links.unionByName(confirmed(docs, across))
        label = components(links, "x", "y")

    final = classes.select("digest", "x").join(label.toDF("x", "label"), "x", "left")
    final = final.select("digest", F.coalesce("label", "x").alias("label"))
    out = described.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over the whole documents table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * met >= 75 * (na.n + nb.n - met)),
reach AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
