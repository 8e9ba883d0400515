"""A persisted inverted index of character trigrams (K-09, J-07): phrases by positions, short terms by prefixes.

On disk, below one folder: ``docs`` (a row a unit: number, place, text, size), ``postings`` (a row a trigram and block of
units) and ``segments`` (a row a segment, written last: what has none isn't read). All are partitioned by segment, so units
are added by writing one more segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import cut, new_path, small_batches

#: Units of a block at most, and characters of units that a task turns into postings at once.
BLOCK_UNITS, PIECE_CHARS = 2048, 1 << 21
#: Characters a bucket, and bounds of the number of buckets. All trigrams with the same first two characters share one.
BUCKET_CHARS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 25, 8, 4096
#: Tasks that write one bucket at most.
SPLITS = 4
#: Trigrams of terms up to which these are filters of the scan; more are joined.
FEW_TERMS = 1000
#: Trigrams of a term whose payloads are read; what has more is held against the text where these have met.
RAREST = 3
#: BM25.
K1, B = 1.2, 0.75

DOCS = "unit_no long, source_id string, unit_id string, start_char long, n_chars long, unit_text string"
POSTINGS = "bucket int, gram long, block long, n int, payload binary"


def folding() -> tuple[np.ndarray, np.ndarray]:
    """Characters whose simple case folding is another one, and that one."""
    pairs = []
    for point in range(0x41, 0x1E944):
        one = chr(point)
        new = one.casefold() if len(one.casefold()) == 1 else one.lower()
        if len(new) == 1 and new != one:
            pairs.append((point, ord(new)))
    return tuple(np.array(side, np.int64) for side in zip(*pairs, strict=True))


def _folder() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.int64)
    old, new = folding()
    table[old] = new
    return table


def grams_of(term: str, fold: np.ndarray) -> list[tuple[int, int, int]]:
    """Trigrams that cover a folded term: offset, least and greatest key. Every third one and the last cover it whole; of
    two characters, it is all trigrams that begin with them."""
    p = fold[np.frombuffer(term.encode("utf-32-le"), np.uint32)].tolist()
    if len(p) < 2:
        return []
    if len(p) == 2:
        low = (p[0] << 42) | (p[1] << 21)
        return [(0, low, low + (1 << 21) - 1)]
    out = []
    for at in sorted({*range(0, len(p) - 2, 3), len(p) - 3}):
        key = (p[at] << 42) | (p[at + 1] << 21) | p[at + 2]
        out.append((at, key, key))
    return out


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, low ones first, and the bytes that each takes."""
    x = x.astype(np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 9):
        size += x >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, np.uint8)
    some, rest, at = np.arange(len(x)), x, ends - size
    while len(some):
        more = rest >= 128
        out[at] = (rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        some, rest, at = some[more], rest[more] >> np.uint64(7), at[more] + 1
    return out, size


def numbers(raw: np.ndarray) -> np.ndarray:
    """What ``varints`` has written."""
    if not len(raw):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def postings_of(unit: np.ndarray, place: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Trigrams, positions of each, and payloads: of each position, in order, the step to its unit and, from the start
    of the unit or from the position before, to its place."""
    order = np.lexsort((place, unit, gram))
    unit, place, gram = unit[order], place[order], gram[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    step = np.diff(unit, prepend=0)
    step[new] = unit[new]
    move = np.diff(place, prepend=0)
    fresh = new | (step > 0)
    move[fresh] = place[fresh]
    raw, size = varints(np.stack([step, move], axis=1).ravel())
    first = np.flatnonzero(new)
    byte = np.concatenate([[0], np.cumsum(size)])[np.concatenate([2 * first, [2 * len(gram)]])]
    data = raw.tobytes()
    return gram[first], np.diff(np.concatenate([first, [len(gram)]])), [data[a:b] for a, b in zip(byte[:-1], byte[1:], strict=True)]


def positions_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Units and places that a payload tells."""
    both = numbers(np.frombuffer(payload, np.uint8))
    step, move = both[::2], both[1::2]
    fresh = step > 0
    fresh[:1] = True
    first = np.flatnonzero(fresh)
    total = np.cumsum(move)
    before = (total - move)[first]
    return np.cumsum(step), total - np.repeat(before, np.diff(np.concatenate([first, [len(step)]])))


def _poster(buckets: int):
    """Postings of the units of a task, block by block of consecutive numbers. Behind every unit stand two empty
    characters, so that its last two begin trigrams too."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _folder()
        for batch in batches:
            numbers_, texts = batch.column("unit_no").to_numpy(), batch.column("unit_text").to_pylist()
            at = 0
            while at < len(texts):
                to = at + 1
                while to < min(len(texts), at + BLOCK_UNITS) and numbers_[to] == numbers_[to - 1] + 1:
                    to += 1
                points = [np.frombuffer((t + "\0\0").encode("utf-32-le"), np.uint32) for t in texts[at:to]]
                ends = np.cumsum([len(p) for p in points])
                whole = fold[np.concatenate(points)]
                keys = (whole[:-2] << 42) | (whole[1:-1] << 21) | whole[2:]
                for low in range(0, len(keys), PIECE_CHARS):
                    own = np.arange(low, min(len(keys), low + PIECE_CHARS))
                    unit = np.searchsorted(ends, own, side="right")
                    place = own - (ends[unit] - np.array([len(p) for p in points])[unit])
                    inside = own < ends[unit] - 2
                    if inside.any():
                        gram, n, payload = postings_of(unit[inside], place[inside], keys[own[inside]])
                        bucket = bucket_of(gram, buckets)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket.astype(np.int32)), pa.array(gram), pa.array(np.full(len(gram), numbers_[at])), pa.array(n.astype(np.int32)), pa.array(payload, pa.binary())],
                            names=["bucket", "gram", "block", "n", "payload"],
                        )
                at = to

    return post


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Of the first two characters, so that a prefix lies in one bucket."""
    return ((gram >> 21) * 0x9E3779B1 & 0xFFFFFFFF) * buckets >> 32


def add_units(units: DataFrame, path: str, segment: str | None = None) -> None:
    """Writes ``units`` (source_id, unit_id, start_char, unit_text) as one more segment of the index at ``path``.

    Units are sorted by place and numbered in that order. A task makes the postings of its units block by block, so what
    is shuffled is a payload a trigram and block, about three bytes a character, and no trigram has a group that grows with
    the corpus. Postings are sorted by bucket, trigram and block, so a scan for a trigram reads one bucket, and of it the
    row groups whose range holds it. Two writers at a time take segments of their own. A null text counts as empty.
    Repeated units are units of their own; extra columns are ignored; without units the segment is empty.
    """
    spark, segment = units.sparkSession, segment or uuid.uuid4().hex
    rows = units.select("source_id", "unit_id", F.col("start_char").cast("long").alias("start_char"), F.coalesce("unit_text", F.lit("")).alias("unit_text"))
    rows = rows.orderBy("source_id", "start_char", F.length("unit_text"), "unit_id").withColumn("n_chars", F.length("unit_text").cast("long"))
    docs = f"{path}/docs/segment={segment}"
    rows.withColumn("unit_no", F.monotonically_increasing_id()).select("unit_no", "source_id", "unit_id", "start_char", "n_chars", "unit_text").write.parquet(docs)
    docs = spark.read.schema(DOCS).parquet(docs)
    size = F.sum(F.greatest(F.col("n_chars") - 2, F.lit(0)))
    n, tokens, chars = docs.agg(F.count("*"), F.coalesce(size, F.lit(0)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-chars // BUCKET_CHARS)))
    found = small_batches(docs).select("unit_no", "unit_text").mapInArrow(_poster(buckets), POSTINGS)
    # by hash, as ranges would have to be sampled, which makes the postings twice
    found = found.repartition("bucket", F.pmod(F.xxhash64("gram"), F.lit(SPLITS))).sortWithinPartitions("bucket", "gram", "block")
    found.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    one = spark.createDataFrame([(n, tokens, buckets)], "n_units long, n_tokens long, buckets int").coalesce(1)
    one.write.parquet(f"{path}/segments/segment={segment}")


def segments_of(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """Complete segments: name, units, tokens, buckets. One row each."""
    rows = spark.read.schema("n_units long, n_tokens long, buckets int, segment string").parquet(f"{path}/segments").collect()
    return sorted((r.segment, r.n_units, r.n_tokens, r.buckets) for r in rows)


def docs_of(spark: SparkSession, path: str, segments: list | None = None) -> DataFrame:
    """The units of all complete segments."""
    segments = segments_of(spark, path) if segments is None else segments
    return spark.read.schema(f"{DOCS}, segment string").parquet(f"{path}/docs").where(F.col("segment").isin([s[0] for s in segments]))


def _keyed(terms: DataFrame, segments: list) -> DataFrame:
    """Trigrams of each term (term_id, term) in each segment: n_grams, offset, bucket, low, high."""
    names, buckets = [s[0] for s in segments], np.array([s[3] for s in segments])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _folder()
        for batch in batches:
            found = []
            for term_id, term in zip(batch.column("term_id").to_pylist(), batch.column("term").to_pylist(), strict=True):
                grams = grams_of(term or "", fold)
                for at, low, high in grams:
                    found += [(term_id, len(grams), at, s, int(bucket_of(np.int64(low), b)), low >> 21, low, high) for s, b in zip(names, buckets.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["term_id", "n_grams", "offset", "segment", "bucket", "prefix", "low", "high"])

    schema = "term_id string, n_grams long, offset long, segment string, bucket long, prefix long, low long, high long"
    return terms.select(F.col("term_id").cast("string").alias("term_id"), "term").mapInArrow(split, schema)


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units in which a term's trigrams meet, with the number of times and the first place, of one term, segment and block after
    the other; with all places where the term has more trigrams than these."""
    key, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        places: dict[int, list[np.ndarray]] = {}
        for r in held:
            unit, place = positions_of(r["payload"])
            inside = place >= r["offset"]  # else the term would begin before the unit
            places.setdefault(r["offset"], []).append((unit[inside] << 40) + place[inside] - r["offset"])
        kept = None
        for some in sorted((np.concatenate(p) for p in places.values()), key=len):
            kept = np.unique(some) if kept is None else kept[np.isin(kept, some)]
            if not len(kept):
                return
        unit, first, n = np.unique(kept >> 40, return_index=True, return_counts=True)
        term, segment, block = key
        at = kept & ((1 << 40) - 1)
        if held[0]["more"]:
            every = pa.array(np.split(at, first[1:]), pa.list_(pa.int64()))
        else:
            every = pa.nulls(len(unit), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([term] * len(unit)), pa.array([segment] * len(unit)), pa.array(unit + block), pa.array(n.astype(np.int64)), pa.array(at[first]), every],
            names=["term_id", "segment", "unit_no", "tf", "at", "places"],
        )

    for batch in batches:
        for r in batch.to_pylist():
            if (r["term_id"], r["segment"], r["block"]) != key:
                yield from done()
                key, held = (r["term_id"], r["segment"], r["block"]), []
            held.append(r)
    yield from done()


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose part of the text is the term, case folded."""
    fold = _folder()
    for batch in batches:
        part, term = (["" if x is None else x for x in batch.column(c).to_pylist()] for c in ("part", "term"))
        points = lambda x: fold[np.frombuffer(x.encode("utf-32-le"), np.uint32)]
        good = [len(x) == len(y) and (x == y or bool((points(x) == points(y)).all())) for x, y in zip(part, term, strict=True)]
        yield batch.select(["term_id", "segment", "unit_no", "at"]).filter(pa.array(good, pa.bool_()))


def find(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """J-07: term_id, segment, unit_no, tf, at: the units in which a term (term_id, term) of two characters at least stands,
    case folded, its overlapping occurrences and its first place. Terms are distinct in term_id.

    First only trigrams and blocks are read: a block counts for a term if it has all trigrams that cover it. Only the payloads
    of the RAREST ones are then read and intersected, the shortest first, as a common trigram's payload would be sent once for each
    term that has it. Where a term has more, its places are held against the text. Up to FEW_TERMS trigrams, these and their
    buckets are filters of all scans (partitions and row groups); more are joined on segment, bucket and first two characters.
    Work is dealt by term and block, so a term that stands everywhere is many small groups.
    """
    segments = segments_of(spark, path)
    keyed = _keyed(terms, segments)
    postings = spark.read.schema("gram long, block long, n int, payload binary, segment string, bucket int").parquet(f"{path}/postings")
    rows = keyed.limit(FEW_TERMS + 1).collect()
    if len(rows) <= FEW_TERMS:
        chosen = F.lit(False)
        for name in sorted({r.segment for r in rows}):
            own = [r for r in rows if r.segment == name]
            grams = F.col("gram").isin(sorted({r.low for r in own if r.low == r.high})) if any(r.low == r.high for r in own) else F.lit(False)
            for low, high in sorted({(r.low, r.high) for r in own if r.low < r.high}):
                grams |= F.col("gram").between(low, high)
            chosen |= (F.col("segment") == name) & F.col("bucket").isin(sorted({r.bucket for r in own})) & grams
        postings = postings.where(chosen)
        # at most FEW_TERMS rows
        keyed = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], keyed.schema))
    else:
        keyed = cut(keyed, "term-grams")
        postings = postings.where(F.col("segment").isin([s[0] for s in segments]))
    postings = postings.withColumns({"prefix": F.shiftright("gram", 21), "bucket": F.col("bucket").cast("long")})
    within = (F.col("gram") >= F.col("low")) & (F.col("gram") <= F.col("high"))
    met = postings.join(keyed, ["segment", "bucket", "prefix"]).where(within)
    key, place = ["term_id", "segment", "block"], ["term_id", "segment", "unit_no"]
    hits = "term_id string, segment string, unit_no long, tf long, at long, places array<long>"

    def meeting(read: DataFrame, whole: DataFrame) -> DataFrame:
        rows = read.select(*key, "offset", "more", "payload").join(whole.select(*key), key)
        # dealt by a hash of the keys: Spark leaves a shuffle by the very keys of the join out, and may then make that join another
        rows = rows.repartition(F.xxhash64(*key)).sortWithinPartitions(*key)
        return small_batches(rows).mapInArrow(_phrases, hits)

    if len(rows) <= FEW_TERMS:
        whole = met.groupBy(*key).agg(F.count_distinct("offset").alias("held"), F.first("n_grams").alias("n_grams")).where("held = n_grams")
        return meeting(met.withColumn("more", F.lit(False)), whole).drop("places")
    counted = cut(met.groupBy(*key, "offset", "n_grams").agg(F.sum("n").alias("n")), "met-grams")
    whole = counted.groupBy(*key, "n_grams").agg(F.count("*").alias("held")).where("held = n_grams")
    rarest = Window.partitionBy("term_id", "segment").orderBy("n", "offset")
    rare = counted.groupBy("term_id", "segment", "offset").agg(F.sum("n").alias("n")).withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= RAREST)
    rare = cut(keyed.join(rare.select("term_id", "segment", "offset"), ["term_id", "segment", "offset"]), "rare-grams")
    read = postings.join(rare, ["segment", "bucket", "prefix"]).where(within).withColumn("more", F.col("n_grams") > RAREST)
    met = cut(meeting(read, whole), "gram-hits")
    parts = met.where("places is not null").select(*place, F.explode("places").alias("at"))
    parts = parts.join(docs_of(spark, path, segments).select("segment", "unit_no", "unit_text"), ["segment", "unit_no"]).join(terms.select(F.col("term_id").cast("string").alias("term_id"), "term"), "term_id")
    parts = parts.select(*place, "at", F.expr("substring(unit_text, cast(at + 1 as int), length(term))").alias("part"), "term")
    same = small_batches(parts).mapInArrow(_same, "term_id string, segment string, unit_no long, at long").groupBy(*place).agg(F.count("*").alias("tf"), F.min("at").alias("at"))
    return met.where("places is null").drop("places").unionByName(same)


def scored(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """O-05: ``found`` with the size of the unit and the BM25 of the phrase over all units: the logarithm of
    (N - n + 0.5) / (n + 0.5), at least 0.000001, and lengths in trigrams."""
    segments = segments_of(spark, path)
    total, tokens = sum(s[1] for s in segments), sum(s[2] for s in segments)
    sizes = docs_of(spark, path, segments).select("segment", "unit_no", F.greatest(F.col("n_chars") - 2, F.lit(0)).alias("size"))
    df = found.groupBy("term_id").agg(F.count("*").alias("df"))
    return found.join(df, "term_id").join(sizes, ["segment", "unit_no"]).withColumn("bm25", _bm25(total, tokens, F.col("size")))


def _bm25(total: int, tokens: int, size: Column) -> Column:
    idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * size / (tokens / max(total, 1) or 1.0)))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(spark: SparkSession, path: str, terms: DataFrame, limit: int, phrases: bool = True) -> DataFrame:
    """R-03, O-05 to O-08: for each question its terms (question_id, position, term, source_filter) find at most ``limit`` units:
    question_id, rank, source_id, unit_id, evidence_start, evidence_end, score, evidence_text.

    First the terms of three characters at least, in their order: the ``limit`` best units of all by BM25, of which the
    filter leaves those of one source, scored 20 and the BM25. What is then missing is made up by units that hold a term of
    two characters at least, whatever the case of ASCII letters: the first ``limit`` of each by place, after the filter,
    scored 10. A unit counts once, for the term that finds it first. A snippet begins 80 characters before the term where
    the text has it letter by letter, and ends 120 behind it. Without ``phrases`` only the second way is gone.
    """
    segments = segments_of(spark, path)
    words = cut(terms.select("term").where(F.length("term") >= 2).distinct().withColumn("term_id", F.col("term")), "terms")
    found = cut(find(spark, path, words), "term-hits")
    docs = docs_of(spark, path, segments)
    best = scored(spark, path, found.where(F.length("term_id") >= 3) if phrases else found.limit(0)).join(docs.select("segment", "unit_no", "source_id", "unit_id", "start_char", "n_chars"), ["segment", "unit_no"])

    def held(asked: DataFrame) -> DataFrame:
        rows = asked.join(found.select(F.col("term_id").alias("term"), "segment", "unit_no"), "term").join(docs, ["segment", "unit_no"])
        return rows.where(_ascii_lower(F.col("unit_text")).contains(_ascii_lower(F.col("term"))))

    rows = _ranked(terms, best.withColumnRenamed("term_id", "term"), held, limit)
    rows = rows.join(docs.select("segment", "unit_no", "unit_text"), ["segment", "unit_no"])
    rows = rows.withColumn("at", F.expr("locate(term, unit_text) - 1"))
    rows = rows.withColumns({"from_": F.greatest(F.lit(0), F.col("at") - 80), "part": F.expr("substring(unit_text, greatest(0, at - 80) + 1, length(unit_text))")})
    return _snippets(rows)


def _ranked(terms: DataFrame, best: DataFrame, held: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """The units of each question, at most ``limit``, from phrase hits (term, bm25 and the unit's columns) and a function that
    gives the units that hold a term of (term, source_filter), whatever the case of ASCII letters."""
    asked = terms.where(F.length("term") >= 2)
    wanted = F.col("source_filter").isNull() | (F.col("source_filter") == F.col("source_id"))
    place = ("source_id", "start_char", "n_chars", "unit_id", "segment", "unit_no")
    order = Window.partitionBy("term").orderBy(F.desc("bm25"), *place)
    best = best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    # at most ``limit`` rows a term
    best = cut(best.select("term", "nth", F.greatest(F.lit(0.0), F.col("bm25") + 20.0).alias("score"), *place), "phrase-hits")
    ranked = asked.join(best, "term").where(wanted).withColumn("way", F.lit(0))

    # each filter and term once, then each question
    first = held(asked.select("term", "source_filter").distinct()).where(wanted)
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("term", "source_filter").orderBy(*place))).where(F.col("nth") <= limit)
    first = first.select("term", F.col("source_filter").alias("filter"), "nth", F.lit(10.0).alias("score"), *place)
    made_up = asked.join(first, (asked["term"] == first["term"]) & asked["source_filter"].eqNullSafe(first["filter"])).drop(first["term"]).drop("filter").withColumn("way", F.lit(1))

    rows = ranked.unionByName(made_up)
    once = Window.partitionBy("question_id", "segment", "unit_no").orderBy("way", "position")
    rows = rows.withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("way", "position", "nth"))).where(F.col("rank") <= limit)


def _snippets(rows: DataFrame) -> DataFrame:
    """What ``search`` returns, from its ranked units with ``at``, where the term stands letter by letter, and the text ``part``
    that begins at ``from_``."""
    end = F.when((F.col("way") == 0) & (F.col("at") < 0), F.lit(240)).otherwise(F.col("at") + F.length("term") + 120)
    rows = rows.withColumn("to_", F.least(F.col("n_chars"), end))
    text = F.expr("substring(part, 1, cast(to_ - from_ as int))")
    return rows.select(
        "question_id", "rank", "source_id", "unit_id", (F.col("start_char") + F.col("from_")).alias("evidence_start"), (F.col("start_char") + F.col("to_")).alias("evidence_end"), "score", text.alias("evidence_text")
    )


HITS = "term_id string, term string, segment string, unit_no long, source_id string, unit_id string, start_char long, n_chars long, tf long, plain boolean, at long, from_ long, part string"


def _scanner(terms: list[tuple[str, str]]):
    """Rows of HITS from units: the terms (term_id, term) that stand in each, case folded, with their overlapping occurrences."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _folder()

        def folded(text: str) -> str:
            return text.lower() if text.isascii() else fold[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype("<u4").tobytes().decode("utf-32-le")

        def times(text: str, word: str) -> int:
            n, at = 0, text.find(word)
            while at >= 0:
                n, at = n + 1, text.find(word, at + 1)
            return n

        sought = [(term_id, term, low, term.encode().lower(), any(low.startswith(low[k:]) for k in range(1, len(low)))) for term_id, term in terms for low in [folded(term)]]
        for batch in batches:
            found = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("unit_no", "source_id", "unit_id", "start_char", "unit_text")), strict=True)
            for unit_no, source_id, unit_id, start, text in keys:
                low, raw = folded(text), None
                for term_id, term, word, ascii_word, overlaps in sought:
                    if word not in low:
                        continue
                    raw = text.encode().lower() if raw is None else raw  # of bytes only ASCII letters have case
                    at = text.find(term)
                    begin = max(0, at - 80)
                    tf = times(low, word) if overlaps else low.count(word)
                    found.append((term_id, term, "", unit_no, source_id, unit_id, start, len(text), tf, ascii_word in raw, at, begin, text[begin : max(240, at + len(term) + 120)]))
            if found:
                schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in HITS.split(", ")])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return scan


def _scan(units: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """HITS of ``units`` for a handful of terms, with their BM25, by one scan: what ``find`` and ``scored`` tell of an index of
    these units. Hits are written once; what is shuffled is a hit, not a text."""
    text = F.coalesce("unit_text", F.lit(""))
    rows = units.select(F.monotonically_increasing_id().alias("unit_no"), "source_id", "unit_id", F.col("start_char").cast("long").alias("start_char"), text.alias("unit_text"))
    hits = cut(small_batches(rows).mapInArrow(_scanner(terms), HITS), "scan-hits")
    total, tokens = units.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.length(text) - 2, F.lit(0))), F.lit(0))).first()
    # a row a term
    return hits.join(F.broadcast(hits.groupBy("term_id").agg(F.count("*").alias("df"))), "term_id").withColumn("bm25", _bm25(total, tokens, F.greatest(F.col("n_chars") - 2, F.lit(0))))


def scan_phrases(units: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Hits (term_id, source_id, unit_id, tf, bm25) of at most FEW_TERMS terms (term_id, term) by one scan of the units."""
    return _scan(units, terms).select("term_id", "source_id", "unit_id", "tf", "bm25")


def scan_search(units: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """What ``search`` finds in an index of ``units``, where the questions have at most FEW_TERMS terms, by one scan."""
    words = sorted(r.term for r in terms.select("term").where(F.length("term") >= 2).distinct().collect())
    hits = _scan(units, [(w, w) for w in words])
    held = hits.where("plain").select("term", "segment", "unit_no", "source_id", "unit_id", "start_char", "n_chars")
    rows = _ranked(terms, hits.where(F.length("term") >= 3), lambda asked: asked.join(held, "term"), limit)
    return _snippets(rows.join(hits.select("term", "unit_no", "at", "from_", "part"), ["term", "unit_no"]))


def scanned(units: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """What ``search`` finds without phrases for at most FEW_TERMS terms (term_id, term), by one scan: term_id, rank, source_id,
    unit_id, evidence_start, evidence_end, score, snippet. Nothing but the first ``limit`` rows of a task is shuffled."""
    few = F.broadcast(terms.select("term_id", "term", _ascii_lower(F.col("term")).alias("low_term")).where(F.length("term") >= 2))
    rows = units.select("source_id", "unit_id", F.col("start_char").cast("long").alias("start_char"), "unit_text", _ascii_lower(F.col("unit_text")).alias("low"), F.length("unit_text").cast("long").alias("n_chars"))
    rows = rows.join(few, F.contains("low", "low_term")).withColumn("found", F.expr("locate(term, unit_text) - 1"))
    rows = rows.withColumns({"from_": F.greatest(F.lit(0), F.col("found") - 80), "to_": F.least(F.col("n_chars"), F.col("found") + F.length("term") + 120)})
    text = F.expr("substring(unit_text, from_ + 1, cast(to_ - from_ as int))")
    rows = rows.select("term_id", "source_id", "unit_id", "start_char", "n_chars", "from_", "to_", text.alias("snippet"))
    order = Window.partitionBy("term_id").orderBy("source_id", "start_char", "n_chars", "unit_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.select("term_id", "rank", "source_id", "unit_id", (F.col("start_char") + F.col("from_")).alias("evidence_start"), (F.col("start_char") + F.col("to_")).alias("evidence_end"), F.lit(10.0).alias("score"), "snippet")


def scratch_index(units: DataFrame) -> str:
    """An index of ``units`` for one use, in the shared folder."""
    path = new_path(units.sparkSession, "lexical")
    add_units(units, path)
    return path
