"""Bounded overlapping chunks of units (W-12, W-13) and their reports (G-05, G-06)."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import small_batches

# Marks that end sentences and clauses, and what may close behind them.
SENTENCE_MARKS, CLAUSE_MARKS, CLOSERS = "。！？!?；;…", "，、：,:", "”’』」】》〉\"')]}）"
PARAGRAPH = re.compile(r"\n[ \t]*\n+")
KINDS = ("paragraph", "sentence", "clause", "whitespace")
LEAST_SHARE, SLACK = 0.55, 64
#: Characters of chunks that are handed over at once.
FRAME_CHARACTERS = 1_000_000
CHUNKS = (
    "chunk_id string, source_id string, unit_id string, ordinal long, norm_start long, norm_end long, length long, overlap_with_previous long, "
    "start_boundary string, end_boundary string, text_sha256 string, text string"
)


@dataclass(frozen=True)
class ChunkPolicy:
    max_chars: int = 1400
    overlap_chars: int = 180

    def __post_init__(self) -> None:
        if self.max_chars <= 0 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("the overlap must be smaller than the chunk")


class Boundaries:
    """Where a text may be cut, found once: by kind, the first place of each cut, the place behind all that closes with
    it, and (paragraphs) from where on a scan still sees it. A cut that would go beyond a limit stops at the limit."""

    def __init__(self, text: str):
        cuts: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
        for m in PARAGRAPH.finditer(text):
            breaks = [i for i in range(m.start(), m.end()) if text[i] == "\n"]
            cuts["paragraph"].append((breaks[1] + 1, m.end(), breaks[-2]))
        for i, c in enumerate(text):
            kind = "sentence" if self._ends_sentence(text, i, c) else "clause" if c in CLAUSE_MARKS else "whitespace" if c.isspace() else None
            if kind:
                end = i + 1
                while kind != "whitespace" and end < len(text) and text[end] in CLOSERS:
                    end += 1
                cuts[kind].append((i + 1, end, i))
        self.cuts = cuts
        self.first = {k: [c[0] for c in v] for k, v in cuts.items()}
        self.full = {k: [c[1] for c in v] for k, v in cuts.items()}

    @staticmethod
    def _ends_sentence(text: str, i: int, c: str) -> bool:
        after = text[i + 1 : i + 2]
        if c == ".":  # F-49: not inside a number
            return not (text[i - 1 : i].isdigit() and after.isdigit()) and (not after or after.isspace() or after in CLOSERS)
        return c in SENTENCE_MARKS and not (c == "…" and after == "…")

    def within(self, kind: str, low: int, high: int) -> list[int]:
        """Cuts of a kind from ``low`` to ``high``, in order."""
        a, b = bisect_left(self.full[kind], low), bisect_right(self.first[kind], high)
        since = low - 2 if kind == "paragraph" else low - 1
        return [min(full, high) for _, full, seen in self.cuts[kind][a:b] if seen >= since]


def chunk_spans(text: str, policy: ChunkPolicy) -> Iterator[tuple[int, int, str, str]]:
    """Start, end and boundary kinds of each chunk of a unit's text. F-51: ends prefer the strongest kind in the last 45
    percent of the budget, and of it the last cut; the next start is the cut nearest behind end minus overlap."""
    bounds, start, began, last = Boundaries(text), 0, "unit_start", 0
    while start < len(text):
        high, low = start + policy.max_chars, start + max(1, int(policy.max_chars * LEAST_SHARE))
        end, kind = min(high, len(text)), "hard" if high < len(text) else "unit_end"
        if kind == "hard":
            low = min(high, max(low, last + 1))
            cuts = ((k, bounds.within(k, low, high)) for k in KINDS)
            kind, end = next(((k, c[-1]) for k, c in cuts if c), (kind, end))
        yield start, end, began, kind
        if end >= len(text):
            return
        wish, last = end - policy.overlap_chars, end
        if policy.overlap_chars == 0:
            start, began = end, "contiguous"
            continue
        reach = min(end, wish + min(SLACK, max(1, policy.overlap_chars // 3)))
        near = [(c[0], n) for n, k in enumerate(KINDS) if (c := bounds.within(k, wish, reach))]
        place, began = (min(near)[0], KINDS[min(near)[1]]) if near else (wish, "hard")
        start = max(start + 1, min(place, end))


def chunk_frames(frames: Iterator[pd.DataFrame], policy: ChunkPolicy) -> Iterator[pd.DataFrame]:
    """Chunks of rows (source_id, unit_id, start_char, unit_text), in frames of about FRAME_CHARACTERS at most, so that memory
    is bounded by the frame that came and one text."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for frame in frames:
        rows, held = [], 0
        for r in frame.itertuples():
            last = r.start_char
            for n, (a, b, began, kind) in enumerate(chunk_spans(r.unit_text, policy)):
                text, start, end = r.unit_text[a:b], r.start_char + a, r.start_char + b
                sha = hashlib.sha256(text.encode()).hexdigest()
                name = hashlib.sha256("\0".join((r.source_id, r.unit_id, str(start), str(end), sha)).encode()).hexdigest()[:24]
                rows.append((f"chk_{name}", r.source_id, r.unit_id, n, start, end, b - a, max(0, last - start), began, kind, sha, text))
                last, held = end, held + b - a
                if held >= FRAME_CHARACTERS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def chunks(unit_texts: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """W-12: chunks of units (source_id, unit_id, start_char, unit_text). Each cut depends on the one before, so a unit is
    one call; units are spread as they are, without a shuffle, in small batches."""
    units = small_batches(unit_texts.select("source_id", "unit_id", F.col("start_char").cast("long").alias("start_char"), "unit_text"))
    return units.mapInPandas(lambda frames: chunk_frames(frames, policy), CHUNKS)


def fixed_chunks(sources: DataFrame, size: int, overlap: int) -> DataFrame:
    """C-01: hard cuts only, as a plain expression: source_id, ordinal, norm_start, norm_end, overlap_with_previous, text."""
    n, step = F.length("text"), size - overlap
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1 - overlap, F.lit(step))).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    df = sources.select("source_id", F.posexplode(starts).alias("ordinal", "norm_start"), "text")
    end = F.least(F.col("norm_start") + size, F.length("text"))
    over = F.when(F.col("ordinal") == 0, 0).otherwise(overlap)
    return df.select("source_id", "ordinal", "norm_start", end.alias("norm_end"), over.alias("overlap_with_previous"), F.substring("text", F.col("norm_start") + 1, F.lit(size)).alias("text"))


def chunk_problems(chunked: DataFrame, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """W-13: chunks that break an invariant, with the names of what they break."""
    order = Window.partitionBy("source_id", "unit_id").orderBy("ordinal")
    before = {c: F.lag(c).over(order) for c in ("norm_end", "norm_start", "ordinal")}
    df = chunked.withColumns({f"last_{k}": v for k, v in before.items()})
    tests = {
        "ORDINAL_NOT_CONTIGUOUS": F.col("ordinal") != F.coalesce(F.col("last_ordinal") + 1, F.lit(0)),
        "GAP": F.col("norm_start") > F.col("last_norm_end"),
        "NO_PROGRESS": (F.col("norm_end") <= F.col("last_norm_end")) | (F.col("norm_start") <= F.col("last_norm_start")),
        "OVERLAP_MISCOUNTED": F.col("overlap_with_previous") != F.coalesce(F.col("last_norm_end") - F.col("norm_start"), F.lit(0)),
        "OVERLAP_ABOVE_BUDGET": F.col("overlap_with_previous") > policy.overlap_chars,
        "LENGTH_OUTSIDE_BUDGET": ~F.col("length").between(1, policy.max_chars) | (F.col("length") != F.col("norm_end") - F.col("norm_start")),
    }
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return df.withColumn("problems", broken).where(F.size("problems") > 0).select("source_id", "unit_id", "ordinal", "problems")


def chunk_report(chunked: DataFrame) -> DataFrame:
    """G-05, G-06: per source: chunks, longest, overlaps, new characters, hard cuts."""
    length, over = F.col("norm_end") - F.col("norm_start"), F.col("overlap_with_previous")
    return chunked.groupBy("source_id").agg(
        F.count("*").alias("chunk_count"),
        F.max(length).cast("long").alias("max_length"),
        F.max(over).cast("long").alias("max_overlap"),
        F.sum(over).cast("long").alias("total_overlap"),
        F.sum(length - over).cast("long").alias("covered_characters"),
    )


def boundary_counts(chunked: DataFrame) -> DataFrame:
    """G-05, G-06: how often chunks of a source start and end at each kind of boundary; hard ends are hard splits."""
    each = chunked.select("source_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_boundary").alias("boundary")) for s in ("start", "end")))).alias("b"))
    return each.groupBy("source_id", "b.side", "b.boundary").agg(F.count("*").alias("n"))
