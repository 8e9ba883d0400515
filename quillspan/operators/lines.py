"""Physical lines with exact offsets (S-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip_eol

#: A line with its end, or what follows the last end.
LINE = "[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"


FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def in_order(*keys: str):
    """The window of a source's lines; all line rules share it, so their rows are shuffled once."""
    return Window.partitionBy("source_id").orderBy(*(keys or ("line_no",)))


def physical_lines(sources: DataFrame) -> DataFrame:
    """``sources`` (source_id, text) as lines: source_id, line_no, start_char, end_char, physical, content.

    Lines end at LF, CR or CR LF; ``content`` and ``end_char`` leave the end out. An empty text has no line."""
    each = sources.select("source_id", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), 0)).alias("at", "physical"))
    before = F.sum(F.length("physical")).over(in_order("at").rowsBetween(FIRST, -1))
    rows = each.select("source_id", (F.col("at") + 1).alias("line_no"), "physical", F.coalesce(before, F.lit(0)).alias("start_char"), strip_eol(F.col("physical")).alias("content"))
    return rows.select("source_id", "line_no", "start_char", (F.col("start_char") + F.length("content")).alias("end_char"), "physical", "content")
