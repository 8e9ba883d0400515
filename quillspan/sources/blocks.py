"""Files of any size, read by ranges of bytes in many tasks: strict decoding, statistics and lines (S-08 to S-12)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import strip_eol
from quillspan.operators.lines import LINE
from quillspan.operators.prefix import before

from .ingest import BOMS, SAMPLE, newline_type, text_statistics, utf16_orders
from .scratch import cut

REPORT = "encoding string, bom string, confidence string, warnings array<string>, blockers array<string>, recommended_action string"


def byte_rows(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` as stretches that end at a byte 0x0A: path, size_bytes, modified, chunk, nth, bytes.

    Spark's text source cuts files into ranges of bytes and finds the ends of its stretches; it does not look at what is
    between them, so any encoding passes. ``chunk`` is where a range begins, ``nth`` grows within it. The final 0x0A
    isn't part of a stretch, and a UTF-8 mark at the beginning of a file is taken off."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    about = {"path": "file_path", "size_bytes": "file_size", "modified": "file_modification_time", "chunk": "file_block_start"}
    # the id is taken right at the scan: rows of a range are in one task, in their order
    return text.select(*(F.col(f"_metadata.{c}").alias(k) for k, c in about.items()), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("bytes"), F.is_valid_utf8("value").alias("utf8"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files: a scan leaves empty ones out, so these come from the listing that every reader makes at the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    # the listing writes a path without host with two slashes more than the scan does
    listed = spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", name),) for name in files.inputFiles()], "path string")
    return listed.join(known, "path", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches with their offset in the file and whether 0x0A follows; and, of each file: marked (a UTF-8 mark was taken
    off) and ended (the last byte is 0x0A). Both follow from the file's size."""
    rows = before(rows, {"offset": ("sum", F.length("bytes") + 1)}, ("nth",), ("path",))
    sums = rows.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.sum(F.length("bytes") + 1).alias("n"), F.max(F.col("offset")).alias("last"))
    left = F.col("size_bytes") - F.col("n")
    sums = sums.select("path", (left >= 2).alias("marked"), left.isin(0, 3).alias("ended"), "last")
    rows = rows.join(sums, "path").withColumn("closed", (F.col("offset") < F.col("last")) | F.col("ended"))
    return rows.withColumn("offset", F.col("offset") + F.when(F.col("marked"), 3).otherwise(0)), sums


def _ladders(rows: DataFrame, files: DataFrame) -> DataFrame:
    """path, bom, ladder: the encodings to try, from the first SAMPLE bytes of each file."""
    head = rows.where(F.col("offset") < SAMPLE).select("path", "marked", F.struct("offset", F.expr(f"substring(bytes, 1, {SAMPLE})").alias("bytes"), "closed").alias("x"))
    head = head.groupBy("path").agg(F.first("marked").alias("marked"), F.array_sort(F.collect_list("x")).alias("xs"))
    files = files.join(head, "path", "left")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r in frame.itertuples():
                content = b"".join(bytes(x["bytes"]) + (b"\n" if x["closed"] else b"") for x in (r.xs if r.xs is not None else ()))
                content = ((BOMS["utf-8"] if r.marked else b"") + content)[:SAMPLE]
                bom = next((name for name, mark in BOMS.items() if content.startswith(mark)), None)
                # half a sample tells nothing about zero bytes on the odd side
                orders = utf16_orders(content[: len(content) // 2 * 2]) if r.size_bytes % 2 == 0 else []
                found.append((r.path, bom or "none", [bom] if bom else [*orders, "utf-8", "gb18030"]))
            yield pd.DataFrame(found, columns=["path", "bom", "ladder"])

    return files.select("path", "size_bytes", "marked", "xs").mapInPandas(each, "path string, bom string, ladder array<string>")


def _lines_of_units(rows: DataFrame) -> DataFrame:
    """Stretches of UTF-16 files put together again: a line feed has two bytes there, so a byte 0x0A ends a line only
    with a zero byte at its right or left, at an even place. Each line becomes one row: path, chunk, nth, encoding, bytes."""
    little = F.col("encoding") == "utf-16-le"
    odd = F.col("offset") % 2 == 1
    # little endian: the stretch before ended at an even byte, and this one begins with the other half of its end
    opens = little & odd & (F.substring("bytes", 1, 1) == F.lit(b"\0"))
    shuts = ~little & ((F.col("offset") + F.length("bytes")) % 2 == 1) & (F.expr("substring(bytes, -1, 1)") == F.lit(b"\0")) & F.col("closed")
    rows = rows.withColumns({"opens": F.coalesce(opens, F.lit(False)), "shuts": F.coalesce(shuts, F.lit(False))})
    rows = before(rows, {"line": ("sum", (F.col("opens") | F.col("shuts")).cast("long"))}, ("nth",), ("path", "encoding"))
    rows = rows.withColumn("line", F.col("line") + F.col("opens").cast("long"))
    part = F.struct("offset", "chunk", "nth", F.expr("substring(bytes, if(opens, 2, 1))").alias("bytes"), "closed")
    whole = rows.groupBy("path", "encoding", "line").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("last").alias("last"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["bytes"], F.when(x["closed"], F.lit(b"\n")).otherwise(F.lit(b""))))
    first, final = F.element_at("parts", 1), F.element_at("parts", -1)
    # the end's other half went to the next stretch; a file whose last byte is 0x0A has lost none
    tail = F.when((F.col("encoding") == "utf-16-le") & final["closed"] & (final["offset"] < F.col("last")), F.lit(b"\0")).otherwise(F.lit(b""))
    return whole.select("path", first["chunk"].alias("chunk"), first["nth"].alias("nth"), "encoding", F.concat(joined, tail).alias("bytes"))


def _decoder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for encoding, data in zip(frame["encoding"], frame["bytes"], strict=True):
            try:
                texts.append(bytes(data).decode(encoding))
            except UnicodeDecodeError:
                texts.append(None)
        yield frame[["path", "chunk", "nth", "encoding"]].assign(text=texts)


TEXTS = "path string, chunk long, nth long, encoding string, text string"


def _decoded(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each file's stretches in the encodings wanted of it (path, encoding): TEXTS, null where one doesn't decode. Their
    line ends are in the texts; marks are not."""
    rows = rows.join(wanted, "path")
    mark = (F.col("offset") == 0) & F.col("bom").startswith("utf-16")
    rows = rows.withColumns({"bytes": F.when(mark, F.expr("substring(bytes, 3)")).otherwise(F.col("bytes")), "offset": F.when(mark, 2).otherwise(F.col("offset"))})
    ended = F.concat("bytes", F.when(F.col("closed"), F.lit(b"\n")).otherwise(F.lit(b"")))
    plain = rows.where("encoding = 'utf-8'").select("path", "chunk", "nth", "encoding", F.when(F.col("utf8"), F.concat(F.decode("bytes", "UTF-8"), F.when(F.col("closed"), "\n").otherwise(""))).alias("text"))
    others = rows.where("encoding = 'gb18030'").select("path", "chunk", "nth", "encoding", ended.alias("bytes"))
    units = _lines_of_units(rows.where("encoding like 'utf-16%'"))
    return plain.unionByName(others.unionByName(units).mapInPandas(_decoder, TEXTS))


def decode_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-08: the files below ``path``, decoded strictly in tasks of a range of bytes each: a report (path, size_bytes, modified
    and REPORT), and the texts of the files that decode, in pieces of a line: path, chunk, nth, text.

    The encoding is that of the mark, or the first that all pieces of the file decode in: UTF-16 where its zero bytes show,
    UTF-8, GB18030. In UTF-8 and GB18030 a byte 0x0A is a line feed and part of nothing else, so each stretch between
    them is decoded by itself, the former within Spark; in UTF-16 stretches are put together to lines first. A carriage
    return before a line feed is in the same piece with it. One piece, thus a line, may have 2 GB at most; a file any number
    of pieces. Empty files, and such as hold a mark alone, have no piece.
    """
    files = cut(_files(spark, path), "files")
    rows, _ = _placed(byte_rows(spark, path))
    rows = cut(rows, "stretches")
    ladders = cut(_ladders(rows, files), "ladders")
    tried = ladders.select("path", "bom", F.posexplode("ladder").alias("step", "encoding")).where("encoding not like 'utf-32%'")
    # UTF-8 first, as it costs nothing to know; what decodes so is not tried as GB18030
    whole = rows.groupBy("path").agg(F.min("utf8").alias("utf8"))
    tried = tried.join(whole, "path", "left").where("not (encoding = 'gb18030' and coalesce(utf8, true))")
    texts = cut(_decoded(rows, tried.select("path", "bom", "encoding")), "pieces")
    good = tried.join(texts.groupBy("path", "encoding").agg(F.max(F.col("text").isNull()).alias("failed")), ["path", "encoding"], "left").where("not coalesce(failed, false)")
    chosen = cut(good.groupBy("path").agg(F.min_by("encoding", "step").alias("encoding")), "encodings")
    report = files.join(ladders, "path").join(chosen, "path", "left")
    marked, failed = F.col("bom") != "none", F.col("encoding").isNull()
    confidence = F.when(failed, "none").when(marked | (F.col("encoding") == "utf-8"), "high").otherwise("medium")
    warning = F.when(marked | failed, F.lit(None)).when(F.col("encoding").startswith("utf-16"), "BOMLESS_UTF16_CANDIDATE").when(F.col("encoding") == "gb18030", "NON_UTF8_GB18030_CANDIDATE")
    blocker = F.when(F.col("bom").startswith("utf-32"), "UNSUPPORTED_BOM").when(failed & marked, "BOM_ENCODING_DECODE_FAILED").when(failed, "NO_STRICT_DECODER")
    report = report.select("path", "size_bytes", "modified", "encoding", "bom", confidence.alias("confidence"), F.array_compact(F.array(warning)).alias("warnings"), F.array_compact(F.array(blocker)).alias("blockers"))
    action = F.when(F.size("blockers") > 0, "reject").when(F.size("warnings") > 0, "review").otherwise("accept")
    pieces = texts.join(chosen, ["path", "encoding"], "left_semi").where("text <> ''").select("path", "chunk", "nth", "text")
    return report.withColumn("recommended_action", action), pieces


def statistics(pieces: DataFrame) -> DataFrame:
    """S-09: what ``text_statistics`` gives for a whole text, from its pieces: sums, and whether the last line is open."""
    each = text_statistics(pieces)
    counts = [c for c in each.columns if c.endswith("_count")]
    out = each.groupBy("path").agg(*(F.sum(c).alias(c) for c in counts))
    return out.withColumn("newline_type", newline_type())


def lines_of_pieces(pieces: DataFrame, source: Column | None = None) -> DataFrame:
    """S-12: physical lines of texts in pieces: source_id (the path, unless ``source`` says another column), chunk, line_no,
    start_char, end_char, physical, content. Places come from a two-level scan, so a source of any size uses all tasks."""
    source = F.col("path") if source is None else source
    rows = pieces.select(source.alias("source_id"), "chunk", "nth", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), 0)).alias("at", "physical"))
    rows = before(rows, {"start_char": ("sum", F.length("physical").cast("long")), "line_no": ("sum", F.lit(1).cast("long"))}, ("nth", "at"))
    rows = rows.withColumns({"content": strip_eol(F.col("physical")), "line_no": F.col("line_no") + 1})
    return rows.select("source_id", "chunk", "line_no", "start_char", (F.col("start_char") + F.length("content")).alias("end_char"), "physical", "content")
