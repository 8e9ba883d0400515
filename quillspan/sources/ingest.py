"""Sources: files with their identity, encoding and newline statistics (S-01 to S-13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte-order marks, the longer ones first.
BOMS = {"utf-32-le": b"\xff\xfe\x00\x00", "utf-32-be": b"\x00\x00\xfe\xff", "utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
SAMPLE, ZERO_SHARE = 65_536, 0.20
DECODED = (
    "path string, source_id string, source_sha256 string, size_bytes long, modified timestamp, encoding string, bom string, confidence string, text string, "
    "warnings array<string>, blockers array<string>, recommended_action string"
)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """S-01 to S-03: path, content, size, modification time and digest of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sha = F.sha2(F.col("content"), 256)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), sha.alias("source_sha256"))


def changed_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """S-03, T-F: path and problem of files whose size or time is not what it was when ``seen`` (path, size_bytes, modified)
    was read, or that came or went since; the contents are not read again."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_now"), F.col("modificationTime").alias("modified_now"))
    both = seen.select("path", "size_bytes", "modified").join(now, "path", "full_outer")
    problem = F.when(F.col("size_now").isNull(), "GONE").when(F.col("size_bytes").isNull(), "NEW")
    problem = problem.when((F.col("size_now") != F.col("size_bytes")) | (F.col("modified_now") != F.col("modified")), "CHANGED")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def verified(files: DataFrame, expected: Column) -> DataFrame:
    """S-04: the files whose digest is ``expected``, in any case; a malformed digest matches nothing."""
    return files.where(expected.rlike("^[0-9A-Fa-f]{64}$") & (F.col("source_sha256") == F.lower(expected)))


def newline_counts(text: Column) -> dict[str, Column]:
    """S-06: LF, CR LF and CR line ends, each counted once."""
    crlf = F.regexp_count(text, F.lit("\\r\\n"))
    counts = {"lf_count": F.regexp_count(text, F.lit("\\n")) - crlf, "crlf_count": crlf, "cr_count": F.regexp_count(text, F.lit("\\r")) - crlf}
    return {k: v.cast("long").alias(k) for k, v in counts.items()}


def newline_type(lf: str = "lf_count", crlf: str = "crlf_count", cr: str = "cr_count") -> Column:
    """S-07: none, lf, crlf, cr or mixed."""
    kinds = sum(((F.col(c) > 0).cast("int") for c in (lf, crlf, cr)), F.lit(0))
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(F.col(lf) > 0, "lf").when(F.col(crlf) > 0, "crlf").otherwise("cr")


def admission(files: DataFrame) -> DataFrame:
    """S-05: ``files`` (path, content, ...) with suffix, NUL, newline and line statistics and the admission status.

    Bytes are read as Latin-1, so each stays one character. With NUL bytes the line count is null."""
    raw = F.decode("content", "ISO-8859-1")
    df = files.withColumn("suffix", F.lower(F.regexp_extract("path", "(\\.[^./]*)$", 1)))
    df = df.withColumn("nul_count", F.regexp_count(raw, F.lit("\\x00")).cast("long")).withColumns(newline_counts(raw))
    ends = F.col("lf_count") + F.col("crlf_count") + F.col("cr_count")
    open_ = F.when((F.length("content") > 0) & ~raw.rlike("[\\r\\n]\\z"), 1).otherwise(0)
    df = df.withColumns({"newline_type": newline_type(), "line_count": F.when(F.col("nul_count") == 0, ends + open_)})
    blockers = F.when(~F.col("suffix").isin(".txt", ".md"), F.array(F.lit("UNSUPPORTED_SUFFIX"))).otherwise(F.array().cast("array<string>"))
    found = (("EMPTY_SOURCE", F.length("content") == 0), ("NUL_BYTES_PRESENT", F.col("nul_count") > 0), ("MIXED_NEWLINES", F.col("newline_type") == "mixed"))
    warnings = F.filter(F.array(*(F.when(test, F.lit(code)) for code, test in found)), lambda x: x.isNotNull())
    df = df.withColumns({"blockers": blockers, "warnings": warnings, "source_id": F.concat(F.lit("source_sha256_"), "source_sha256")})
    status = F.when(F.size("blockers") > 0, "unsupported").when(F.size("warnings") > 0, "review").otherwise("accepted_for_encoding_inspection")
    return df.withColumn("admission_status", status)


def utf16_orders(sample: bytes) -> list[str]:
    """S-11: the byte orders a text without mark may have, the likelier first: zero bytes on one side, or line ends."""
    if len(sample) < 4 or len(sample) % 2:
        return []
    pairs = len(sample) // 2
    seen = {}
    for order, side, ends in (("utf-16-le", 1, (b"\n\x00", b"\r\x00")), ("utf-16-be", 0, (b"\x00\n", b"\x00\r"))):
        seen[order] = (sum(sample.count(e) for e in ends), sample[side::2].count(0) / pairs)
    orders = sorted(seen, key=lambda o: seen[o], reverse=True)
    return [o for o in orders if seen[o][0] > 0 or seen[o][1] >= ZERO_SHARE]


def choose_encoding(content: bytes) -> dict[str, object]:
    """S-08, S-10: encoding, text, confidence, warnings and blockers of a file's bytes; the first that decodes strictly."""
    bom = next((name for name, mark in BOMS.items() if content.startswith(mark)), None)
    out: dict[str, object] = {"encoding": None, "bom": bom or "none", "confidence": "none", "text": None, "warnings": [], "blockers": []}

    def attempt(encoding: str, data: bytes) -> bool:
        try:
            out["text"], out["encoding"] = data.decode(encoding), encoding
        except UnicodeDecodeError:
            return False
        return True

    if bom and bom.startswith("utf-32"):
        out["blockers"] = ["UNSUPPORTED_BOM"]
    elif bom:
        if attempt(bom, content[len(BOMS[bom]) :]):
            out["confidence"] = "high"
        else:
            out["blockers"] = ["BOM_ENCODING_DECODE_FAILED"]
    elif len(content) % 2 == 0 and any(attempt(order, content) for order in utf16_orders(content[:SAMPLE])):
        out |= {"confidence": "medium", "warnings": ["BOMLESS_UTF16_CANDIDATE"]}
    elif attempt("utf-8", content):
        out["confidence"] = "high"
    elif attempt("gb18030", content):
        out |= {"confidence": "medium", "warnings": ["NON_UTF8_GB18030_CANDIDATE"]}
    else:
        out["blockers"] = ["NO_STRICT_DECODER"]
    out["recommended_action"] = "reject" if out["blockers"] else "review" if out["warnings"] else "accept"
    return out


def decode(files: DataFrame) -> DataFrame:
    """S-08: ``files`` decoded, one row a file; what no decoder takes has a null text and blockers. Spark's ``decode``
    has no GB18030, so bytes pass through Arrow once."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DECODED.split(", ")]
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                sha = hashlib.sha256(r.content).hexdigest()
                rows.append({"path": r.path, "source_id": f"source_sha256_{sha}", "source_sha256": sha, "size_bytes": len(r.content), "modified": r.modified, **choose_encoding(r.content)})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "modified").mapInPandas(each, DECODED)


def text_statistics(sources: DataFrame) -> DataFrame:
    """S-09: ``sources`` (text, ...) with counts of special characters and line ends."""
    classes = {
        "replacement_count": "\\x{FFFD}",
        "nul_count": "\\x00",
        "embedded_bom_count": "\\x{FEFF}",
        "control_count": "[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x9F]",
        "noncharacter_count": "[\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(17)) + "]",
    }
    counted = {k: F.regexp_count("text", F.lit(p)).cast("long") for k, p in classes.items()}
    df = sources.withColumns({"character_count": F.length("text").cast("long"), **counted, **newline_counts(F.col("text"))})
    ends = F.col("lf_count") + F.col("crlf_count") + F.col("cr_count")
    open_ = F.when((F.length("text") > 0) & ~F.col("text").rlike("[\\r\\n]\\z"), 1).otherwise(0)
    return df.withColumns({"newline_type": newline_type(), "line_count": ends + open_})


def identity(documents: DataFrame) -> DataFrame:
    """L-01: ``documents`` (doc_id, text) as sources: digest, size, newline class and line count of each text."""
    df = documents.select("doc_id", F.sha2("text", 256).alias("source_sha256"), F.octet_length("text").cast("long").alias("size_bytes"), "text")
    df = df.withColumns(newline_counts(F.col("text"))).withColumn("newline_type", newline_type())
    ends = F.col("lf_count") + F.col("crlf_count") + F.col("cr_count")
    open_ = F.when((F.length("text") > 0) & ~F.col("text").rlike("[\\r\\n]\\z"), 1).otherwise(0)
    return df.withColumn("line_count", ends + open_).drop("text")


def as_sources(documents: DataFrame) -> DataFrame:
    """Texts of the documents table as (source_id, text)."""
    return documents.select(F.col("doc_id").cast("string").alias("source_id"), "text")
