"""Line deduplication across documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

#: Keys of at least so many code points, found in at least so many documents, are dropped.
MIN_CHARS, MIN_DOCS = 20, 3
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id inside: below every other.
_NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def shared_lines(documents: DataFrame) -> DataFrame:
    """(id, version, pos) of every line to drop: its key is long enough, is in enough documents, and this is not the
    largest doc_id that holds it."""
    rows = documents.select("id", "version", F.posexplode(_lines()).alias("pos", "line"))
    rows = rows.where(F.length("line") >= MIN_CHARS).withColumn("key", line_key(F.col("line")))
    rows = rows.where(F.length("key") >= MIN_CHARS)
    rows = cut(rows.select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    common = rows.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"))
    common = cut(common.where(F.col("n") >= MIN_DOCS).drop("n"), "common-lines")
    return rows.join(common, ["h1", "h2"]).where("id < last").select("id", "version", "pos")


def drop_shared_lines(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_lines, n_dropped, kept (the text that stays).

    Lines are what stands between line feeds; a null or empty text is one empty line. Normalised lines are exploded
    and hashed to 128 bits, distinct documents are counted per hash (combined before the shuffle, so a line that is
    everywhere costs a row a task), and the positions of lines to drop come back to their document by a join that
    skew handling may split. The rest is joined again in its order.

    A key that several lines of one document share counts once for it; in the document that keeps it all stay. Rows
    that share a doc_id are one document; a null doc_id is a document below all others. Extra columns are ignored; an
    empty table gives an empty result.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64("text").alias("version"),
    )
    drops = shared_lines(docs).groupBy("id", "version").agg(F.collect_set("pos").alias("drop"))
    out = docs.join(drops, ["id", "version"], "left").select("doc_id", _lines().alias("lines"), "drop")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drop", F.array().cast("array<int>")))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """drop_shared_lines over the whole documents table."""
    out = drop_shared_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id < c.last AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
