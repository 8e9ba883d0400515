"""Limits of policies: what exceeds one is left out, and a warning row says so (O-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.sources.scratch import cut

WARNING = "source_id string, stage string, warning string, left_out long"


def warnings_of(rows: DataFrame, stage: str, code: str, left_out=None) -> DataFrame:
    """Warning rows from rows with a source_id."""
    n = F.lit(None).cast("long") if left_out is None else left_out.cast("long")
    return rows.select("source_id", F.lit(stage).alias("stage"), F.lit(code).alias("warning"), n.alias("left_out"))


def within(rows: DataFrame, most: int, order: tuple[str, ...], stage: str, code: str) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each source in ``order``, and a warning for each source that has more. Only the rows of
    such sources are sorted; the others pass as they are, and where there is none, no row is moved."""
    many = cut(rows.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") > most), "beyond-limit")
    if many.isEmpty():
        return rows, warnings_of(many, stage, code, F.col("n") - most)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    cut_ = rows.join(many.select("source_id"), "source_id", "left_semi").withColumn("place", place).where(F.col("place") <= most).drop("place")
    kept = rows.join(many.select("source_id"), "source_id", "left_anti").unionByName(cut_)
    return kept, warnings_of(many, stage, code, F.col("n") - most)
