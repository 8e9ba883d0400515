"""A training-data pipeline over the documents table. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import fmindex, langid, minhash, mixing, sharding
from quillspan.llm.storage import cut

#: Mean probability below which the language of a text counts as unknown where there are too few documents to calibrate.
LEAST_SCORE = 0.3
#: Tokens that the mixture takes, as a share of what is there; each document at most once.
SHARE, EPOCHS = 0.8, 1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or no language with the score that held-out documents
    of the known languages have, less a slack for short texts. Learns from the documents that op8 may learn from.
    Without any labelled document there is no network, and all are rejected."""
    held, labelled = langid.held_out(F.col("doc_id")), docs.select("doc_id", "text", "lang")
    network = langid.train(labelled.where(~held))
    return langid.in_known_language(docs, network, *(langid.calibrate(labelled.where(held), network) or (LEAST_SCORE,)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id; rows without doc_id all stay."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(cut(gone, "duplicates"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return fmindex.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf of the domain-language-source tree up to its budget."""
    mixed = mixing.mix_documents(docs, mixing.levels_of_documents(), mixing.WEIGHTS, SHARE, EPOCHS)
    return mixed.where("epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "epochs"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every document into a shard and a slot of it: the documents' columns, size, text_crc32, shard, slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: A trained network, set similarity and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
