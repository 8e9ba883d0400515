"""Tables on disk: explicit schemas, partitioned writes, logical hashes, manifests, verification (K-01 to K-15, R-10 to R-12)."""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Seconds without a sign of life after which a build counts as killed.
LEASE = 600
#: Input schemas; readers fail on rows that don't fit.
UNIT_INDEX = "source_id string, unit_id string, norm_start long, norm_end long, body_start long, body_end long"
CANDIDATE = (
    "claim_type string, subject string, object string, value string, unit string, polarity boolean, source_id string, unit_id string, evidence_start long, evidence_end long, evidence_text string"
)
LINK = (
    "relation string, left_result_id string, left_role string, right_result_id string, right_role string, source_id string, unit_id string, evidence_start long, evidence_end long, evidence_text string"
)
GOLD = (
    "case_id string, question_id string, question string, source_filter string, expected_decision string, expected_predicate string, expected_claim string, expected_fact_ids array<string>, tags array<string>"
)
QUESTION = "question_id string, question string, source_filter string"
#: The folder of the index of a project's units, which is derived from them and not in the manifest.
INDEX = "lexical"
#: Columns that tables are partitioned by on disk.
PARTITIONS = {"claims": ["status"], "anomalies": ["category"], "facts": ["claim_type"]}


def read_rows(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """S-14 to S-17: rows of JSON lines or CSV by an explicit schema; what doesn't parse fails the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path)


def closed_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """S-14, S-17: objects of a file of JSON lines with exactly the fields of ``schema``, and (line, problem) of the lines
    that are none: blank ones, others than objects, with fields that are unknown, missing or of another type."""
    names = [f.split()[0] for f in schema.split(", ")]
    lines = spark.read.text(path).withColumn("fields", F.expr("json_object_keys(value)"))
    known = F.array(*(F.lit(n) for n in names))
    lines = lines.withColumn("row", F.from_json("value", schema))
    typed = [F.col(f"row.{n}").isNull() & F.get_json_object("value", f"$.{n}").isNotNull() for n in names]
    wrong = typed[0]
    for test in typed[1:]:
        wrong = wrong | test
    problem = (
        F.when(F.trim("value") == "", "BLANK_LINE")
        .when(F.col("fields").isNull(), "NOT_AN_OBJECT")
        .when(F.size(F.array_except("fields", known)) > 0, "UNKNOWN_FIELD")
        .when(F.size(F.array_except(known, "fields")) > 0, "MISSING_FIELD")
        .when(wrong, "WRONG_TYPE")
    )
    lines = lines.withColumn("problem", problem)
    return lines.where("problem is null").select("row.*"), lines.where("problem is not null").select(F.col("value").alias("line"), "problem")


def unit_index(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """S-16: units (source_id, unit_id, start_char, end_char): body offsets count where both are there. A source that has
    no unit is one."""
    both = F.col("body_start").isNotNull() & F.col("body_end").isNotNull()
    units = rows.select("source_id", "unit_id", F.when(both, F.col("body_start")).otherwise(F.col("norm_start")).alias("start_char"), F.when(both, F.col("body_end")).otherwise(F.col("norm_end")).alias("end_char"))
    rest = sources.join(units.select("source_id").distinct(), "source_id", "left_anti")
    return units.unionByName(rest.select("source_id", F.lit("unit-1").alias("unit_id"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char")))


def canonical_json(df: DataFrame) -> Column:
    """K-15: a row as JSON with sorted names and its nulls."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def logical_hash(df: DataFrame) -> Column:
    """G-28: a hash of a table's rows whatever their order and files: sums of two parts of 60 bits of each row's digest,
    which partial sums combine before any shuffle."""
    row = F.sha2(canonical_json(df), 256)
    sums = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return F.sha2(F.concat_ws("|", F.count("*"), *(F.coalesce(s, F.lit(0)).cast("string") for s in sums)), 256)


def table_hashes(tables: dict[str, DataFrame]) -> DataFrame:
    """K-12: table_name, n_rows, logical_sha256 of each table."""
    rows = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), logical_hash(df).alias("logical_sha256")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its path class."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def recover(spark: SparkSession, path: str) -> None:
    """R-22: where a swap was cut off between its two renames, the old project takes its place again."""
    fs, of = _files(spark, path)
    if not fs.exists(of(f"{path}/manifest")) and fs.exists(of(f"{path}.old/manifest")):
        fs.delete(of(path), True)
        if not fs.rename(of(f"{path}.old"), of(path)):
            raise OSError(f"{path}: the old project could not be put back")


class _Lock:
    """R-23: ``path``.lock, which names its owner and is touched as long as that lives. One that has not been touched for
    LEASE seconds is a killed build's, and is taken over."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs, of = _files(spark, path)
        self.place, self.done = of(f"{path}.lock"), threading.Event()
        if self.fs.exists(self.place) and time.time() - self.fs.getFileStatus(self.place).getModificationTime() / 1000 > LEASE:
            self.fs.delete(self.place, False)
        if not self.fs.createNewFile(self.place):
            raise OSError(f"{path}.lock: another build is at work, or was killed less than {LEASE} seconds ago")
        write_text(self.fs, self.place, json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "application": spark.sparkContext.applicationId}))
        threading.Thread(target=self._touch, daemon=True).start()

    def _touch(self) -> None:
        while not self.done.wait(LEASE / 4):
            self.fs.setTimes(self.place, int(time.time() * 1000), -1)

    def release(self) -> None:
        self.done.set()
        self.fs.delete(self.place, False)


def write_text(fs, place, text: str) -> None:
    out = fs.create(place, True)
    out.write(text.encode())
    out.close()


class Journal:
    """R-22: what a build has done so far, below the place that it writes to. A stage is entered when all its tables are
    written, and not before; one that is entered is read back instead of being done again."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place, self.tables = spark, place, {}
        self.fs, self.of = _files(spark, place)

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> None:
        """Adds the tables of ``make`` to ``tables`` as written; its ``warnings`` by the name of the stage."""
        entry = self.of(f"{self.place}/_journal/{name}")
        if self.fs.exists(entry):
            stream = self.fs.open(entry)
            told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.tables |= {n: self.spark.read.schema(StructType.fromJson(s)).parquet(f"{self.place}/{n}") for n, s in told.items()}
            return
        made = {f"_journal/warnings-{name}" if n == "warnings" else n: df for n, df in make().items()}
        self.tables |= write_tables(made, self.place)
        open_ = self.of(f"{self.place}/_journal/{name}.open")
        write_text(self.fs, open_, json.dumps({n: json.loads(df.schema.json()) for n, df in made.items()}))
        if not self.fs.rename(open_, entry):
            raise OSError(f"{self.place}: stage {name} could not be entered")

    def warnings(self) -> list[DataFrame]:
        return [df for n, df in self.tables.items() if n.startswith("_journal/")]

    def close(self) -> dict[str, DataFrame]:
        """The project's tables; the journal is gone then."""
        self.fs.delete(self.of(f"{self.place}/_journal"), True)
        return {n: df for n, df in self.tables.items() if not n.startswith("_journal/")}


@contextmanager
def replacing(spark: SparkSession, path: str, key: str | None = None) -> Iterator[str]:
    """K-13, R-22: a fresh place to write a project to; when the block ends without an error, it takes the place of what is
    at ``path`` by two renames. Until then, and after an error, what was there stays. A lock keeps others out. With a
    ``key`` that names the build by its content, a place that a killed build of the same key has left is given again, with
    what its journal says; places of other keys go. A build that its own rules refuse (ValueError) leaves nothing."""
    path = path.rstrip("/")
    fs, of = _files(spark, path)
    lock = _Lock(spark, path)
    place, left = f"{path}.build-{key or uuid.uuid4().hex}", False
    try:
        recover(spark, path)
        for other in fs.globStatus(of(f"{path}.build-*")) or ():
            if other.getPath().getName() != of(place).getName():
                fs.delete(other.getPath(), True)
        yield place
        fs.delete(of(f"{path}.old"), True)
        if fs.exists(of(path)) and not fs.rename(of(path), of(f"{path}.old")):
            raise OSError(f"{path}: the old project could not be put aside")
        if not fs.rename(of(place), of(path)):
            recover(spark, path)
            raise OSError(f"{path}: the new project could not take its place")
        fs.delete(of(f"{path}.old"), True)
    except ValueError:
        raise
    except BaseException:
        left = key is not None
        raise
    finally:
        if not left:
            fs.delete(of(place), True)
        lock.release()


def break_lock(spark: SparkSession, path: str) -> None:
    """Lets the next build of a path begin where one was killed, and puts the old project back if it had been put aside."""
    fs, of = _files(spark, path.rstrip("/"))
    fs.delete(of(f"{path.rstrip('/')}.lock"), False)
    recover(spark, path.rstrip("/"))


def write_tables(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """K-01 to K-07: writes tables below ``path`` and returns them as written."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()}


def write_manifest(tables: dict[str, DataFrame], path: str) -> None:
    """K-12, K-13: every table's schema, row count and hash; a project without it isn't there, so it comes last."""
    spark = next(iter(tables.values())).sparkSession
    schemas = spark.createDataFrame([(name, df.schema.json()) for name, df in tables.items()], "table_name string, table_schema string")
    table_hashes(tables).join(schemas, "table_name").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_project(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """S-18: tables of a published project, all or some, by the schemas of its manifest."""
    recover(spark, path.rstrip("/"))
    rows = {r.table_name: r.table_schema for r in spark.read.parquet(f"{path}/manifest").select("table_name", "table_schema").collect()}
    return {n: spark.read.schema(StructType.fromJson(json.loads(rows[n]))).parquet(f"{path}/{n}") for n in names or rows}


def manifest_differences(told: DataFrame, found: DataFrame) -> DataFrame:
    """X-04, J-20: names on one side only, and names whose row counts or hashes differ."""
    both = told.alias("a").join(found.alias("b"), "table_name", "full_outer")
    problem = F.when(F.col("b.logical_sha256").isNull(), "MISSING").when(F.col("a.logical_sha256").isNull(), "UNEXPECTED")
    problem = problem.when((F.col("a.logical_sha256") != F.col("b.logical_sha256")) | (F.col("a.n_rows") != F.col("b.n_rows")), "CHANGED")
    return both.select("table_name", problem.alias("problem")).where("problem is not null")


def folders(spark: SparkSession, path: str) -> list[str]:
    """S-20: names of what lies right below a path, through Hadoop's file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found)


def safe_relative(path: Column) -> Column:
    """P-34: a relative path of plain parts, without empty ones, dots alone or backslashes."""
    return F.coalesce(path.rlike(r"^(?!.*(^|/)\.{1,2}(/|$))[^/\\\x00]+(/[^/\\\x00]+)*$"), F.lit(False))


def verify_project(spark: SparkSession, path: str) -> DataFrame:
    """R-10 to R-12: what of a project isn't as its manifest says: tables that lack, that are there unasked, or whose rows
    differ; empty where all is. The index is no table of the manifest; ``plans.project.verify`` looks at it, too."""
    told = spark.read.parquet(f"{path}/manifest")
    here = set(folders(spark, path)) - {"manifest", INDEX}
    known = {name: df for name, df in read_project(spark, path).items() if name in here}
    found = table_hashes(known)
    extra = spark.createDataFrame([(name,) for name in sorted(here - set(known))], "table_name string")
    extra = extra.select("table_name", F.lit(0).cast("long").alias("n_rows"), F.lit("").alias("logical_sha256"))
    return manifest_differences(told, found.unionByName(extra))


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """J-15: ids that ``rows`` mention (in a column or an array) and ``known`` does not have, with how often."""
    ids = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
    used = rows.select(ids.alias("id")).where("id is not null")
    return used.join(known.select(F.col(key).alias("id")), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """G-27: ids that stand for several rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
