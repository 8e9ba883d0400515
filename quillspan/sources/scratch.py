"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Where a table that ``cut`` has given stands.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Spark's setting by which an action's shuffle files go at its end, and not when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, on a local master alone, a temporary folder of our own."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    sc.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/quillspan/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside; its own comes back."""
    own = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor
    costs only the reread of its splits. The shuffles that it took leave the disk at once. Ids and digests are most of
    many tables, and only a code for letters makes these shorter."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _set(spark, SHUFFLES_GO, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside leave the disk at its end, but those that the function which it gives was called for."""
    before, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths.get(df))  # a table that was held, not written, stays anyway
        return df

    try:
        yield keep
    finally:
        for own, path in [w for w in _written[before:] if w[1] not in kept]:
            remove(own, path)
            _written.remove((own, path))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small enough for texts of any length: of a few MB, and of few rows.
    Limits that the user has set stay."""
    conf = df.sparkSession.conf
    for key, usual, own in (("maxBytesPerBatch", "67108864b", "4m"), ("maxRecordsPerBatch", "10000", "1000")):
        key = f"spark.sql.execution.arrow.{key}"
        if conf.get(key) == usual:
            conf.set(key, own)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_written() -> None:
    """Removes every intermediate table of this process; a session that is gone already leaves its folder."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            remove(spark, path)
