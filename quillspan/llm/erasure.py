"""Cascading erasure: tables as sorted files, victims routed to the files that may hold them, and those files rewritten."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, shared_dir, small_batches

#: A table of n rows becomes files of 1 + n // FILES rows; masters whose CRC-32 this divides are erased.
FILES, MODULUS = 150, 100
#: Rows from which files get tasks of their own; small tables share some.
TASK_ROWS = 20_000
#: Rows and bytes of a row group; memory of a database, which spills beyond it.
GROUP_ROWS, GROUP_BYTES, MEMORY = 1 << 17, 64 << 20, "256MB"
_NEVER = -(1 << 63)


@dataclass(frozen=True)
class Kind:
    """A table: its column of money, and how its rows meet victims: columns that ``id`` and ``other`` equal."""

    money: str
    keys: tuple[str, ...]


KINDS = {
    "clients": Kind("balance", ("client_id", "master_id")),
    "clicks": Kind("value", ("client_id",)),
    "sales": Kind("total", ("client_id",)),
    "sale_lines": Kind("amount", ("sale_id",)),
}
_FILE = "file_no long, path string, n_rows long, cents long, ids_sha256 string, low struct<key:long,id:long>, high struct<key:long,id:long>"
_NEW = "table_name string, file_no long, path string, n_rows long, n_erased long, cents long, ids_sha256 string"


def place(client_id: Column) -> Column:
    """CRC-32 of the decimal id; of the empty string for a null."""
    return F.crc32(F.coalesce(client_id.cast("string"), F.lit("")).cast("binary"))


def local_folder(spark: SparkSession, uri: str) -> str:
    """The path of a folder that driver and executors have mounted; files are rewritten in place of one another there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if full.getScheme() != "file":
        raise ValueError(f"{uri}: erasure needs spark.checkpoint.dir on a mounted file system")
    return full.getPath()


class _Digest:
    """Rows, cents and the hash of the ids of a file, batch by batch."""

    def __init__(self) -> None:
        self.rows, self.cents, self.sha = 0, 0, hashlib.sha256()

    def add(self, ids: pa.Array, money: pa.Array) -> None:
        text = ",".join("" if i is None else str(i) for i in ids.to_pylist())
        self.sha.update((("," if self.rows else "") + text).encode() if len(ids) else b"")
        self.rows += len(ids)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(100 * pc.fill_null(money, 0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.5)
        whole = whole[np.isfinite(whole)]
        self.cents += int(whole.astype(np.int64).sum()) if len(whole) and np.abs(whole).max() < 1 << 40 else sum(map(int, whole.tolist()))

    def result(self) -> tuple[int, int | None, str]:
        return self.rows, self.cents if -(1 << 63) <= self.cents < 1 << 63 else None, self.sha.hexdigest()


class _Writer:
    """One file, streamed under a temporary name."""

    def __init__(self, folder: str, temp: str, file_no: int):
        os.makedirs(folder, exist_ok=True)
        os.makedirs(temp, exist_ok=True)
        self.file_no, self.path, self.temp = file_no, f"{folder}/{file_no:05d}.parquet", f"{temp}/{uuid.uuid4().hex}.parquet"
        self.digest, self.low, self.high, self.out, self.held = _Digest(), None, None, None, []

    def add(self, rows: pa.Table, money: str, key: pa.Array, ids: pa.Array) -> None:
        self.low = self.low or (key[0].as_py(), ids[0].as_py())
        self.high = (key[-1].as_py(), ids[-1].as_py())
        self.digest.add(rows.column(0).combine_chunks(), rows.column(money).combine_chunks())
        self.held.append(rows)
        if sum(t.num_rows for t in self.held) >= GROUP_ROWS or sum(t.nbytes for t in self.held) >= GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            table = pa.concat_tables(self.held)
            self.out = self.out or pq.ParquetWriter(self.temp, table.schema)
            self.out.write_table(table)
            self.held = []

    def close(self) -> tuple:
        self.flush()
        self.out.close()
        os.replace(self.temp, self.path)
        rows, cents, sha = self.digest.result()
        return self.file_no, self.path, rows, cents, sha, dict(zip(("key", "id"), self.low, strict=True)), dict(zip(("key", "id"), self.high, strict=True))


def _runs(files: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """File and range of each run of equal numbers."""
    edges = np.flatnonzero(np.diff(files)) + 1
    for a, b in zip([0, *edges], [*edges, len(files)], strict=True):
        yield int(files[a]), int(a), int(b)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _file_writer(folder: str, temp: str, columns: list[str], money: str, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            rows = pa.Table.from_arrays(batch.column("row").flatten(), names=columns)
            for file_no, a, b in _runs(batch.column("file_no").to_numpy()) if batch.num_rows else ():
                if now and now.file_no != file_no:
                    yield _batch([now.close()], schema)
                    now = None
                now = now or _Writer(folder, temp, file_no)
                now.add(rows.slice(a, b - a), money, batch.column("key").slice(a, b - a), batch.column("id").slice(a, b - a))
        if now:
            yield _batch([now.close()], schema)

    return write


def dealt(file: Column, files: int, rows: int) -> tuple[int, Column]:
    """Tasks for so many files of so many rows, and the task of a file: one each, unless they are small."""
    tasks = max(1, min(files, 1 + rows // TASK_ROWS))
    return tasks, F.floor(file * tasks / files).cast("int")


def write_sorted(table: DataFrame, key: Column, ids: Column, money: str, folder: str, temp: str, files: int = FILES) -> DataFrame:
    """Writes ``table`` (row: a struct of its columns, and what ``key`` and ``ids`` need) as files of consecutive rows, sorted
    by key and all columns, nulls first; returns a row a file with the range of (key, ids) in it.

    Two shuffles: the sort by ranges of key and columns, after which a row's number is its task's first number plus its
    place in the task (one count a task reaches the driver), and one that brings each file's rows to the task that
    streams them out. A key with any share of the rows is split by the columns after it.
    """
    spark = table.sparkSession
    columns = table.schema["row"].dataType.names
    ordered = table.select("row", key.alias("key"), F.coalesce(ids, F.lit(_NEVER)).alias("id"))
    ordered = ordered.orderBy("key", *(F.col("row").getField(c) for c in columns))
    ordered = cut(ordered.withColumn("nth", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("nth", 33)
    counts = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    total = sum(r.n for r in counts)
    if not total:
        return spark.createDataFrame([], _FILE)
    starts = np.concatenate([[0], np.cumsum([r.n for r in counts])[:-1]]).tolist()
    base = spark.createDataFrame([(r.task, s) for r, s in zip(counts, starts, strict=True)], "task long, base long")
    number = F.col("base") + F.col("nth").bitwiseAND((1 << 33) - 1)
    size = 1 + total // files
    placed = ordered.withColumn("task", task).join(F.broadcast(base), "task").select("row", "key", "id", number.alias("number"))
    placed = placed.withColumn("file_no", F.expr(f"number div {size}"))
    placed = small_batches(placed).repartitionById(*dealt(F.col("file_no"), -(-total // size), total)).sortWithinPartitions("file_no", "number")
    schema = _arrow(_FILE)
    return cut(placed.select("row", "key", "id", "file_no").mapInArrow(_file_writer(folder, temp, columns, money, schema), _FILE), "files")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _rewrite(table: str, file_no: int, path: str, temp: str, victims: Iterator[pa.Table]) -> tuple | None:
    """Reads one file with an embedded database, without the victims' rows, in the order they were in, and writes what is
    left beside it; None if no row is a victim's. The file itself stays, so a repeated attempt finds what the first found."""
    import duckdb

    own = f"{temp}/{uuid.uuid4().hex}"
    os.makedirs(f"{own}/spill")
    kind, columns = KINDS[table], pq.read_schema(path).names
    try:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": f"{own}/spill"}) as db:
            db.execute("CREATE TABLE victims (id BIGINT, other BIGINT)")
            for some in victims:
                db.register("shard", some)
                db.execute("INSERT INTO victims SELECT id, other FROM shard")
                db.unregister("shard")
            # a column of that name hides the number; a single thread keeps the file's order then
            named = "file_row_number" not in (c.lower() for c in columns)
            rows = f"read_parquet($path{', file_row_number = true' if named else ''})"
            match = " AND ".join(f"t.{_quoted(c)} IS NOT DISTINCT FROM v.{v}" for c, v in zip(kind.keys, ("id", "other"), strict=False))
            erased = db.execute(f"SELECT count(*) FROM {rows} t SEMI JOIN victims v ON {match}", {"path": path}).fetchall()[0][0]
            if not erased:
                return None
            digest, new = _Digest(), path.removesuffix(".parquet") + "-erased.parquet"
            if erased < pq.read_metadata(path).num_rows:
                picked = ", ".join(f"t.{_quoted(c)}" for c in columns)
                kept = f"SELECT {picked} FROM {rows} t ANTI JOIN victims v ON {match}{' ORDER BY t.file_row_number' if named else ''}"
                db.execute(f"COPY ({kept}) TO '{own}/kept.parquet' (FORMAT parquet, ROW_GROUP_SIZE {GROUP_ROWS})", {"path": path})
                with pq.ParquetFile(f"{own}/kept.parquet") as file:
                    for batch in file.iter_batches(columns=[columns[0], kind.money]):
                        digest.add(batch.column(columns[0]), batch.column(kind.money))
                os.replace(f"{own}/kept.parquet", new)
            n, cents, sha = digest.result()
            return table, file_no, new, n, erased, cents, sha
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _rewriter(temp: str, schema: pa.Schema):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((batch, a, b) for batch in batches if batch.num_rows for _, a, b in _runs(batch.column("file").to_numpy()))
        ahead = next(pieces, None)
        while ahead:
            batch, a, _ = first = ahead
            told = [batch.column(c)[a].as_py() for c in ("table_name", "file_no", "path", "file")]

            def run() -> Iterator[pa.Table]:
                nonlocal ahead
                while ahead and ahead[0].column("file")[ahead[1]].as_py() == told[3]:
                    batch, a, b = ahead
                    yield pa.Table.from_batches([batch.slice(a, b - a)]).select(["id", "other"])
                    ahead = next(pieces, None)

            done = _rewrite(*told[:3], temp, run())
            assert ahead is not first
            if done:
                yield _batch([done], schema)

    return rewrite


def victims_of(tables: dict[str, DataFrame], owner: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """The victims' keys with the place of their rows: table_name, id, other, place (key, id).

    Victim masters are those whose CRC-32 ``modulus`` divides, and the one whose clients together have most clicks, the
    smallest among equals. Rows of clients are theirs by master_id, clicks and sales by client_id, lines by sale_id,
    whose place is that of the client that ``owner`` (sale_id, client_id) names.
    """
    clients, clicks, sales = (tables[t] for t in ("clients", "clicks", "sales"))
    per_client = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    owners = clients.where("master_id is not null").select("client_id", "master_id").distinct()
    counts = owners.join(per_client, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    top = counts.orderBy(F.desc("n"), "master_id").limit(1).collect()
    chosen = F.crc32(F.col("master_id").cast("string").cast("binary")) % modulus == 0
    for r in top:
        chosen |= F.col("master_id") == r.master_id
    gone = cut(owners.where(chosen), "victim-clients")
    ids = gone.where("client_id is not null").select("client_id").distinct()
    sold = sales.where("client_id is not null and sale_id is not null").select("sale_id", "client_id").join(ids, "client_id", "left_semi").select("sale_id").distinct()
    sold = sold.join(owner, "sale_id")

    def part(df: DataFrame, table: str, column: str, other: Column, second: Column) -> DataFrame:
        spot = F.struct(place(F.col("client_id")).alias("key"), F.coalesce(second, F.lit(_NEVER)).cast("long").alias("id"))
        return df.select(F.lit(table).alias("table_name"), F.col(column).alias("id"), other.cast("long").alias("other"), spot.alias("place"))

    none = F.lit(None)
    parts = part(gone, "clients", "client_id", F.col("master_id"), F.col("client_id"))
    for table in ("clicks", "sales"):
        parts = parts.unionAll(part(ids, table, "client_id", none, none))
    return parts.unionAll(part(sold, "sale_lines", "sale_id", none, F.col("sale_id")))


def erase(tables: dict[str, DataFrame], files: int = FILES, modulus: int = MODULUS) -> DataFrame:
    """Writes ``clients``, ``clicks``, ``sales`` and ``sale_lines`` as sorted files into a new folder below
    spark.checkpoint.dir, erases the victims from them, and returns a row for each file that is left.

    1. Rows are sorted by the CRC-32 of the client's id (a line's sale's; null or no sale: of the empty string), then by
       all columns, nulls first, and written as files of 1 + n // ``files`` rows.
    2. Victims' keys are routed to the files whose range of places holds theirs (at most ``files`` + 1 ranges a table go to
       the tasks), one key once for each such file; the place of a line has its sale in it, so the sales of a client with
       very many are not sent to all of that client's files.
    3. A task a file loads its shard of victims into an embedded database, which reads the file, leaves the victims' rows
       out and writes the others, by their number in the file, beside it. Originals are never changed, and results have
       names of their own, so a lost task is simply repeated. When all are done, the originals of rewritten files go.

    Where a sale_id repeats, its lines are placed by its smallest client_id, and they are victims if any of its sales
    is. Null ids cascade to nothing, but a row of clients with a victim's master_id goes whatever its client_id. Repeated
    rows are rows of their own. Amounts that are null, not a number or infinite count 0 cents; a sum beyond a long is
    null. Further columns are written along, whatever their names; a table without rows has no files.
    """
    spark = tables["clients"].sparkSession
    root = f"{local_folder(spark, shared_dir(spark)).rstrip('/')}/erasure-{uuid.uuid4().hex}"
    temp = f"{root}-open"
    owner = tables["sales"].where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("client_id"))
    owner = cut(owner, "sale-clients")
    nested = {t: df.select(F.struct("*").alias("row")) for t, df in tables.items()}
    lines = nested["sale_lines"].withColumn("sale_id", F.col("row.sale_id")).join(owner, "sale_id", "left").select("row", F.col("client_id").alias("_owner"))
    nested["sale_lines"] = lines
    written, shards, total = [], [], 0
    for name, df in nested.items():
        client = F.col("_owner") if name == "sale_lines" else F.col("row.client_id")
        second = F.col("row").getField(KINDS[name].keys[0]).cast("long") if name in ("clients", "sale_lines") else F.lit(None).cast("long")
        found = write_sorted(df, place(client), second, KINDS[name].money, f"{root}/{name}", temp, files)
        written.append(found.withColumn("table_name", F.lit(name)))
        rows = found.select("file_no", "path", "low", "high", "n_rows").orderBy("file_no").collect()
        shards += [(name, r.file_no, r.path, r.low, r.high) for r in rows]
        total += sum(r.n_rows for r in rows)
    base = written[0]
    for more in written[1:]:
        base = base.unionAll(more)
    ranges = spark.createDataFrame(
        [(*s, k) for k, s in enumerate(shards)], "table_name string, file_no long, path string, low struct<key:long,id:long>, high struct<key:long,id:long>, file int"
    )
    ranges = ranges.groupBy("table_name").agg(F.collect_list(F.struct("file_no", "path", "low", "high", "file")).alias("files"))
    routed = victims_of(tables, owner, modulus).join(F.broadcast(ranges), "table_name")
    routed = routed.select("table_name", "id", "other", F.explode(F.filter("files", lambda f: (f["low"] <= F.col("place")) & (F.col("place") <= f["high"]))).alias("f"))
    routed = routed.select("table_name", "id", "other", "f.file_no", "f.path", "f.file")
    routed = routed.repartitionById(*dealt(F.col("file"), max(1, len(shards)), total)).sortWithinPartitions("file")
    new = cut(routed.mapInArrow(_rewriter(temp, _arrow(_NEW)), _NEW), "rewritten")
    for r in new.join(F.broadcast(ranges.select("table_name", F.explode("files").alias("f")).select("table_name", "f.file_no", F.col("f.path").alias("old"))), ["table_name", "file_no"]).collect():
        os.remove(r.old)
    shutil.rmtree(temp, ignore_errors=True)

    columns = F.create_map(*(F.lit(x) for name, df in tables.items() for x in (name, ",".join(df.columns))))
    new = new.select("table_name", "file_no", *(F.col(c).alias(f"new_{c}") for c in ("path", "n_rows", "cents", "ids_sha256")), "n_erased")
    out = base.join(F.broadcast(new), ["table_name", "file_no"], "left").withColumn("rewritten", F.col("new_path").isNotNull())
    out = out.where("not rewritten or new_n_rows > 0")

    def current(c: str) -> Column:
        return F.when(F.col("rewritten"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return out.select(
        "file_no", current("n_rows"), F.coalesce("n_erased", F.lit(0)).cast("long").alias("n_erased"), current("cents"),
        "rewritten", "table_name", current("ids_sha256"), columns[F.col("table_name")].alias("columns"), current("path"),
    )


def op13_erasure(spark, sf_dir: str) -> DataFrame:
    """erase over the whole tables."""
    return erase({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in KINDS})
