"""Deterministic sharded WARC archives: written under temporary names, committed by a manifest, read back by record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, new_path, remove, small_batches

#: Shards at least; payload bytes a shard; compressed bytes after which a file is closed; bytes of a batch read back.
MIN_SHARDS, SHARD_BYTES, ROLL_BYTES, BATCH_BYTES = 64, 1 << 30, 256 << 20, 4 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"
MANIFEST = "shard long, seq long, temp string, final string, n_bytes long, n_records long, sha256 string"
RECORDS = "record_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, with the same bytes for the same input."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}", "", ""]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + gz.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or where ``first`` names an earlier page of equal payload, a revisit record without it."""
    name = f"{_ID}{'' if page_id is None else page_id}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<{name}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    headers += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        return record("response", headers, head + payload)
    headers += [("WARC-Refers-To", f"<{_ID}{first}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", headers, head)


def info_record(shard: int, seq: int) -> bytes:
    headers = [("WARC-Record-ID", f"<urn:x-file:{shard}:{seq}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
    return record("warcinfo", headers, b"software: quillspan\r\nformat: WARC File Format 1.1\r\n")


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names of object stores are taken for Arrow's."""
    scheme, colon, rest = folder.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest)


class _File:
    """An archive being written under a temporary name that no other attempt uses."""

    def __init__(self, folder: str, shard: int, seq: int):
        self.fs, base = _filesystem(folder)
        self.shard, self.seq = shard, seq
        self.temp = f"{base}/_temporary/{uuid.uuid4().hex}.open"
        self.final = f"{base}/part-{shard:06d}-{seq:04d}.warc.gz"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        self.add(info_record(shard, seq))

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = [self.shard, self.seq, self.temp, self.final, self.bytes, self.records, self.sha.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in MANIFEST.split(", ")])


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "page_id", "url", "html", "first"))
            for shard, page_id, url, html, first in zip(*columns, strict=True):
                shard = shard.as_py()
                if now and (now.shard != shard or now.bytes >= roll_bytes):
                    yield now.close()
                    now = _File(folder, shard, now.seq + 1 if now.shard == shard else 0)
                now = now or _File(folder, shard, 0)
                now.add(page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py()))
        if now:
            yield now.close()

    return write


def _committer(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for temp, final, size in zip(*(batch.column(c).to_pylist() for c in ("temp", "final", "n_bytes")), strict=True):
                if fs.get_file_info(temp).type != pafs.FileType.NotFound:
                    fs.move(temp, final)
                elif fs.get_file_info(final).size != size:  # an attempt before this one has moved it, or nothing is there
                    raise FileNotFoundError(temp)
            yield batch

    return commit


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, min_shards: int = MIN_SHARDS) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files into ``folder``, a URI that every executor reaches.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least ``min_bytes``, those with
    the smallest page_id are responses, all others revisit them. Records are range-sorted by a 64-bit hash of the
    page_id, so equal ranges of it are equal shards whatever the ids, and one page's copies never meet in one task;
    files roll when their compressed size reaches ``roll_bytes``. The same pages give the same bytes in the same files.

    Tasks write under temporary names and return a line of manifest each file; a second job renames what the
    manifest lists (again without harm), and the manifest itself is renamed last: an archive without it isn't there.
    What lost or repeated attempts left is removed.

    A null page_id is never a response that others refer to, and such records are placed by payload and url; ties in
    page_id are all responses. Repeated rows
    are repeated records. A null url becomes the record's own name. Extra columns are ignored; an empty table gives
    a manifest without files.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("payload_bytes", F.length(payload).cast("long"))
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = cut(copies.where("n > 1 and first is not null").select("digest", "first"), "copies")
    total = rows.agg(F.sum("payload_bytes")).first()[0] or 0
    shards = max(min_shards, -(-total // SHARD_BYTES))

    rows = rows.join(copies, "digest", "left")
    revisit = ~F.col("first").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    rows = rows.withColumn("first", F.when(revisit, F.col("first"))).withColumn("place", F.when(F.col("page_id").isNull(), F.xxhash64("digest", "url")).otherwise(F.xxhash64("page_id")))
    high = F.shiftrightunsigned("place", 31).cast("long")  # 33 bits
    rows = rows.withColumn("shard", F.shiftright(high * F.lit(shards), 33).cast("long"))
    rows = rows.select("shard", "place", "page_id", "url", "html", "first").repartitionById(shards, F.col("shard").cast("int"))
    rows = rows.sortWithinPartitions("shard", "place", "page_id", "url", "html").select("shard", "page_id", "url", "html", "first")
    manifest = cut(rows.mapInArrow(_writer(folder, roll_bytes), MANIFEST), "manifest")
    manifest = manifest.mapInArrow(_committer(folder), MANIFEST).select("final", "n_bytes", "n_records", "sha256")
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest.open")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    remove(spark, f"{folder}/_manifest")
    if not fs.rename(path(f"{folder}/_manifest.open"), path(f"{folder}/_manifest")):
        raise OSError(f"{folder}: the manifest could not be committed")
    remove(spark, f"{folder}/_temporary")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, a gzip member at a time."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                break
            parts.append(member.decompress(rest))
            rest = member.unused_data
        if not member.eof:
            if parts and any(parts):
                raise ValueError("the archive ends within a record")
            return
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


class _Checked:
    """A stream that counts and hashes what is read of it."""

    def __init__(self, stream):
        self.stream, self.bytes, self.sha = stream, 0, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.bytes += len(data)
        self.sha.update(data)
        return data


def _reader(folder: str):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for final, told_bytes, told_records, told_sha in (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("final", "n_bytes", "n_records", "sha256")), strict=True)):
            rows, held, seen = [], 0, 0
            with fs.open_input_stream(final, compression=None) as raw:
                stream = _Checked(raw)
                for headers, block in _records(stream):
                    seen += 1
                    if f"sha1:{digest_of(block)}" != headers["WARC-Block-Digest"]:
                        raise ValueError(f"{final}: {headers['WARC-Record-ID']} is damaged")
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = headers["WARC-Type"] == "response"
                    if whole and (len(payload) != length or digest_of(payload) != told):
                        raise ValueError(f"{final}: payload of {headers['WARC-Record-ID']} is damaged")
                    refers = headers.get("WARC-Refers-To")
                    row = (headers["WARC-Record-ID"][1:-1], headers["WARC-Type"], headers["WARC-Target-URI"], told, length)
                    rows.append((*row, refers[1:-1] if refers else None, payload if whole else None))
                    held += len(block) + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                        rows, held = [], 0
            if (stream.bytes, seen, stream.sha.hexdigest()) != (told_bytes, told_records, told_sha):
                raise ValueError(f"{final}: not the file that the manifest names")
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return read


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a committed archive, a file a task: record_id, record_type, uri, payload_digest, payload_bytes,
    refers_to, payload (null for revisits). Digests of records are checked, and bytes, records and digest of each file
    against the manifest; damage raises."""
    manifest = spark.read.parquet(f"{folder}/_manifest").select("final", "n_bytes", "n_records", "sha256")
    files = max(1, manifest.count())
    at = F.pmod(F.xxhash64("final"), F.lit(files)).cast("int")
    return manifest.repartitionById(files, at).mapInArrow(_reader(folder), RECORDS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the whole pages table as WARC, reads it back and describes each page's record."""
    folder = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    number = lambda c: F.nullif(F.substring(c, len(_ID) + 1, 40), F.lit("")).cast("long")
    return read_archives(spark, folder).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
