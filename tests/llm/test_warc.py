import base64
import hashlib

import pyarrow.fs as pafs
import pytest

from quillspan.llm.storage import new_path
from quillspan.llm.warc import read_archives, write_archives

ROWS = [(5, "http://a/é b", "<p>é</p>", 1), (3, "http://b", "<p>é</p>", 1), (9, None, None, 1), (7, "u", "", 1), (8, "v", "x\r\n\r\nWARC/1.1\r\n" * 50, 1), (None, "n", "<p>é</p>", 1), (3, "http://b", "<p>é</p>", 1)]
SCHEMA = "page_id long, url string, html string, first int"


def files(folder):
    fs, base = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    return {f.base_name: fs.open_input_stream(f.path, compression=None).read() for f in found if f.path.endswith(".warc.gz")}, [f.path for f in found]


def test_round_trip_and_dedup(spark):
    folder = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame(ROWS, SCHEMA), folder, min_shards=3)
    got = read_archives(spark, folder).collect()
    assert len(got) == len(ROWS)
    first = {}
    for page, _, html, _ in ROWS:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for page, _, html, _ in ROWS:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rows = [r for r in got if r.record_id == f"urn:x-page:{'' if page is None else page}"]
        for r in rows:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), digest)
            if page == first[html or ""]:
                assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", f"urn:x-page:{first[html or '']}", None)


def test_same_bytes_whatever_the_partitions(spark):
    one, two = new_path(spark, "test-warc"), new_path(spark, "test-warc")
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * 30, 0) for i in range(200)]
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(7), one, min_shards=4, roll_bytes=3000)
    write_archives(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1), two, min_shards=4, roll_bytes=3000)
    (a, names), (b, _) = files(one), files(two)
    assert a == b and len(a) > 8
    assert not any("_temporary" in n or ".open" in n for n in names)


def test_small_payloads_are_all_responses(spark):
    folder = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame(ROWS, SCHEMA), folder, min_bytes=10**6)
    assert {r.record_type for r in read_archives(spark, folder).collect()} == {"response"}


def test_empty_table(spark):
    folder = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert read_archives(spark, folder).count() == 0


def test_a_file_that_is_not_the_manifests_is_refused(spark):
    """Cut at the end of a record, every record that is left is sound; only the manifest tells."""
    folder = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30, 0) for i in range(200)], SCHEMA), folder, min_shards=2)
    fs, base = pafs.FileSystem.from_uri(folder)
    path = next(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".warc.gz"))
    data = fs.open_input_stream(path, compression=None).read()
    last = data.rindex(b"\x1f\x8b\x08")
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data[:last])
    with pytest.raises(Exception, match="not the file that the manifest names"):
        read_archives(spark, folder).count()


def test_torn_commits_and_second_runs(spark):
    """A manifest whose rename never came is no archive; the same run again makes it one, with the same files."""
    folder, rows = new_path(spark, "test-warc"), [(i, f"http://h/{i}", f"page {i} " * 30, 0) for i in range(50)]
    write_archives(spark.createDataFrame(rows, SCHEMA), folder, min_shards=2)
    before, _ = files(folder)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.delete_dir(f"{base}/_manifest")
    with pytest.raises(Exception):
        read_archives(spark, folder)
    write_archives(spark.createDataFrame(rows, SCHEMA), folder, min_shards=2)
    assert files(folder)[0] == before and read_archives(spark, folder).count() == 50


def test_payloads_beyond_the_read_step_and_many_null_ids(spark):
    """Payloads of several megabytes come back whole; records without id are spread by what they hold."""
    big = "".join(f"{k * 7919 % 1000003:07d}" for k in range(400_000))
    rows = [(1, "u", big, 0), (2, "v", big, 0)] + [(None, f"http://n/{k}", f"text {k}", 0) for k in range(300)]
    folder = new_path(spark, "test-warc")
    write_archives(spark.createDataFrame(rows, SCHEMA), folder, min_shards=8)
    got = read_archives(spark, folder).collect()
    assert len(got) == 302 and {bytes(r.payload).decode() for r in got if r.record_id == "urn:x-page:1"} == {big}
    assert len(files(folder)[0]) == 8
