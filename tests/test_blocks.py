"""Files by ranges of bytes, and two-level scans, against whole files and whole windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import anomaly, prefix
from quillspan.operators.lines import physical_lines
from quillspan.sources import blocks, ingest

LETTERS = ["a", "b ", "é", "中", "上", "ੁ", "਀", "ਊ", "𝒳", "\r", "\n", "\r\n", "\n\n", "�", "\x00", "\u000b", "ਅ\n", "﻿", "字" * 9]


def files(folder):
    rng, made = random.Random(3), {}
    for n in range(12):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(100, 250)))
        encoding = ["utf-8", "utf-8-sig", "gb18030", "utf-16-le", "utf-16-be", "utf-16"][n % 6]
        made[f"{encoding}-{n}.txt"] = ("﻿".encode("utf-16-le") if encoding == "utf-16" else b"") + (text.encode("utf-16-le") if encoding == "utf-16" else text.encode(encoding, "replace" if encoding == "gb18030" else "strict"))
    plain = "第1章 起\n" * 50
    made |= {f"plain-{e}.txt": plain.encode(e) for e in ("utf-8", "gb18030", "utf-16-le", "utf-16-be")}
    made |= {"empty.txt": b"", "mark.txt": b"\xef\xbb\xbf", "bad.txt": b"\x81\n\xff\xff\n", "bad-mark.txt": b"\xef\xbb\xbfabc\n\xff", "wide.txt": "a".encode("utf-32"), "odd16.txt": b"\xff\xfea\x00\n", "one.txt": b"x" * 700, "ends.txt": b"\n\n\n", "cr.txt": b"a\rb\r", "latin.txt": "caf\xe9 \n na\xefve\n".encode("latin-1"), "sp ace %41.txt": b"a\nb"}
    for name, content in made.items():
        (folder / name).write_bytes(content)
    return made


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    """Read in ranges of 128 bytes, one file split over several."""
    folder = tmp_path_factory.mktemp("files")
    made, conf = files(folder), spark.conf
    was = {k: conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    conf.set("spark.sql.files.maxPartitionBytes", "128")
    conf.set("spark.sql.files.openCostInBytes", "16")
    report, pieces = blocks.decode_files(spark, f"file://{folder}")
    out = {r.path.rsplit("/", 1)[1]: r for r in report.collect()}, pieces.persist()
    chunks = pieces.select("path", "chunk").distinct().count()
    for k, v in was.items():
        conf.set(k, v)
    assert chunks > 2 * len(made)
    return made, *out


def name(path):
    from urllib.parse import unquote

    return unquote(path.rsplit("/", 1)[-1])


def test_encodings_are_those_of_whole_files(read):
    made, report, _ = read
    assert {name(n) for n in report} == set(made)
    for path, r in report.items():
        want = ingest.choose_encoding(made[name(path)])
        if name(path) != "mark.txt":  # nothing but a mark is left over by Spark's reader as nothing
            assert {k: getattr(r, k) for k in want if k != "text"} == {k: v for k, v in want.items() if k != "text"}, path
        assert r.size_bytes == len(made[name(path)])


def test_texts_statistics_and_lines_are_those_of_whole_files(spark, read):
    made, report, pieces = read
    whole = {n: ingest.choose_encoding(c)["text"] for n, c in made.items()}
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.path, r.chunk, r.nth)):
        texts.setdefault(name(r.path), []).append(r.text)
    assert {n: "".join(t) for n, t in texts.items()} == {n: t for n, t in whole.items() if t}
    sources = spark.createDataFrame([(n, t) for n, t in whole.items() if t], "source_id string, text string")
    want = {r.source_id: r.asDict() for r in ingest.text_statistics(sources).drop("text").collect()}
    got = {name(r.path): r.asDict() for r in blocks.statistics(pieces).collect()}
    assert {n: {k: v for k, v in r.items() if k != "path"} for n, r in got.items()} == {n: {k: v for k, v in r.items() if k != "source_id"} for n, r in want.items()}
    columns = ["line_no", "start_char", "end_char", "physical", "content"]
    lines = {(name(r.source_id), *(r[c] for c in columns)) for r in blocks.lines_of_pieces(pieces).collect()}
    assert lines == {(r.source_id, *(r[c] for c in columns)) for r in physical_lines(sources).collect()}


def rows_of(spark, n=400):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(3)}", i, rng.choice([None, -2, 0, 1, 5]), rng.choice([None, "a", "b"])) for i in range(n)]
    return spark.createDataFrame([(s, i, v, x, i // rng.choice([20, 20, 20])) for s, i, v, x in rows], "source_id string, i int, v int, letter string, chunk long").repartition(7)


def test_running_values_are_those_of_one_window(spark):
    rows = rows_of(spark)
    w = Window.partitionBy("source_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.select("source_id", "i", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("sum"), F.max("v").over(w).alias("max"), F.last("v", ignorenulls=True).over(w).alias("last"), F.lag("v").over(Window.partitionBy("source_id").orderBy("i")).alias("lag"))
    parts = prefix.before(rows, {"sum": ("sum", F.col("v")), "max": ("max", F.col("v")), "last": ("last", F.col("v"))}, ("i",))
    parts = prefix.previous(parts, {"lag": F.col("v")}, ("i",))
    assert sorted(map(str, parts.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_states_are_those_of_one_walk(spark):
    steps = {"out": {"a": "in-a", "b": "in-b"}, "in-a": {"a": "out"}, "in-b": {"b": "out"}}
    got = prefix.states(rows_of(spark), "state", F.col("letter"), steps, "out", ("i",)).collect()
    for source in {r.source_id for r in got}:
        state = "out"
        for r in sorted((r for r in got if r.source_id == source), key=lambda r: r.i):
            assert r.state == state
            state = steps[state].get(r.letter, state)
    assert len(got) == 400


def test_line_rules_of_chunks_are_those_of_windows(spark):
    """W-01, W-02, W-04: the same lines in chunks and without."""
    rng = random.Random(6)
    texts = [(f"s{k}", "".join(rng.choice(["", " ", "x" * 20, "中" * 20, "中中 x" * 6, "a\tb"]) + rng.choice(["\n", "\r\n", "\n"]) for _ in range(150))) for k in range(3)]
    sources = spark.createDataFrame(texts, "source_id string, text string")
    lines = physical_lines(sources)
    parts = lines.withColumn("chunk", F.col("line_no").cast("long") / 7).withColumn("chunk", F.floor("chunk"))
    for rule, columns in ((anomaly.line_runs, ["source_id", "line_no", "normal", "run"]), (lambda x: anomaly.script_shifts(x, 10, 0.3), ["source_id", "line_no", "cjk_before", "latin_before"])):
        want = sorted(map(tuple, rule(lines).select(columns).collect()))
        assert sorted(map(tuple, rule(parts).select(columns).collect())) == want and want
    pieces = parts.select("source_id", "chunk", F.col("line_no").alias("nth"), F.col("physical").alias("text"))
    for width, stride, least in ((80, 80, 24), (50, 20, 10), (10, 30, 1), (100_000, 100_000, 5)):
        want = sorted(map(tuple, anomaly.char_windows(sources, width, stride, least).collect()))
        assert sorted(map(tuple, anomaly.windows_of_pieces(pieces, width, stride, least).collect())) == want and want
