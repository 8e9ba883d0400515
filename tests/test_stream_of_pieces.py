"""Sources in pieces, in any order and any batches, against the rules over whole sources."""

import random

from pyspark.sql import functions as F

from quillspan.operators.anomaly import AnomalyPolicy, line_findings, line_runs
from quillspan.operators.lines import physical_lines
from quillspan.plans import scale_queries, text_queries
from quillspan.streaming.pieces import LINE_STATE, PIECE, STORE, cut_in_pieces, watch_pieces

POLICY = AnomalyPolicy(max_line_characters=60, duplicate_min_characters=12, duplicate_min_line_distance=3, script_shift_min_characters=10, marker_groups={"a": ("甲", "乙"), "b": ("丙",)})
LONG = "这一行足够长，可以当作重复的段落来看待"
TEXTS = {
    "plain": "\n".join([LONG, "x", "y", "z", LONG, "this line is of latin letters alone", LONG + "。", "甲乙丙", "", " ", "x  x", "x x", "x x "]),
    "ends": "a\r\nb\rc\n\r\n\r\r\nd\r",
    "marks": "a�b\x00c﻿\nhttp://x.com 未完待续\n求月票\n" + "长" * 70 + "😀\n" + "z" * 200,
    "open": "no end of line",
    "same": (LONG + "\n") * 9 + "\x1c" + LONG + "\n" + LONG,
    "empty": "",
    "gone": None,
}


def _batch(spark, folder, rows):
    spark.createDataFrame(rows, PIECE).coalesce(1).write.mode("append").parquet(folder)


def _rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def _equal(spark, out, texts):
    sources = spark.createDataFrame(list(texts.items()), "source_id string, text string")
    lines = physical_lines(sources)
    columns = ("source_id", "line_no", "start_char", "end_char", "physical", "content", "run")
    told = spark.read.schema(LINE_STATE).parquet(f"{out}/lines")
    assert _rows(told, columns) == _rows(line_runs(lines), columns)
    found = line_findings(lines, POLICY)
    assert _rows(spark.read.parquet(f"{out}/findings").select(*found.columns), found.columns) == _rows(found, found.columns)
    return found


def test_pieces_in_disorder_with_repeats_over_restarts(spark, tmp_path, width=3):
    """Every batch is a query of its own, begun again from the checkpoint; pieces come mixed and some twice, the second
    time with another text or after the last one."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    sources = spark.createDataFrame(list(TEXTS.items()), "source_id string, text string")
    pieces = [tuple(r) for r in cut_in_pieces(sources, width).collect()]
    rng = random.Random(width)
    rng.shuffle(pieces)
    before = spark.conf.get(STORE, None)
    half = len(pieces) // 2
    for k in range(2):
        some = pieces[half:] if k else pieces[:half]
        _batch(spark, folder, some + [(s, n, "other", last) for s, n, _, last in pieces[: k * half : 5]] + [(None, 0, "x", True), ("plain", None, "x", True)])
        watch_pieces(spark, folder, out, checkpoint, POLICY).awaitTermination()
    _batch(spark, folder, [("plain", 10_000, "behind the end", True), ("open", 0, "again", True)])
    watch_pieces(spark, folder, out, checkpoint, POLICY).awaitTermination()
    assert spark.conf.get(STORE, None) == before
    rules = {r.rule_id for r in _equal(spark, out, TEXTS).select("rule_id").distinct().collect()}
    assert len(rules) >= 9


def test_a_source_waits_for_a_missing_piece_and_a_lost_batch_is_written_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    _batch(spark, folder, [("s", 0, f"{LONG}\nx\ny\r", False), ("s", 2, LONG, True)])
    watch_pieces(spark, folder, out, checkpoint, POLICY).awaitTermination()
    assert spark.read.schema(LINE_STATE).parquet(f"{out}/lines").count() == 2  # a CR may go on as CR LF
    _batch(spark, folder, [("s", 1, "\nz\n", None)])
    watch_pieces(spark, folder, out, checkpoint, POLICY).awaitTermination()
    commits = tmp_path / "check" / "commits"
    max(commits.glob("[0-9]*"), key=lambda p: int(p.name)).unlink()  # as if the driver had died between output and commit
    for crc in commits.glob(".*crc"):
        crc.unlink()
    watch_pieces(spark, folder, out, checkpoint, POLICY).awaitTermination()
    found = _equal(spark, out, {"s": f"{LONG}\nx\ny\r\nz\n{LONG}"})
    assert found.where(F.col("rule_id") == "DISTANT_DUPLICATE_PASSAGE_CANDIDATE").count() == 1


def test_query_of_pieces_gives_the_findings_of_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    found = line_findings(physical_lines(text_queries.doc_sources(spark, sf)))
    want = text_queries.named(found.groupBy("source_id", "rule_id").agg(F.count("*").alias("n"), F.min("start_char").alias("first_char"), F.max("end_line").alias("last_line")))
    got = scale_queries.QUERIES["stream_findings_of_pieces"](spark, sf)
    assert want.columns == got.columns and _rows(want, want.columns) == _rows(got, got.columns) != []
