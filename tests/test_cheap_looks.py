"""Cheap looks before patterns: what they let through is what the patterns find."""

from pyspark.sql import functions as F

from quillspan.functions.text import cjk_ratio
from quillspan.operators import anomaly, structure
from quillspan.operators.lines import physical_lines
from quillspan.plans import text_queries

TEXTS = [
    "plain", "HTTPS://X.y and WWW.z", "a.COM b.cnx c.Org-d <B>x</b> < b>", "未完待续 <p", "tab\there\x0c", "bell\x07 nul\x00", "﻿bom �", "\U0001fffe ﷐ \x85 é", "",
    "-" * 10, " " + "-" * 12 + " ", "-" * 9, "x " + "-" * 12,
]


def test_looks_lose_nothing(spark):
    """F18."""
    lines = physical_lines(spark.createDataFrame([(str(k), t) for k, t in enumerate(TEXTS)], "source_id string, text string"))
    got = {(r.source_id, r.signal, r.hit) for r in anomaly.web_matches(lines).collect()}
    every = {k: f"(?=x|[^x]|$){p}" for k, p in anomaly.WEB.items()}  # the same matches by patterns that are not known, so nothing is left out before
    assert got == {(r.source_id, r.signal, r.hit) for r in anomaly.web_matches(lines, every).collect()} and len(got) == 7
    whole = "|".join(p for _, p in anomaly.CHARACTERS)
    at = lambda test: {r.source_id for r in lines.where(test).collect()}
    content = F.col("content")
    assert at(content.rlike(anomaly.SPECIAL)) == at(content.rlike(whole)) == {"5", "6", "7"}
    assert at(anomaly._separates(content)) == at(content.rlike(anomaly.SEPARATOR)) == {"9", "10"}


def test_windows_of_other_scripts_are_asked_nothing_else(spark):
    """entities, registers and sentences of a window without ideographs are not looked for."""
    windows = spark.createDataFrame([("s", k, 800 * k, 800 * k + 800, "latin letters " * 50) for k in range(2)], "source_id string, window_no int, start_char int, end_char int, window string")
    plan = anomaly.shift_signals(windows, anomaly.AnomalyPolicy())._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.split("\n") if "array_distinct(regexp_extract_all" in line]
    assert made and all(">= 0.6) THEN array_distinct(" in line for line in made)
    shares = spark.createDataFrame([("",), (" \n",), ("abc é",), ("漢 字a",), (None,)], "t string").select(cjk_ratio(F.col("t")).alias("x"))
    assert [r.x for r in shares.collect()] == [0.0, 0.0, 0.0, 2 / 3, 0.0]


def test_headings_are_read_by_units(spark):
    """texts, lines and headings are made once."""
    plan = text_queries.unit_partition(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "regexp_extract_all" not in plan and "collect_list" not in plan
    lines = physical_lines(spark.createDataFrame([("a", "第1章\n　 \n起\n")], "source_id string, text string"))
    assert [(r.rule_id, r.detached) for r in structure.heading_candidates(lines).collect()] == [("NUMBERED_PREFIX_HEADING", "起")]
