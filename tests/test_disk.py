"""What queries over stories leave on disk while they run."""

import pytest

from quillspan.operators import entities, limits
from quillspan.plans import story_queries
from quillspan.sources import scratch

CLAIM = (
    "source_id string, unit_id string, result_id string, claim_type string, subject string, object string, evidence_start long, evidence string, "
    "matched_spans array<struct<start:int,end:int>>"
)


def left_by(spark, query):
    """The rows of a query over one customer, and the tables that it has left."""
    before = len(scratch._written)
    rows = query(spark, "").collect()
    return rows, [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in scratch._written[before:]]


@pytest.fixture()
def one_customer(spark, monkeypatch):
    monkeypatch.setattr(story_queries, "keys", lambda spark, _: spark.createDataFrame([(7, 3)], "k long, n long"))


def test_answers_leave_only_themselves(spark, one_customer):
    """F1."""
    rows, left = left_by(spark, story_queries.answers_of_all_kinds)
    told = {r.no: (r.decision, r.answer_text) for r in rows}
    assert told == {no: (decision, text and text.format(k=7, n=3)) for no, (_, decision, text) in enumerate(story_queries._ANSWERS)}
    assert left == ["answers"]


def test_no_shuffle_stays_behind_a_table(spark):
    """the map outputs of what was written are gone when it is."""
    seen = []
    conf = spark.conf.get(scratch.SHUFFLES_GO, None)
    kept = scratch.cut(spark.range(100).repartition(3), "numbers")
    assert kept.count() == 100 and spark.conf.get(scratch.SHUFFLES_GO, None) == conf
    with scratch.passing(spark) as keep:
        seen += [keep(scratch.cut(kept, "stays")), scratch.cut(kept, "goes")]
    assert seen[0].count() == 100 and not any("/goes-" in path for _, path in scratch._written)


def test_rows_within_a_limit_are_not_moved(spark):
    """F1."""
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source_id string, x int")
    assert "Exchange" not in limits.within(rows, 2, ("x",), "s", "C")[0]._jdf.queryExecution().executedPlan().toString()
    kept, warned = limits.within(rows, 1, ("x",), "s", "C")
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 1)] and [(r.source_id, r.left_out) for r in warned.collect()] == [("a", 1)]


def test_surfaces_are_sought_once(spark):
    """a mention's place is found by one call, and is that nearest to the first matched span."""
    rows = [("s", "u", "r", "alias", "甲", "乙", 10, "甲 甲又称乙", [(2, 6)]), ("s", "u", "q", "count", "丙", "", 0, "丁共有3名", [])]
    found = entities.mentions(spark.createDataFrame(rows, CLAIM))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [surface_span") == 1
    assert sorted((r.role, r.surface, r.start_char, r.end_char) for r in found.collect()) == [("object", "乙", 15, 16), ("subject", "甲", 12, 13)]
