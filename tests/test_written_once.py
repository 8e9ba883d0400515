from quillspan.operators import entities, semantics, structure
from quillspan.plans import story_queries


def test_headings_and_units_are_read_by_findings(spark):
    sources = spark.createDataFrame([("a", "第1章 起\n正文\n第3章 承\n正文\n")], "source_id string, text string")
    headings, units, found = structure.inspect_structure(sources)
    assert headings.inputFiles() and units.inputFiles()
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    assert [r.rule_id for r in found.collect()] == ["ORDINAL_GAP_CANDIDATE"]


def test_candidates_are_made_once(spark):
    text = "甲击败乙。甲可能来了。"
    units = spark.createDataFrame([("a", "u", 0, 0, text)], "source_id string, unit_id string, start_char long, body_start long, unit_text string")
    found, _, tasks = semantics.candidates(units)
    assert found.inputFiles()
    assert [r.clause for r in found.collect()] == ["甲击败乙。"] and [r.evidence_text for r in tasks.collect()] == ["甲可能来了。"]


def test_reports_make_no_facts(spark, monkeypatch):
    monkeypatch.setattr(entities, "facts", lambda *_: 1 / 0)
    monkeypatch.setattr(story_queries, "keys", lambda spark, _: spark.createDataFrame([(7, 3)], "k long, n long"))
    assert len(story_queries.semantic_report(spark, "").collect()) == 8
    assert [r.n_aliases for r in story_queries.merged_entities(spark, "").collect()] == [2]
