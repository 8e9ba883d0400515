"""From sentences to answers, with conflicts, links and a benchmark."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import anomaly, chunking, entities, gold, qa, retrieval, structure
from quillspan.plans import project
from quillspan.sources import ingest
from quillspan.sources import tables as store
from quillspan.streaming.ingest import watch_anomalies

GOLD = "北门后来改称玄门。张三击败李四。玄门位于皇城北侧。守卫共有100名。工程始于2001-02-03。系统允许删除。来客共有100名。来客共有1000名。护卫共有20名。护卫后来共有30名。"


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("project"))
    sources = spark.createDataFrame([("gold", GOLD)], "source_id string, text string")
    project.publish(spark, sources, path)
    return path


def test_gold_questions(spark, published):
    want = {
        "玄门位于哪里？": "answered",
        "张三击败了谁？": "answered",
        "守卫有多少名？": "answered",
        "工程什么时候开始？": "answered",
        "系统允许删除吗？": "answered",
        "系统禁止删除吗？": "answered",
        "张三为何背叛师门？": "refused_unsupported",
        "李四击败了谁？": "refused_insufficient_evidence",
        "玄门有多少层？": "refused_insufficient_evidence",
        "系统允许进入吗？": "refused_insufficient_evidence",
        "来客有多少名？": "refused_ambiguous",
        "护卫有多少名？": "refused_ambiguous",
        "护卫现在有多少名？": "answered",
    }
    rows = project.ask(spark, published, list(want)).collect()
    assert {r.question: r.decision for r in rows} == want
    said = {r.question: r.answer_text for r in rows}
    assert said["护卫现在有多少名？"] == "护卫共有30名。[E1]"
    assert said["系统禁止删除吗？"].startswith("否。系统允许删除。")
    for r in rows:
        for c in r.citations:
            assert c.evidence_text == GOLD[c.evidence_start : c.evidence_end]


def test_project_is_verified(spark, published):
    assert store.verify_project(spark, published).count() == 0
    facts = store.read_project(spark, published, ["facts"])["facts"]
    status = {(r.subject, r.value): r.canonical_status for r in facts.where("claim_type = 'count'").collect()}
    assert status == {("守卫", "100"): "canonical", ("来客", "100"): "contested", ("来客", "1000"): "contested", ("护卫", "20"): "temporal_variant", ("护卫", "30"): "temporal_variant"}
    claims = store.read_project(spark, published, ["claims"])["claims"]
    assert store.dangling(facts, "result_id", claims, "result_id").count() == 0 and store.repeated_ids(facts, "fact_id").count() == 0


def test_packets_and_benchmark(spark, published):
    asked = retrieval.intent_rows(spark, [("q0", "张三击败了谁？", None), ("q1", "李四击败了谁？", None), ("q2", "玄门的主人是谁？", None)])
    tables = store.read_project(spark, published, ["facts", "entity_names"])
    packets = qa.answers(asked, tables["facts"], tables["entity_names"])
    packets = spark.createDataFrame(packets.collect(), packets.schema)
    assert qa.packet_differences(packets, packets).count() == 0
    forged = packets.withColumn("answer_text", F.when(F.col("question_id") == "q0", "x").otherwise(F.col("answer_text")))
    assert [r.reason_codes for r in qa.packet_differences(forged, packets).collect()] == [["ANSWER_TEXT_MISMATCH"]]
    first = packets.where("question_id = 'q0'").select(F.to_json("answer_claim", {"ignoreNullFields": "false"}).alias("c"), F.col("citations")[0]["fact_id"].alias("f")).first()
    cases = spark.createDataFrame(
        [
            ("c0", "q0", "answered", "defeats", first.c, [first.f], []),
            ("c1", "q1", "refused_insufficient_evidence", "defeats", None, [], ["relation_direction"]),
            ("c2", "q2", "refused_unsupported", "unsupported", None, [], ["unsupported_open_predicate"]),
        ],
        "case_id string, question_id string, expected_decision string, expected_predicate string, expected_claim string, expected_fact_ids array<string>, tags array<string>",
    )
    failures = gold.hard_negative_failures(cases, asked, packets, tables["facts"], tables["entity_names"])
    results = gold.evaluate(cases, packets, failures)
    assert all(r.exact_pass for r in results.collect())
    made = gold.metrics(results).first()
    assert made.exact_case_accuracy == 1.0 and made.hallucination_rate == 0.0
    assert gold.gate_blockers(results, cases, gold.POLICIES["smoke"]).count() > 0


def accepted(spark, rows):
    """Accepted claims from (type, subject, object, value, unit, evidence)."""
    text, out = "", []
    for n, (kind, subject, object_, value, unit, said) in enumerate(rows):
        start = len(text)
        text += said
        out.append((f"r{n}", kind, subject, object_, value, unit, True, "s", "u", start, len(text), said, [(0, len(said))], value, f"p{n}"))
    schema = "result_id string, claim_type string, subject string, object string, value string, unit string, polarity boolean, source_id string, unit_id string, evidence_start long, evidence_end long, evidence string, matched_spans array<struct<start:int,end:int>>, normalized_value string, claim_fingerprint string"
    return spark.createDataFrame(out, schema), text


@pytest.mark.parametrize(
    ("rows", "conflict", "status"),
    [
        ([("count", "军", "", "100", "人", "军共有100人。"), ("count", "军", "", "120", "人", "后来军共有120人。"), ("count", "军", "", "130", "人", "军共有130人。")], "MULTIPLE_COUNT_VALUES", "contested"),
        ([("count", "军", "", "100", "人", "军共有100人。"), ("count", "军", "", "120", "人", "后来军共有120人。"), ("count", "军", "", "130", "人", "随后军共有130人。")], "COUNT_TEMPORAL_TRANSITION", "temporal_variant"),
        ([("date", "事", "", "2001-02-03", "", "事始于2001年2月3日。"), ("date", "事", "", "2002-02-03", "", "事截至2002年2月3日。")], None, "canonical"),
        ([("date", "人", "", "2001-02", "", "人出生于2001-02。"), ("date", "人", "", "2001-02-03", "", "人出生于2001-02-03。")], "DATE_PRECISION_REFINEMENT", "compatible_variant"),
        ([("defeats", "甲", "乙", None, "", "甲击败乙。"), ("defeats", "乙", "甲", None, "", "乙击败甲。")], "RECIPROCAL_DEFEATS_UNRESOLVED", "contested"),
    ],
)
def test_conflicts(spark, rows, conflict, status):
    good, _ = accepted(spark, rows)
    tables = entities.normalize(good)
    assert {r.conflict_type for r in tables["conflicts"].collect()} == ({conflict} if conflict else set())
    assert {r.canonical_status for r in tables["facts"].collect()} == {status}


def test_entities_merge_and_stay_apart(spark):
    rows = [("alias", "玄霄", "青帝", None, "", "玄霄又称青帝。"), ("defeats", "青帝", "韩岳", None, "", "青帝击败韩岳。"), ("located_in", "塔", "韩岳", None, "", "塔位于韩岳。")]
    good, _ = accepted(spark, rows)
    tables = entities.normalize(good)
    names = {r.canonical_name: (sorted(r.aliases), r.entity_type) for r in tables["entities"].collect()}
    assert names["青帝"] == (["玄霄", "青帝"], "actor")
    assert [r.conflict_type for r in tables["blocked_merges"].collect()] == ["ENTITY_TYPE_CONFLICT"]
    assert [r.normalized_surface for r in tables["ambiguity_groups"].collect()] == ["韩岳"]
    assert entities.report(tables).first().may_build_review_index


def test_structure(spark):
    text = "前置说明\n第一卷\n第一章\n正文\n第一节\n正文\n第三章\n正文\n第二卷\n第一章\n正文\n尾声\n完\n第二章\n后\n"
    sources = spark.createDataFrame([("a", text), ("b", ""), ("c", "no headings here\n")], "source_id string, text string")
    _, units, found = structure.inspect_structure(sources)
    rows = units.where("source_id = 'a'").orderBy("start_char").collect()
    assert [r.unit_type for r in rows] == ["front_matter", "volume", "chapter", "section", "chapter", "volume", "chapter", "epilogue", "chapter"]
    byid = {r.unit_id: i for i, r in enumerate(rows)}
    assert [byid.get(r.parent_unit_id) for r in rows] == [None, None, 1, 2, 1, None, 5, 5, 5]
    assert rows[0].start_char == 0 and rows[-1].end_char == len(text) and all(a.end_char == b.start_char for a, b in zip(rows, rows[1:]))
    assert {r.rule_id for r in found.where("source_id = 'a'").collect()} >= {"ORDINAL_GAP_CANDIDATE", "CHAPTER_AFTER_EPILOGUE_CANDIDATE", "EMPTY_UNIT_BODY_CANDIDATE"} - {"EMPTY_UNIT_BODY_CANDIDATE"}
    assert [r.unit_type for r in units.where("source_id = 'c'").collect()] == ["document"]


def test_anomalies(spark):
    clean = spark.createDataFrame([("a", "第一章\n他走进房间，坐下来喝茶。\n")], "source_id string, text string")
    assert anomaly.inspect_anomalies(clean).count() == 0
    odd = spark.createDataFrame([("b", "甲�乙\n作者有话说：\n未完待续，请访问www.example.com\n" + "行\n" * 4 + "字" * 90 + "\n" + "x" * 90 + "\n")], "source_id string, text string")
    rules = {r.rule_id for r in anomaly.inspect_anomalies(odd).collect()}
    assert rules == {"UNICODE_REPLACEMENT_CHARACTER", "AUTHOR_META_OR_PARATEXT_CANDIDATE", "WEB_RESIDUE_CANDIDATE", "REPEATED_LINE_RUN_CANDIDATE", "ABRUPT_SCRIPT_PROFILE_SHIFT_CANDIDATE"}


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("甲\r\n乙\n".encode())
    (tmp_path / "in" / "b.md").write_bytes("甲乙".encode("gb18030"))
    (tmp_path / "in" / "c.bin").write_bytes(b"x\x00")
    files = ingest.read_files(spark, str(tmp_path / "in"))
    seen = {r.path.rsplit("/", 1)[1]: r for r in ingest.admission(files).collect()}
    assert [seen[n].admission_status for n in ("a.txt", "b.md", "c.bin")] == ["review", "accepted_for_encoding_inspection", "unsupported"]
    assert (seen["a.txt"].newline_type, seen["a.txt"].line_count, seen["c.bin"].line_count) == ("mixed", 2, None)
    texts = {r.path.rsplit("/", 1)[1]: (r.encoding, r.text) for r in ingest.decode(files).collect()}
    assert texts["a.txt"] == ("utf-8", "甲\r\n乙\n") and texts["b.md"] == ("gb18030", "甲乙")
    assert ingest.verified(files, F.upper(F.col("source_sha256"))).count() == 3
    spark.createDataFrame([("s", "行\n" * 3)], "source_id string, text string").write.parquet(str(tmp_path / "stream"))
    watch_anomalies(spark, str(tmp_path / "stream"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["REPEATED_LINE_RUN_CANDIDATE"]


def test_builds_are_found_again_and_checked(spark, tmp_path):
    root = f"file://{tmp_path}"
    sources = spark.createDataFrame([("a", "陆川击败韩岳。")], "source_id string, text string")
    path = project.publish_once(spark, sources, root)
    made = (tmp_path / path.rsplit("/", 1)[1] / "manifest").stat().st_mtime_ns
    assert project.publish_once(spark, sources, root) == path
    assert (tmp_path / path.rsplit("/", 1)[1] / "manifest").stat().st_mtime_ns == made
    assert project.build_key(sources, project.PROFILES["strict"]) != path.rsplit("/", 1)[1]
    spark.range(1).write.parquet(f"{path}/stray")
    spark.read.parquet(f"{path}/timeline").limit(0).write.mode("overwrite").parquet(f"{path}/entities")
    assert {(r.table_name, r.problem) for r in store.verify_project(spark, path).collect()} == {("stray", "UNEXPECTED"), ("entities", "CHANGED")}


def test_profiles_and_paths(spark):
    made = project.load_profile('{"profile": "strict", "max_clause_characters": 42}')
    assert made.canonical and made.semantic.max_clause_characters == 42 and not made.semantic.emit_model_tasks
    with pytest.raises(ValueError):
        project.load_profile('{"unknown": 1}')
    paths = spark.createDataFrame([("a/b.txt", True), ("../a", False), ("a//b", False), ("/a", False), ("a/./b", False), ("a\\b", False), ("a..b", True), (None, False)], "p string, want boolean")
    assert paths.where(store.safe_relative(F.col("p")) != F.col("want")).count() == 0


def test_chunk_boundaries(spark):
    units = spark.createDataFrame([("s", "u", 0, "一句话。" * 20 + "\n\n" + "字" * 50)], "source_id string, unit_id string, start_char long, unit_text string")
    made = chunking.chunks(units, chunking.ChunkPolicy(30, 6))
    counts = {(r.side, r.boundary): r.n for r in chunking.boundary_counts(made).collect()}
    assert counts[("start", "unit_start")] == 1 and counts[("end", "unit_end")] == 1 and counts[("end", "hard")] >= 1 and counts[("end", "sentence")] >= 2
    assert chunking.chunk_problems(made, chunking.ChunkPolicy(30, 6)).count() == 0


def test_a_failed_build_leaves_the_old_project(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    good = spark.createDataFrame([("a", "陆川击败韩岳。")], "source_id string, text string")
    project.publish(spark, good, path)
    with pytest.raises(ValueError):
        project.publish(spark, spark.createDataFrame([("a", "天气很好。")], "source_id string, text string"), path)
    assert store.verify_project(spark, path).isEmpty() and not list(tmp_path.glob("p.build*")) and not (tmp_path / "p.lock").exists()
    assert project.regenerated_differences(spark, path).isEmpty()
    assert [r.decision for r in project.probe(spark, path).collect()] == ["answered"]
    (tmp_path / "p").rename(tmp_path / "p.old")  # killed between the two renames
    (tmp_path / "p.lock").touch()
    with pytest.raises(OSError):
        project.publish(spark, good, path)
    assert project.ask(spark, path, ["陆川击败了谁？"]).first().decision == "answered"
    store.break_lock(spark, path)
    with store.replacing(spark, path) as place:
        spark.range(1).write.parquet(f"{place}/t")
    assert (tmp_path / "p" / "t").exists() and not (tmp_path / "p.old").exists()


def test_limits_leave_warnings(spark, tmp_path):
    """Every limit that is reached says so; nothing below a limit is touched."""
    long_ = "他" * 700 + "击败韩岳。"
    text = "".join(f"第{k}章 题{k}\n陆川击败韩岳。似乎陆川来了。\n" for k in range(1, 6)) + "----------\n" + ("字" * 30 + "\n") * 10 + "\ufffd一\ufffd\n" + long_
    policy = project.ProjectPolicy(
        anomaly.AnomalyPolicy(max_findings=1, mosaic=anomaly.MosaicPolicy(max_block_characters=200)),
        project.headings.StructurePolicy(max_units=4),
        project.semantics.SemanticPolicy(max_candidates=3, max_findings=1, max_model_tasks=2),
    )
    made = project.build(spark.createDataFrame([("a", text), ("b", "陆川击败韩岳。")], "source_id string, text string"), policy)
    warned = {(r.source_id, r.warning) for r in made["warnings"].collect()}
    assert {w for s, w in warned if s == "a"} >= {"UNIT_LIMIT_REACHED", "CANDIDATE_LIMIT_REACHED", "MODEL_TASK_LIMIT_REACHED", "MOSAIC_BLOCK_LIMIT_REACHED", "FINDING_LIMIT_REACHED"}
    assert not [w for s, w in warned if s == "b"]
    assert made["claims"].where("source_id = 'a'").count() == 3 and made["claims"].where("source_id = 'b'").count() == 1
    found = project.semantic_findings(made["claims"], made["long_clauses"]).where("rule_id = 'CLAUSE_EXCEEDS_EXTRACTION_LIMIT'").collect()
    assert [(r.source_id, r.signals) for r in found] == [("a", [f"length={len(long_)}"])]


def test_identity_links_stay_within_a_source(spark):
    rows = [("alias", "玄霄", "青帝", None, "", "玄霄又称青帝。")]
    good, text = accepted(spark, rows)
    other = good.withColumns({"source_id": F.lit("t"), "result_id": F.lit("r9")})
    found = entities.mentions(good.unionByName(other))
    links = spark.createDataFrame([("same_as", "r0", "subject", "r9", "object", "s", "u", 0, len(text), text, 1)], "relation string, left_result_id string, left_role string, right_result_id string, right_role string, source_id string, unit_id string, evidence_start long, evidence_end long, evidence_text string, position int")
    sources = spark.createDataFrame([("s", text)], "source_id string, text string")
    units = spark.createDataFrame([("s", "u", 0, len(text))], "source_id string, unit_id string, start_char long, end_char long")
    assert [r.problem for r in entities.valid_links(links, found, sources, units).collect()] == ["CROSS_SOURCE_IDENTITY_MERGE"]


def test_merging_keeps_what_must_stay_apart(spark):
    """Components against the rule itself, edge by edge, over all members."""
    rng = random.Random(5)
    for _ in range(200):
        names = [f"m{k}" for k in range(9)]
        types = {m: rng.choice(["entity", "unknown", "actor", "place"]) for m in names}
        edges = sorted((rng.choice([0, 1, 2, 3]), *rng.sample(names, 2), "") for _ in range(rng.randint(0, 14)))
        groups, apart, blocked = {m: {m} for m in names}, {frozenset(e[1:3]) for e in edges if e[0] == 3}, 0
        for kind, a, b, _ in edges:
            x, y = groups[a], groups[b]
            kinds = {types[m] for m in x | y} - {"entity", "unknown"}
            if kind == 3:
                blocked += x is y
            elif x is not y:
                if len(kinds) > 1 or any(frozenset((p, q)) in apart for p in x for q in y):
                    blocked += 1
                else:
                    x |= y
                    groups.update(dict.fromkeys(x, x))
        homes, refused = entities.settle(types, edges)
        assert {m: homes[m][0] for m in names} == {m: min(groups[m]) for m in names} and len(refused) == blocked


def test_closed_rows_cases_and_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"question_id": "q", "question": "谁？", "source_filter": null}\n\n[1]\n{"question_id": "q"}\n{"question_id": "q", "question": "x", "source_filter": null, "more": 1}\n{"question_id": {"a": 1}, "question": 3, "source_filter": null}\n')
    rows, problems = store.closed_rows(spark, str(tmp_path / "c.jsonl"), "question_id string, question string, source_filter string")
    assert [p.problem for p in problems.collect()][:4] == ["BLANK_LINE", "NOT_AN_OBJECT", "MISSING_FIELD", "UNKNOWN_FIELD"] and rows.where("question = '谁？'").count() == 1
    cases = spark.createDataFrame([("a", "q1", "谁？", None, "answered", "alias", None, [], []), ("b", "q2", "谁？", None, "refused_unsupported", "x", None, [], ["odd"])], store.GOLD)
    assert {(r.case_id, r.problem) for r in gold.case_problems(cases).collect()} == {("a", "ANSWER_WITHOUT_CLAIM_OR_FACTS"), ("b", "UNKNOWN_PREDICATE"), ("b", "UNKNOWN_TAG")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("一")
    (tmp_path / "in" / "b.txt").write_text("二")
    seen = spark.createDataFrame(ingest.read_files(spark, str(tmp_path / "in")).select("path", "size_bytes", "modified").collect())
    assert ingest.changed_files(spark, str(tmp_path / "in"), seen).isEmpty()
    (tmp_path / "in" / "a.txt").write_text("一二")
    (tmp_path / "in" / "b.txt").unlink()
    (tmp_path / "in" / "c.txt").write_text("三")
    assert sorted(r.problem for r in ingest.changed_files(spark, str(tmp_path / "in"), seen).collect()) == ["CHANGED", "GONE", "NEW"]
    sources = spark.createDataFrame([("s", "一二三"), ("t", "四")], "source_id string, text string")
    index = spark.createDataFrame([("s", "u", 0, 3, 1, 2), ("s", "v", 0, 3, None, 2)], store.UNIT_INDEX)
    assert sorted(tuple(r) for r in store.unit_index(index, sources).collect()) == [("s", "u", 1, 2), ("s", "v", 0, 3), ("t", "unit-1", 0, 1)]


def test_model_proposals_have_no_authority(spark):
    tasks = spark.createDataFrame([("t", 10, 20, "0123456789")], "task_id string, evidence_start long, evidence_end long, evidence_text string")
    schema = "task_id string, claim_type string, subject string, object string, value string, unit string, polarity boolean, evidence_start long, evidence_end long, evidence_text string, fields array<string>"
    rows = [("t", "alias", "a", "b", None, "", True, 12, 15, "234", ["subject"]), ("x", "alias", "a", "b", None, "", True, 12, 15, "234", []), ("t", "odd", "a", "b", None, "", True, 8, 15, "z", ["may_index"])]
    got = [r.rejections for r in project.semantics.model_proposals(tasks, spark.createDataFrame(rows, schema)).orderBy(F.size("rejections")).collect()]
    assert got[0] == [] and "UNKNOWN_TASK" in got[1] and set(got[2]) == {"AUTHORITY_FIELD_PRESENT", "UNSUPPORTED_CLAIM_TYPE", "SPAN_OUTSIDE_TASK", "EVIDENCE_TEXT_MISMATCH"}


def test_lexical_search_of_few_and_of_many_terms(spark, monkeypatch):
    units = spark.createDataFrame([("a", "u", 0, "玄霄又称青帝，天下知名。"), ("b", "u", 5, "青帝在此。青帝！"), ("c", "u", 0, "无关"), ("d", "u", 0, "")], "source_id string, unit_id string, start_char long, unit_text string")
    asked = spark.createDataFrame([("q", "青帝", "玄霄又称", "alias", "", None), ("r", "青帝", "", "unsupported", "", "b"), ("z", "x", "", "unsupported", "", None)], "question_id string, subject string, object string, predicate string, question string, source_filter string")
    few = sorted(map(tuple, retrieval.lexical_hits(asked, units, 5).collect()))
    monkeypatch.setattr(retrieval.lexindex, "FEW_TERMS", 0)
    assert sorted(map(tuple, retrieval.lexical_hits(asked, units, 5).collect())) == few
    assert [(r[0], r[1], r[2], r[6] >= 20) for r in few] == [("q", 1, "a", True), ("q", 2, "b", False), ("r", 1, "b", False)]
    with pytest.raises(ValueError):
        retrieval.lexical_hits(asked, units, 101)


def test_command_line(spark, tmp_path, capsys):
    from quillspan.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("陆川击败韩岳。\n玄霄又称青帝。\n")
    base, made = str(tmp_path), f"file://{tmp_path}/p"
    assert main(["build", f"{base}/in", made]) == 0 and main(["verify", made, "--deep"]) == 0
    assert main(["ask", made, "陆川击败了谁？"]) == 0 and "陆川击败了韩岳。[E1]" in capsys.readouterr().out
    assert main(["ask", made, "陆川为何离开？"]) == 3 and main(["search", made, "玄霄又称谁？"]) in (0, 3)
    for name in ("admit", "encoding", "anomalies", "structure", "semantic", "chunks"):
        assert main([name, f"{base}/in", f"{base}/out-{name}"]) == 0 and list((tmp_path / f"out-{name}").rglob("*.json")) or name == "anomalies"
    project.ask(spark, made, ["陆川击败了谁？"]).write.parquet(f"{base}/packets")
    assert main(["verify-answer", made, f"{base}/packets"]) == 0
    spark.read.parquet(f"{base}/packets").withColumn("answer_text", F.lit("x")).write.parquet(f"{base}/forged")
    assert main(["verify-answer", made, f"{base}/forged"]) == 2
    (tmp_path / "g.jsonl").write_text('{"case_id": "c", "question_id": "q", "question": "韩岳击败了谁？", "source_filter": null, "expected_decision": "refused_insufficient_evidence", "expected_predicate": "defeats", "expected_claim": null, "expected_fact_ids": [], "tags": ["relation_direction"]}\n')
    assert main(["gold-run", made, f"{base}/g.jsonl", f"file://{base}/report", "--policy", "smoke"]) == 2
    assert main(["gold-verify", made, f"{base}/g.jsonl", f"file://{base}/report", "--policy", "smoke"]) == 0
    assert main(["export", made, "facts", f"{base}/facts"]) == 0
