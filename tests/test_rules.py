"""Rules on hand-made sentences: numerals, headings, discourse, proposals, validators, chunks, questions, encodings."""

import random
import re
from decimal import Decimal

import pytest

from quillspan.functions.numerals import claim_integer, numbers_in, ordinal, plain_decimal, to_date, to_decimal
from quillspan.operators import claims
from quillspan.operators.chunking import ChunkPolicy, chunk_spans
from quillspan.operators.claims import Claim, validate
from quillspan.operators.coherence import MosaicPolicy, mosaic, splices
from quillspan.operators.entities import link_problem
from quillspan.operators.headings import StructurePolicy, detect_heading
from quillspan.operators.retrieval import parse_question
from quillspan.operators.semantics import proposals
from quillspan.sources.ingest import choose_encoding


@pytest.mark.parametrize(("text", "value"), [("1", 1), ("００２", 2), ("十", 10), ("十二", 12), ("二十", 20), ("一百零二", 102), ("两百三十一", 231), ("一万零三", 10003), ("甲", None), ("一二", 2), ("", None)])
def test_ordinals(text, value):
    assert ordinal(text) == value


def test_numbers_and_dates():
    assert claim_integer("一二") == 12 and claim_integer("三千五百") == 3500 and claim_integer("x") is None
    assert numbers_in("共有十二柄和 3.5 个") == [(Decimal(12), 2, 4), (Decimal("3.5"), 7, 10)]
    assert to_decimal("一百") == 100 and to_decimal("1e2") == 100 and to_decimal("abc") is None
    assert plain_decimal("1E+2") == "100" and plain_decimal("+2.50") == "2.5"
    assert [to_date(x) for x in ("2026年7月22日", "2026/7", "2026-02-30", "x")] == ["2026-07-22", "2026-07", None, None]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("第一章 风起", ("NUMBERED_PREFIX_HEADING", "chapter", 1, "风起", "high")),
        ("章三 云", ("NUMBERED_SUFFIX_HEADING", "chapter", 3, "云", "medium")),
        ("卷五 第二十六章 起", ("COMBINED_VOLUME_CHAPTER_HEADING", "chapter", 26, "起", "high")),
        ("卷1 13章", ("COMBINED_VOLUME_CHAPTER_HEADING", "chapter", 13, "", "high")),
        ("卷三 番外 雪", ("COMBINED_VOLUME_SPECIAL_HEADING", "extra_story", None, "雪", "high")),
        ("Chapter 7: Night", ("ENGLISH_NUMBERED_HEADING", "chapter", 7, "Night", "high")),
        ("Prologue", ("ENGLISH_SPECIAL_HEADING", "prologue", None, "", "high")),
        ("楔子", ("SPECIAL_HEADING", "prologue", None, "", "high")),
        ("## Notes", ("MARKDOWN_GENERIC_HEADING", "section", None, "Notes", "medium")),
        ("第十章风起", ("NUMBERED_PREFIX_HEADING", "chapter", 10, "风起", "medium")),
    ],
)
def test_headings(line, want):
    h = detect_heading(line)
    assert (h.rule_id, h.unit_type, h.ordinal, h.title, h.confidence) == want


def test_what_is_no_heading():
    assert detect_heading("普通正文。") is None
    assert not detect_heading("第一章" + "长" * 200).accepted
    assert detect_heading("## Notes", StructurePolicy(accept_markdown_headings=False)) is None


def test_proposals(spark):
    want = {
        "玄霄又称青帝。": [("alias", "玄霄", "青帝", None, "", True)],
        "陆川并未击败韩岳。": [("defeats", "陆川", "韩岳", None, "", False)],
        "守门人不允许陆川进入内殿。": [("permission", "守门人", "陆川进入内殿", None, "", False)],
        "剑阵共有十二柄飞剑。": [("count", "剑阵", "", "12", "柄飞剑", True)],
        "守军总计一百零二人。": [("count", "守军", "", "102", "人", True)],
        "大战发生于2026年7月22日。": [("date", "大战", "", "2026年7月22日", "", True)],
        "陆川击败韩岳随后离开。": [("defeats", "陆川", "韩岳", None, "", True)],
        "塔坐落于北境，林晚可以进入塔后来离开。": [("located_in", "塔", "北境", None, "", True), ("permission", "林晚", "进入塔", None, "", True)],
        "天气很好。": [],
    }
    rows = spark.createDataFrame([(t, 0, 0) for t in want], "clause string, evidence_start int, proposition_offset int")
    got = {t: [] for t in want}
    for p in proposals(rows).orderBy("trigger_start").collect():
        got[p.clause].append((p.claim_type, p.subject, p.object, p.value, p.unit, p.polarity))
    assert got == want


def test_relations_are_what_the_lazy_pattern_finds():
    """Places of names and markers against one regular expression for all."""
    rng, names, seen = random.Random(1), ["甲", "乙", "甲乙", "以X", "x y", "Tower", "k", "为丙", "可", "é"], 0
    for _ in range(6000):
        markers = rng.choice([claims.ALIAS, claims.DEFEATS, claims.LOCATED, claims.PERMITS, claims.FORBIDS])
        gap = claims.PERMISSION_GAP if markers in (claims.PERMITS, claims.FORBIDS) else claims.GAP
        left, right = rng.choice([*names, ""] if gap is claims.PERMISSION_GAP else names), rng.choice(names)
        parts = [left, right, rng.choice(markers), rng.choice(markers), rng.choice("字，。 ,a\n"), "字" * rng.randint(1, 14), " "]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        text = text.upper() if rng.random() < 0.3 else text
        before = f"{claims.literal(left)}{gap.pattern()}" if left else ""
        shape = f"{before}{claims.any_of(markers)}{gap.pattern()}{claims.literal(right)}"
        assert claims.relations(text, left, markers, right, gap) == [m.span() for m in re.finditer(shape, text, re.I)]
        assert claims.literal_spans(text, right) == [m.span() for m in re.finditer(claims.literal(right), text, re.I)]
        seen += bool(claims.relations(text, left, markers, right, gap))
    assert seen > 200


@pytest.mark.parametrize(
    ("claim", "evidence", "status", "reason"),
    [
        (Claim("alias", "玄霄", "青帝"), "玄霄又称青帝。", "accepted", "EXACT_TYPED_ALIAS_MATCH"),
        (Claim("alias", "青帝", "玄霄"), "玄霄又称青帝。", "accepted", "EXACT_TYPED_ALIAS_MATCH"),
        (Claim("alias", "玄霄", "青帝"), "玄霄并未改称青帝。", "rejected", "NEGATED_ALIAS_RELATION"),
        (Claim("alias", "玄霄", ""), "玄霄又称青帝。", "rejected", "ALIAS_TERMS_REQUIRED"),
        (Claim("defeats", "陆川", "韩岳"), "陆川击败韩岳。", "accepted", "EXACT_TYPED_DEFEAT_MATCH"),
        (Claim("defeats", "韩岳", "陆川"), "陆川击败韩岳。", "rejected", "RELATION_DIRECTION_MISMATCH"),
        (Claim("defeats", "陆川", "韩岳"), "据说陆川击败韩岳。", "review", "MODAL_REPORTED_OR_QUESTION_ASSERTION"),
        (Claim("defeats", "陆川", "韩岳"), "陆川击败韩岳。韩岳击败陆川。", "review", "CONFLICTING_RELATION_ASSERTIONS"),
        (Claim("located_in", "Tower", "North"), "Tower is located in North.", "accepted", "EXACT_TYPED_LOCATION_MATCH"),
        (Claim("located_in", "楼", "南境"), "楼位于北境。", "rejected", "RELATION_NOT_FOUND"),
        (Claim("permission", "守门人", "进入", polarity=True), "守门人允许进入。", "accepted", "EXACT_TYPED_PERMISSION_MATCH"),
        (Claim("permission", "守门人", "进入", polarity=True), "守门人不允许进入。", "rejected", "PERMISSION_POLARITY_MISMATCH"),
        (Claim("permission", "", "进入", polarity=False), "不可以进入。", "accepted", "EXACT_TYPED_PERMISSION_MATCH"),
        (Claim("count", "守卫", value=100), "守卫共有100名。", "accepted", "EXACT_TYPED_COUNT_MATCH"),
        (Claim("count", "守卫", value=10), "守卫共有100名。", "rejected", "NUMERIC_VALUE_MISMATCH"),
        (Claim("count", "守卫", value=100), "守卫共有100名，守卫共有90名。", "review", "MULTIPLE_COUNT_VALUES"),
        (Claim("count", "第3守卫", value=3), "第3守卫共有5名。", "rejected", "NUMERIC_VALUE_MISMATCH"),
        (Claim("count", "守卫", value=1), "天气很好。", "rejected", "COUNT_ASSERTION_NOT_FOUND"),
        (Claim("date", "工程", value="2001-02-03"), "工程始于2001年2月3日。", "accepted", "EXACT_TYPED_DATE_MATCH"),
        (Claim("date", "工程", value="2001-02"), "工程始于2001年2月3日。", "rejected", "DATE_VALUE_MISMATCH"),
        (Claim("date", "工程", value="2001-02-30"), "工程始于2001年2月3日。", "rejected", "DATE_SUBJECT_AND_VALUE_REQUIRED"),
        (Claim("other", "a", "b"), "a b", "review", "UNSUPPORTED_CLAIM_TYPE"),
    ],
)
def test_validators(claim, evidence, status, reason):
    verdict = validate(claim, evidence)
    assert (verdict.status, verdict.reason) == (status, reason)


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("玄霄叫什么？", ("alias", "object", "玄霄", "", "any")),
        ("谁击败了韩岳？", ("defeats", "subject", "", "韩岳", "any")),
        ("陆川击败了谁？", ("defeats", "object", "陆川", "", "any")),
        ("陆川击败了韩岳吗？", ("defeats", "boolean", "陆川", "韩岳", "any")),
        ("听雪楼位于哪里？", ("located_in", "object", "听雪楼", "", "any")),
        ("护卫现在有多少名？", ("count", "value", "护卫", "", "current")),
        ("大战发生于何时？", ("date", "value", "大战", "", "any")),
        ("守门人禁止进入吗？", ("permission", "boolean", "守门人", "进入", "any")),
        ("这部作品的主题是什么？", ("unsupported", "", "", "", "any")),
    ],
)
def test_questions(question, want):
    i = parse_question(question)
    assert (i.predicate, i.requested_role, i.subject, i.object, i.temporal_scope) == want
    assert i.supported == (want[0] != "unsupported")


def test_chunks_cover_and_rebuild():
    rng = random.Random(4)
    for _ in range(250):
        text = "".join(rng.choice("abc 。，.\n\n”…3") for _ in range(rng.randint(1, 2500)))
        size = rng.randint(1, 220)
        policy = ChunkPolicy(size, rng.randint(0, size - 1))
        last, rebuilt = 0, ""
        for start, end, _, _ in chunk_spans(text, policy):
            assert 0 < end - start <= size and 0 <= last - start <= policy.overlap_chars and end > last or not last
            rebuilt, last = rebuilt + text[max(last, start) : end], end
        assert rebuilt == text


def test_encodings():
    assert choose_encoding("﻿甲".encode())["encoding"] == "utf-8" and choose_encoding("﻿甲".encode())["text"] == "甲"
    assert choose_encoding("﻿甲乙".encode("utf-16-le"))["encoding"] == "utf-16-le"
    assert choose_encoding("ab\ncd\n".encode("utf-16-be"))["encoding"] == "utf-16-be"
    assert choose_encoding("甲乙丙".encode("gb18030"))["encoding"] == "gb18030"
    assert choose_encoding("﻿a".encode("utf-32-le"))["blockers"] == ["UNSUPPORTED_BOM"]
    assert choose_encoding(b"abcd")["encoding"] == "utf-8"


def test_identity_links():
    assert link_problem("same_as", "玄霄", "青帝", "玄霄就是青帝。") is None
    assert link_problem("same_as", "玄霄", "青帝", "玄霄与青帝是同一人。") is None
    assert link_problem("different_from", "玄霄", "青帝", "玄霄与青帝不是同一人。") is None
    assert link_problem("same_as", "玄霄", "青帝", "据说玄霄就是青帝。") == "MODAL_LINK"
    assert link_problem("same_as", "玄霄", "青帝", "玄霄击败青帝。") == "RELATION_NOT_STATED"


def test_coherence():
    steady = "\n\n".join(["标题", *["今天天气很好我们一起出门散步然后回家吃饭" * 2] * 16])
    assert mosaic(steady, MosaicPolicy()) is None
    rng = random.Random(7)
    mixed = ["标题"] + ["".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(60)) for _ in range(20)]
    assert mosaic("\n\n".join(mixed), MosaicPolicy()) is not None
    chapters = "\n\n".join(["第一卷第一章", *mixed[1:], "第一卷第二章", *mixed[1:4]])
    found = splices(chapters)
    assert len(found) == 1 and found[0][2][2] == "paragraph_count=20"
    assert splices("没有标题") is None
