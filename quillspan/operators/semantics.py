"""Clauses, discourse and claim proposals (P-15 to P-20, F-30 to F-37)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.numerals import ordinal_value
from quillspan.functions.text import bare, sha, spans, stable_id
from quillspan.sources.scratch import cut

# The wording that the rules know.
# A run that finds no terminator is not tried again from within, so the pattern is linear.
CLAUSE = "(?<![^。！？!?；;\\r\\n])[^。！？!?；;\\r\\n]++(?:[。！？!?；;]+|$)"
RUMORED = ("据说", "传闻", "听说", "相传", "坊间传言", "消息称")
RUMOR = f"(?U)^\\s*(?:{'|'.join(RUMORED)})[，,：:\\s]*"
ATTRIBUTED = {"belief": "认为|相信|认定|觉得", "suspicion": "怀疑|猜测|推测", "accusation": "指控|控告|谴责"}
WHO = "[A-Za-z0-9_\\-\\u3400-\\u9fff·]{1,24}"
SUPPOSED = ("如果", "假如", "倘若", "若是", "若")
HYPOTHETICAL = f"(?U)(?:^|[，,：:\\s])(?:{'|'.join(SUPPOSED)})[，,：:\\s]*"
FUTURE = "计划|准备|将要|即将|拟于|预计"
AMBIGUOUS_CUE = "同一人|身份|属于|担任|拥有|失去|成为|来自|前往|效忠|支持|反对|死亡|失踪|可能|似乎|传闻|怀疑|认为"
MARKERS = {
    "alias": ("更名为", "改称", "又称", "亦称", "也称", "别名为", "别名是", "别名", "原名为", "原名是", "原名", "旧称", "被称为"),
    "defeats": ("击败", "战胜", "打败", "击溃"),
    "located_in": ("坐落于", "位于", "地处", "设于"),
    "permission": ("不受限制可以", "获准", "允许", "准许", "有权", "能够", "可以", "不允许", "不可以", "不得", "禁止", "无权", "不能"),
    "count": ("数量为", "数目为", "共有", "共计", "总计", "合计", "一共", "共"),
    "date": ("出生于", "发生于", "开始于", "始于", "截至", "日期为", "时间为"),
}
FORBIDS = {"不允许", "不可以", "不得", "禁止", "无权", "不能"}
RULE_IDS = {
    "alias": "DETERMINISTIC_ALIAS_MARKER",
    "defeats": "DETERMINISTIC_DEFEAT_MARKER",
    "located_in": "DETERMINISTIC_LOCATION_MARKER",
    "permission": "DETERMINISTIC_PERMISSION_MARKER",
    "count": "DETERMINISTIC_COUNT_CUE",
    "date": "DETERMINISTIC_DATE_CUE",
}
NAME = "[A-Za-z0-9_\\-\\u3400-\\u9fff·]{1,48}"
NEGATION = "并未|没有|不曾|从未|并非|不是|未曾|未能|未|不"
LEFT_CUES = "(?U)(?:(?:在昨日|在当日|于昨日|于当日|后来|随后|最终|曾经|此前|当时|已经|曾|计划|准备|将要|即将|预计|并未|没有|不曾|从未|未曾|未能|未|不)\\s*)+$"
RIGHT_STOPS = "随后|然后|后来|并且|而后|之后|从此|当场|同时"
NUMBER = "[-+]?[0-9]+(?:\\.[0-9]+)?|[零〇○一二两兩三四五六七八九十百千万萬亿億]+"
DATE = "[0-9]{4}(?:年|[-/.])[0-9]{1,2}(?:(?:月|[-/.])[0-9]{1,2}日?)?"
UNIT = "(?U)^\\s*([A-Za-z\\u3400-\\u9fff]{0,12})"
EDGE, ENDS = " \t，,:：；;", "。！？!?"
#: How far a number or a date may stand behind its cue, a negation before a marker; and lengths of slots.
NEAR, BEFORE, NAME_SIZE, ACTION_SIZE = 32, 6, 24, 48


@dataclass(frozen=True)
class SemanticPolicy:
    max_candidates: int = 200_000
    max_findings: int = 50_000
    max_model_tasks: int = 50_000
    max_clause_characters: int = 600
    emit_model_tasks: bool = True

    def __post_init__(self) -> None:
        if min(self.max_candidates, self.max_findings, self.max_model_tasks, self.max_clause_characters) <= 0:
            raise ValueError("limits must be positive")


def clauses(units: DataFrame, pattern: str = CLAUSE) -> DataFrame:
    """P-15: clauses of units (source_id, unit_id, start_char, body_start, unit_text): with terminator, not blank:
    source_id, unit_id, evidence_start, evidence_end, clause."""
    local = F.greatest(F.lit(0), F.col("body_start") - F.col("start_char")).cast("int")
    body = units.select("source_id", "unit_id", (F.col("start_char") + local).alias("base"), F.substring("unit_text", local + 1, F.length("unit_text")).alias("body"))
    each = body.select("source_id", "unit_id", "base", F.explode(spans(F.col("body"), pattern)).alias("x"))
    rows = each.select("source_id", "unit_id", (F.col("base") + F.col("x.start")).alias("evidence_start"), (F.col("base") + F.col("x.end")).alias("evidence_end"), F.col("x.hit").alias("clause"))
    return rows.where(F.col("clause").rlike("(?U)\\S"))


def _holds(text: Column, words: Iterable[str]) -> Column:
    """Whether a text has one of the words: a look at bytes, far cheaper than a pattern, so it is taken before one."""
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def discourse(clause: Column) -> dict[str, Column]:
    """P-16: status of a clause, whom it is attributed to, and where the proposition begins in it."""
    # one chain of tests for the three: it is the same expression in each column, so it runs once
    told = lambda status, who, offset: F.struct(F.lit(status).alias("status"), who.alias("who"), offset.alias("offset"))
    nobody, whole = F.lit(""), F.lit(0)
    said = F.when(_holds(clause, RUMORED) & clause.rlike(RUMOR), told("rumor", nobody, F.length(F.regexp_extract(clause, f"({RUMOR})", 1))))
    for name, verbs in ATTRIBUTED.items():
        lead = f"(?U)^\\s*({WHO})(?:{verbs})[，,：:\\s]*"
        said = said.when(_holds(clause, verbs.split("|")) & clause.rlike(lead), told(name, F.regexp_extract(clause, lead, 1), F.length(F.regexp_extract(clause, f"({lead})", 1))))
    after = F.length(clause) - F.length(F.regexp_extract(clause, f"(?s)^.*?{HYPOTHETICAL}(.*)$", 1))
    said = said.when(_holds(clause, "？?"), told("question", nobody, whole)).when(_holds(clause, SUPPOSED) & clause.rlike(HYPOTHETICAL), told("hypothetical", nobody, after))
    said = said.when(_holds(clause, FUTURE.split("|")), told("future_intent", nobody, whole)).otherwise(told("assertion", nobody, whole))
    return {"discourse_status": said["status"], "attributor": said["who"], "proposition_offset": said["offset"]}


def factual_status(status: Column, polarity: Column) -> Column:
    """P-20."""
    return F.when(status == "assertion", F.when(polarity, "asserted_fact").otherwise("negated_fact")).otherwise(status)


def _trimmed(text: Column, edge: str) -> Column:
    return F.regexp_replace(text, f"^[{edge}]+|[{edge}]+$", "")


def _slots(kind: Column, hit: Column, before: Column, rest: Column) -> dict[str, Column]:
    """F-31 to F-37: the slots around a marker, null or empty where they are missing. Each is one expression:

    * subject: the last name before the marker, once the cues between the two are gone;
    * object of a relation: the name right behind it; of a permission: all that follows; both up to a sequence word;
    * token: the first number or date near behind it, and of a number the unit that follows.
    """
    name = F.try_element_at(F.regexp_extract_all(F.regexp_replace(_trimmed(before, EDGE), LEFT_CUES, ""), F.lit(NAME), 0), F.lit(-1))
    subject = F.coalesce(F.right(name, F.lit(NAME_SIZE)), F.lit(""))
    # a sequence word that the slot begins with belongs to it, wherever it stands
    upto = lambda c: F.regexp_extract(c, f"(?s)^(?=({RIGHT_STOPS})?)(.(?:(?:(?=\\1)|(?!{RIGHT_STOPS})).)*)", 2)
    other = F.substring(upto(F.regexp_extract(rest, f"^[{EDGE}]*({NAME})", 1)), 1, NAME_SIZE)
    action = bare(F.substring(upto(_trimmed(rest, EDGE + ENDS)), 1, ACTION_SIZE))
    near = F.substring(rest, 1, NEAR)
    number = F.regexp_extract(near, f"({NUMBER})", 1)
    ahead = F.regexp_extract(near, f"(?s)^(.*?)(?:{NUMBER})", 1)
    behind = F.substring(rest, F.length(ahead) + F.length(number) + 1, F.length(rest))
    relation, permission = kind.isin("alias", "defeats", "located_in"), kind == "permission"
    return {
        "subject": subject,
        "object": F.when(relation, other).when(permission, action).otherwise(""),
        "token": F.when(kind == "count", number).when(kind == "date", F.regexp_extract(near, f"({DATE})", 1)).otherwise(""),
        "unit": F.when(kind == "count", F.regexp_extract(behind, UNIT, 1)).otherwise(""),
        "polarity": F.when(permission, ~hit.isin(*sorted(FORBIDS))).otherwise(~F.right(before, F.lit(BEFORE)).rlike(NEGATION)),
    }


def _value(kind: Column, token: Column) -> Column:
    """The value that a token says: numbers plain, dates as they are."""
    plain = F.when(token.rlike("[0-9]"), F.ltrim(token, F.lit("+"))).when(token != "", ordinal_value(token).cast("string"))
    return F.when(kind == "count", plain).when(kind == "date", F.nullif(token, F.lit("")))


def marker_places(rows: DataFrame, markers: dict[str, tuple[str, ...]] = MARKERS) -> DataFrame:
    """Every marker in ``said``, one row each: claim_type, hit and start added. Kinds are looked for one by one, and of a kind
    a marker takes its place before shorter ones do. Expressions that whole-stage code can hold, so no span lists."""
    looked = []
    for kind, words in markers.items():
        longest = "|".join(sorted(words, key=len, reverse=True))
        # each match goes on where the one before has ended, and the tail is tried once
        parts = lambda i, longest=longest: F.regexp_extract_all("said", F.lit(f"(?s)\\G.*?({longest})"), i)
        looked.append(F.when(_holds(F.col("said"), words), F.struct(F.lit(kind).alias("kind"), parts(1).alias("hits"), parts(0).alias("parts"))))
    each = rows.select("*", F.explode(F.array(*looked)).alias("p")).select("*", F.posexplode("p.hits").alias("nth", "hit"))
    start = F.length(F.array_join(F.slice("p.parts", F.lit(1), F.col("nth") + 1), "")) - F.length("hit")
    return each.withColumns({"claim_type": F.col("p.kind"), "start": start}).drop("p", "nth")


def proposals(rows: DataFrame) -> DataFrame:
    """P-17, F-30: clause rows with discourse, one row a proposal; clauses without proposal are left out. Built-in
    expressions alone."""
    names = list(rows.columns)
    each = marker_places(rows.withColumn("said", F.expr("substring(clause, proposition_offset + 1)")))
    each = each.withColumns({"before": F.expr("substring(said, 1, start)"), "rest": F.expr("substring(said, start + length(hit) + 1)")})
    slots = _slots(F.col("claim_type"), F.col("hit"), F.col("before"), F.col("rest"))
    # a list of one: the tests below would otherwise be moved before the slots, and make them a second time
    each = each.select(*names, "claim_type", "hit", "start", F.inline(F.array(F.struct(*(c.alias(n) for n, c in slots.items())))))
    needs = F.when(F.col("claim_type") == "permission", F.col("object") != "").when(F.col("claim_type").isin("count", "date"), (F.col("subject") != "") & (F.col("token") != ""))
    rule = F.create_map(*(F.lit(x) for kv in RULE_IDS.items() for x in kv))[F.col("claim_type")]
    base = F.col("evidence_start") + F.col("proposition_offset")
    each = each.where(needs.otherwise((F.col("subject") != "") & (F.col("object") != "")))
    each = each.withColumns({"value": _value(F.col("claim_type"), F.col("token")), "rule_id": rule, "trigger_start": base + F.col("start"), "trigger_end": base + F.col("start") + F.length("hit")})
    return each.select(*names, "claim_type", "subject", "object", "value", "unit", "polarity", "rule_id", "trigger_start", "trigger_end")


def candidates(units: DataFrame, policy: SemanticPolicy = SemanticPolicy()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P-15 to P-20: candidate claims, clauses too long to read (P-18), and tasks for a model (P-19): clauses with an
    ambiguous cue and no proposal."""
    rows = clauses(units)
    long_ = rows.where(F.length("clause") > policy.max_clause_characters)
    rows = rows.where(F.length("clause") <= policy.max_clause_characters).withColumns(discourse(F.col("clause")))
    found = proposals(rows).withColumn("factual_status", factual_status(F.col("discourse_status"), F.col("polarity")))
    ids = ("source_id", "unit_id", "claim_type", "evidence_start", "evidence_end", "subject", "object", "value", "unit", "polarity", "trigger_start")
    # written once: tasks are what has no proposal, and would have all of them made a second time
    found = cut(found.withColumns({"candidate_id": stable_id("sem_", *(F.col(c) for c in ids), length=32), "evidence_sha256": sha(F.col("clause"))}), "candidates")
    key = ["source_id", "unit_id", "evidence_start"]
    cue = rows.where(F.col("clause").rlike(AMBIGUOUS_CUE)) if policy.emit_model_tasks else rows.limit(0)
    tasks = cue.join(found.select(*key).distinct(), key, "left_anti")
    tasks = tasks.select(*key, "evidence_end", F.col("clause").alias("evidence_text"), stable_id("smt_", *(F.col(c) for c in (*key, "evidence_end", "clause")), length=32).alias("task_id"))
    return found, long_, tasks


def overlapping(rows: DataFrame, areas: DataFrame, width: int = 4096) -> DataFrame:
    """J-03: ``rows`` (source_id, evidence_start, evidence_end, ...) with ``upstream``: the sorted names of the areas
    (source_id, start_char, end_char, name) that they overlap. Both are cut into stretches of the text, so the join is
    by equality; pairs that meet in several stretches count once."""
    stretch = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))
    key = ["source_id", "evidence_start", "evidence_end"]
    spans_ = rows.select(*key).distinct().withColumn("at", F.explode(stretch("evidence_start", "evidence_end")))
    others = areas.where("end_char > start_char").withColumn("at", F.explode(stretch("start_char", "end_char")))
    met = spans_.join(others, ["source_id", "at"]).where("evidence_start < end_char and start_char < evidence_end")
    met = met.groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("upstream"))
    return rows.join(met, key, "left").withColumn("upstream", F.coalesce("upstream", F.array().cast("array<string>")))


def model_proposals(tasks: DataFrame, payloads: DataFrame) -> DataFrame:
    """P-33: proposals (task_id, claim_type, subject, object, value, unit, polarity, evidence_start, evidence_end,
    evidence_text, fields) with ``rejections``: why a proposal is no candidate. Authority stays with the validators, so a
    payload that names a field of theirs is refused."""
    known = payloads.join(tasks.select("task_id", F.col("evidence_start").alias("task_start"), F.col("evidence_end").alias("task_end"), F.col("evidence_text").alias("task_text")), "task_id", "left")
    local = F.substring("task_text", (F.col("evidence_start") - F.col("task_start") + 1).cast("int"), (F.col("evidence_end") - F.col("evidence_start")).cast("int"))
    barred = F.array(*(F.lit(x) for x in ("status", "may_index", "may_freeze", "accepted", "canonical_status", "validation_status")))
    tests = {
        "UNKNOWN_TASK": F.col("task_start").isNull(),
        "AUTHORITY_FIELD_PRESENT": F.arrays_overlap("fields", barred),
        "UNSUPPORTED_CLAIM_TYPE": ~F.col("claim_type").isin(*MARKERS),
        "SPAN_OUTSIDE_TASK": ~((F.col("task_start") <= F.col("evidence_start")) & (F.col("evidence_start") < F.col("evidence_end")) & (F.col("evidence_end") <= F.col("task_end"))),
        "EVIDENCE_TEXT_MISMATCH": ~F.col("evidence_text").eqNullSafe(local),
    }
    return known.withColumn("rejections", F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))).drop("task_start", "task_end", "task_text")
