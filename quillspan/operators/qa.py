"""Strict answers: a typed claim with citations, or a refusal (R-05 to R-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import sha, stable_id
from quillspan.sources.scratch import cut, passing

from .retrieval import DECIDING, answerability, entity_names, indexed_facts

# What packets say.
DATE_LABELS = {"birth_date": "出生日期", "death_date": "去世日期", "start_date": "开始日期", "end_date": "结束日期", "event_date": "发生日期"}
REFUSALS = {
    "unsupported": ("refused_unsupported", "当前知识库不支持对此类问题作出可靠回答。", "REFUSAL_UNSUPPORTED_PREDICATE"),
    "ambiguous": ("refused_ambiguous", "现有证据存在歧义、冲突或未限定的时间版本，无法给出唯一答案。", "REFUSAL_AMBIGUOUS_EVIDENCE"),
    "not_answerable": ("refused_insufficient_evidence", "现有证据没有记录该问题所需的类型化事实。", "REFUSAL_INSUFFICIENT_TYPED_EVIDENCE"),
}
CLAIM = ("predicate", "requested_role", "subject", "object", "value", "unit", "predicate_scope", "fact_polarity", "boolean_answer", "temporal_scope")
#: Of a fact, what a citation shows, and what an answer is made of.
CITED = ("fact_id", "source_id", "unit_id", "evidence_start", "evidence_end", "evidence_text", "claim_type", "predicate_scope", "canonical_status", "polarity")
TOLD = (*CITED, "subject", "object", "value", "unit", "normalized_subject", "normalized_object")


def answer_claim(hit: str = "hit", ask: str = "ask") -> Column:
    """R-06, F-40: the typed answer that a hit gives to an intent, both structs."""
    h, a = (lambda c: F.col(f"{hit}.{c}")), (lambda c: F.col(f"{ask}.{c}"))
    kind, role = a("predicate"), a("requested_role")
    same = a("subject_form") == h("normalized_subject")
    subject = F.when((kind == "defeats") & (role == "subject"), h("subject")).otherwise(a("subject"))
    other = F.when(same, h("object")).when(a("subject_form") == h("normalized_object"), h("subject")).otherwise(h("object"))
    object_ = F.when((kind == "alias") & (role == "object"), other).when(kind.isin("defeats", "located_in") & (role == "object"), h("object")).otherwise(a("object"))
    truth = F.when(kind == "permission", h("polarity") == a("polarity")).when(role == "boolean", h("polarity"))
    unit = F.when(h("unit") == "", a("unit")).otherwise(h("unit"))
    value = F.when(kind.isin("count", "date"), h("value"))
    made = (kind, role, subject, object_, value, unit, h("predicate_scope"), h("polarity"), truth, a("temporal_scope"))
    return F.struct(*(c.alias(n) for c, n in zip(made, CLAIM, strict=True)))


def render(claim: Column, marks: Column) -> Column:
    """F-42: the answer in words."""
    c = lambda n: claim[n]
    said = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs), F.lit("。"), marks)
    kind, role = c("predicate"), c("requested_role")
    verb = F.when(kind == "alias", "又称").when(kind == "defeats", "击败了").otherwise("位于")
    lead = F.when(c("boolean_answer"), "是。").otherwise("否。")
    may = F.when(c("fact_polarity"), "允许").otherwise("禁止")
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in DATE_LABELS.items() for x in kv))[c("predicate_scope")], F.lit("日期"))
    truth = F.when(kind == "permission", said(lead, c("subject"), may, c("object"))).when(c("boolean_answer"), said(lead, c("subject"), verb, c("object"))).otherwise(said(lead, "证据中的类型化事实明确否定了该关系"))
    return (
        F.when(role == "boolean", truth)
        .when(kind == "count", said(c("subject"), "共有", c("value"), c("unit")))
        .when(kind == "date", said(c("subject"), "的", label, "是", c("value")))
        .otherwise(said(c("subject"), verb, c("object")))
    )


def answers(asked: DataFrame, facts: DataFrame, entities: DataFrame, max_citations: int = 20, keep: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """R-08: one packet a question: decision, reason_codes, answer_text, answer_claim, citations, packet_id.

    Questions and what each step finds are kept once (``keep``: written, or for a few questions held), so that plans stay
    small and nothing runs twice; facts should be a written table too.

    Where a permission question finds nothing, facts of the opposite polarity may answer it with no (R-05, F-41); that
    nothing is recorded never does. Hits that say different things refuse; citations are the first by place, numbered."""
    if not 1 <= max_citations <= 20:
        raise ValueError("an answer has 1 to 20 citations")
    facts = indexed_facts(facts)
    # what decides goes from step to step; the facts themselves come to the hits that are told
    deciding = facts.select(*DECIDING)
    with passing(facts.sparkSession) as until:
        asked, entities = keep(asked, "questions"), entity_names(entities)
        first, hits = answerability(asked, deciding, entities, keep)
        first = keep(first, "answerability")
        open_ = first.where("answerability = 'not_answerable' and predicate = 'permission' and requested_role = 'boolean'")
        turned = asked.join(open_.select("question_id"), "question_id", "left_semi").withColumn("polarity", ~F.col("polarity"))
        # they are all about permissions
        second, more = answerability(keep(turned, "questions"), deciding.where("claim_type = 'permission'"), entities, keep)
        second = second.where("answerability in ('answerable', 'ambiguous')").select("question_id", F.col("answerability").alias("other"), F.col("reason_codes").alias("other_codes"))
        ask = first.join(second, "question_id", "left").withColumn("final", F.coalesce("other", "answerability"))
        ask = until(keep(ask.select("question_id", F.struct(*asked.columns).alias("ask"), "final", "reason_codes", "other_codes"), "states"))
        every = hits.select("question_id", "fact_id").unionByName(more.select("question_id", "fact_id"))
        every = until(keep(ask.where("final = 'answerable'").select("question_id").join(every, "question_id"), "told-hits"))
    every = every.join(facts.select("fact_id", F.struct(*TOLD).alias("hit")), "fact_id")
    told = ask.where("final = 'answerable'").join(every.repartition("question_id").dropDuplicates(["question_id", "fact_id"]), "question_id").withColumn("claim", answer_claim())
    order = Window.partitionBy("question_id").orderBy("hit.source_id", "hit.evidence_start", "hit.evidence_end", "hit.fact_id")
    told = told.withColumn("n", F.row_number().over(order))
    citation = F.struct("n", F.concat(F.lit("E"), "n").alias("citation_id"), *(F.col(f"hit.{c}").alias(c) for c in CITED), sha(F.col("hit.evidence_text")).alias("evidence_sha256"))
    packed = told.groupBy("question_id").agg(
        F.countDistinct(F.to_json("claim", {"ignoreNullFields": "false"})).alias("claims"),
        F.min_by("claim", "n").alias("claim"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= max_citations, citation))).alias("citations"),
    )
    out = ask.join(packed, "question_id", "left")
    out = out.withColumn("unlike", (F.col("final") == "answerable") & (F.col("claims") > 1))
    out = out.withColumn("final", F.when(F.col("unlike"), "ambiguous").otherwise(F.col("final")))
    out = out.withColumns({"yes": F.col("final") == "answerable", "marks": F.array_join(F.transform("citations", lambda x: F.concat(F.lit("["), x["citation_id"], F.lit("]"))), "")})
    none = F.array().cast("array<string>")
    codes = F.when(F.col("unlike"), F.array(F.lit("PHASE6_MULTIPLE_SEMANTIC_ANSWERS"))).when(F.col("yes"), F.concat("reason_codes", F.coalesce("other_codes", none))).otherwise(F.coalesce("other_codes", "reason_codes"))
    refused = spark_rows(out, REFUSALS)
    out = out.withColumn("codes", codes).join(F.broadcast(refused), "final", "left")
    own = F.when(F.col("yes"), F.array(F.lit("STRICT_TYPED_ANSWER"), F.lit("CITATIONS_STRUCTURALLY_ENTAILED"))).otherwise(F.array("code"))
    out = out.select(
        "question_id",
        F.col("ask.question").alias("question"),
        F.col("ask.predicate").alias("predicate"),
        F.when(F.col("yes"), "answered").otherwise(F.col("refusal")).alias("decision"),
        F.array_distinct(F.concat("codes", own)).alias("reason_codes"),
        F.when(F.col("yes"), render(F.col("claim"), F.col("marks"))).otherwise(F.col("message")).alias("answer_text"),
        F.when(F.col("yes"), F.col("claim")).alias("answer_claim"),
        F.filter(F.coalesce("citations", F.array().cast(out.schema["citations"].dataType)), lambda x: F.col("yes")).alias("citations"),
    )
    said = F.to_json(F.struct("question", "decision", "reason_codes", "answer_text", "answer_claim", "citations"), {"ignoreNullFields": "false"})
    return out.withColumns({"packet_id": stable_id("qa_", said), "may_present": F.lit(True), "may_freeze": F.lit(False)})


def spark_rows(df: DataFrame, refusals: dict[str, tuple[str, str, str]]) -> DataFrame:
    """F-43: refusals as rows: final, refusal, message, code."""
    return df.sparkSession.createDataFrame([(k, *v) for k, v in refusals.items()], "final string, refusal string, message string, code string")


def packet_differences(packets: DataFrame, recomputed: DataFrame) -> DataFrame:
    """R-09: packets that do not equal their recomputation, with the fields that differ; a packet whose question was not
    recomputed differs in all."""
    fields = [c for c in packets.columns if c != "question_id"]
    show = lambda side, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias("x")), {"ignoreNullFields": "false"})
    both = packets.select("question_id", F.struct(*fields).alias("old")).join(recomputed.select("question_id", F.struct(*fields).alias("new")), "question_id", "left")
    unlike = F.array_compact(F.array(*(F.when(~show("old", c).eqNullSafe(show("new", c)), F.lit(f"{c.upper()}_MISMATCH")) for c in fields)))
    return both.select("question_id", unlike.alias("reason_codes")).where(F.size("reason_codes") > 0)
