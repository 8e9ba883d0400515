"""Gold benchmark: cases against packets, metrics, coverage, gates and hard negatives (R-14 to R-19, G-23 to G-25)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import safe_ratio, search_form
from quillspan.sources.scratch import cut

from .retrieval import ACTIVE, entity_names, indexed_facts

REFUSED = ("refused_unsupported", "refused_insufficient_evidence", "refused_ambiguous")
PREDICATES = ("alias", "defeats", "located_in", "permission", "count", "date")
TAGS = ("entity_only_no_predicate", "relation_direction", "numeric_prefix", "temporal_scope", "contested_fact", "unsupported_open_predicate", "lexical_distractor", "absence_not_negative")
ZERO = ("hallucination_rate", "overanswer_count", "wrong_answer_count", "citation_mismatch_count")
EXACT = {"answer_claim_accuracy": 1.0, "citation_entailment_rate": 1.0, "answer_precision": 1.0, "refusal_precision": 1.0}


@dataclass(frozen=True)
class GoldPolicy:
    """What a benchmark must cover and reach."""

    min_cases: int
    min_answered: int
    min_each_refusal: int
    min_answered_per_predicate: int
    tags: tuple[str, ...]
    min_each_tag: int
    floors: dict[str, float]
    certifies_release: bool = False


# The two policies.
POLICIES = {
    "smoke": GoldPolicy(12, 6, 2, 1, ("relation_direction", "temporal_scope", "unsupported_open_predicate", "lexical_distractor", "absence_not_negative"), 1, EXACT | dict.fromkeys(("exact_case_accuracy", "decision_accuracy", "answer_recall", "refusal_recall"), 1.0)),
    "release": GoldPolicy(100, 42, 15, 7, TAGS, 3, EXACT | {"exact_case_accuracy": 0.98, "decision_accuracy": 0.99, "answer_recall": 0.98, "refusal_recall": 0.98}, True),
}


def evaluate(cases: DataFrame, packets: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """R-14, J-23: cases (case_id, question_id, expected_decision, expected_predicate, expected_claim as canonical JSON,
    expected_fact_ids, tags) against packets. ``failures`` (case_id, failures) are hard negatives that data do not bear out."""
    got = packets.select("question_id", F.col("decision").alias("actual_decision"), F.col("predicate").alias("actual_predicate"), F.to_json("answer_claim", {"ignoreNullFields": "false"}).alias("claim"), F.array_sort(F.transform("citations", lambda c: c["fact_id"])).alias("fact_ids"), "packet_id")
    df = cases.join(got, "question_id", "left")
    if failures is not None:
        df = df.join(failures, "case_id", "left")
    else:
        df = df.withColumn("failures", F.lit(None).cast("array<string>"))
    df = df.withColumns({"failures": F.coalesce("failures", F.array().cast("array<string>")), "actual_decision": F.coalesce("actual_decision", F.lit("evaluator_error"))})
    wanted, given = F.col("expected_decision") == "answered", F.col("actual_decision") == "answered"
    claim = F.when(wanted, F.col("claim").eqNullSafe(F.col("expected_claim"))).otherwise(F.col("claim").isNull())
    cited = F.when(wanted, given & (F.size("fact_ids") > 0) & (F.col("fact_ids") == F.array_sort("expected_fact_ids"))).otherwise(F.coalesce(F.size("fact_ids"), F.lit(0)) <= 0)
    df = df.withColumns({"decision_correct": F.col("actual_decision") == F.col("expected_decision"), "claim_correct": F.coalesce(claim, F.lit(False)), "citations_correct": F.coalesce(cited, F.lit(False)), "predicate_correct": F.coalesce(F.col("actual_predicate") == F.col("expected_predicate"), F.lit(False))})
    df = df.withColumns({"overanswer": ~wanted & given, "wrong_answer": wanted & given & ~(F.col("claim_correct") & F.col("citations_correct"))})
    df = df.withColumn("hallucination", F.col("overanswer") | F.col("wrong_answer"))
    exact = F.col("decision_correct") & F.col("claim_correct") & F.col("citations_correct") & F.col("predicate_correct") & (F.size("failures") == 0)
    df = df.withColumn("exact_pass", exact)
    told = {
        "DECISION_MISMATCH": ~F.col("decision_correct"),
        "ANSWER_CLAIM_MISMATCH": ~F.col("claim_correct"),
        "CITATION_EXPECTATION_MISMATCH": ~F.col("citations_correct"),
        "OVERANSWERED_GOLD_REFUSAL": F.col("overanswer"),
        "ANSWERED_WITH_WRONG_CLAIM_OR_CITATION": F.col("wrong_answer"),
        "PREDICATE_MISMATCH": ~F.col("predicate_correct"),
        "GOLD_CASE_EXACT_MATCH": F.col("exact_pass"),
    }
    codes = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in told.items())))
    return df.withColumn("reason_codes", F.concat(codes, "failures")).drop("claim", "fact_ids")


def case_problems(cases: DataFrame) -> DataFrame:
    """S-17, G-27: case_id and problem of cases that contradict themselves or one another."""
    answered = F.col("expected_decision") == "answered"
    facts = F.coalesce(F.size("expected_fact_ids"), F.lit(0))
    twice = F.count("*").over(Window.partitionBy("case_id")) > 1
    tests = {
        "CASE_ID_REPEATED": twice,
        "UNKNOWN_DECISION": ~F.col("expected_decision").isin("answered", *REFUSED),
        "UNKNOWN_PREDICATE": ~F.col("expected_predicate").isin("unsupported", *PREDICATES),
        "ANSWER_WITHOUT_CLAIM_OR_FACTS": answered & (F.col("expected_claim").isNull() | (facts < 1)),
        "REFUSAL_WITH_CLAIM_OR_FACTS": ~answered & (F.col("expected_claim").isNotNull() | (facts > 0)),
        "UNKNOWN_TAG": F.size(F.array_except("tags", F.array(*(F.lit(t) for t in TAGS)))) > 0,
        "QUESTION_EMPTY": F.trim("question") == "",
    }
    told = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in tests.items())))
    return cases.select("case_id", told.alias("told")).select("case_id", F.explode("told").alias("problem")).distinct()


def metric_columns(wanted: Column, given: Column, refused: Column, exact: Column, decision: Column, claim: Column, cited: Column) -> dict[str, Column]:
    """G-23: metrics from flags of each case; a ratio of nothing is 1."""
    n = F.count("*")
    over, wrong = F.count_if(~wanted & given), F.count_if(wanted & given & ~(claim & cited))
    return {
        "exact_case_accuracy": safe_ratio(F.count_if(exact), n),
        "decision_accuracy": safe_ratio(F.count_if(decision), n),
        "answer_claim_accuracy": safe_ratio(F.count_if(wanted & claim), F.count_if(wanted)),
        "citation_entailment_rate": safe_ratio(F.count_if(wanted & cited), F.count_if(wanted)),
        "answer_precision": safe_ratio(F.count_if(wanted & exact), F.count_if(given)),
        "answer_recall": safe_ratio(F.count_if(wanted & exact), F.count_if(wanted)),
        "refusal_precision": safe_ratio(F.count_if(~wanted & exact), F.count_if(refused)),
        "refusal_recall": safe_ratio(F.count_if(~wanted & exact), F.count_if(~wanted)),
        "hallucination_rate": safe_ratio(over + wrong, n),
        "overanswer_count": over,
        "wrong_answer_count": wrong,
        "citation_mismatch_count": F.count_if(wanted & ~cited),
    }


def metrics(results: DataFrame) -> DataFrame:
    wanted, given = F.col("expected_decision") == "answered", F.col("actual_decision") == "answered"
    flags = (F.col(c) for c in ("exact_pass", "decision_correct", "claim_correct", "citations_correct"))
    made = metric_columns(wanted, given, F.col("actual_decision").isin(*REFUSED), *flags)
    return results.agg(*(v.alias(k) for k, v in made.items()))


def coverage(cases: DataFrame) -> DataFrame:
    """G-24: kind (decision, predicate of answered cases, tag), name, n."""
    by = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    out = by(cases, "decision", "expected_decision").unionByName(by(cases.where("expected_decision = 'answered'"), "predicate", "expected_predicate"))
    return out.unionByName(by(cases.select(F.explode("tags").alias("tag")), "tag", "tag"))


def gate_blockers(results: DataFrame, cases: DataFrame, policy: GoldPolicy) -> DataFrame:
    """G-25: what a benchmark misses, by name; empty where it passes."""
    spark = results.sparkSession
    made = metrics(results)
    names = [c for c in made.columns]
    long_ = made.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("m.*")
    limits = spark.createDataFrame([(k, v, None) for k, v in policy.floors.items()] + [(k, None, 0.0) for k in ZERO], "name string, floor double, ceiling double")
    metric = long_.join(F.broadcast(limits), "name")
    low = metric.where("value < floor").select(F.concat(F.lit("METRIC_"), F.upper("name"), F.lit("_BELOW_POLICY_FLOOR")).alias("blocker"))
    high = metric.where("value > ceiling").select(F.concat(F.lit("METRIC_"), F.upper("name"), F.lit("_ABOVE_POLICY_CEILING")).alias("blocker"))
    wanted = [("decision", "answered", policy.min_answered), *(("decision", r, policy.min_each_refusal) for r in REFUSED), *(("predicate", p, policy.min_answered_per_predicate) for p in PREDICATES), *(("tag", t, policy.min_each_tag) for t in policy.tags)]
    need = spark.createDataFrame(wanted, "kind string, name string, least int")
    short = need.join(coverage(cases), ["kind", "name"], "left").where("coalesce(n, 0) < least")
    short = short.select(F.concat(F.lit("COVERAGE_"), F.upper("kind"), F.lit("_"), F.upper("name"), F.lit("_BELOW_POLICY")).alias("blocker"))
    few = cases.agg(F.count("*").alias("n")).where(F.col("n") < policy.min_cases).select(F.lit("COVERAGE_CASES_BELOW_POLICY").alias("blocker"))
    return low.unionByName(high).unionByName(short).unionByName(few)


def reverse_relations(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """R-17: questions whose relation is recorded in the other direction only as asked: question_id."""
    have = indexed_facts(facts).where(F.col("canonical_status").isin(*ACTIVE)).where(F.col("claim_type").isin("defeats", "located_in", "alias"))
    have = have.select("claim_type", "source_id", "normalized_subject", "normalized_object")
    role, same = F.col("requested_role"), F.col("predicate") == F.col("claim_type")
    turned = F.when(role == "object", F.col("normalized_object") == F.col("subject_form")).when(role == "subject", F.col("normalized_subject") == F.col("object_form"))
    turned = turned.when(role == "boolean", (F.col("normalized_subject") == F.col("object_form")) & (F.col("normalized_object") == F.col("subject_form")))
    name = F.when(role == "object", F.col("subject_form")).otherwise(F.col("object_form"))
    keyed = asked.withColumn("name", name).where("name != ''")
    sides = have.withColumn("name", F.explode(F.array_distinct(F.array("normalized_subject", "normalized_object"))))
    met = keyed.join(sides, "name").where(same & turned & (F.col("source_filter").isNull() | (F.col("source_filter") == F.col("source_id"))))
    return met.select("question_id").distinct()


def prefix_collisions(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """J-19: groups with two values of which one begins the other. Sorted as text, a value that begins another is begun
    on by its successor too, so neighbours are enough: no pairs are built."""
    each = counts.select(*keys, F.col(value).cast("string").alias("v")).distinct()
    after = F.lead("v").over(Window.partitionBy(*keys).orderBy("v"))
    return each.withColumn("after", after).where(F.col("after").startswith(F.col("v"))).groupBy(*keys).agg(F.count("*").alias("collisions"))


def absent_not_negative(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """R-18: permission questions about a known subject without any fact on the action."""
    have = indexed_facts(facts).where(F.col("canonical_status").isin(*ACTIVE)).where("claim_type = 'permission'")
    want = asked.where("predicate = 'permission' and subject_form != '' and object_form != ''")
    known = want.join(have.select(F.col("normalized_subject").alias("subject_form")).distinct(), "subject_form", "left_semi")
    said = have.select(F.col("normalized_subject").alias("subject_form"), F.col("normalized_object").alias("object_form")).distinct()
    return known.join(said, ["subject_form", "object_form"], "left_anti").select("question_id")


def named_entities(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """J-06: questions that contain the name of an entity, both in the form that names are looked up in. Of a question, the
    parts of each length that a name has are joined with the names by equality: as many as it has characters, times the
    lengths there are (a few dozen, collected), and neither side is sent everywhere."""
    names = cut(entity_names(entities).where(F.length("normalized_name") >= 2), "entity-names")
    lengths = sorted(r.n for r in names.select(F.length("normalized_name").alias("n")).distinct().collect())
    each = asked.select("question_id", "source_filter", search_form(F.col("question")).alias("form"))
    part = F.explode(F.sequence(F.lit(1), F.length("form") - F.col("n") + 1))
    each = each.withColumn("n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.length("form") >= F.col("n"))
    each = each.withColumn("at", part).select("question_id", "source_filter", F.expr("substring(form, at, n)").alias("normalized_name")).distinct()
    met = each.join(names, "normalized_name")
    return met.where(F.col("source_filter").isNull() | F.array_contains("source_ids", F.col("source_filter"))).select("question_id").distinct()


def hard_negative_failures(cases: DataFrame, asked: DataFrame, packets: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """R-16, R-19: case_id and the tags that the facts do not bear out."""
    have = indexed_facts(facts)
    matching = asked.join(have, (asked.predicate == have.claim_type) & (asked.subject_form == have.normalized_subject)).where((asked.predicate != "permission") | (asked.object_form == have.normalized_object))
    answer = F.when(have.claim_type.isin("count", "date"), F.concat_ws("|", have.value, have.unit, have.predicate_scope)).otherwise(F.concat_ws("|", have.normalized_object, have.polarity))
    seen = matching.groupBy("question_id").agg(F.count("*").alias("n"), F.max(F.col("canonical_status") == "contested").alias("contested"), F.countDistinct(F.when(F.col("canonical_status") == "temporal_variant", answer)).alias("times"))
    counts = asked.where("predicate = 'count'").select("question_id", "subject_form").join(have.where("claim_type = 'count'").select(F.col("normalized_subject").alias("subject_form"), "unit", "value"), "subject_form")
    flags = {
        "relation_direction": reverse_relations(asked, facts),
        "numeric_prefix": prefix_collisions(counts, ["question_id", "unit"]).select("question_id").distinct(),
        "absence_not_negative": absent_not_negative(asked, facts),
        "named": named_entities(asked, entities),
    }
    df = cases.select("case_id", "question_id", F.explode("tags").alias("tag")).join(packets.select("question_id", "decision", "reason_codes", "predicate"), "question_id").join(seen, "question_id", "left")
    df = df.join(asked.select("question_id", "temporal_scope"), "question_id")
    for name, found in flags.items():
        df = df.join(found.withColumn(name, F.lit(True)), "question_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    lacks = F.col("decision") == "refused_insufficient_evidence"
    open_ = (F.col("decision") == "refused_unsupported") & yes("named")
    tests = {
        "relation_direction": yes("relation_direction"),
        "numeric_prefix": yes("numeric_prefix"),
        "temporal_scope": F.array_contains("reason_codes", "TEMPORAL_SCOPE_REQUIRED") & (F.coalesce("times", F.lit(0)) >= 2) & (F.col("temporal_scope") == "any"),
        "contested_fact": F.array_contains("reason_codes", "CONTESTED_FACTS_PRESENT") & yes("contested"),
        "lexical_distractor": lacks & F.col("n").isNull(),
        "entity_only_no_predicate": open_,
        "unsupported_open_predicate": open_,
        "absence_not_negative": lacks & yes("absence_not_negative"),
    }
    ok = F.coalesce(*(F.when(F.col("tag") == tag, test) for tag, test in tests.items()), F.lit(True))
    bad = df.where(~ok).select("case_id", F.concat(F.lit("HARD_NEGATIVE_EVIDENCE_NOT_ESTABLISHED:"), "tag").alias("code"))
    return bad.groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("failures"))
