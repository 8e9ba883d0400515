"""The whole way from texts to answers, as one plan of tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import anomaly, chunking, claims, entities, gold, headings, lexindex, qa, retrieval, semantics, structure
from quillspan.operators.limits import within
from quillspan.operators.lines import physical_lines
from quillspan.sources import tables as store
from quillspan.sources.scratch import cut, new_path, remove
from quillspan.sources.tables import INDEX

#: Of the rules; a build of another version is another build.
VERSION = "quillspan-3"
#: Questions that are answered without written tables, and rows that such a step may hold at the driver.
FEW, MOST_LOCAL = 20, 10_000


@dataclass(frozen=True)
class ProjectPolicy:
    """Policies of all stages. ``canonical`` refuses to publish contested or ambiguous facts."""

    anomaly: anomaly.AnomalyPolicy = field(default_factory=anomaly.AnomalyPolicy)
    structure: headings.StructurePolicy = field(default_factory=headings.StructurePolicy)
    semantic: semantics.SemanticPolicy = field(default_factory=semantics.SemanticPolicy)
    chunk: chunking.ChunkPolicy = field(default_factory=chunking.ChunkPolicy)
    canonical: bool = False


_S = semantics.SemanticPolicy
PROFILES = {
    "balanced": ProjectPolicy(),
    "strict": ProjectPolicy(semantic=_S(150_000, 40_000, 10_000, 500, False), canonical=True),
    "high-recall": ProjectPolicy(semantic=_S(500_000, 150_000, 150_000, 900, True)),
}


def accepted_claims(sources: DataFrame, units: DataFrame, findings: DataFrame, policy: semantics.SemanticPolicy) -> dict[str, DataFrame]:
    """``claims``: candidates with verdict; ``model_tasks``; ``long_clauses`` that were not read; and ``warnings`` where a
    limit was reached. A claim may be indexed if it is asserted and accepted, its unit needs no review and no unsafe
    finding overlaps its evidence (T-22)."""
    found, unread, tasks = semantics.candidates(structure.unit_texts(units, sources), policy)
    tasks, more_tasks = within(cut(tasks, "model-tasks"), policy.max_model_tasks, ("evidence_start", "evidence_end", "task_id"), "semantic", "MODEL_TASK_LIMIT_REACHED")
    judged, many = judged_claims(found, sources, units, findings, policy)
    return {"claims": judged, "model_tasks": tasks, "long_clauses": unread, "warnings": many.unionByName(more_tasks)}


def judged_claims(found: DataFrame, sources: DataFrame, units: DataFrame, findings: DataFrame, policy: semantics.SemanticPolicy) -> tuple[DataFrame, DataFrame]:
    """The ``claims`` of candidates, and the warning where their limit was reached. Their evidence is the clause, or what they
    bring as evidence_text."""
    found, many = within(found.withColumn("evidence_text", F.col("clause")) if "clause" in found.columns else found, policy.max_candidates, ("evidence_start", "trigger_start", "claim_type", "candidate_id"), "semantic", "CANDIDATE_LIMIT_REACHED")
    # what the unit says of itself comes along where candidates meet their units anyway
    review = units.select("source_id", "unit_id", "review_status").hint("merge")
    judged = claims.validate_claims(found.join(review, ["source_id", "unit_id"]), sources, units)
    asserted = F.col("discourse_status") == "assertion"
    silent = F.array(F.lit("NONASSERTIVE_DISCOURSE"))
    judged = judged.withColumns({"reason_codes": F.when(asserted, F.col("reason_codes")).otherwise(silent), "status": F.when(asserted, F.col("status")).otherwise("not_validated_nonassertive")})
    unsafe = findings.where("category in ('contamination_candidate', 'paratext_candidate') or (category = 'text_anomaly' and severity = 'high')")
    judged = semantics.overlapping(judged, unsafe.select("source_id", "start_char", "end_char", F.concat_ws(":", "rule_id", "category").alias("name")))
    settled, clean = F.col("review_status") == "accepted_candidate", F.size("upstream") == 0
    more = F.array_compact(F.array(F.when(~settled, F.lit("UNIT_REQUIRES_STRUCTURE_REVIEW")), F.when(~clean, F.lit("EVIDENCE_OVERLAPS_UPSTREAM_ANOMALY"))))
    judged = judged.withColumns({"reason_codes": F.array_distinct(F.concat("reason_codes", more)), "may_index": (F.col("status") == "accepted") & settled & clean})
    return judged, many


def semantic_findings(judged: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Section 2.13: candidate_id, rule_id, severity, signals; and a finding for each clause that is too long to be read
    (P-18), without candidate."""
    rules = {
        "CANDIDATE_IN_REVIEW_UNIT": (F.col("review_status") != "accepted_candidate", "medium", F.array(F.concat(F.lit("unit_review_status="), "review_status"))),
        "EVIDENCE_OVERLAPS_UPSTREAM_ANOMALY": (F.size("upstream") > 0, "high", F.col("upstream")),
        "NONASSERTIVE_PROPOSITION_CANDIDATE": (F.col("discourse_status") != "assertion", "medium", F.array(F.concat(F.lit("discourse_status="), "discourse_status"), F.concat(F.lit("attributor="), "attributor"))),
        "DETERMINISTIC_CANDIDATE_NOT_ACCEPTED": ((F.col("discourse_status") == "assertion") & (F.col("status") != "accepted"), "medium", F.col("reason_codes")),
    }
    each = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("rule_id"), F.lit(sev).alias("severity"), told.alias("signals"))) for k, (test, sev, told) in rules.items())))
    out = judged.select("source_id", "unit_id", "candidate_id", "evidence_start", "evidence_end", F.explode(each).alias("f")).select("source_id", "unit_id", "candidate_id", "evidence_start", "evidence_end", "f.*")
    if unread is None:
        return out
    about = {"candidate_id": F.lit(None).cast("string"), "rule_id": F.lit("CLAUSE_EXCEEDS_EXTRACTION_LIMIT"), "severity": F.lit("medium"), "signals": F.array(F.concat(F.lit("length="), F.length("clause")))}
    return out.unionByName(unread.withColumns(about).select(*out.columns))


def semantic_report(judged: DataFrame) -> DataFrame:
    """G-03: source_id, kind (claim_type, discourse_status or validation_status), name, n."""
    kinds = {"claim_type": "claim_type", "discourse_status": "discourse_status", "validation_status": "status"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in kinds.items())))
    return judged.select("source_id", each.alias("x")).groupBy("source_id", "x.kind", "x.name").agg(F.count("*").alias("n"))


def policy_json(policy: ProjectPolicy) -> str:
    """A policy as JSON with sorted names, as a project keeps it."""
    return json.dumps(asdict(policy), sort_keys=True, ensure_ascii=False)


def policy_of(text: str) -> ProjectPolicy:
    """The policy that ``policy_json`` has told; unknown fields fail."""

    def rebuilt(usual, told):
        if is_dataclass(usual):
            if set(told) - {f.name for f in fields(usual)}:
                raise ValueError(f"a policy has no {sorted(set(told) - {f.name for f in fields(usual)})}")
            return replace(usual, **{k: rebuilt(getattr(usual, k), v) for k, v in told.items()})
        if isinstance(told, dict):
            return {k: rebuilt((), v) for k, v in told.items()}
        return tuple(told) if isinstance(told, list) else told

    return rebuilt(ProjectPolicy(), json.loads(text))


_PLACE = ("start_char", "end_char", "rule_id", "finding_id")


def _inspected(sources: DataFrame, lines: DataFrame, policy: ProjectPolicy) -> dict[str, DataFrame]:
    """Findings up to the policy's limit, headings, and the warnings of both."""
    found, many = within(cut(anomaly.inspect_anomalies(sources, policy.anomaly, lines), "findings"), policy.anomaly.max_findings, _PLACE, "anomaly", "FINDING_LIMIT_REACHED")
    marks = cut(structure.heading_candidates(lines, policy.structure), "headings")
    return {"anomalies": found, "headings": marks, "warnings": many.unionByName(anomaly.mosaic_warnings(sources, lines, policy.anomaly))}


def _structured(sources: DataFrame, lines: DataFrame, marks: DataFrame, units: DataFrame, policy: ProjectPolicy) -> dict[str, DataFrame]:
    found, many = within(cut(structure.continuity_findings(units, marks, policy.structure), "findings"), policy.structure.max_findings, _PLACE, "structure", "FINDING_LIMIT_REACHED")
    _, beyond = structure.boundaries(marks, policy.structure)
    return {"structure_findings": found, "chunks": chunking.chunks(structure.unit_texts(units, sources), policy.chunk), "warnings": many.unionByName(beyond)}


def _judged(semantic: dict[str, DataFrame], policy: semantics.SemanticPolicy) -> tuple[DataFrame, DataFrame]:
    order = ("evidence_start", "evidence_end", "rule_id", "candidate_id")
    return within(semantic_findings(semantic["claims"], semantic["long_clauses"]), policy.max_findings, order, "semantic", "SEMANTIC_FINDING_LIMIT_REACHED")


def build(sources: DataFrame, policy: ProjectPolicy = ProjectPolicy(), links: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a project from ``sources`` (source_id, text); what several of them come from is written once."""
    lines = cut(physical_lines(sources), "lines")
    first = _inspected(sources, lines, policy)
    units = cut(structure.units(first["headings"], sources, lines, policy.structure), "units")
    second = _structured(sources, lines, first["headings"], units, policy)
    semantic = accepted_claims(sources, units, first["anomalies"], policy.semantic)
    semantic["claims"] = cut(semantic["claims"], "claims")
    found, many = _judged(semantic, policy.semantic)
    warnings = reduce(DataFrame.unionByName, [first["warnings"], second["warnings"], semantic["warnings"], many])
    out = {"sources": sources.select("source_id", "text", F.sha2("text", 256).alias("source_sha256")), "units": units, "semantic_findings": found}
    out |= first | second | semantic | {"warnings": warnings}
    return out | entities.normalize(semantic["claims"].where("may_index"), sources, units, links)


def publish(spark: SparkSession, sources: DataFrame, path: str, policy: ProjectPolicy = ProjectPolicy(), links: DataFrame | None = None) -> None:
    """Builds a project and puts it in the place of what was at ``path``. Each stage is written and read back before the next
    builds on it, so none runs twice. All is written beside the place, and takes it by a rename only when it is whole: a
    build that fails or is killed leaves the old project as it was. The same build, begun again after it was killed, goes on
    behind the last stage in its journal."""
    key = build_key(sources, policy) if links is None else build_key(sources, policy) + links.agg(store.logical_hash(links)).first()[0][:16]
    with store.replacing(spark, path, key) as place:
        _write(spark, sources, place, policy, links)


def _write(spark: SparkSession, sources: DataFrame, path: str, policy: ProjectPolicy, links: DataFrame | None) -> None:
    """One stage after the other; those that a journal at ``path`` has are not done again."""
    journal = store.Journal(spark, path)
    t, stage = journal.tables, journal.stage
    texts = lambda: t["sources"].select("source_id", "text")
    good = lambda: t["claims"].where("may_index")

    # what the project was built by is kept with it, so that it can be built again
    told = {"sources": sources.select("source_id", "text", F.sha2("text", 256).alias("source_sha256")), "policy": spark.createDataFrame([(policy_json(policy),)], "policy string").coalesce(1)}
    stage("sources", lambda: told if links is None else told | {"links": links})
    stage("lines", lambda: {"lines": physical_lines(texts())})
    stage("findings", lambda: _inspected(texts(), t["lines"], policy))
    stage("units", lambda: {"units": structure.units(t["headings"], texts(), t["lines"], policy.structure)})
    stage("structure", lambda: _structured(texts(), t["lines"], t["headings"], t["units"], policy))
    problems = chunking.chunk_problems(t["chunks"], policy.chunk)
    if not problems.isEmpty():
        raise ValueError(f"chunks break their own rules: {problems.first().asDict()}")
    stage("claims", lambda: accepted_claims(texts(), t["units"], t["anomalies"], policy.semantic))
    if good().isEmpty():
        raise ValueError("no claim was accepted: there is nothing to index")

    def judged() -> dict[str, DataFrame]:
        found, many = _judged(t, policy.semantic)
        return {"semantic_findings": found, "mentions": entities.mentions(good()), "warnings": many}

    def identity() -> dict[str, DataFrame]:
        valid = None if links is None else entities.valid_links(t["links"], t["mentions"], texts(), t["units"]).where("problem is null")
        merged, blocked = entities.components(t["mentions"], entities.identity_edges(t["mentions"], good(), valid))
        return {"merged": merged, "blocked_merges": blocked}

    def index() -> dict[str, DataFrame]:
        remove(spark, f"{path}/{INDEX}")
        lexindex.add_units(structure.unit_texts(t["units"], texts()), f"{path}/{INDEX}", "units")
        return {}

    def facts() -> dict[str, DataFrame]:
        return {"facts": retrieval.indexed_facts(entities.fact_status(t["plain_facts"], t["conflicts"], t["blocked_merges"])), "entity_names": retrieval.entity_names(t["entities"])}

    stage("judged", judged)
    stage("identity", identity)
    stage("entities", lambda: {"entities": entities.entities(t["mentions"], t["merged"])})
    stage("plain_facts", lambda: {"plain_facts": entities.facts(good(), t["mentions"], t["merged"], t["entities"])})
    stage("conflicts", lambda: {"conflicts": entities.conflicts(t["plain_facts"])})
    stage("facts", facts)
    stage("timeline", lambda: {"timeline": entities.timeline(t["facts"]), "ambiguity_groups": entities.ambiguity_groups(t["mentions"], t["merged"], t["entities"])})
    gates = entities.report(t).first()
    if not gates.may_build_review_index or (policy.canonical and not gates.may_publish_canonical):
        raise ValueError(f"the project may not be published: {gates.asDict()}")
    stage("index", index)
    warned = store.write_tables({"warnings": reduce(DataFrame.unionByName, journal.warnings())}, path)
    store.write_manifest(journal.close() | warned, path)


def regenerated_differences(spark: SparkSession, path: str, policy: ProjectPolicy | None = None) -> DataFrame:
    """R-10: tables of a project that a fresh build of its own sources and links, by its own policy unless another is
    given, does not give: table_name, problem."""
    fresh, names = new_path(spark, "regenerated"), store.folders(spark, path)
    told = store.read_project(spark, path, [n for n in ("sources", "policy", "links") if n in names])
    policy = policy or policy_of(told["policy"].first().policy)
    _write(spark, told["sources"], fresh, policy, told.get("links"))
    columns = ("table_name", "n_rows", "logical_sha256")
    return store.manifest_differences(*(spark.read.parquet(f"{p}/manifest").select(*columns) for p in (path, fresh)))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """R-10 to R-12: table_name and problem of what isn't as the manifest says, the index of units included, which must have
    the units' texts and no others; empty where all is sound."""
    wrong = store.verify_project(spark, path)
    if {"units", "sources"} - set(store.folders(spark, path)):
        return wrong
    project = store.read_project(spark, path, ["units", "sources"])
    texts = structure.unit_texts(project["units"], project["sources"].select("source_id", "text"))
    columns = ("source_id", "unit_id", "start_char", "unit_text")
    sides = {INDEX: lexindex.docs_of(spark, f"{path}/{INDEX}"), "units": texts} if INDEX in store.folders(spark, path) else {"units": texts}
    hashes = {r.table_name: (r.n_rows, r.logical_sha256) for r in store.table_hashes({n: df.select(*columns).withColumn("start_char", F.col("start_char").cast("long")) for n, df in sides.items()}).collect()}
    if hashes.get(INDEX) == hashes["units"]:
        return wrong
    return wrong.unionByName(spark.createDataFrame([(INDEX, "CHANGED" if INDEX in hashes else "MISSING")], wrong.schema))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """R-11: the packet of a question about the project's own first canonical relation, within its source; no row where it
    has none. A name that stands for several entities there may make it ambiguous, which is an answer; that nothing is
    found isn't."""
    facts = store.read_project(spark, path, ["facts"])["facts"].where("canonical_status = 'canonical' and polarity and claim_type in ('located_in', 'defeats', 'alias')")
    asks = {"located_in": "位于哪里？", "defeats": "击败了谁？", "alias": "又叫什么？"}
    first = facts.select("subject", "claim_type", "source_id").orderBy("source_id", "fact_id").limit(1).collect()
    return ask(spark, path, [r.subject + asks[r.claim_type] for r in first], first[0].source_id if first else None)


def load_profile(text: str) -> ProjectPolicy:
    """S-19: a policy from a JSON object with closed fields: a base profile's name and limits of the semantic stage."""
    told = json.loads(text)
    known = {"profile", "canonical", *(f.name for f in fields(_S))}
    if not isinstance(told, dict) or set(told) - known:
        raise ValueError(f"a profile is an object of {sorted(known)}")
    base = PROFILES[told.pop("profile", "balanced")]
    canonical = told.pop("canonical", base.canonical)
    return replace(base, canonical=bool(canonical), semantic=replace(base.semantic, **told))


def build_key(sources: DataFrame, policy: ProjectPolicy) -> str:
    """K-14: names a build by its content: the sources' rows, in any order, and the policy."""
    content = sources.select("source_id", "text").agg(store.logical_hash(sources.select("source_id", "text"))).first()[0]
    return "bld_" + hashlib.sha256(f"{VERSION}|{content}|{policy!r}".encode()).hexdigest()[:40]


def publish_once(spark: SparkSession, sources: DataFrame, root: str, policy: ProjectPolicy = ProjectPolicy()) -> str:
    """K-14: the path of the project of these sources below ``root``: one that is there and verifies is used again."""
    path = f"{root}/{build_key(sources, policy)}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    if not there or not verify(spark, path).isEmpty():
        publish(spark, sources, path, policy)
    return path


def ask(spark: SparkSession, path: str, questions: list[str], source: str | None = None) -> DataFrame:
    """Packets for questions against a published project."""
    asked = retrieval.intent_rows(spark, [(f"q{n}", q, source) for n, q in enumerate(questions)])
    project = store.read_project(spark, path, ["facts", "entity_names"])
    facts, names = project["facts"], project["entity_names"]
    if len(questions) <= FEW:
        # what a few questions can touch is a few rows, which the forms of their names find in one pass; all else is done on these
        forms = sorted({f for r in asked.select("subject_form", "object_form").collect() for f in r if f})
        names = _local(names.where(F.col("normalized_name").isin(forms)))
        known = [r.entity_id for r in names.select("entity_id").distinct().collect()]
        side = lambda s: F.col(f"normalized_{s}").isin(forms) | F.col(f"{s}_entity_id").isin(known)
        facts = _local(facts.where(side("subject") | side("object")))
        return qa.answers(asked, facts, names, keep=lambda df, _: _local(df))
    return qa.answers(asked, facts, names)


def search(spark: SparkSession, path: str, questions: list[str], limit: int = 10, source: str | None = None) -> DataFrame:
    """R-03: units of a published project that the words of questions find, whatever the answers are."""
    asked = retrieval.intent_rows(spark, [(f"q{n}", q, source) for n, q in enumerate(questions)])
    return retrieval.lexical_hits(asked, f"{path}/{INDEX}", limit)


def _local(df: DataFrame) -> DataFrame:
    """The rows of a small table at the driver: at most MOST_LOCAL, else the table as it is."""
    rows = df.limit(MOST_LOCAL + 1).collect()
    return df if len(rows) > MOST_LOCAL else df.sparkSession.createDataFrame(rows, df.schema)


def verify_answers(spark: SparkSession, path: str, packets: DataFrame) -> DataFrame:
    """R-09, R-13: packets that the project does not give today, with the fields that differ."""
    project = store.read_project(spark, path, ["facts", "entity_names"])
    asked = retrieval.intents(packets.select("question_id", "question", F.lit(None).cast("string").alias("source_filter")))
    return qa.packet_differences(packets, qa.answers(asked, project["facts"], project["entity_names"]).select(packets.columns))


def gold_report(spark: SparkSession, path: str, cases: DataFrame, out: str, policy: gold.GoldPolicy = gold.POLICIES["release"]) -> None:
    """R-14, R-15: every case against the project: results, metrics, coverage, blockers and the manifest of these at ``out``.
    Cases that contradict themselves stop it."""
    wrong = gold.case_problems(cases).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.case_id}: {r.problem}" for r in wrong))
    project = store.read_project(spark, path, ["facts", "entity_names"])
    facts, names = project["facts"], project["entity_names"]
    asked = cut(retrieval.intents(cases.select("question_id", "question", "source_filter")), "questions")
    packets = cut(qa.answers(asked, facts, names), "packets")
    failures = gold.hard_negative_failures(cases, asked, packets, facts, names)
    results = cut(gold.evaluate(cases, packets, failures), "results")
    made = {"results": results, "metrics": gold.metrics(results), "coverage": gold.coverage(cases), "blockers": gold.gate_blockers(results, cases, policy)}
    with store.replacing(spark, out) as place:
        store.write_manifest(store.write_tables(made, place), place)


def gold_differences(spark: SparkSession, path: str, cases: DataFrame, report: str, policy: gold.GoldPolicy = gold.POLICIES["release"]) -> DataFrame:
    """R-15: tables of a report that are not its manifest's, or that the project and the cases do not give today."""
    fresh = new_path(spark, "gold")
    gold_report(spark, path, cases, fresh, policy)
    columns = ("table_name", "n_rows", "logical_sha256")
    today = store.manifest_differences(*(spark.read.parquet(f"{p}/manifest").select(*columns) for p in (report, fresh)))
    return store.verify_project(spark, report).unionByName(today).distinct()


def profile(name: str, **changes) -> ProjectPolicy:
    """A named profile, with parts replaced."""
    return replace(PROFILES[name], **changes)
