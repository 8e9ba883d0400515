"""Queries over claims, facts, questions and benchmarks. Sentences are made from the star-schema tables, so every rule has
whole tables to work on and plain SQL to be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import anomaly, claims, entities, gold, qa, retrieval, semantics, structure
from quillspan.sources import tables as store
from quillspan.sources.scratch import cut

from .text_queries import _WINDOWS, DOC_LINES, doc_lines, doc_sources, named, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return add


_CLAUSE = "[^.!?\\n]+[.!?]+"
#: The same, linear in the text; DuckDB's expressions are so by themselves.
_LINEAR = "(?<![^.!?\\n])[^.!?\\n]++[.!?]+"


def _units(spark, sf_dir) -> DataFrame:
    whole = (F.lit("unit-1").alias("unit_id"), F.lit(0).cast("long").alias("start_char"), F.lit(0).cast("long").alias("body_start"))
    return doc_sources(spark, sf_dir).select("source_id", *whole, F.col("text").alias("unit_text"))


@query("clauses", f"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CLAUSE}')) AS clause FROM documents) SELECT doc_id, count(*) AS n_clauses, sum(length(clause))::BIGINT AS n_chars, max(length(clause))::BIGINT AS longest FROM c WHERE regexp_matches(clause, '\\S') GROUP BY doc_id")
def clauses(spark, sf_dir):
    rows = semantics.clauses(_units(spark, sf_dir), _LINEAR)
    length = F.col("evidence_end") - F.col("evidence_start")
    return named(rows.groupBy("source_id").agg(F.count("*").alias("n_clauses"), F.sum(length).alias("n_chars"), F.max(length).alias("longest")))


_SAID = (
    ("据说陆川击败韩岳。", "rumor", "", 2),
    ("林晚认为陆川击败韩岳。", "belief", "林晚", 4),
    ("林晚怀疑陆川击败韩岳。", "suspicion", "林晚", 4),
    ("林晚指控陆川击败韩岳。", "accusation", "林晚", 4),
    ("如果陆川击败韩岳。", "hypothetical", "", 2),
    ("陆川击败韩岳？", "question", "", 0),
    ("陆川计划击败韩岳。", "future_intent", "", 0),
    ("陆川并未击败韩岳。", "assertion", "", 0),
)


@query("discourse_status", "SELECT s_suppkey, clause, discourse_status, attributor, proposition_offset FROM supplier, (VALUES " + ", ".join(f"('{c}', '{s}', '{w}', {o}::BIGINT)" for c, s, w, o in _SAID) + ") v(clause, discourse_status, attributor, proposition_offset)")
def discourse_status(spark, sf_dir):
    """Eight sentences for each supplier, with their status by hand in the SQL."""
    said = F.explode(F.array(*(F.lit(c) for c, *_ in _SAID)))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("clause")).withColumns(semantics.discourse(F.col("clause")))
    return rows.withColumn("proposition_offset", F.col("proposition_offset").cast("long"))


@query("negated_clauses", f"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CLAUSE}')) AS clause FROM documents) SELECT doc_id, count(*) AS n FROM c WHERE regexp_matches(clause, '(?i)(^|[ ,.;:(])(not|never|no|cannot)([ ,.;:)!?]|$)') GROUP BY doc_id")
def negated_clauses(spark, sf_dir):
    rows = semantics.clauses(_units(spark, sf_dir), _LINEAR).where(F.col("clause").rlike("(?i)(^|[ ,.;:(])(not|never|no|cannot)([ ,.;:)!?]|$)"))
    return named(rows.groupBy("source_id").agg(F.count("*").alias("n")))


def located_candidates(spark, sf_dir, who: str = "customer") -> DataFrame:
    """A sentence for each customer or supplier that says where it is, with the claim in it."""
    key, name, nation = {"customer": ("c_custkey", "c_name", "c_nationkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey")}[who]
    rows = table(spark, sf_dir, who).join(F.broadcast(table(spark, sf_dir, "nation")), F.col(nation) == F.col("n_nationkey"))
    text = F.concat(name, F.lit(" is located in "), "n_name", F.lit("."))
    return _one_sentence(rows, key, "located_in", F.col(name), F.col("n_name"), None, text)


def _one_sentence(rows: DataFrame, key: str, kind: str, subject, object_, value, text) -> DataFrame:
    value = F.lit(None).cast("string") if value is None else value
    return rows.select(
        F.col(key).cast("string").alias("source_id"),
        F.lit("unit-1").alias("unit_id"),
        F.lit(kind).alias("claim_type"),
        subject.alias("subject"),
        object_.alias("object"),
        value.alias("value"),
        F.lit("").alias("unit"),
        F.lit(True).alias("polarity"),
        F.lit(0).cast("long").alias("evidence_start"),
        F.length(text).cast("long").alias("evidence_end"),
        text.alias("evidence_text"),
    )


def judged(candidates: DataFrame) -> DataFrame:
    sources = candidates.select("source_id", F.col("evidence_text").alias("text"))
    units = candidates.select("source_id", "unit_id", F.col("evidence_start").alias("start_char"), F.col("evidence_end").alias("end_char"))
    return claims.validate_claims(candidates, sources, units)


@query("chinese_proposals", "SELECT c_custkey, 'located_in' AS claim_type, c_name_ AS subject, '城' || c_nationkey AS object, true AS polarity FROM (SELECT c_custkey, '客' || c_custkey AS c_name_, c_nationkey FROM customer)")
def chinese_proposals(spark, sf_dir):
    """Proposals by the marker rules from a sentence for each customer."""
    text = F.concat(F.lit("客"), "c_custkey", F.lit("位于城"), "c_nationkey", F.lit("。"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("clause"), F.lit(0).alias("evidence_start"))
    found = semantics.proposals(rows.withColumns(semantics.discourse(F.col("clause"))))
    return found.select("c_custkey", "claim_type", "subject", "object", "polarity")


@query("claim_validation_located", "SELECT c_custkey, 'accepted' AS status, 'EXACT_TYPED_LOCATION_MATCH' AS reason_code, 0::BIGINT AS match_start, (length(c_name) + length(n_name) + 15)::BIGINT AS match_end FROM customer JOIN nation ON c_nationkey = n_nationkey")
def claim_validation_located(spark, sf_dir):
    rows = judged(located_candidates(spark, sf_dir))
    span = F.col("matched_spans")[0]
    return rows.select(F.col("source_id").cast("long").alias("c_custkey"), "status", F.array_join("reason_codes", ",").alias("reason_code"), span["start"].cast("long").alias("match_start"), span["end"].cast("long").alias("match_end"))


def count_candidates(spark, sf_dir) -> DataFrame:
    """A sentence for each customer that says how many orders it has; every second claim is one too many."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey")
    text = F.concat("c_name", F.lit(" has a total of "), "n", F.lit(" orders."))
    claimed = (F.col("n") + F.col("c_custkey") % 2).cast("string")
    return _one_sentence(rows, "c_custkey", "count", F.col("c_name"), F.lit(""), claimed, text)


_COUNTED = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'EXACT_TYPED_COUNT_MATCH' ELSE 'NUMERIC_VALUE_MISMATCH' END AS reason_code FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


def _verdicts(rows: DataFrame, key: str) -> DataFrame:
    return judged(rows).select(F.col("source_id").cast("long").alias(key), "status", F.array_join("reason_codes", ",").alias("reason_code"))


@query("claim_validation_count", _COUNTED)
def claim_validation_count(spark, sf_dir):
    return _verdicts(count_candidates(spark, sf_dir), "c_custkey")


def date_candidates(spark, sf_dir) -> DataFrame:
    """A sentence for each order with its date; every third claim is a day late, every fifth sentence only a report."""
    day = F.to_date("o_orderdate")
    head = F.when(F.col("o_orderkey") % 5 == 0, "reportedly order").otherwise("order")
    text = F.concat(head, F.lit(" O"), "o_orderkey", F.lit("X date "), F.date_format(day, "yyyy-MM-dd"), F.lit("."))
    claimed = F.date_format(F.date_add(day, F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)), "yyyy-MM-dd")
    return _one_sentence(table(spark, sf_dir, "orders"), "o_orderkey", "date", F.concat(F.lit("O"), "o_orderkey", F.lit("X")), F.lit(""), claimed, text)


_DATED = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 5 = 0 THEN 'review' ELSE 'accepted' END AS status,
CASE WHEN o_orderkey % 3 = 0 THEN 'DATE_VALUE_MISMATCH' WHEN o_orderkey % 5 = 0 THEN 'MODAL_REPORTED_OR_QUESTION_ASSERTION' ELSE 'EXACT_TYPED_DATE_MATCH' END AS reason_code FROM orders"""


@query("claim_validation_date", _DATED)
def claim_validation_date(spark, sf_dir):
    return _verdicts(date_candidates(spark, sf_dir), "o_orderkey")


@query("reason_counts", f"SELECT 'count' AS claim_type, status, reason_code, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL UNION ALL SELECT 'date', status, reason_code, count(*) FROM ({_DATED}) GROUP BY ALL")
def reason_counts(spark, sf_dir):
    return claims.reason_counts(judged(count_candidates(spark, sf_dir)).unionByName(judged(date_candidates(spark, sf_dir))))


@query(
    "anomaly_overlap",
    f"""{DOC_LINES}, {_WINDOWS.strip()},
s AS (SELECT id, start_char, start_char + length(content) AS end_char FROM lines WHERE length(content) > 0)
SELECT s.id AS doc_id, s.start_char::BIGINT AS evidence_start, count(*) AS n_windows, min(w.window_no) AS first_window FROM s JOIN windows w ON s.id = w.doc_id AND s.start_char < w.start_char + length(w.w) AND w.start_char < s.end_char GROUP BY ALL""",
)
def anomaly_overlap(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).where("end_char > start_char").select("source_id", F.col("start_char").alias("evidence_start"), F.col("end_char").alias("evidence_end"))
    windows = anomaly.char_windows(doc_sources(spark, sf_dir), 800, 800, 240)
    areas = windows.select("source_id", "start_char", "end_char", F.lpad(F.col("window_no").cast("string"), 9, "0").alias("name"))
    out = semantics.overlapping(lines, areas).where(F.size("upstream") > 0)
    return named(out.select("source_id", "evidence_start", F.size("upstream").cast("long").alias("n_windows"), F.col("upstream")[0].cast("long").alias("first_window")))


def accepted_located(spark, sf_dir, who: str = "customer") -> DataFrame:
    return judged(located_candidates(spark, sf_dir, who)).where("may_index")


@query(
    "mentions",
    """SELECT c_custkey, 'subject' AS role, lower(c_name) AS normalized_surface, 'entity' AS inferred_type, 0::BIGINT AS start_char, length(c_name)::BIGINT AS end_char FROM customer
UNION ALL SELECT c_custkey, 'object', lower(n_name), 'place', (length(c_name) + 15)::BIGINT, (length(c_name) + 15 + length(n_name))::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def mentions(spark, sf_dir):
    found = entities.mentions(accepted_located(spark, sf_dir))
    return found.select(F.col("source_id").cast("long").alias("c_custkey"), "role", "normalized_surface", "inferred_type", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


@query("entity_components", "SELECT s_suppkey, s_name AS canonical_name, 'entity' AS entity_type, 1::BIGINT AS n_mentions FROM supplier UNION ALL SELECT s_suppkey, n_name, 'place', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def entity_components(spark, sf_dir):
    good = accepted_located(spark, sf_dir, "supplier")
    found = entities.mentions(good)
    merged, _ = entities.components(found, entities.identity_edges(found, good))
    out = entities.entities(found, merged)
    return out.select(F.col("source_id").cast("long").alias("s_suppkey"), "canonical_name", "entity_type", F.size("mention_ids").cast("long").alias("n_mentions"))


def made_facts(rows: DataFrame, kind: str, source, subject, object_, value, unit, polarity, order, marker=None) -> DataFrame:
    """Fact rows of one source from a table's columns."""
    text = F.lit(None).cast("string")
    return rows.select(
        order[1].cast("string").alias("fact_id"),
        F.lit(kind).alias("claim_type"),
        F.lit("generic_date" if kind == "date" else kind).alias("predicate_scope"),
        text.alias("subject_entity_id"),
        subject.cast("string").alias("subject"),
        text.alias("object_entity_id"),
        (F.lit("") if object_ is None else object_).cast("string").alias("object"),
        (text if value is None else value).cast("string").alias("value"),
        (F.lit("") if unit is None else unit).cast("string").alias("unit"),
        (F.lit(True) if polarity is None else polarity).alias("polarity"),
        F.lit(source).alias("source_id"),
        order[0].cast("long").alias("evidence_start"),
        order[0].cast("long").alias("evidence_end"),
        (F.lit("unspecified") if marker is None else marker).alias("temporal_marker"),
    )


def _disputes(rows: DataFrame, *keys: str) -> DataFrame:
    parts = F.split(F.replace("group", F.lit("surface:"), F.lit("")), "\\|")
    return entities.conflicts(rows).select(*(parts[i].alias(k) for i, k in enumerate(keys)), "conflict_type", "status", F.size("values").cast("long").alias("n_values"), F.size("fact_ids").cast("long").alias("n_facts"))


def date_facts(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return made_facts(orders, "date", "orders", F.col("o_custkey"), None, F.date_format("o_orderdate", "yyyy-MM-dd"), None, None, (F.col("o_orderkey"), F.col("o_orderkey")))


@query("conflict_dates", "SELECT o_custkey::VARCHAR AS subject, 'MULTIPLE_DATE_VALUES' AS conflict_type, 'unresolved' AS status, count(DISTINCT o_orderdate::DATE) AS n_values, count(*) AS n_facts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate::DATE) > 1")
def conflict_dates(spark, sf_dir):
    return _disputes(date_facts(spark, sf_dir), "subject")


def permission_facts(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    marker = F.when(F.col("value") > 90, "later").otherwise("unspecified")
    return made_facts(events, "permission", "events", F.col("user_id"), F.col("event_type"), None, None, F.col("value") > 50, (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)"), F.lpad(F.col("event_id").cast("string"), 12, "0")), marker)


_ALLOWED = """WITH e AS (SELECT *, value > 50 AS state, CASE WHEN value > 90 THEN 'later' ELSE 'unspecified' END AS marker FROM events),
l AS (SELECT *, lag(state) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM e),
g AS (SELECT user_id, event_type, count(DISTINCT state) AS states, count(*) AS n, bool_or(old IS NOT NULL AND old <> state) AND NOT bool_or(old IS NOT NULL AND old <> state AND marker <> 'later') AS supported FROM l GROUP BY ALL)"""


@query("conflict_permissions", f"{_ALLOWED} SELECT user_id::VARCHAR AS subject, event_type AS action, CASE WHEN supported THEN 'PERMISSION_POLARITY_TRANSITION' ELSE 'PERMISSION_POLARITY_CONFLICT' END AS conflict_type, CASE WHEN supported THEN 'resolved_temporal' ELSE 'unresolved' END AS status, states AS n_values, n AS n_facts FROM g WHERE states > 1")
def conflict_permissions(spark, sf_dir):
    return _disputes(permission_facts(spark, sf_dir), "subject", "action")


@query("conflict_counts", "SELECT l_orderkey::VARCHAR AS subject, lower(l_returnflag) AS unit, 'MULTIPLE_COUNT_VALUES' AS conflict_type, 'unresolved' AS status, count(DISTINCT l_quantity) AS n_values, count(DISTINCT l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity) AS n_facts FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1")
def conflict_counts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("long")
    name = F.concat_ws("-", "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", quantity)
    return _disputes(made_facts(items, "count", "lineitem", F.col("l_orderkey"), None, quantity, F.col("l_returnflag"), None, (F.col("l_linenumber"), name)), "subject", "unit")


@query("conflict_locations", "SELECT o_custkey::VARCHAR AS subject, 'MULTIPLE_LOCATIONS' AS conflict_type, 'unresolved' AS status, count(DISTINCT o_orderpriority) AS n_values, count(*) AS n_facts FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def conflict_locations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _disputes(made_facts(orders, "located_in", "orders", F.col("o_custkey"), F.col("o_orderpriority"), None, None, None, (F.col("o_orderkey"), F.col("o_orderkey"))), "subject")


@query(
    "reciprocal_defeats",
    """WITH p AS (SELECT DISTINCT 'p' || (l_partkey % 40) AS a, 'p' || (l_suppkey % 40) AS b FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40)
SELECT least(a, b) AS first_name, greatest(a, b) AS second_name, 'RECIPROCAL_DEFEATS_UNRESOLVED' AS conflict_type, 'unresolved' AS status, count(*) AS n_values, count(*) AS n_facts FROM p GROUP BY ALL HAVING count(*) > 1""",
)
def reciprocal_defeats(spark, sf_dir):
    side = lambda c: F.concat(F.lit("p"), F.col(c) % 40)
    pairs = table(spark, sf_dir, "lineitem").select(side("l_partkey").alias("a"), side("l_suppkey").alias("b")).where("a != b").distinct()
    rows = made_facts(pairs, "defeats", "lineitem", F.col("a"), F.col("b"), None, None, None, (F.lit(0), F.concat_ws("-", "a", "b")))
    return _disputes(rows, "first_name", "second_name")


@query("temporal_transition", f"{_ALLOWED} SELECT user_id, event_type, states, supported FROM g")
def temporal_transition(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", (F.col("value") > 50).alias("polarity"), F.when(F.col("value") > 90, "later").otherwise("unspecified").alias("temporal_marker"))
    return entities.temporal_transitions(events, ["user_id", "event_type"], "polarity", ["ts", "event_id"])


@query("timeline", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source_order FROM events")
def timeline(spark, sf_dir):
    rows = permission_facts(spark, sf_dir).withColumns({"source_id": F.col("subject"), "unit_id": F.lit("unit-1"), "value": F.col("fact_id")})
    out = entities.timeline(rows)
    return out.select(F.col("fact_id").cast("long").alias("event_id"), F.col("source_id").cast("long").alias("user_id"), F.col("source_order").cast("long"))


@query("ambiguity_groups", "SELECT lower(p_name) AS normalized_surface, count(DISTINCT p_brand) AS n_entities, count(*) AS n_mentions FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_brand) > 1")
def ambiguity_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    found = parts.select(F.lit("part").alias("source_id"), F.col("p_partkey").cast("string").alias("mention_id"), F.col("p_name").alias("surface"), F.lower("p_name").alias("normalized_surface"))
    merged = parts.select(F.lit("part").alias("source_id"), F.col("p_partkey").cast("string").alias("mention_id"), F.col("p_brand").alias("component"))
    brands = merged.select("source_id", "component", F.col("component").alias("entity_id")).distinct()
    out = entities.ambiguity_groups(found, merged, brands)
    return out.select("normalized_surface", F.size("entity_ids").cast("long").alias("n_entities"), F.size("mention_ids").cast("long").alias("n_mentions"))


@query("fact_status", f"{_ALLOWED} SELECT CASE WHEN states = 1 THEN 'canonical' WHEN supported THEN 'temporal_variant' ELSE 'contested' END AS canonical_status, sum(n)::BIGINT AS n FROM g GROUP BY ALL")
def fact_status(spark, sf_dir):
    rows = permission_facts(spark, sf_dir)
    out = entities.fact_status(rows, entities.conflicts(rows))
    return out.groupBy("canonical_status").agg(F.count("*").alias("n"))


@query(
    "referential_integrity",
    """SELECT 'lineitem.l_orderkey' AS reference, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS used, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS dangling
UNION ALL SELECT 'orders.o_custkey', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'labels.doc_id', (SELECT count(DISTINCT doc_id) FROM labels), (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""",
)
def referential_integrity(spark, sf_dir):
    out = None
    for used, column, known, key in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")):
        rows = table(spark, sf_dir, used)
        count = rows.agg(F.lit(f"{used}.{column}").alias("reference"), F.countDistinct(column).alias("used"))
        lost = store.dangling(rows, column, table(spark, sf_dir, known), key).agg(F.count("*").alias("dangling"))
        row = count.crossJoin(lost)
        out = row if out is None else out.unionByName(row)
    return out


def located_facts(spark, sf_dir, who: str = "customer") -> tuple[DataFrame, DataFrame]:
    """Canonical facts and entity names of the located-in sentences, as written tables."""
    good = cut(accepted_located(spark, sf_dir, who), "accepted")
    rows = good.select(
        F.concat(F.lit("fac_"), "source_id").alias("fact_id"), "result_id", "claim_type", F.lit("location").alias("predicate_scope"),
        F.concat(F.lit("ent_"), "subject").alias("subject_entity_id"), "subject", F.concat(F.lit("ent_"), "object").alias("object_entity_id"), "object",
        F.col("normalized_value").alias("value"), "unit", "polarity", "source_id", "unit_id", "evidence_start", "evidence_end",
        F.sha2("evidence", 256).alias("evidence_sha256"), F.col("evidence").alias("evidence_text"), F.lit("unspecified").alias("temporal_marker"), F.lit("canonical").alias("canonical_status"),
    )
    names = rows.select(F.explode(F.array(F.struct(F.col("subject_entity_id").alias("entity_id"), F.col("subject").alias("name")), F.struct(F.col("object_entity_id").alias("entity_id"), F.col("object").alias("name")))).alias("e"), "source_id")
    # a row for each source of a name: a nation's customers may be many
    names = names.select("e.entity_id", F.col("e.name").alias("canonical_name"), F.array("e.name").alias("aliases"), F.array("source_id").alias("source_ids")).distinct()
    return cut(retrieval.indexed_facts(rows), "facts"), cut(retrieval.entity_names(names), "entity-names")


def where_questions(spark, sf_dir, who: str = "customer") -> DataFrame:
    key, name = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name")}[who]
    rows = table(spark, sf_dir, who)
    return rows.select(F.col(key).cast("string").alias("question_id"), F.concat(name, F.lit("位于哪里？")).alias("question"), F.lit(None).cast("string").alias("source_filter"))


@query("question_intents", "SELECT c_custkey, 'located_in' AS predicate, 'object' AS requested_role, c_name AS subject, 'any' AS temporal_scope, true AS supported FROM customer")
def question_intents(spark, sf_dir):
    out = retrieval.intents(where_questions(spark, sf_dir))
    return out.select(F.col("question_id").cast("long").alias("c_custkey"), "predicate", "requested_role", "subject", "temporal_scope", "supported")


@query("typed_lookup", "SELECT c_custkey, n_name AS object, 'fac_' || c_custkey AS fact_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def typed_lookup(spark, sf_dir):
    facts, names = located_facts(spark, sf_dir)
    asked = retrieval.resolved(retrieval.intents(where_questions(spark, sf_dir)), retrieval.entity_names(names))
    hits = retrieval.lookup(asked, retrieval.indexed_facts(facts))
    return hits.select(F.col("question_id").cast("long").alias("c_custkey"), "object", "fact_id")


@query("answerability", "SELECT s_suppkey, 'answerable' AS answerability, 'TYPED_FACT_MATCH' AS reason_code FROM supplier")
def answerability(spark, sf_dir):
    facts, names = located_facts(spark, sf_dir, "supplier")
    out, _ = retrieval.answerability(retrieval.intents(where_questions(spark, sf_dir, "supplier")), facts, names)
    return out.select(F.col("question_id").cast("long").alias("s_suppkey"), "answerability", F.array_join("reason_codes", ",").alias("reason_code"))


_ANSWERS = "SELECT s_suppkey, 'answered' AS decision, concat(s_name, '位于', n_name, '。[E1]') AS answer_text, 'fac_' || s_suppkey AS fact_id, sha256(concat(s_name, ' is located in ', n_name, '.')) AS evidence_sha256 FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query("answers_citations", _ANSWERS)
def answers_citations(spark, sf_dir):
    """The flagship: sentences to claims, validated, made facts, and answered with a citation."""
    facts, names = located_facts(spark, sf_dir, "supplier")
    out = qa.answers(retrieval.intents(where_questions(spark, sf_dir, "supplier")), facts, names)
    cited = F.col("citations")[0]
    return out.select(F.col("question_id").cast("long").alias("s_suppkey"), "decision", "answer_text", cited["fact_id"].alias("fact_id"), cited["evidence_sha256"].alias("evidence_sha256"))


_TERMS = (("t1", "the"), ("t2", "que"), ("t3", "license"), ("t4", "und"))
_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in _TERMS) + ") v(term_id, term))"


def _terms(spark) -> DataFrame:
    return spark.createDataFrame(list(_TERMS), "term_id string, term string")


@query(
    "lexical_like",
    f"""WITH {_TERMS_SQL}, m AS (SELECT term_id, term, doc_id, text, row_number() OVER (PARTITION BY term_id ORDER BY doc_id::VARCHAR) AS rank FROM documents JOIN terms ON contains(lower(text), lower(term))),
p AS (SELECT *, strpos(text, term) - 1 AS pos FROM m WHERE rank <= 20)
SELECT term_id, rank, doc_id, greatest(0, pos - 80)::BIGINT AS evidence_start, least(length(text), pos + length(term) + 120)::BIGINT AS evidence_end, sha256(substr(text, greatest(0, pos - 80) + 1, least(length(text), pos + length(term) + 120) - greatest(0, pos - 80))) AS snippet_sha256 FROM p""",
)
def lexical_like(spark, sf_dir):
    out = retrieval.contains_hits(_units(spark, sf_dir), _terms(spark), 20)
    return named(out.select("term_id", "rank", "source_id", "evidence_start", "evidence_end", F.sha2("snippet", 256).alias("snippet_sha256")))


@query(
    "phrase_bm25",
    f"""WITH {_TERMS_SQL}, s AS (SELECT doc_id, lower(text) AS text, greatest(coalesce(length(text), 0) - 2, 0) AS size FROM documents),
t AS (SELECT count(*) AS n, avg(size) AS mean FROM s),
m AS (SELECT term_id, doc_id, size, (length(text) - length(replace(text, term, ''))) // length(term) AS tf FROM s JOIN terms ON contains(text, term)),
d AS (SELECT term_id, count(*) AS df FROM m GROUP BY term_id)
SELECT term_id, doc_id, tf, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean)), 6) AS score FROM m JOIN d USING (term_id), t""",
)
def phrase_bm25(spark, sf_dir):
    out = retrieval.phrase_bm25(_units(spark, sf_dir), _terms(spark))
    return named(out.select("term_id", "source_id", "tf", F.round("score", 6).alias("score")))


@query(
    "temporal_select",
    "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey",
)
def temporal_select(spark, sf_dir):
    """The past and the current state of each customer's orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    scopes = orders.withColumn("scope", F.explode(F.array(F.lit("past"), F.lit("current"))))
    ends = retrieval.temporal_ends(scopes, ["o_custkey", "scope"], ["o_orderdate", "o_orderkey"], F.col("scope"))
    return ends.groupBy("o_custkey").agg(*(F.max(F.when(F.col("scope") == scope, F.col("o_orderkey"))).alias(name) for scope, name in (("past", "first_order"), ("current", "last_order"))))


@query("date_refine", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders")
def date_refine(spark, sf_dir):
    """Each order's date as a month and as a day: the day refines the month."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.explode(F.array(F.substring(day, 1, 7), day)).alias("value"))
    rows = orders.withColumns({"predicate": F.lit("date"), "canonical_status": F.lit("compatible_variant")})
    return retrieval.most_precise_dates(rows).select(F.col("question_id").alias("o_orderkey"), "value")


@query(
    "reverse_relation",
    """WITH p AS (SELECT DISTINCT 'p' || (l_partkey % 40) AS a, 'p' || (l_suppkey % 40) AS b FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40)
SELECT n AS question_id FROM (SELECT 'p' || range AS n FROM range(60)) WHERE n IN (SELECT b FROM p)""",
)
def reverse_relation(spark, sf_dir):
    """Whom did each of sixty names defeat? Those that were defeated themselves are recorded the other way round."""
    side = lambda c: F.concat(F.lit("p"), F.col(c) % 40)
    pairs = table(spark, sf_dir, "lineitem").select(side("l_partkey").alias("a"), side("l_suppkey").alias("b")).where("a != b").distinct()
    facts = made_facts(pairs, "defeats", "lineitem", F.col("a"), F.col("b"), None, None, None, (F.lit(0), F.concat_ws("-", "a", "b"))).withColumn("canonical_status", F.lit("canonical"))
    asked = spark.range(60).select(F.concat(F.lit("p"), "id").alias("question_id"))
    asked = asked.select("question_id", F.concat("question_id", F.lit("击败了谁？")).alias("question"), F.lit(None).cast("string").alias("source_filter"))
    return gold.reverse_relations(retrieval.intents(asked), facts)


@query(
    "prefix_collisions",
    """WITH v AS (SELECT DISTINCT l_partkey, l_quantity::BIGINT::VARCHAR AS v FROM lineitem),
n AS (SELECT *, lead(v) OVER (PARTITION BY l_partkey ORDER BY v) AS after FROM v) SELECT l_partkey, count(*) AS collisions FROM n WHERE starts_with(after, v) GROUP BY l_partkey""",
)
def prefix_collisions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").cast("long").alias("value"))
    return gold.prefix_collisions(items, ["l_partkey"])


@query(
    "absence_not_negative",
    "SELECT u.user_id || '-' || t.event_type AS question_id FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)",
)
def absence_not_negative(spark, sf_dir):
    """May each user do each kind of event? Those never seen doing it are known, but nothing is recorded."""
    events = table(spark, sf_dir, "events")
    asked = events.select("user_id").distinct().crossJoin(events.select(F.col("event_type").alias("kind")).distinct())
    asked = asked.select(F.concat_ws("-", "user_id", "kind").alias("question_id"), F.lit("permission").alias("predicate"), F.col("user_id").cast("string").alias("subject_form"), F.regexp_replace("kind", "_", "").alias("object_form"))
    facts = permission_facts(spark, sf_dir).withColumn("canonical_status", F.lit("canonical"))
    return gold.absent_not_negative(asked, facts)


_CASES = "WITH c AS (SELECT l.doc_id, quality = 1 AS wanted, n_chars > 1000 AS given, quality = 1 AND n_chars > 1000 AS exact, (quality = 1) = (n_chars > 1000) AS decision, n_chars % 2 = 0 AS claim, n_chars % 3 > 0 AS cited FROM labels l JOIN documents d USING (doc_id))"


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {whole}) = 0 THEN 1 ELSE count(*) FILTER (WHERE {part}) / count(*) FILTER (WHERE {whole}) END"


@query(
    "gold_metrics",
    f"""{_CASES} SELECT {", ".join(f"round({_ratio(p, w)}, 6) AS {n}" for n, p, w in (
        ("exact_case_accuracy", "exact", "true"), ("decision_accuracy", "decision", "true"), ("answer_claim_accuracy", "wanted AND claim", "wanted"),
        ("citation_entailment_rate", "wanted AND cited", "wanted"), ("answer_precision", "wanted AND exact", "given"), ("answer_recall", "wanted AND exact", "wanted"),
        ("refusal_precision", "NOT wanted AND exact", "NOT given"), ("refusal_recall", "NOT wanted AND exact", "NOT wanted"),
        ("hallucination_rate", "(NOT wanted AND given) OR (wanted AND given AND NOT (claim AND cited))", "true")))},
  count(*) FILTER (WHERE NOT wanted AND given) AS overanswer_count, count(*) FILTER (WHERE wanted AND given AND NOT (claim AND cited)) AS wrong_answer_count, count(*) FILTER (WHERE wanted AND NOT cited) AS citation_mismatch_count FROM c""",
)
def gold_metrics(spark, sf_dir):
    """Labels as what is expected, lengths as what was given."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    rows = rows.select((F.col("quality") == 1).alias("wanted"), (n > 1000).alias("given"), (n % 2 == 0).alias("claim"), (n % 3 > 0).alias("cited"))
    w, g = F.col("wanted"), F.col("given")
    made = gold.metric_columns(w, g, ~g, w & g, w == g, F.col("claim"), F.col("cited"))
    return rows.agg(*((F.round(v, 6) if k.endswith(("accuracy", "rate", "precision", "recall")) else v).alias(k) for k, v in made.items()))


@query(
    "gold_coverage",
    """WITH c AS (SELECT CASE WHEN quality = 1 THEN 'answered' ELSE 'refused_unsupported' END AS d, 'p' || (doc_id % 6) AS p, CASE WHEN toxic = 1 THEN ['toxic', 'labelled'] ELSE ['labelled'] END AS tags FROM labels)
SELECT 'decision' AS kind, d AS name, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'predicate', p, count(*) FROM c WHERE d = 'answered' GROUP BY ALL
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM c) GROUP BY ALL""",
)
def gold_coverage(spark, sf_dir):
    return gold.coverage(_label_cases(table(spark, sf_dir, "labels")))


def _label_cases(labels: DataFrame) -> DataFrame:
    return labels.select(
        F.when(F.col("quality") == 1, "answered").otherwise("refused_unsupported").alias("expected_decision"),
        F.concat(F.lit("p"), F.col("doc_id") % 6).alias("expected_predicate"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.lit("labelled"))).otherwise(F.array(F.lit("labelled"))).alias("tags"),
    )


@query(
    "gold_gates",
    """WITH short(blocker) AS (VALUES ('COVERAGE_DECISION_REFUSED_AMBIGUOUS_BELOW_POLICY'), ('COVERAGE_DECISION_REFUSED_INSUFFICIENT_EVIDENCE_BELOW_POLICY'),
  ('COVERAGE_PREDICATE_ALIAS_BELOW_POLICY'), ('COVERAGE_PREDICATE_COUNT_BELOW_POLICY'), ('COVERAGE_PREDICATE_DATE_BELOW_POLICY'), ('COVERAGE_PREDICATE_DEFEATS_BELOW_POLICY'),
  ('COVERAGE_PREDICATE_LOCATED_IN_BELOW_POLICY'), ('COVERAGE_PREDICATE_PERMISSION_BELOW_POLICY'), ('COVERAGE_TAG_RELATION_DIRECTION_BELOW_POLICY'), ('COVERAGE_TAG_TEMPORAL_SCOPE_BELOW_POLICY'),
  ('COVERAGE_TAG_UNSUPPORTED_OPEN_PREDICATE_BELOW_POLICY'), ('COVERAGE_TAG_LEXICAL_DISTRACTOR_BELOW_POLICY'), ('COVERAGE_TAG_ABSENCE_NOT_NEGATIVE_BELOW_POLICY'))
SELECT blocker FROM short""",
)
def gold_gates(spark, sf_dir):
    """What labels that are all met miss of the smoke policy."""
    cases = _label_cases(table(spark, sf_dir, "labels"))
    yes = F.lit(True)
    results = cases.withColumns({"actual_decision": F.col("expected_decision"), "exact_pass": yes, "decision_correct": yes, "claim_correct": yes, "citations_correct": yes})
    return gold.gate_blockers(results, cases, gold.POLICIES["smoke"])


@query(
    "manifest_diff",
    """SELECT 'labels' AS table_name, 'MISSING' AS problem UNION ALL SELECT 'nation', 'CHANGED' UNION ALL SELECT 'region', 'UNEXPECTED'""",
)
def manifest_diff(spark, sf_dir):
    """A manifest of three tables against three others: one lacks, one differs, one is new."""
    tables = {t: table(spark, sf_dir, t) for t in ("benchmark", "nation", "labels", "region")}
    told = store.table_hashes({k: tables[k] for k in ("benchmark", "nation", "labels")})
    changed = tables["nation"].withColumn("n_name", F.when(F.col("n_nationkey") == 0, "X").otherwise(F.col("n_name")))
    found = store.table_hashes({"benchmark": tables["benchmark"].orderBy(F.desc("item_id")), "nation": changed, "region": tables["region"]})
    return store.manifest_differences(told, found)


@query("conversation_order", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE gap > 1) AS gaps FROM (SELECT conv_id, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations) GROUP BY conv_id")
def conversation_order(spark, sf_dir):
    """Turns as ordinals of their conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    gaps = structure.ordinal_continuity(turns, ["conv_id"], ["turn"], "turn")
    return gaps.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("issue") == "ORDINAL_GAP_CANDIDATE").alias("gaps"))
