"""conflicts of stories, and of facts of every type."""

from quillspan.operators import entities
from quillspan.plans import story_queries

from .test_disk import left_by, one_customer  # noqa: F401


def test_conflicts_leave_only_themselves(spark, one_customer):  # noqa: F811
    """F2."""
    rows, left = left_by(spark, story_queries.story_conflicts)
    assert sorted(map(tuple, rows)) == [(7, "COUNT_TEMPORAL_TRANSITION", "resolved_temporal", 2), (7, "MULTIPLE_COUNT_VALUES", "unresolved", 2)] and left == ["conflicts"]


def test_facts_are_read_once_for_all_conflicts(spark):
    """groups of every type come from one look at the facts."""
    schema = (
        "fact_id string, claim_type string, predicate_scope string, subject_entity_id string, subject string, object_entity_id string, object string, value string, unit string, "
        "polarity boolean, source_id string, evidence_start long, evidence_end long, temporal_marker string"
    )
    fact = lambda n, kind, value, marker="unspecified", **more: (str(n), kind, "birth_date" if kind == "date" else kind, None, more.get("s", "甲"), None, more.get("o", ""), value, "", more.get("p", True), "s", n, n + 1, marker)
    rows = [
        fact(0, "count", "3"), fact(1, "count", "4", "later"), fact(2, "date", "2021"), fact(3, "date", "2021-03"), fact(4, "permission", None, o="x"), fact(5, "permission", None, o="x", p=False),
        fact(6, "defeats", None, o="乙"), fact(7, "defeats", None, s="乙", o="甲"), fact(8, "located_in", None, o="城"), fact(9, "alias", None, o="丙"), fact(10, "count", "9", s="丁"),
    ]
    found = entities.conflicts(spark.createDataFrame(rows, schema))
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert sorted((r.conflict_type, r.severity, r.status, tuple(r.fact_ids)) for r in found.collect()) == [
        ("COUNT_TEMPORAL_TRANSITION", "info", "resolved_temporal", ("0", "1")),
        ("DATE_PRECISION_REFINEMENT", "info", "resolved_precision", ("2", "3")),
        ("PERMISSION_POLARITY_CONFLICT", "review", "unresolved", ("4", "5")),
        ("RECIPROCAL_DEFEATS_UNRESOLVED", "review", "unresolved", ("6", "7")),
    ]
