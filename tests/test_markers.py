"""Proposals: each slot is made once, and markers are found where every kind by itself would find them."""

import re

import pytest
from pyspark.sql import functions as F

from quillspan.operators import semantics


def proposed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, clause string").withColumn("evidence_start", F.lit(0))
    return semantics.proposals(rows.withColumns(semantics.discourse(F.col("clause"))))


def test_slots_are_made_once(spark):
    """no filter repeats the patterns of the slots, and none runs outside of compiled code."""
    plan = proposed(spark, "甲击败乙。")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [line for line in plan if re.match(r"\W*Filter ", line)]
    assert filters and not any("regexp_extract" in line or "RLIKE" in line for line in filters)
    assert not any("transform(" in line or "aggregate(" in line for line in plan if "Generate " in line)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("甲😀共有权乙", [("permission", "乙", 3, 5)]),
        ("据说😀，甲击败乙并且丙战胜丁", [("defeats", "乙", 5, 7), ("defeats", "丁", 11, 13)]),
        ("甲原名为乙。甲共有12名", [("alias", "乙", 1, 4), ("count", "12", 7, 9)]),
        ("", []),
    ],
)
def test_places_of_markers(spark, text, expected):
    rows = proposed(spark, text).orderBy("trigger_start").collect()
    assert [(r.claim_type, r.value or r.object, r.trigger_start, r.trigger_end) for r in rows] == expected
