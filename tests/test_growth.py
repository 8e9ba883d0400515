"""Plans of queries whose rows are many times the bytes of the table that they are made of."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import lexindex, retrieval
from quillspan.plans import catalogue, story_queries
from quillspan.sources.scratch import cut

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["claim_envelopes", "claim_reasons"])
def test_claims_are_not_broadcast(spark, name):
    """small tables of keys become many claims, none of which may go through the driver."""
    assert "Broadcast" not in plan_of(catalogue.QUERIES[name](spark, SF))


@pytest.mark.parametrize("kind", ["keys", "lines"])
def test_keys_are_dealt(spark, kind):
    """One small file of keys makes work for all cores."""
    rows = story_queries.keys(spark, SF) if kind == "keys" else story_queries.lines_of(spark, SF, ["{k}", "{n}"], "x")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_few_payloads_of_long_terms(spark, tmp_path, monkeypatch):
    """of a long term only the payloads of its rarest trigrams are read; near misses at their places are no hits."""
    texts = ["ab " * 50 + "the Quick brown fox jumps", "the quick brown fax jumps", "THE QUICK BROWN FOX JUMPS, the quick brown fox jumps", "quick"]
    units = spark.createDataFrame([(str(k), "u", 0, t) for k, t in enumerate(texts)], "source_id string, unit_id string, start_char long, unit_text string")
    lexindex.add_units(units, f"{tmp_path}/index", "one")
    read = []
    monkeypatch.setattr(lexindex, "FEW_TERMS", 4)
    monkeypatch.setattr(lexindex, "cut", lambda df, name: read.append((name, df)) or cut(df, name))
    terms = spark.createDataFrame([("t", "the quick brown fox jumps"), ("s", "quick")], "term_id string, term string")
    found = lexindex.find(spark, f"{tmp_path}/index", terms).join(lexindex.docs_of(spark, f"{tmp_path}/index").select("segment", "unit_no", "source_id"), ["segment", "unit_no"])
    assert sorted((r.term_id, r.source_id, r.tf, r.at) for r in found.collect()) == [("s", "0", 1, 154), ("s", "1", 1, 4), ("s", "2", 2, 4), ("s", "3", 1, 0), ("t", "0", 1, 150), ("t", "2", 2, 0)]
    rare = next(df for name, df in read if name == "rare-grams")
    assert {r.term_id: r.n for r in rare.groupBy("term_id").agg(F.count("*").alias("n")).collect()} == {"t": lexindex.RAREST, "s": 2}


def test_few_terms_are_scanned(spark, monkeypatch):
    """for a handful of terms nothing is indexed."""
    monkeypatch.setattr(lexindex, "scratch_index", lambda units: pytest.fail("indexed"))
    units = spark.createDataFrame([("b", "u", 5, "xx Que que"), ("a", "u", 0, "QUE"), ("c", "u", 0, None)], "source_id string, unit_id string, start_char long, unit_text string")
    terms = spark.createDataFrame([("t", "que"), ("o", "q")], "term_id string, term string")
    got = retrieval.contains_hits(units, terms, 20).orderBy("rank").select("term_id", "rank", "source_id", "evidence_start", "evidence_end", "snippet").collect()
    assert [tuple(r) for r in got] == [("t", 1, "a", 0, 3, "QUE"), ("t", 2, "b", 5, 15, "xx Que que")]
