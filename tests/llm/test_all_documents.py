"""Language identification learns from all documents, and is calibrated by all."""

from pyspark.sql import functions as F

from quillspan.llm import langid


def test_all_documents_are_learned_from(spark, monkeypatch):
    """a sample is only where learning begins; in each language most documents have words that none in the sample has."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(langid, "GROUP_DOCS", 150)
    rows = [(k, f"{'ka lo mi' if k % 2 else 'ze tu ba'} {k} " * 8, "xx" if k % 2 else "yy") for k in range(600)] + [(600, "12 34", "xx")]
    network = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert network.documents == 600
    told = langid.identify(spark.createDataFrame(rows[:40], "doc_id long, text string, lang string"), network).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in told)


def test_all_documents_calibrate(spark, monkeypatch):
    """the least score is a quantile of all held-out documents, not of a sample of them."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(langid, "LOST", 0.0)
    scores = {k: 0.9 - k / 10_000 for k in range(400)}
    monkeypatch.setattr(langid, "identify", lambda docs, _: docs.select(F.col("doc_id").cast("long").alias("doc_id"), (0.9 - F.regexp_extract("text", "[0-9]+", 0).cast("double") / 10_000).alias("score")))
    held = spark.createDataFrame([(k, "ab " * 100 + str(k), "xx") for k in range(400)] + [(k, f"abcd {k}", "xx") for k in range(400, 500)], "doc_id long, text string, lang string")
    least, slack = langid.calibrate(held, langid.Network(["xx"]))
    assert abs(least - min(scores.values())) < 1e-9
    below = sorted((least - (0.9 - k / 10_000)) * 4**0.5 for k in range(400, 500))
    assert abs(slack - below[99]) < 1e-9
