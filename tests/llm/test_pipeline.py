import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm.fmindex import contamination
from quillspan.llm.minhash import near_duplicates


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns
        seen[name] = docs
    n = {k: v.count() for k, v in seen.items()}
    assert n["language_id"] > 990 > n["near_dedup"] >= n["decontaminate"] > n["mix"] > 0
    assert near_duplicates(seen["near_dedup"]).where("not kept").count() == 0
    assert contamination(seen["decontaminate"], spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*columns, "size", "text_crc32", "shard", "slot"]
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in seen["mix"].select("doc_id").collect())


def test_odd_documents(spark, tmp_path):
    sf = f"file://{tmp_path}"
    words = "the of and that this with from have were which would there their what about into more other some time"
    rows = [
        (1, words * 3, "en", "src1", 9, "x"),
        (1, words * 3, "en", "src1", 9, "x"),
        (2, words * 3, "en", None, None, None),
        (None, "il est des une dans pour avec les " * 30, None, "src2", 1, "y"),
        (4, None, "en", "src1", 0, "z"),
        (5, "", None, None, None, None),
        (6, "der die das und nicht mit von ein eine " * 4000, "de", "src3", 5, "q"),
        (7, "benchmark words one two three four five six seven eight nine ten eleven", "en", "src3", 5, "q"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    documents = spark.createDataFrame(rows, schema).withColumns({"tokens": F.lit(1), "shard": F.lit("s"), "epochs": F.lit(None).cast("int")})
    documents.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([1, 1, None, 6, 7], key=str)
    clean = corpus_pipeline.decontaminate(spark, docs, sf)
    assert 7 not in {r.doc_id for r in clean.collect()}
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == set(documents.columns) | {"size", "text_crc32", "slot"}
    assert {r.doc_id for r in out.collect()} <= {1, None, 6}
    empty = f"{sf}/empty"
    documents.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_unlearned_languages_go(spark):
    """Long texts in an unlearned language and of random letters go, short and shouted ones of known languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    random_letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(n))
    german = [r.text for r in docs.where("lang = 'de' and n_chars > 1000").collect()]
    known = docs.where("lang <> 'de'")
    planted = [(10**6 + k, t) for k, t in enumerate(german)] + [(2 * 10**6 + k, random_letters(2000)) for k in range(40)]
    planted += [(3 * 10**6, "The house."), (3 * 10**6 + 1, "la vie"), (3 * 10**6 + 2, "THE OF AND THAT THIS WITH FROM HAVE " * 20)]
    extra = spark.createDataFrame(planted, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "'p' AS source", "length(text) AS n_chars")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, known.unionByName(extra.select(known.columns)), "").select("doc_id").collect()}
    gone = lambda low: sum(low <= k < low + 10**6 and k not in kept for k, _ in planted)
    assert len(german) > 20 and gone(10**6) > 0.9 * len(german) and gone(2 * 10**6) == 40 and gone(3 * 10**6) == 0
    assert known.count() - sum(k < 10**6 for k in kept if k is not None) < 0.01 * known.count()
