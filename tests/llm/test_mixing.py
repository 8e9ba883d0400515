import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm.mixing import EPOCHS, SHARE, WEIGHTS, budgets, levels_of_documents, mix_documents, share_out


def test_share_out():
    assert share_out(10, [100, 100], [1, 4]) == [2, 8]
    assert share_out(10, [1, 100, 100], [8, 1, 1]) == [1, 5, 4]
    assert share_out(500, [100, 100], [1, 4]) == [100, 100]
    assert share_out(10, [100, 100], [1, 0]) == [10, 0]
    assert share_out(10, [4, 100], [1, 0]) == [4, 6]
    assert share_out(7, [], []) == []


def water(budget, room, weights):
    """The same law by another way: the level at which min(room, level * weight) adds up to the budget."""
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(r, level * w) for r, w in zip(room, weights, strict=True)) < budget else (low, level)
    return [min(r, low * w) for r, w in zip(room, weights, strict=True)]


def test_budgets_against_levels():
    """Budgets down a random tree within a token of the level that fills each node's children."""
    rng = random.Random(3)
    for _ in range(40):
        leaves = {(d, x, s): rng.randint(0, 400) for d in "ab" for x in ("en", "de", "fr") for s in ("s", "t") if rng.random() < 0.8}
        weights = {"domain": {"a": 3.0, "b": 1.0}, "language": {"en": 0.6, "de": 0.3}, "source": {"t": 0.5}}
        epochs = rng.randint(1, 3)
        budget = rng.randint(0, epochs * sum(leaves.values()))
        got = budgets(leaves, budget, weights, epochs)
        assert sum(got.values()) == budget and all(got[k] <= epochs * n for k, n in leaves.items())
        for depth, level in enumerate(("domain", "language", "source")):
            for head in {k[:depth] for k in leaves}:
                names = sorted({k[depth] for k in leaves if k[:depth] == head})
                part = [sum(v for k, v in got.items() if k[: depth + 1] == (*head, n)) for n in names]
                room = [epochs * sum(v for k, v in leaves.items() if k[: depth + 1] == (*head, n)) for n in names]
                want = water(sum(part), room, [weights[level].get(n, 1.0) for n in names])
                assert all(abs(p - w) < 1.01 for p, w in zip(part, want, strict=True)), (part, want)


def test_shortage_goes_to_siblings_first():
    leaves = {("a", "en", "s1"): 10, ("a", "de", "s1"): 1000, ("b", "en", "s1"): 1000}
    weights = {"domain": {"a": 1, "b": 1}, "language": {"en": 3, "de": 1}}
    got = budgets(leaves, 400, weights, 1)
    assert got == {("a", "en", "s1"): 10, ("a", "de", "s1"): 190, ("b", "en", "s1"): 200}
    got = budgets(leaves, 400, weights, 4)
    assert got[("a", "en", "s1")] == 40 and sum(got.values()) == 400
    assert sum(budgets(leaves, 9999, weights, 1).values()) == 2010


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (1.7, 2), (0.8, 1), (9.0, 3)])
def test_prefixes_are_the_longest_that_fit(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mix_documents(docs, levels_of_documents(), WEIGHTS, share, epochs)
    rows = out.select("domain", "language", "source", "n_tokens", "epochs", F.col("row.doc_id").alias("id")).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.domain, r.language, r.source), []).append(r)
    sums = {k: sum(r.n_tokens for r in v) for k, v in leaves.items()}
    want = budgets(sums, int(share * sum(sums.values())), WEIGHTS, epochs)
    place = out.select(F.col("row.doc_id").alias("id"), *(F.shiftrightunsigned(F.xxhash64(F.lit(1).cast("long"), F.lit(e).cast("long"), F.col("row.doc_id")), 1).alias(f"p{e}") for e in range(4)))
    place = {r.id: r for r in place.collect()}
    for leaf, members in leaves.items():
        part, rest = divmod(want[leaf], sums[leaf])
        left, taken = rest, set()
        for r in sorted(members, key=lambda r: (place[r.id][f"p{part}"], r.id)):
            if r.n_tokens > left or rest == 0:
                break
            left -= r.n_tokens
            taken.add(r.id)
        assert {r.id: r.epochs for r in members} == {r.id: part + (r.id in taken) for r in members}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "a b", "en", "s", 2), (2, "", "en", "src4", 3), (2, "", "en", "src4", 3)], "doc_id long, text string, lang string, source string, tokens int")
    out = mix_documents(docs, levels_of_documents(), WEIGHTS, 1.0, 1)
    assert sorted((r.domain, r.language, r.n_tokens, r.epochs) for r in out.collect()) == [("?", "?", 0, 0), ("?", "en", 2, 1), ("domain0", "en", 0, 0), ("domain0", "en", 0, 0)]
    assert mix_documents(docs.limit(0), levels_of_documents(), WEIGHTS, SHARE, EPOCHS).count() == 0
