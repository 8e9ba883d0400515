"""The trigram index against the full-text engine of the standard library's SQLite, and against plain loops."""

import random
import sqlite3

import numpy as np
import pytest

from quillspan.operators import lexindex, retrieval
from quillspan.operators.lexindex import add_units, find, numbers, positions_of, postings_of, scored, search, varints
from quillspan.sources.scratch import new_path

UNITS = "source_id string, unit_id string, start_char long, unit_text string"
TERMS = "question_id string, position int, term string, source_filter string"
WORDS = ["License", "LICENSE", "license", "Apache", "apache ", "青帝", "玄霄又称青帝", "É", "é", "ſ", "s", "aaa", "aaaa", "50%", "x_y", "\n", " ", "。", "ab", "AB", "𝒳𝒴𝒵", "K", "k", "the", "The "]


def some_units(seed, n):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(4)}", f"u{i}", i * 10, "".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(n)]
    return [*rows, ("s1", "long", 7, "aaaa license " * 3000), ("s0", "empty", 3, ""), ("s0", "none", 4, None), ("s2", "short", 5, "ab")]


def engine(units):
    """SQLite's FTS5 with its trigram tokenizer, rows in the order of their places."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(source_id UNINDEXED, unit_id UNINDEXED, text, tokenize='trigram')")
    db.execute("CREATE TABLE u (source_id, unit_id, start, text)")
    for source, unit, start, text in sorted(units, key=lambda u: (u[0], u[2], len(u[3] or ""), u[1])):
        db.execute("INSERT INTO f VALUES (?, ?, ?)", (source, unit, text or ""))
        db.execute("INSERT INTO u VALUES (?, ?, ?, ?)", (source, unit, start, text or ""))
    return db


def expected(db, terms, source, limit):
    """Phrases in their order, the best of all and then of the source; then what holds a term, by place."""
    rows, seen = [], set()
    for term in terms:
        found = db.execute("SELECT source_id, unit_id, text, bm25(f) AS r FROM f WHERE f MATCH ? ORDER BY r, rowid LIMIT ?", ('"' + term.replace('"', '""') + '"', limit)).fetchall() if len(term) > 2 else []
        for s, u, text, rank in found:
            if (s, u) not in seen and source in (None, s):
                seen.add((s, u))
                at = text.find(term)
                a, z = (max(0, at - 80), min(len(text), at + len(term) + 120)) if at >= 0 else (0, min(len(text), 240))
                rows.append((s, u, round(20 - rank, 6), text[a:z]))
    for term in terms:
        like = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        for s, u, text in db.execute("SELECT source_id, unit_id, text FROM u WHERE text LIKE ? ESCAPE '\\' AND (? IS NULL OR source_id = ?) ORDER BY rowid LIMIT ?", (like, source, source, limit)).fetchall():
            if (s, u) not in seen:
                seen.add((s, u))
                at = text.find(term)
                a, z = max(0, at - 80), min(len(text), at + len(term) + 120)
                rows.append((s, u, 10.0, text[a:z]))
    return rows[:limit]


QUESTIONS = [(["license", "Apache License"], None), (["LICENSE"], "s1"), (["青帝", "玄霄又称青帝"], None), (["aaa"], "s2"), (["aa"], None), (["ab", "é", "É。"], "s0"), (["50%", "x_y", "%", "a_b"], None), (["ſſſ", "sss"], None), (["𝒳𝒴"], "s3"), (["nowhere", "zq"], None), (["kkk", "The The"], None)]


@pytest.fixture(scope="module")
def index(spark):
    units = some_units(1, 300)
    path = new_path(spark, "lexical")
    add_units(spark.createDataFrame(units, UNITS).repartition(5), path)
    return path, units, engine(units)


def asked(spark, questions):
    return spark.createDataFrame([(str(q), i, t, source) for q, (terms, source) in enumerate(questions) for i, t in enumerate(terms)], TERMS)


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.question_id, []).append((r.source_id, r.unit_id, round(r.score, 6), r.evidence_text))
    return out


@pytest.mark.parametrize("limit", [3, 20, 100])
def test_rows_are_those_of_the_engine(spark, index, limit):
    path, _, db = index
    got = told(search(spark, path, asked(spark, QUESTIONS), limit).collect())
    for q, (terms, source) in enumerate(QUESTIONS):
        assert got.get(str(q), []) == expected(db, [t for t in terms if len(t) > 1], source, limit), terms


def test_many_terms_are_joined_and_find_the_same(spark, index, monkeypatch):
    path = index[0]
    few = told(search(spark, path, asked(spark, QUESTIONS), 20).collect())
    monkeypatch.setattr(lexindex, "FEW_TERMS", 0)
    assert told(search(spark, path, asked(spark, QUESTIONS), 20).collect()) == few


def test_occurrences_overlap_and_statistics_are_of_all_units(spark, index):
    path, units, db = index
    terms = [(t, t) for t in ("aaa", "license", "青帝玄", "Apache ", "ab")]
    found = find(spark, path, spark.createDataFrame(terms, "term_id string, term string")).collect()
    docs = {(r.segment, r.unit_no): (r.source_id, r.unit_id) for r in lexindex.docs_of(spark, path).collect()}
    plain = {(s, u): (t or "").replace("ſ", "s").replace("K", "k").lower() for s, u, _, t in units}
    for term, _ in terms:
        low = term.lower()
        want = {k: (sum(t.startswith(low, i) for i in range(len(t))), t.find(low)) for k, t in plain.items() if low in t}
        assert {docs[r.segment, r.unit_no]: (r.tf, r.at) for r in found if r.term_id == term} == want
    best = {docs[r.segment, r.unit_no]: r.bm25 for r in scored(spark, path, find(spark, path, spark.createDataFrame([("x", "license")], "term_id string, term string"))).collect()}
    assert best == pytest.approx({(s, u): -r for s, u, r in db.execute("SELECT source_id, unit_id, bm25(f) FROM f WHERE f MATCH '\"license\"'")})


def test_a_second_segment_is_as_one_index(spark, monkeypatch):
    """Added without a rebuild; pieces and blocks of any size give the same."""
    monkeypatch.setattr(lexindex, "PIECE_CHARS", 70)
    monkeypatch.setattr(lexindex, "BLOCK_UNITS", 7)
    units, path = some_units(2, 120), new_path(spark, "lexical")
    add_units(spark.createDataFrame([u for u in units if u[0] < "s2"], UNITS), path)
    add_units(spark.createDataFrame([u for u in units if u[0] >= "s2"], UNITS), path)
    add_units(spark.createDataFrame([], UNITS), path)
    got, db = told(search(spark, path, asked(spark, QUESTIONS), 20).collect()), engine(units)
    assert [got.get(str(q), []) for q in range(len(QUESTIONS))] == [expected(db, [t for t in terms if len(t) > 1], source, 20) for terms, source in QUESTIONS]


def test_a_segment_that_was_not_finished_is_not_read(spark, index, tmp_path):
    path, units, _ = index
    terms = spark.createDataFrame([("a", "license")], "term_id string, term string")
    before = sorted(map(tuple, find(spark, path, terms).collect()))
    spark.createDataFrame([(0, 1, 0, 1, b"\0\0", "broken")], f"{lexindex.POSTINGS}, segment string").write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    assert sorted(map(tuple, find(spark, path, terms).collect())) == before


def test_scans_read_the_terms_buckets_only(spark, index):
    plan = find(spark, index[0], spark.createDataFrame([("a", "license")], "term_id string, term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan


def test_long_phrases_by_the_thousand_trigrams(spark):
    """Joined, with groups of many rows each: none may be split, whatever the joins become at run time."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    units = [(f"s{k % 5}", f"u{k}", k, " ".join(rng.choice(words) for _ in range(120))) for k in range(200)]
    terms = [(str(k), u[3][k : k + 130].upper()) for k, u in enumerate(units[:60])] + [("none", "abc " * 40)]
    path = new_path(spark, "lexical")
    add_units(spark.createDataFrame(units, UNITS), path)
    docs = {(r.segment, r.unit_no): r.unit_id for r in lexindex.docs_of(spark, path).collect()}
    got = sorted((r.term_id, docs[r.segment, r.unit_no], r.tf, r.at) for r in find(spark, path, spark.createDataFrame(terms, "term_id string, term string")).collect())
    assert got == sorted((i, u, t.count(p.lower()), t.find(p.lower())) for i, p in terms for _, u, _, t in units if p.lower() in t) and len(got) >= 60


def test_codec():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 300, 200), rng.integers(0, 1 << 50, 200), [0, 127, 128, (1 << 56) - 1]])
    assert (numbers(varints(x)[0]) == x).all() and len(numbers(np.empty(0, np.uint8))) == 0
    unit, place, gram = rng.integers(0, 5, 300), rng.permutation(300), rng.integers(0, 7, 300)
    for g, n, payload in zip(*postings_of(unit, place, gram), strict=True):
        assert list(zip(*map(np.ndarray.tolist, positions_of(payload)), strict=True)) == sorted(zip(unit[gram == g].tolist(), place[gram == g].tolist(), strict=True)) and n == (gram == g).sum()


def test_folding_is_the_engines_for_the_letters_it_knows():
    """SQLite folds by an older version of Unicode; what it folds, we fold, in the blocks that both know."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='trigram')")
    known = [(a, b) for a, b in zip(*map(np.ndarray.tolist, lexindex.folding()), strict=True) if a < 0x370 or 0x391 <= a < 0x528 or 0x531 <= a < 0x560]
    for a, _ in known:
        db.execute("INSERT INTO f (rowid, text) VALUES (?, ?)", (a, f"q{chr(a)}z"))
    assert all((a,) in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (f'"q{chr(b)}z"',)).fetchall() for a, b in known)


def test_questions_search_an_index_or_units(spark, index):
    path, units, _ = index
    rows = [("q", "license", "", "alias", "who has a license", None), ("r", "青帝", "", "unsupported", "", "s1")]
    q = spark.createDataFrame(rows, "question_id string, subject string, object string, predicate string, question string, source_filter string")
    assert told(retrieval.lexical_hits(q, path, 5).collect()) == told(retrieval.lexical_hits(q, spark.createDataFrame(units, UNITS), 5).collect())
