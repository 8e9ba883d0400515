import random
import re

import numpy as np

from quillspan.llm.fmindex import FMIndex, Wavelet, contamination, suffix_order, without_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = set()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.add((doc, len(w), len(hit), tuple(sorted(found))))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "bb", "É1", "the", "of", "x-y"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 9, 10, 14]))) for i in range(12)] + [(90, ""), (91, None), (92, "...")]
    docs = [(i, text(rng.choice([0, 1, 9, 80]))) for i in range(40)]
    docs += [(100 + i, f"{text(4)}. {items[i % 12][1].upper()}! {text(3)} {items[0][1]}") for i in range(20)]
    docs += [(200, None), (None, items[2][1]), (201, items[4][1])] + [(300 + i, docs[45][1]) for i in range(5)]
    documents = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(documents, benchmark).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == brute(docs, items)
    for r in got:
        assert r.n_hit == sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))
    kept = without_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.n_hit)
    assert contamination(documents.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in contamination(documents, benchmark.limit(0)).collect()} == {0}


def test_index_parts():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 37, 500)
    wavelet = Wavelet(symbols, 6)
    at, want = rng.integers(0, 501, 300), rng.integers(0, 37, 300)
    assert wavelet.rank(want, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(want, at, strict=True)]
    text = [*rng.integers(1, 3, 60), 0]
    assert suffix_order(np.array(text)).tolist() == sorted(range(61), key=lambda i: text[i:])
    index = FMIndex(np.array([7, 7, 9, 7, 7, 9, 7], np.uint64), np.array([0, 3, 3, 7]))
    low, high = index.search(np.array([[0, 7, 9], [0, 9, 7], [7, 7, 9]], np.uint64), np.array([2, 2, 3]))
    assert (high - low).tolist() == [2, 1, 2]
    assert sorted(index.locate(np.arange(low[0], high[0]))) == [1, 6]


def test_benchmark_in_several_passes(spark, monkeypatch):
    """A benchmark over the bound of one pass, with an item that is over it alone."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["a", "bb", "É1", "the", "of", "x-y"]) for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 9, 10, 14]))) for i in range(20)] + [(90, ""), (91, None), (92, text(150))]
    docs = [(i, text(rng.choice([0, 1, 9, 80]))) for i in range(20)] + [(None, items[3][1]), (7, None)]
    cut = words(items[-1][1])
    docs += [(100 + i, f"zz {' '.join(cut[i : i + 12])} zz {items[i % 20][1]} {items[0][1]}") for i in range(0, 130, 3)]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(str, contamination(documents, benchmark).collect()))
    monkeypatch.setattr("quillspan.llm.fmindex.BENCHMARK_BYTES", 200)
    got = contamination(documents, benchmark).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == brute(docs, items)
    assert sorted(map(str, got)) == once
    kept = without_contaminated(documents, benchmark).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if not r.n_hit)
