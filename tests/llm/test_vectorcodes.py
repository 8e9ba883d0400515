import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from quillspan.llm import vectorcodes
from quillspan.llm.vectorcodes import Tree, encode_vectors, floors

SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int"


def naive(rows, parts=16, entries=64, rounds=2):
    """Plain loops over exact fractions: code, error and label_error by vec_id, and the digest."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = {i: [v[p * w : p * w + w] for p in range(parts)] for i, v, _ in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(p, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut.values():
                own.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    best = {i: [nearest(p, v[p]) for p in range(parts)] for i, v in cut.items()}
    error = {i: sum(d for d, _ in b) for i, b in best.items()}
    per = {}
    for i, _, label in kept:
        per[label] = per.get(label, 0) + error[i]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in best[i]), error[i], per[label], digest) for i, _, label in kept}


def coded(spark, rows, **more):
    out, _ = encode_vectors(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3), **more)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return {r.vec_id: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("spread", [3, 40, 1 << 40])
def test_tree_finds_the_nearest_with_the_lowest_index(seed, spread):
    """On a coarse grid equal distances abound; large coordinates need exact integers."""
    rng = np.random.default_rng([seed, spread])
    kind = object if spread > 1000 else np.int64
    entries, q = (rng.integers(-spread, spread, (n, 3)).astype(kind) for n in (64, 400))
    index, best = Tree(entries).nearest(q)
    d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == [min(range(64), key=lambda k: (row[k], k)) for row in d.tolist()]
    assert best.tolist() == d.min(axis=1).tolist()


def test_tree_prunes():
    """A well spread codebook is not searched whole."""
    entries = np.array([(x * 100, y * 100) for x in range(8) for y in range(8)])
    looked, plain = [0], Tree._squares
    tree = Tree(entries)
    tree._squares = lambda q, e: (looked.__setitem__(0, looked[0] + len(q)), plain(tree, q, e))[1]
    tree.nearest(np.random.default_rng(1).integers(0, 800, (1000, 2)))
    assert looked[0] < 40 * 1000


def test_floors_go_down_and_stay_exact():
    assert floors(np.array([-0.001, 0.001, -1 / 256, 0.999])).tolist() == [-1, 0, -1, 255]
    assert floors(np.array([1e300, -3e307, 1.7e308, 0.5])).tolist() == [int(1e300) * 256, int(-3e307) * 256, int(1.7e308) * 256, 128]


def test_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.1, 32).tolist(), [0, 1, None][i % 3]) for i in range(300)]
    rows += [(300 + i, rows[i % 5][1], 1) for i in range(40)]
    assert coded(spark, rows) == naive(rows)


def test_sums_beyond_64_bits_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 16) * (1e13 if i % 4 else 1e-2)).tolist(), i % 2) for i in range(90)]
    want = naive(rows, entries=8)
    got = coded(spark, rows, entries=8)
    fits = lambda x: x if x < 1 << 63 else None
    assert {i: (c, fits(e), d) for i, (c, e, _, d) in want.items()} == {i: (c, e, d) for i, (c, e, _, d) in got.items()}
    assert all(r[2] is None for r in got.values())


def test_odd_rows(spark):
    good = [(i, [float(i % 7)] * 16, 1) for i in range(5)]
    odd = [(10, None, 1), (11, [None] * 16, 1), (12, [math.nan] * 16, 2), (13, [math.inf] * 16, 2), (14, [1.0] * 17, 3), (15, [], 3), (None, [2.0] * 16, None)]
    got = coded(spark, good + odd)
    assert set(got) == {0, 1, 2, 3, 4, 14, 15, None}
    assert got[14][:3] == got[15][:3] == (None, None, None)
    assert got[None][:3] == ("02" * 16, 0, 0)
    repeated, _ = encode_vectors(spark.createDataFrame([(*r, "x", 7) for r in good + good], SCHEMA))
    assert sorted((r.vec_id, r.code) for r in repeated.collect()) == sorted(2 * [(i, f"{2 * i:02x}" * 16) for i in range(5)])


def test_nothing_to_code(spark):
    assert coded(spark, []) == {}
    assert {k: v[:3] for k, v in coded(spark, [(1, [1.0], 1), (None, [1.0] * 16, 2)]).items()} == {1: (None,) * 3, None: (None,) * 3}


def test_several_slices_a_batch(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.1, 16).tolist(), 0) for i in range(120)]
    want = coded(spark, rows)
    monkeypatch.setattr(vectorcodes, "SLICE", 64)
    assert coded(spark, rows) == want == naive(rows)
