"""Components by stars, and identity by components, against plain walks and whole sources."""

import random

import pytest

from quillspan.operators import entities
from quillspan.operators.connected import connected


def walked(edges):
    """The smallest node that each node reaches."""
    home = {}
    for s, a, b in edges:
        home.setdefault((s, a), a), home.setdefault((s, b), b)
    changed = True
    while changed:
        changed = False
        for s, a, b in edges:
            least = min(home[s, a], home[s, b])
            changed |= home[s, a] != least or home[s, b] != least
            home[s, a] = home[s, b] = least
    return home


def test_stars_reach_the_smallest_node(spark):
    """A long path in disorder, a hub, a ring, two sources with the same names, repeated and looped edges."""
    rng = random.Random(1)
    names = [f"n{k:03}" for k in rng.sample(range(300), 120)]
    edges = [("p", a, b) for a, b in zip(names, names[1:], strict=False)] + [("h", "m", f"x{k}") for k in range(80)] + [("r", f"{k:02}", f"{(k + 1) % 30:02}") for k in range(30)]
    edges += [("s", "m", "x1"), ("s", "x2", "x1"), ("s", "x2", "x1"), ("s", "z", "z2")]
    rows = connected(spark.createDataFrame([*edges, ("l", "o", "o")], "source_id string, a string, b string").repartition(5)).collect()
    assert {(r.source_id, r.node): r.home for r in rows} == walked(edges) and len(rows) == len(walked(edges))


def graph(seed):
    """Mentions of all types and edges of all kinds, with conflicts."""
    rng = random.Random(seed)
    found, edges = [], []
    for s in ("s1", "s2"):
        ids = [f"m{k:03}" for k in range(150)]
        found += [(s, m, rng.choice(["entity", "unknown", "actor", "place"] if rng.random() < 0.3 else ["entity", "unknown", "actor"])) for m in ids]
        for n in range(160):
            a, b = rng.sample(ids[: 150 if n % 2 else 60], 2)
            kind = rng.choice([0, 0, 1, 2, 3])
            edges.append((s, kind, n // 3, a, b, f"c{n}" if kind == 1 else ""))
    return found, edges


@pytest.mark.parametrize("seed", range(2))
def test_components_one_by_one_are_those_of_whole_sources(spark, monkeypatch, seed):
    found, edges = graph(seed)
    rows = spark.createDataFrame(found, "source_id string, mention_id string, inferred_type string"), spark.createDataFrame(edges, "source_id string, kind int, rank long, a string, b string, claim string")
    want = {}
    for s in ("s1", "s2"):
        own = sorted(e[1:] for e in edges if e[0] == s)
        named = {m for e in own for m in e[2:4]}
        homes, refused = entities.settle({m: t for x, m, t in found if x == s and m in named}, [(k, a, b, c) for k, _, a, b, c in own])
        want |= {(s, m): (m, ()) for x, m, _ in found if x == s} | {(s, m): (home, tuple(sorted(basis))) for m, (home, basis) in homes.items()}
        want[s] = sorted(map(str, refused))
    for most in (200_000, 10, 0):
        monkeypatch.setattr(entities, "SOURCE_EDGES", most)
        merged, blocked = entities.components(*rows)
        got = {(r.source_id, r.mention_id): (r.component, tuple(r.merge_basis)) for r in merged.collect()}
        for s in ("s1", "s2"):
            got[s] = sorted(str(tuple(r)[1:]) for r in blocked.where(f"source_id = '{s}'").collect())
        assert got == want and want["s1"]
