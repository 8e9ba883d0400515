import random
import re

from quillspan.llm.components import components
from quillspan.llm.minhash import near_duplicates


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
        sets[doc] = runs if words else set()
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in docs}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgÉß") for _ in range(rng.randint(1, 12)))
    rows, n = [], 0
    for _ in range(60):
        words = [word() for _ in range(rng.choice([1, 3, 4, 5, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(copy).swapcase() if rng.random() < 0.3 else " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_same_components_as_brute_force(spark):
    rows = corpus()
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_many_near_copies_below_and_above(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((d, " ".join(copy)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n ", 7), (None, "a b c d e f", 7), (5, "a b c d e f", 7), (5, "a b c d e f", 7), (6, "A B C D E F", 7)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long"))
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (300, 299), (300, 301), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 300: 299, 301: 299}
