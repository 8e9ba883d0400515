import random
import re

from quillspan.llm.substrings import drop_repeated_spans


def brute(rows):
    """Sentences by a scan of words; runs as tuples of words."""
    docs = {}
    for doc, text in rows:
        words = [(m[0].lower(), m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        cuts, start = [], 0
        for k, (w, at) in enumerate(words):
            gap = text[at + len(w) : words[k + 1][1]] if k + 1 < len(words) else "\n"
            if w[-1] in ".!?" or "\n" in gap:
                cuts.append((start, k + 1))
                start = k + 1
        runs = []
        for i in range(len(cuts)):
            j = next((j for j in range(i + 2, len(cuts) + 1) if cuts[j - 1][1] - cuts[i][0] >= 20), None)
            if j:
                runs.append((i, j, tuple(w for w, _ in words[cuts[i][0] : cuts[j - 1][1]])))
        docs[doc] = text, words, cuts, runs
    first = {}
    for doc in sorted(docs):
        for i, _, key in docs[doc][3]:
            first.setdefault(key, (doc, i))
    out = set()
    for doc, (text, words, cuts, runs) in docs.items():
        gone = {s for i, j, key in runs if first[key] != (doc, i) for s in range(i, j)}
        edges = [words[a][1] for a, _ in cuts] + [len(text)]
        kept = text[: edges[0]] + "".join(text[edges[s] : edges[s + 1]] for s in range(len(cuts)) if s not in gone)
        out.add((doc, len(cuts), len(gone), kept))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "!", "?", "\n"])
    passages = [" ".join(sentence(rng.randint(3, 18)) for _ in range(6)) for _ in range(5)]
    rows = []
    for d in range(80):
        parts = [" ".join(sentence(rng.randint(1, 15)) for _ in range(rng.randint(0, 6))) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((d, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, ""), (202, "one two"), (203, passages[0] + " " + passages[0])]
    out = drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_odd_rows(spark):
    text = "One two three four five six seven eight nine ten eleven. " * 2
    rows = [(None, text, 1), (1, text, 2), (1, text, 2), (2, None, 3)]
    out = drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, version int"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 2, 0, text), (1, 2, 2, ""), (1, 2, 2, ""), (2, 0, 0, None)], key=str)
    assert drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_few_whole_sentences(spark):
    """Passages of 50 to 120 words with 0, 1 or 2 whole sentences inside, glued to what surrounds them."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    rows, planted = [], []
    for whole in (0, 1, 2):
        for _ in range(40):
            passage = words(rng.randint(50, 120))
            for end in sorted(rng.sample(range(10, len(passage) - 10), whole + 1 if whole else rng.randint(0, 1))):
                passage[end] += rng.choice([".", '."', "!)", "。"])
            planted.append(set(passage))
            for k in range(2):
                around = [words(rng.randint(0, 40)) for _ in range(2)]
                rows.append((2 * len(planted) + k, " ".join(around[0] + passage + around[1])))
    out = {r.doc_id: r for r in drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, passage in enumerate(planted):
        first, second = 2 * k + 2, 2 * k + 3
        assert out[first].text == dict(rows)[first] and out[first].n_removed == 0
        kept = out[second].text.split()
        assert out[second].n_removed > 0 and sum(w in passage for w in kept) < len(passage)
        assert set(dict(rows)[second].split()) - passage <= set(kept)
    stay = sum(w in p for k, p in enumerate(planted) for w in out[2 * k + 3].text.split())
    assert stay < 0.3 * sum(map(len, planted))


def test_texts_without_ascii_ends(spark):
    rng = random.Random(6)
    signs = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
    chinese = "。".join(signs(12) for _ in range(6)) + "。"
    symbols = " ".join(f"{signs(1)}x{rng.randint(0, 10**6)}®" for _ in range(60))
    texts = [signs(30) + chinese + signs(30), signs(7) + chinese + signs(9), "to " * 90, "he " + "to " * 60, f"a list {symbols} of words", f"another {symbols} one"]
    out = {r.doc_id: r.text for r in drop_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == texts[0] and out[4] == texts[4]
    assert len(out[1]) < 50 and out[3] == "he " and len(out[5]) < 0.4 * len(texts[5])
