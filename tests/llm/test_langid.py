import zlib

import numpy as np

from quillspan.llm import langid
from quillspan.llm.langid import Network, identify, in_known_language, op8_language_id, train


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"])
    letters, truth = rng.integers(97, 123, (5, 4)), np.array([0, 1, 2, 1])
    for part in (net.there, net.back):
        for name in part.names:
            setattr(part, name, getattr(part, name).astype(np.float64))

    def loss():
        p, _ = net.positions(letters)
        return -np.log(p[:, np.arange(4), truth]).sum()

    keep = ([], [])
    p, _ = net.positions(letters, keep)
    p[:, np.arange(4), truth] -= 1
    grad = p @ net.V.T
    there = net.there.backward(letters, keep[0], grad[:, :, : langid.HIDDEN])
    back = net.back.backward(letters[::-1], keep[1], grad[::-1, :, langid.HIDDEN :])
    for part, grads in ((net.there, there), (net.back, back)):
        for name, at in (("U", (3, 7)), ("U", (2, 2 * langid.HIDDEN + 8)), ("b", (langid.HIDDEN + 4,)), ("W", (int(letters[2, 1]), 5))):
            w = getattr(part, name)
            was, step = w[at], 1e-2
            w[at] = was + step
            up = loss()
            w[at] = was - step
            down = loss()
            w[at] = was
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def _plain_scores(net, text):
    """Each window by itself, a byte after the other, in plain Python."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size, total = len(text), np.zeros(len(net.languages))

    def states(part, read):
        h, out, k = np.zeros(langid.HIDDEN), [], langid.HIDDEN
        for byte in read:
            x, u = part.W[byte].astype(float) + part.b, h @ part.U.astype(float)
            z, r = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
            n = np.tanh(x[2 * k :] + r * u[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    for begin in range(0, size, langid.SPAN):
        end = min(begin + langid.SPAN, size)
        first, last = max(0, begin - langid.MARGIN), min(size, end + langid.MARGIN)
        there, back = states(net.there, text[first:last]), states(net.back, text[first:last][::-1])[::-1]
        for k in range(begin - first, end - first):
            e = np.exp(np.concatenate([there[k], back[k]]) @ net.V.astype(float) + net.c)
            total += e / e.sum()
    return total


def test_pooling_against_plain_loops():
    """Texts of no, one and several windows, multi-byte letters across their edges, all read whole and by themselves."""
    net = Network(["a", "b", "c"])
    texts = ["", "x", "été " * 300, "die Straße und so weiter, 12 km. " * 40, "字" * 400, "a" * langid.SPAN, "b" * (langid.SPAN + 1)]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = net.pooled(np.concatenate(data), offsets)
    want = np.array([_plain_scores(net, d) for d in data])
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3) and np.allclose(got.sum(axis=1), np.diff(offsets), rtol=1e-4)


def test_many_languages_and_ties(spark):
    """More languages than a few hundred are learned and predicted like any others; equal rows get equal results."""
    words = [chr(97 + k % 26) + chr(97 + k // 26) for k in range(230)]
    rows = [(k, f"{words[k % 230]} " * 20, f"l{k % 230:03}") for k in range(460)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, lang string")
    network = train(docs)
    assert len(network.known) == 230
    out = identify(docs, network).collect()
    assert len(out) == 462 and len({(r.lang_pred, r.score) for r in out if r.doc_id == 3}) == 1
    assert {r.lang_pred for r in out} <= set(network.known)


def test_held_out_accuracy_without_copies(spark):
    """Held-out documents of which no near copy was learned from."""
    from quillspan.llm.minhash import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    seen = {c for k, c in group.items() if not held(k)}
    langs = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in op8_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out and group[r.doc_id] not in seen]
    assert len(out) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) > 0.97


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = train(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 .. 34", "x"), (None, "der die das und nicht", "x"), (4, "the of and that " * 30000, "x"), (5, "— … ∞", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lettered string")
    got = {r.doc_id: r for r in identify(odd, network).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 5)] == ["und"] * 4 and got[4].lang_pred == "en" and got[3].score == 0
    kept = in_known_language(odd, network, 0.4)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 4}
    assert train(docs.limit(0)) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}
    assert identify(odd.limit(0), network).count() == 0


def test_states_stand_in_columns_and_large_sums_overflow_to_the_ends():
    rng = np.random.default_rng(5)
    own = langid.Direction(rng)
    letters = rng.integers(0, 256, (40, 7)).astype(np.uint8)
    text, at, running = letters.T.ravel(), np.arange(7) * 40, np.full(40, 7)
    for shift in (0, 500):
        own.b += shift * np.where(np.arange(3 * langid.HIDDEN) % 2, 1, -1).astype(np.float32)
        want = own.forward(letters)
        with np.errstate(all="raise", under="ignore"):
            for t, state in own.run(text, at, running, False):
                assert state.shape == (langid.HIDDEN, 7)
                np.testing.assert_allclose(state.T, want[t], atol=5e-6)
