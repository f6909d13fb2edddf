from __future__ import annotations

import random
import zlib

import numpy as np

from laurel.llm import toxicity as tx


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    net = tx.Network(3)
    for k in net.w:
        net.w[k] = (net.w[k] + 0.05 * rng.standard_normal(net.w[k].shape)).astype(np.float64)
    words = tx.Words()
    ids = np.concatenate([tx.windows(words.number(tx.cut(t))) for t in
                          ("a bad day for all", "fine words here and there", "", "x")])
    rows, labels = words.rows(), np.array([1.0, 0, 0, 1])
    _, grads = net.gradients(rows, ids, labels)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, eps = net.w[k][at], 1e-4
        sides = []
        for step in (eps, -eps):
            net.w[k][at] = kept + step
            sides.append(net.gradients(rows, ids, labels)[0])
        net.w[k][at] = kept
        assert abs((sides[0] - sides[1]) / (2 * eps) - g[at]) < 2e-3 * max(1, abs(g[at])), k


def test_windows_cover_every_word():
    for n in (0, 1, 16, 47, 48, 49, 80, 81, 500):
        cut = tx.windows(np.arange(1, n + 1, dtype=np.int32))
        assert set(cut.ravel()) - {0} == set(range(1, n + 1)) and cut.shape[1] == tx.WINDOW


def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(700):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["wretch", "Vermin!!", "fiend", "zyx" + rng.choice(vocab)])
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy(spark, documents):
    data = rows()
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in data], "doc_id long, quality int, toxic int")
    extra = [(9000, ""), (9001, None), (9002, "word " * 60_000 + "wretch vermin wretch"), (9000, "")]
    docs = documents([(i, t) for i, t, _ in data] + extra).selectExpr("*", "1 AS score", "2 AS toxic")
    got = tx.score_documents(docs, labels).collect()
    assert len(got) == len(data) + 4
    by_id = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in data}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [i for i in truth if by_id[i].held_out]
    right = sum(by_id[i].predicted == truth[i] for i in held)
    assert right >= 0.9 * len(held)
    assert by_id[9000].score == by_id[9001].score < 0.3


def test_edges(spark, documents):
    kind = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], kind)
    assert tx.score_documents(documents([]), none).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (None, 0, None)], kind)
    got = tx.score_documents(documents([(1, "a"), (None, "b")]), one).collect()
    assert [r.score for r in got] == [0.0, 0.0] and sorted(r.held_out for r in got) == [False, False]
