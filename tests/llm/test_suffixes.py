from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from laurel.llm import suffixes as sx


def brute(rows, length=50):
    """Every window against the smallest id that holds it, byte by byte."""
    big = lambda i: float("inf") if i is None else i
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            first[w] = min(first.get(w, float("inf")), big(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < big(i):
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((-1 if i is None else i, len(b), int(np.diff(np.concatenate([[0], gone])).clip(0).sum())
                    if len(b) else 0, kept))
    return sorted(out, key=str)


def run(spark, documents, rows, hot=sx.HOT):
    got = sx.remove_repeats(documents(rows), hot).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept)
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept))
                   for r in got), key=str)




@pytest.mark.parametrize("seed,hot", [(1, sx.HOT), (2, sx.HOT), (3, 0), (4, 2)])
def test_against_brute_force(spark, documents, seed, hot, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(sx, "CHUNK_BYTES", 700)
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    base = [make(rng.randint(0, 400)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):  # pieces of others around the threshold, shifted, in any order
        t = ""
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(base)
            at = rng.randint(0, max(0, len(s) - 1))
            t += s[at:at + rng.choice([30, 44, 49, 50, 51, 120])] + make(rng.randint(0, 3))
        rows.append((100 + i, t))
    rows += [(7, base[3]), (500, "a" * 3000), (501, "a" * 51), (499, "ab" * 300), (502, None),
             (None, base[5]), (None, base[5]), (503, ""), (504, "é" * 400), (505, "é" * 30)]
    # many rows without an id, which repeat others
    rows += [(None, rng.choice(base)[:200] + make(3)) for _ in range(30)]
    rng.shuffle(rows)
    assert run(spark, documents, rows, hot) == brute(rows)


def test_corpus(spark, documents, corpus):
    assert run(spark, documents, corpus) == brute(corpus)


def test_many_copies(spark, documents):
    rng = random.Random(3)
    page = "".join(rng.choice("abcdef ") for _ in range(500))
    rows = [(i, page) for i in range(300)] + [(1000 + i, page[:200] + str(i) + page[200:]) for i in range(50)]
    got = {r[0]: r for r in run(spark, documents, rows)}
    assert len(got[0][3]) == 500 and all(got[i][3] == b"" for i in range(1, 300))
    assert sorted(got.values(), key=str) == brute(rows)


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    assert keys[sx.multikey_order(keys)].tolist() == sorted(keys.tolist())


def test_edges(spark, documents):
    assert sx.remove_repeats(documents([])).count() == 0
    extra = documents([(1, "x" * 80), (1, "x" * 80), (2, "x" * 80)]).selectExpr("*", "1 AS part", "2 AS kept")
    got = sorted((r.doc_id, len(r.kept)) for r in sx.remove_repeats(extra).collect())
    assert got == [(1, 80), (1, 80), (2, 0)]


def test_a_phrase_in_every_document_is_spread(spark, documents):
    rng = random.Random(1)
    other = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    phrase = "the phrase that every document has in it "
    rows = [(i, f"{other(60)}{phrase}{other(60)}") for i in range(700)]
    rows += [(700 + i, other(9) + rows[i][1][30:]) for i in range(0, 700, 9)]
    shares = []
    for hot in (10**9, 50):
        got = pieces(rows, hot)
        shares.append(max(got.values()) / sum(got.values()))
    assert shares[0] > 3 * shares[1] and shares[1] < 0.1, shares
    assert run(spark, documents, rows, 50) == brute(rows)


def pieces(rows, hot):
    """Rows that each bucket gets, of the steps as the operator takes them in one process."""
    table = lambda part: pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()),
                                   "text": [r[1] for r in part]})
    parts = [rows[i::8] for i in range(8)]
    texts = np.sort(np.array([sx.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0]), 1)[0, 0]
                              for _, t in rows], np.uint64))
    splitters = texts[:: len(texts) // 15]
    key = lambda i: (pa.scalar(i, pa.int32()),)
    named = pa.concat_tables([sx._name_anchors(splitters)(key(i), table(p)) for i, p in enumerate(parts)])
    by = lambda t, c, v: t.filter(pa.compute.equal(t.column(c), v))
    buckets = sorted(set(named.column("bucket").to_pylist()))
    shared = pa.concat_tables([sx._shared_names(hot)(key(b), by(named, "bucket", b)) for b in buckets])
    got = {}
    for i, p in enumerate(parts):
        sent = sx._send(splitters)(key(i), table(p), by(shared, "part", i))
        for b, n in zip(sent.column("bucket").to_pylist(), sent.column("n").to_pylist()):
            got[b] = got.get(b, 0) + n
    return got
