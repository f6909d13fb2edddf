from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash

from laurel.llm import fmindex
from laurel.llm import substrings as sub

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    turn = lambda k: xxhash.xxh3_64_intdigest(rows[k][1] or "") if rows[k][0] is None else 0
    order = sorted(range(len(rows)), key=lambda k: (
        rows[k][0] is None, rows[k][0] or 0, turn(k), rows[k][1] or ""))
    first, out = set(), []
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            w = tuple(words[s:s + length])
            if w in first:
                gone[s:s + length] = [True] * length
            first.add(w)
        out.append((rows[k][0], len(words), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=str)


def run(spark, documents, rows, hot=sub.HOT):
    got = sub.remove_repeats(documents(rows), hot).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_words - len(r.kept.split())
    return sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=str)


@pytest.mark.parametrize("vocab,hot", [(2, sub.HOT), (5, 0), (60, sub.HOT), (60, 2)])
def test_against_brute_force(spark, documents, vocab, hot):
    rng = random.Random(vocab)
    make = lambda n: [f"w{rng.randrange(vocab)}" for _ in range(n)]
    base = [make(rng.randint(0, 150)) for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(50):
        words = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            at = rng.randint(0, max(0, len(b) - 1))
            words += b[at:at + rng.choice([5, 18, 19, 20, 21, 33, 60])] + make(rng.randint(0, 2))
        rows.append((100 + i, "  ".join(words) + "\n"))
    rows += [(3, " ".join(base[4])), (None, " ".join(base[5])), (None, " ".join(base[5])), (900, None),
             (901, ""), (902, "x " * 500), (903, "x\ty\n" * 90), (904, " ".join(base[1] * 3))]
    # many rows without an id, which repeat each other and others
    rows += [(None, " ".join(rng.choice(base)[:40] + make(2))) for _ in range(30)]
    rng.shuffle(rows)
    assert run(spark, documents, rows, hot) == brute(rows)


def test_corpus(spark, documents, corpus):
    assert run(spark, documents, corpus) == brute(corpus)


def test_many_copies(spark, documents):
    page = " ".join(f"p{i}" for i in range(120))
    rows = [(i, page) for i in range(200)] + [(500 + i, f"a{i} " + page + f" b{i}") for i in range(40)]
    assert run(spark, documents, rows) == brute(rows)


def test_index_against_counting():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    text[[80, 200, 399]] = 0
    index = fmindex.FMIndex(text, 5, 12)
    ends = np.array([e for e in range(12, 400) if not (text[e - 12:e] == 0).any()])
    matched, low, high = index.search(text, ends, 12)
    whole = text.tolist()
    count = lambda p: sum(whole[i:i + len(p)] == p for i in range(len(whole)))
    for e, m, a, b in zip(ends, matched, low, high):
        assert b - a == count(whole[e - m:e])
        longest = max([n for n in range(1, 13) if count(whole[e - n:e]) > 1], default=0)
        assert m == min(12, longest + 1)


def test_wavelet_rank():
    rng = np.random.default_rng(3)
    for symbols in (1, 2, 3, 37):
        values = rng.integers(0, symbols, 500)
        matrix = fmindex.WaveletMatrix(values, symbols)
        c, at = rng.integers(0, symbols, 300), rng.integers(0, 501, 300)
        want = [int((values[:i] == s).sum()) for s, i in zip(c, at)]
        assert matrix.rank(c, at).tolist() == want


def test_edges(spark, documents):
    assert sub.remove_repeats(documents([])).count() == 0
    extra = documents([(2, "a " * 30), (1, "a " * 30)]).selectExpr("*", "1 AS part", "2 AS shard")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in sub.remove_repeats(extra).collect())
    assert [g[:2] for g in got] == [(1, 30), (2, 30)] and got[1][2] == ""


def phrases(n, seed=1):
    """One phrase of twelve words among other words in every document; some repeat their text."""
    rng = random.Random(seed)
    phrase = " ".join(f"phrase{i}" for i in range(12))
    other = lambda k: " ".join(f"v{rng.randrange(10**6)}" for _ in range(k))
    rows = [(i, f"{other(15)} {phrase} {other(15)}") for i in range(n)]
    return rows + [(n + i, f"{other(3)} {rows[i][1]}") for i in range(0, n, 9)]


def test_a_phrase_in_every_document_is_spread(spark, documents):
    rows = phrases(700)
    sizes = []
    for hot in (10**9, 50):
        sent = pieces(rows, hot)
        sizes.append(max(sent.values()) / (sum(sent.values()) / len(sent)))
    assert sizes[0] > 4 > 2 > sizes[1]
    assert run(spark, documents, rows, 50) == brute(rows)


def pieces(rows, hot):
    """Rows that each shard gets, of the steps as the operator takes them in one process."""
    table = lambda part: pa.table({"doc_id": pa.array([r[0] for r in part], pa.int64()),
                                   "text": [r[1] for r in part]})
    shards, parts = 16, [rows[i::8] for i in range(8)]
    key = lambda i: (pa.scalar(i, pa.int32()),)
    named = pa.concat_tables([sub._name_anchors(shards)(key(i), table(p)) for i, p in enumerate(parts)])
    by = lambda t, c, v: t.filter(pa.compute.equal(t.column(c), v))
    shared = pa.concat_tables([sub._shared_names(hot)(key(s), by(named, "shard", s)) for s in range(shards)
                               if by(named, "shard", s).num_rows])
    got = {}
    for i, p in enumerate(parts):
        sent = sub._send(shards)(key(i), table(p), by(shared, "part", i))
        for s, n in zip(sent.column("shard").to_pylist(), sent.column("n").to_pylist()):
            got[s] = got.get(s, 0) + n
    return got
