from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from laurel.llm import simhash as sh


def plain_mark(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(corpus):
    for _, text in corpus + [(0, "ÀB c"), (1, "A\x0bB\x1cC D")]:
        assert sh.simhash(text) == plain_mark(text)


def test_codes_are_perfect():
    a = sh.Anchors()
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32)
    home = a.home(half)
    diff = half ^ home
    assert (np.bitwise_count(diff & np.uint32(0x7FFFFF)) <= 3).all()
    assert (np.bitwise_count(diff >> np.uint32(23) & np.uint32(0x7F)) <= 1).all()
    assert (diff >> np.uint32(30) == 0).all() and (a.home(home) == home).all()
    near = half ^ (np.uint32(1) << rng.integers(0, 32, 4000).astype(np.uint32))
    assert (a.within(near) == home[:, None]).any(axis=1).all()


def brute_components(marks):
    names = sorted(marks)
    label = {i: i for i in names}
    changed = True
    while changed:
        changed = False
        for i in names:
            for j in names:
                if (marks[i] ^ marks[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.fixture(scope="module")
def planted():
    """Fingerprints around a few centres, a chain, copies."""
    rng = random.Random(9)
    marks = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            flips = rng.sample(range(64), rng.randint(0, 4))
            marks[len(marks)] = centre ^ sum(1 << f for f in flips)
    x = rng.getrandbits(64)
    for step in range(0, 60, 3):
        x ^= 7 << step
        marks[len(marks)] = x
    for _ in range(120):
        marks[len(marks)] = rng.getrandbits(64)
    return marks


def test_links_and_components(spark, planted, monkeypatch):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for block in (8192, 20):
        monkeypatch.setattr(sh, "BLOCK", block)
        df = spark.createDataFrame([(signed(v),) for v in set(planted.values())], "fp long")
        label = {r.node: r.label for r in sh.components(sh.links(df)).collect()}
        got = {}
        for i, v in planted.items():
            got.setdefault(label.get(signed(v), signed(v)), set()).add(i)
        want = {}
        for i, name in brute_components(planted).items():
            want.setdefault(name, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, documents, corpus):
    rows = corpus + [(900, "".join(c.upper() if c < "a{" else c for c in corpus[0][1]))]
    got = {r.doc_id: r for r in sh.near_duplicates(documents(rows)).collect()}
    want = brute_components({i: plain_mark(t) for i, t in rows})
    assert {i: r.component_id for i, r in got.items()} == want


def test_edges(spark, documents):
    assert sh.near_duplicates(documents([])).count() == 0
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, "z y x w"), (5, None), (4, "")]
    extra = documents(rows).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS _fp")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in sh.near_duplicates(extra).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (4, 4), (5, 4)]
