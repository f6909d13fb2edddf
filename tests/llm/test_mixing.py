from __future__ import annotations

import random

from laurel.llm import mixing


def expected_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        open_ -= over


def test_targets_and_taken(spark, documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "a", "a", "b", "c", None, "Z"]))
            for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (5002, "tiny", "é")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 30 or s in ("empty", "é")


def test_rerun_and_order_do_not_matter(spark, documents):
    rows = [(i, "word " * (i % 37 + 1), f"s{i % 3}") for i in range(400)]
    first = sorted(map(tuple, mixing.mix(documents(rows)).collect()))
    again = sorted(map(tuple, mixing.mix(documents(rows[::-1]).repartition(7)).collect()))
    assert first == again


def test_edges(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    nothing = mixing.mix(documents([(1, None), (2, "  ")])).collect()
    assert [r.taken for r in nothing] == [0, 0]
    same = [(7, "a b c", "s")] * 4
    assert len(mixing.mix(documents(same)).collect()) == 4
    extra = documents([(1, "a b", "s"), (None, "c", None)]).selectExpr(
        "*", "1 AS size", "2 AS target", "3 AS _m")
    assert mixing.mix(extra).count() == 2
