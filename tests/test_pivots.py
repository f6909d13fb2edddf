from __future__ import annotations

import numpy as np
import pytest

from laurel.operators import pivots


def unit(x):
    x = np.asarray(x, float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Eight tight clusters, copies, and vectors without a direction."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    data = np.repeat(centres, 60, axis=0) + 0.05 * rng.normal(size=(480, 12))
    data[100:130] = data[99]
    data[200:210] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(480, None), (481, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = pivots.write_vectors(df, "id", "v", str(tmp_path_factory.mktemp("pivots")), 24)
    whole = np.vstack([data, np.zeros((2, 12))])
    asked = np.vstack([centres[:4], rng.normal(size=(3, 12)), np.zeros((1, 12)), -centres[:1], data[99:100]])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, v array<double>")
    return index, queries, unit(asked) @ unit(whole).T


@pytest.mark.parametrize("k", [1, 7, 40, 600])
def test_equals_the_full_comparison(table, k):
    index, queries, scores = table
    got, share = pivots.nearest(index, queries, "q", "v", k)
    found = {(r.q, r["rank"]): (r.id, round(r.score, 8)) for r in got.collect()}
    keys = np.floor(scores * 1e9 + 0.5)
    for q in range(len(scores)):
        order = np.lexsort((np.arange(scores.shape[1]), -keys[q]))[:k]
        mine = [found[q, n + 1] for n in range(len(order))]
        assert [m[1] for m in mine] == pytest.approx(scores[q][order].tolist(), abs=1e-7)
        # scores a rounding apart may change places
        same = {i: keys[q][i] for i in order}
        assert all(i == j or abs(same.get(i, keys[q][i]) - same[j]) <= 2 for (i, _), j in zip(mine, order))
    assert 0 < share <= 1 and (k > 40 or share < 0.8)


def test_groups_that_cannot_win_stay_closed(table):
    index, queries, _ = table
    near = queries.filter("q < 4")
    _, share = pivots.nearest(index, near, "q", "v", 5)
    assert share < 0.35


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = pivots.write_vectors(none, "id", "v", str(tmp_path / "n"))
    ask = spark.createDataFrame([(1, [1.0, 2.0])], "q long, v array<double>")
    assert pivots.nearest(index, ask, "q", "v")[0].count() == 0
    some = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 0.0])], "id long, v array<double>")
    index = pivots.write_vectors(some, "id", "v", str(tmp_path / "s"))
    assert pivots.nearest(index, ask.limit(0), "q", "v")[0].count() == 0
    assert [r.id for r in pivots.nearest(index, ask, "q", "v")[0].orderBy("rank").collect()] == [5, 6]
