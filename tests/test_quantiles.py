from __future__ import annotations

import numpy as np
import pytest

from laurel.operators import ranking

PROBABILITIES = [0.0, 0.01, 0.5, 0.75, 0.9, 0.97, 1.0]


@pytest.mark.parametrize("name", ["uniform", "ties", "heavy", "tiny", "huge", "one", "signed zeros"])
def test_quantiles_are_exact(spark, name, monkeypatch):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.random(1001), "ties": rng.integers(0, 5, 700).astype(float),
        "heavy": np.exp(rng.normal(0, 40, 500)), "tiny": 1 + rng.random(200) * 1e-15,
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 5.0] * 9), "one": np.full(50, 3.25),
        "signed zeros": np.array([0.0, -0.0, 1.0, -1.0]),
    }[name]
    monkeypatch.setattr(ranking, "BUCKETS", 16)
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double")
    got = {r.probability: r.value for r in ranking.exact_quantiles(df, "v", PROBABILITIES).collect()}
    ordered = np.sort(values)
    for p in PROBABILITIES:
        at = p * (len(values) - 1)
        lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert got[p] == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12)


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert ranking.exact_quantiles(empty, "v", [0.5]).count() == 0


def test_no_row_moves(spark):
    """One sort or exchange of the rows would show in the stages' plans; a pass only aggregates."""
    df = spark.range(2000).selectExpr("CAST(id * 37 % 1999 AS double) AS v")
    known = df.selectExpr("v AS x")
    cells = ranking._cells(known, [(0.0, 1998.0)])
    assert sum(c.n for c in cells[0.0, 1998.0]) == 2000
    assert len(cells[0.0, 1998.0]) <= ranking.BUCKETS
