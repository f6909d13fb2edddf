"""Pairwise tournament of a ranking's head (Bradley-Terry strengths).

A head has a stated size (sixty rows per job), so one task holds one head; many jobs run
in parallel. The pairs never leave that task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators.ranking import score_key

# fixed values: criteria with their weights, the share of draws, and when the rounds end
CRITERIA = {
    "jd_fit_score": 0.26, "rerank_score": 0.20, "retrieval_skill_count": 0.14,
    "jd_skill_match_count": 0.12, "assessment_mean_score": 0.12,
    "evidence_confidence_bonus": 0.05, "has_production_keywords": 0.04,
    "product_company_ratio": 0.04, "behavioural_composite": 0.03,
}
DRAW_PRIOR = 0.02
MAX_ROUNDS = 200
TOLERANCE = 1e-10


def win_totals(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected wins of each row against all others: a criterion is won by the larger
    value, a tie is half a win, and every match is pulled a little to a draw."""
    n = len(values)
    ordered = np.sort(values, axis=0)
    below = np.empty_like(values)
    upto = np.empty_like(values)
    for j in range(values.shape[1]):
        below[:, j] = np.searchsorted(ordered[:, j], values[:, j], side="left")
        upto[:, j] = np.searchsorted(ordered[:, j], values[:, j], side="right")
    wins = (below + 0.5 * (upto - below - 1)) @ weights
    return (1 - DRAW_PRIOR) * wins + DRAW_PRIOR * 0.5 * (n - 1)


def strengths(wins: np.ndarray) -> np.ndarray:
    """Minorise-maximise iteration for one match per pair, scaled to sum 1 each round."""
    n = len(wins)
    p = np.full(n, 1.0 / n)
    for _ in range(MAX_ROUNDS):
        meet = 1.0 / np.add.outer(p, p)
        fresh = wins / (meet.sum(axis=1) - np.diag(meet))
        fresh = fresh / fresh.sum()
        moved = np.abs(fresh - p).max()
        p = fresh
        if moved < TOLERANCE:
            break
    return p


def run_tournament(
    head: DataFrame, group: str = "jd_id", id_col: str = "candidate_id",
    criteria: dict[str, float] | None = None,
) -> DataFrame:
    """(group, id, tournament_score in 0..1) for the rows of each head. A head of one row,
    or no criteria at all, scores 0."""
    table = CRITERIA if criteria is None else criteria
    columns = [c for c in table if c in head.columns]
    if not columns:
        return head.select(group, id_col, F.lit(0.0).alias("tournament_score"))
    weights = np.array([table[c] for c in columns], dtype=float)
    weights = weights / weights.sum()

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        score = np.zeros(len(rows))
        if len(rows) > 1:
            p = strengths(win_totals(rows[columns].to_numpy(dtype=float), weights))
            spread = p.max() - p.min()
            if spread > 1e-12:
                score = (p - p.min()) / spread
        return rows[[group, id_col]].assign(tournament_score=score)

    schema = head.select(
        group, id_col, F.lit(0.0).cast("double").alias("tournament_score")
    ).schema
    # values that differ by rounding noise only are ties
    cols = [score_key(F.col(c)).cast("double").alias(c) for c in columns]
    return head.select(group, id_col, *cols).groupBy(group).applyInPandas(play, schema)
