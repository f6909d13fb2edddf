"""Batch build: candidates and job texts to scored matrices."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators import explain, scoring
from laurel.operators.features import DEFAULT_AS_OF, feature_matrix
from laurel.operators.quality import apply_gates, gate_stats
from laurel.operators.retrieval import lexical_scores, retrieval_scores
from laurel.operators.tournament import run_tournament
from laurel.session import cut_lineage, materialise
from laurel.sources.candidates import corpus_text, rerank_text
from laurel.sources.tables import spread

RERANK_HEAD = 300
TOURNAMENT_HEAD = 60

# What scoring reads. A pool is multiplied by the number of jobs, so only these columns go
# through it; texts and display columns are joined to the rows of a head or a top-k.
SCORING = (
    "candidate_id", "is_honeypot", "gate_passed", "proxy_label", "ml_fit", "location_fit",
    "availability_score", "engagement_score", "behavioural_composite",
    "evidence_confidence_bonus", "jd_fit_score", "retrieval_skill_count",
    "jd_skill_match_count", "assessment_mean_score", "has_production_keywords",
    "product_company_ratio",
)


def gated_matrix(candidates: DataFrame, as_of: dt.date = DEFAULT_AS_OF, gates=None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    return apply_gates(feature_matrix(candidates, as_of, keep), gates)


def with_texts(candidates: DataFrame) -> DataFrame:
    """The two text projections, computed in the pass that reads the profiles."""
    return candidates.withColumns(
        {"corpus_text": corpus_text(), "rerank_text": rerank_text()}
    )


def per_job(matrix: DataFrame, jobs: DataFrame, retrieval: DataFrame,
            id_col: str = "candidate_id") -> DataFrame:
    """Every candidate for every job: the scoring columns, ``jd_id`` and the retrieval
    score (0 when absent).

    The scores of a candidate are folded into one small map (a job has one entry), so the
    matrix is joined once instead of once per job.
    """
    matrix = matrix.select(*[name for name in SCORING if name in matrix.columns])
    scores = retrieval.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("jd_id", "retrieval_score"))).alias("_m")
    )
    ids = jobs.agg(F.array_sort(F.collect_list("jd_id")).alias("ids")).scalar()
    return (
        matrix.join(scores, id_col, "left")
        .withColumn("_ids", ids)
        .withColumn("jd_id", F.explode("_ids"))
        .withColumn(
            "retrieval_score",
            F.coalesce(F.try_element_at("_m", "jd_id"), F.lit(0.0)),
        )
        .drop("_m", "_ids")
    )


def head_scores(
    scored: DataFrame, matrix: DataFrame, jobs: DataFrame, rerank_k: int = RERANK_HEAD,
    tournament_n: int = TOURNAMENT_HEAD,
) -> DataFrame:
    """(jd_id, candidate_id, rerank_score, tournament_score) of the head of each job.

    Only the head rows of ``scored`` go on; they fetch their text from the matrix.
    """
    head = cut_lineage(scoring.provisional_head(scored, rerank_k, group="jd_id"))
    # a head has a fixed size and is replicated; the texts stay where they are
    texts = matrix.select("candidate_id", "rerank_text").join(
        F.broadcast(head.select("candidate_id", "jd_id")), "candidate_id"
    )
    rerank = cut_lineage(
        lexical_scores(texts, jobs, "candidate_id", "rerank_text", "jd_id", "text")
    )
    keys = ["jd_id", "candidate_id"]
    ranked = head.join(rerank.withColumnRenamed("score", "rerank_score"), keys)
    top = ranked.filter(F.col("head_rank") <= tournament_n)
    played = run_tournament(top)
    return rerank.withColumnRenamed("score", "rerank_score").join(
        played, keys, "left"
    ).withColumn("tournament_score", F.coalesce("tournament_score", F.lit(0.0)))


def with_head_scores(scored: DataFrame, heads: DataFrame) -> DataFrame:
    """Head scores back on all rows, 0 outside the head."""
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    return scored.join(heads, ["jd_id", "candidate_id"], "left").withColumns({
        "rerank_score": zero("rerank_score"), "tournament_score": zero("tournament_score"),
    })


class RankingError(ValueError):
    """A ranking was asked for that cannot be given."""


class Scored(NamedTuple):
    """``scores``: one row per job and candidate with ``final_score``. ``matrix``: one row
    per candidate with everything else."""

    scores: DataFrame
    matrix: DataFrame


def build_scored(
    candidates: DataFrame, jobs: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
    accuracy: bool = True, code: str = "crc32", model=None,
) -> Scored:
    """Scores of every job and candidate, with the matrix they were made from."""
    matrix = materialise(
        gated_matrix(with_texts(candidates), as_of, keep=("corpus_text", "rerank_text")),
        "matrix",
    )
    retrieval = materialise(
        retrieval_scores(
            spread(matrix.select("candidate_id", "corpus_text")), jobs, "candidate_id",
            "corpus_text", "jd_id", "text", code=code,
        ),
        "retrieval",
    )
    fitted = scoring.with_fit(scoring.with_proxy_label(matrix), model)
    scored = per_job(fitted, jobs, retrieval)
    if accuracy:
        heads = materialise(head_scores(scored, matrix, jobs), "heads")
        scored = with_head_scores(scored, heads)
    return Scored(scoring.with_final_score(scored), matrix)


def explained_top(scored: Scored, k: int = 100) -> DataFrame:
    """The first ``k`` of every job with matrix columns and reasoning. The matrix stays where it is:
    the first ``k`` are replicated."""
    best = explain.rank_candidates(scored.scores, k, "jd_id").select(
        "jd_id", "candidate_id", "rank", "final_score"
    )
    shown = scored.matrix.drop("corpus_text", "rerank_text").join(
        F.broadcast(best), "candidate_id"
    )
    return explain.with_reasoning(shown, "jd_id")


def rank(scored: Scored, k: int = 100) -> DataFrame:
    """The explained output table of every job."""
    return explain.output_table(explained_top(scored, k), k, "jd_id")


class Answer(NamedTuple):
    """``rows``: the explained top of every job; ``gates``: counts of the gates over the pool;
    ``coverage``: how far the pool covers what the jobs need, and where widening stopped."""

    rows: DataFrame
    gates: DataFrame
    coverage: DataFrame


def rank_pool(
    matrix: DataFrame, jobs: DataFrame, retrieval: DataFrame, k: int = 100, model=None,
    heads: DataFrame | None = None,
) -> Answer:
    """Rank the rows of ``matrix`` and nothing else: the fit is scaled over them. ``retrieval`` may
    hold scores of a larger pool; rows that it does not know have 0."""
    fitted = scoring.with_fit(scoring.with_proxy_label(matrix), model)
    scored = per_job(fitted, jobs, retrieval)
    if heads is not None:
        scored = with_head_scores(scored, heads)
    final = scoring.with_final_score(scored)
    levels = scoring.coverage_levels(matrix, target=k)
    return Answer(
        rank(Scored(final, matrix), k), gate_stats(matrix), scoring.coverage_result(levels)
    )


def rank_subset(
    matrix: DataFrame, ids: DataFrame, jobs: DataFrame, retrieval: DataFrame, k: int = 100,
    model=None, heads: DataFrame | None = None,
) -> Answer:
    """Rank the candidates named in ``ids`` from a stored matrix. Retrieval scores are those of the
    full pool; the fit is scaled over the subset. Unknown ids are left out; when none is known there
    is nothing to rank, which is an error."""
    pool = matrix.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    pool = materialise(pool, "subset")
    if pool.isEmpty():
        raise RankingError("none of the requested candidate ids is known")
    return rank_pool(pool, jobs, retrieval, k, model, heads)


def rank_adhoc(
    candidates: DataFrame, jobs: DataFrame, k: int = 100, as_of: dt.date = DEFAULT_AS_OF,
    code: str = "crc32", model=None,
) -> Answer:
    """Rank profiles that no matrix knows: features, gates and texts are built for them, and they are
    retrieved among themselves."""
    scored = build_scored(candidates, jobs, as_of, accuracy=False, code=code, model=model)
    levels = scoring.coverage_levels(scored.matrix, target=k)
    return Answer(rank(scored, k), gate_stats(scored.matrix), scoring.coverage_result(levels))
