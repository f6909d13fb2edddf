"""The whole batch build on shaped profiles."""

from __future__ import annotations

import pytest
from conftest import STUFFER, UNUSED_EXPERT, profile, skill

from laurel.operators.sampling import graded_sample
from laurel.plans import build
from laurel.plans.build import build_scored, rank


def test_build_and_rank(spark, candidates_of):
    strong = [profile(n, skills=[skill("Vector Search"), skill("BM25"), skill("Python")],
                      github_activity_score=float(n)) for n in range(1, 6)]
    weak = [profile(n, title="Graphic Designer", skills=[skill("Photoshop")])
            for n in range(6, 9)]
    traps = [profile(9, **STUFFER), profile(10, **UNUSED_EXPERT)]
    jobs = spark.createDataFrame(
        [(1, "vector search and bm25 ranking engineer"), (2, "python production ranking")],
        "jd_id long, text string")
    scored = build_scored(candidates_of(*strong, *weak, *traps), jobs)
    rows = rank(scored, 100).collect()
    for jd in (1, 2):
        mine = sorted((r for r in rows if r["jd_id"] == jd), key=lambda r: r["rank"])
        ids = [int(r["candidate_id"][-7:]) for r in mine]
        assert 10 not in ids and len(ids) == 9  # impossible profiles never appear
        assert set(ids[:5]) == {1, 2, 3, 4, 5}
        assert mine[-1]["score"] == 0.0 and ids[-1] == 9  # gated rows stay, with score 0
        assert len({r["reasoning"] for r in mine}) == len(mine)
    plain = build_scored(candidates_of(*strong, *weak, *traps), jobs, accuracy=False)
    assert "rerank_score" not in plain.scores.columns and plain.scores.count() == 20


def people():
    strong = [profile(n, skills=[skill("Vector Search"), skill("BM25"), skill("Python")],
                      github_activity_score=float(n)) for n in range(1, 6)]
    weak = [profile(n, title="Graphic Designer", skills=[skill("Photoshop")]) for n in range(6, 9)]
    return [*strong, *weak, profile(9, **STUFFER), profile(10, **UNUSED_EXPERT)]


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame([(1, "vector search and bm25 ranking engineer")], "jd_id long, text string")


def test_subset_keeps_the_pool_scores_and_scales_the_fit(spark, candidates_of, jobs):
    whole = build_scored(candidates_of(*people()), jobs, accuracy=False)
    retrieval = whole.scores.select("jd_id", "candidate_id", "retrieval_score")
    ids = spark.createDataFrame([(f"CAND_{n:07d}",) for n in (2, 7, 9, 10, 99)] * 2, "candidate_id string")
    answer = build.rank_subset(whole.matrix, ids, jobs, retrieval, 100)
    rows = {int(r["candidate_id"][-7:]): r for r in answer.rows.collect()}
    assert set(rows) == {2, 7, 9} and rows[2]["rank"] == 1
    gates = answer.gates.first()
    assert (gates["total"], gates["honeypots"]) == (4, 1)
    assert answer.coverage.first()["pool_size"] <= 4
    # alone in the pool, a fit has nothing to be scaled against
    one = build.rank_subset(whole.matrix, ids.limit(1), jobs, retrieval, 100).rows.first()
    assert one["score"] < rows[2]["score"]


def test_unknown_ids_are_an_error(spark, candidates_of, jobs):
    whole = build_scored(candidates_of(*people()), jobs, accuracy=False)
    nobody = spark.createDataFrame([("CAND_0000099",)], "candidate_id string")
    with pytest.raises(build.RankingError):
        build.rank_subset(whole.matrix, nobody, jobs, whole.scores, 100)


def test_adhoc_pool_is_built_and_ranked(candidates_of, jobs):
    answer = build.rank_adhoc(candidates_of(*people()[3:]), jobs, 3)
    rows = sorted(answer.rows.collect(), key=lambda r: r["rank"])
    assert [int(r["candidate_id"][-7:]) for r in rows][:2] == [4, 5] or {
        int(r["candidate_id"][-7:]) for r in rows[:2]} == {4, 5}
    assert len(rows) == 3 and answer.gates.first()["total"] == 7


def test_graded_sample_takes_raw_rows_of_the_best(spark, candidates_of):
    raw = candidates_of(*people())
    labels = spark.createDataFrame(
        [(f"CAND_{n:07d}", float(n in (4, 6)) + 0.5 * (n == 2)) for n in range(1, 11)],
        "candidate_id string, proxy_label double")
    got = graded_sample(raw, labels, 4)
    assert got.columns == raw.columns
    # ties at 0 go by id
    assert sorted(int(r["candidate_id"][-7:]) for r in got.collect()) == [1, 2, 4, 6]
