from __future__ import annotations

import math

import pytest
from conftest import SERVICES_ONLY, STUFFER, TINY_LONG, UNUSED_EXPERT, profile, role, skill
from pyspark.sql import functions as F

from laurel import vocab
from laurel.operators import features, quality


@pytest.fixture(scope="module")
def rows(candidates_of):
    """The feature rows of the shaped profiles, by number."""
    shapes = {
        1: {}, 2: STUFFER, 3: UNUSED_EXPERT, 4: TINY_LONG, 5: SERVICES_ONLY,
        6: dict(roles=[role("Zeta", "Engineer", "2023-01-01", 60, end="2024-01-01")]),
        7: dict(years=25.0, roles=[role("Zeta", "Engineer", "2024-06-01", 24)]),
        8: dict(notice_period_days=120.0),
        9: dict(github_activity_score=0.0, offer_acceptance_rate=0.0,
                last_active_date=None, skill_assessment_scores=None),
        10: dict(skills=[], roles=[]),
        11: dict(skills=[skill("Computer Vision"), skill("YOLO"), skill("PyTorch")]),
        12: dict(roles=[role("A", "Engineer", "2023-01-01", 8, end="2023-09-01"),
                        role("B", "Senior Engineer", "2024-06-01", 9, end="2025-03-01"),
                        role("C", "Staff Engineer", "2025-04-01", 10)]),
        13: dict(last_active_date="2025-06-01", recruiter_response_rate=0.05),
        14: dict(applications_submitted_30d=60.0),
        15: dict(roles=[role("Acme Industries", "Junior Developer", "not a date", 10)]),
    }
    df = candidates_of(*[profile(n, **s) for n, s in shapes.items()])
    gated = quality.apply_gates(features.feature_matrix(df))
    return {int(r["candidate_id"][-7:]): r for r in gated.collect()}


def test_contract_has_forty_numbers(rows):
    assert len(vocab.NUMERIC_FEATURES) == 40
    for r in rows.values():
        assert all(isinstance(r[c], float) and math.isfinite(r[c]) for c in vocab.NUMERIC_FEATURES)


def test_sound_profile(rows):
    r = rows[1]
    assert r["gate_passed"] and r["honeypot_reasons"] == [] and r["soft_flags"] == []
    assert r["retrieval_skill_count"] == 1 and r["jd_skill_match_count"] == 3
    trust = (math.log1p(17) * math.sqrt(50 / 12) + 0.8 * math.log1p(9) * math.sqrt(44 / 12)
             + 0.8 * math.log1p(26) * math.sqrt(61 / 12))
    assert r["skill_trust_score"] == pytest.approx(trust)
    assert r["assessment_mean_score"] == 78.5 and r["top_assessment_score"] == 91.0
    assert r["recency_score"] == pytest.approx(math.exp(-20 / 90))
    assert r["location_fit"] == 1.0
    assert r["top_jd_skills"] == ["NLP", "BM25", "PyTorch"]
    assert r["top_retrieval_skills"] == ["BM25"]


def test_jd_fit_formula(rows):
    r = rows[1]
    base = (0.30 * 1 / 3 + 0.15 * 0.5 + 0.12 * math.tanh(r["skill_trust_score"] / 4)
            + 0.12 * 0.785 + 0.10 + 0.08 + 0.08 * 0.5)
    # a technical title outside the AI list counts 0.55
    assert r["jd_fit_score"] == pytest.approx(base * (0.4 + 0.6 * 0.55))
    assert r["jd_fit_score"] > rows[2]["jd_fit_score"]


def test_keyword_stuffer(rows):
    assert rows[2]["keyword_stuffer_flag"] == 1 and not rows[2]["gate_passed"]
    assert "keyword_stuffer" in rows[2]["gate_failures"]


@pytest.mark.parametrize(("number", "reason"), [
    (3, "expert_zero_duration:4_skills"),
    (4, "implausible_tenure:Attic Works:141mo"),
    (6, "duration_exceeds_calendar:Zeta:60>12mo"),
    (7, "yoe_exceeds_career_history:25.0>2.0yr"),
    (14, "impossible_application_volume:60"),
])
def test_impossible_profiles(rows, number, reason):
    assert reason in rows[number]["honeypot_reasons"]
    assert rows[number]["is_honeypot"] == 1 and not rows[number]["gate_passed"]


def test_services_only_career(rows):
    r = rows[5]
    assert r["all_consulting_career"] == 1 and r["product_company_ratio"] == 0
    assert r["gate_failures"] == ["all_consulting_career"]


def test_soft_flag_only(rows):
    assert rows[8]["gate_passed"] and rows[8]["soft_flags"] == ["notice_gt_90"]


def test_zero_counts_as_missing(rows):
    r = rows[9]
    assert r["github_linked"] == 0 and r["offer_acceptance_rate"] == 0.5
    assert r["days_since_active"] == 365 and r["assessment_verified_skills"] == 0


def test_empty_arrays(rows):
    r = rows[10]
    assert r["role_count"] == 0 and r["scope_progression_score"] == 0.5
    assert r["jd_skill_match_ratio"] == 0 and r["all_consulting_career"] == 0


def test_wrong_specialisation(rows):
    assert rows[11]["cv_speech_dominance"] == pytest.approx(2 / 3)
    assert rows[11]["wrong_specialisation_penalty"] == pytest.approx(2 / 3)
    assert "cv_speech_no_nlp" in rows[11]["soft_flags"]


def test_career_shape(rows):
    r = rows[12]
    assert r["title_chaser_flag"] == 1 and r["has_recent_career_gap"] == 1
    assert r["scope_progression_score"] == pytest.approx(0.7)
    assert r["avg_tenure_months"] == 9 and r["avg_title_tenure_months"] == 9


def test_silent_candidate(rows):
    assert "inactive_unresponsive" in rows[13]["gate_failures"]


def test_substring_company_and_bad_date(rows):
    assert rows[15]["all_consulting_career"] == 1  # "ust" is inside "industries"
    assert rows[15]["last_role_start_recency_months"] == 0


def test_numeric_contract(spark):
    df = spark.createDataFrame([("a", "7.5"), ("b", "n/a")], "candidate_id string, trust_score string")
    out = {r["candidate_id"]: r for r in features.with_numeric_contract(df).collect()}
    assert out["a"]["trust_score"] == 7.5 and out["b"]["trust_score"] == 0.0
    assert out["a"]["role_count"] == 0.0


def test_title_rules(spark):
    titles = ["VP Engineering", "Engineering Manager", "Principal Engineer", "Lead Engineer",
              "Sr. Engineer", "ML Intern", "Associate Engineer", "Engineer"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    levels = [r[0] for r in df.select(features.title_level(F.col("t"))).collect()]
    assert levels == [7, 6, 5, 4, 3, 0, 1, 2]


def test_live_evidence(spark, candidates_of):
    matrix = features.feature_matrix(candidates_of(profile(1), profile(2)))
    records = spark.createDataFrame(
        [("CAND_0000001", "pytorch", 0.9), ("CAND_0000001", "BM25", 0.5),
         ("CAND_0000002", "pytorch", 0.1)],
        "candidate_id string, skill_name string, confidence double",
    )
    out = {r["candidate_id"]: r for r in features.apply_live_evidence(matrix, records).collect()}
    assert out["CAND_0000001"]["skill_trust_score"] == pytest.approx(3.5)
    assert out["CAND_0000001"]["evidence_confidence_bonus"] == 0.15
    assert out["CAND_0000002"]["has_live_evidence"] == 0.0
