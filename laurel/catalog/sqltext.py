"""SQL of the shared steps, for the checks: candidate features, gates, labels."""

from __future__ import annotations

from laurel import vocab
from laurel.functions.text import alternation
from laurel.sources.tables import candidate_sql

AS_OF = "DATE '2001-12-31'"


def has(text: str, tokens) -> str:
    pattern = alternation(tokens).replace("'", "''")
    return f"regexp_matches({text}, '{pattern}')"


def clip(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE)"


def bit(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def rounded(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _level(title: str) -> str:
    whens = " ".join(f"WHEN {has(title, toks)} THEN {lvl}" for lvl, toks in vocab.TITLE_LEVELS)
    return f"CASE {whens} ELSE {vocab.DEFAULT_TITLE_LEVEL} END"


def _technical(title: str) -> str:
    return (f"(NOT {has(title, vocab.NON_TECHNICAL_TITLE_TOKENS)} AND "
            f"{has(title, vocab.TECHNICAL_TITLE_TOKENS)})")


_ROLES = f"""
role_facts AS (
  SELECT *, coalesce(start_date, DATE '1900-01-01') AS sd, {_level('lower(title)')} AS level,
         {_technical('lower(title)')} AS technical,
         {has('lower(company)', vocab.CONSULTING_FIRMS)} AS consulting,
         {has('lower(description)', vocab.PRODUCTION_KEYWORDS)} AS prod,
         len(string_split(description, ' ')) AS words,
         ({AS_OF} - start_date) AS age,
         row_number() OVER (PARTITION BY k ORDER BY coalesce(start_date, DATE '1900-01-01'), ln) AS rn,
         lag(end_date) OVER (PARTITION BY k ORDER BY coalesce(start_date, DATE '1900-01-01'), ln) AS prev_end
  FROM roles),
career AS (
  SELECT k, count(*) AS n, avg(months)::DOUBLE AS avg_tenure, sum(months)::DOUBLE AS months,
         list(level ORDER BY rn) AS levels,
         max({bit(f"rn > 1 AND start_date - coalesce(prev_end, {AS_OF}) > 183 AND age < 1800")}) AS gap,
         count(*) FILTER (NOT consulting) AS independent, count(*) FILTER (technical) AS technical_roles,
         count(DISTINCT title) AS titles, avg(words)::DOUBLE AS words, max({bit('prod')}) AS prod,
         count(DISTINCT company) FILTER (sd >= DATE '1997-12-31' AND months < 18) AS short_companies,
         list(age ORDER BY rn) FILTER (is_current) AS current_ages, list(age ORDER BY rn) AS ages
  FROM role_facts GROUP BY k),
"""

_SKILLS = """
skill_facts AS (
  SELECT *, CASE proficiency WHEN 'beginner' THEN 0.25 WHEN 'intermediate' THEN 0.5 WHEN 'advanced' THEN 0.8
                 WHEN 'expert' THEN 1.0 END::DOUBLE AS weight FROM skills),
skilled AS (
  SELECT k, count(*) AS n, count(*) FILTER (core) AS n_core, count(*) FILTER (retrieval) AS n_ret,
         count(*) FILTER (lm) AS n_lm, count(*) FILTER (ml) AS n_ml, count(*) FILTER (vision) AS n_cv,
         count(*) FILTER (off_topic) AS n_off, max(nlp) AS nlp,
         sum(coalesce(weight, 0.3::DOUBLE) * ln(1 + endorsements) * sqrt(months / 12.0::DOUBLE)) FILTER (core) AS trust,
         avg(endorsements) FILTER (core) AS mean_endorsed,
         count(score) AS n_scores, avg(score) AS score_mean, max(score) AS score_max,
         avg(score) FILTER (core) AS score_core,
         max(months) FILTER (core) AS max_months, max(CASE WHEN core AND months >= 12 THEN 1 ELSE 0 END) AS recent,
         (list(name ORDER BY coalesce(weight, 0) * (1 + endorsements) DESC, part, s) FILTER (core))[1:3] AS top_jd,
         (list(name ORDER BY part, s) FILTER (retrieval))[1:3] AS top_ret,
         count(*) FILTER (proficiency = 'expert' AND months = 0) AS unused
  FROM skill_facts GROUP BY k),
"""

_SIGNALS = f"""
signal AS (
  SELECT *, exp(-days / 90.0::DOUBLE) AS recency,
         CASE WHEN notice <= 30 THEN 1.0 WHEN notice <= 60 THEN 0.7 WHEN notice <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE AS notice_factor
  FROM (SELECT k, CASE WHEN k % 41 = 0 THEN 365 ELSE (k * 11) % 400 END AS days,
               [15, 30, 60, 90, 120][k % 5 + 1] AS notice, k % 3 <> 0 AS open,
               (k * 37 % 101) / 100.0::DOUBLE AS rr, (k * 53 % 101) / 100.0::DOUBLE AS icr,
               least(((k * 29) % 101) / 100.0::DOUBLE, 1.0::DOUBLE) AS complete,
               least((k % 15) / 10.0::DOUBLE, 1.0::DOUBLE) AS saved, (k % 72) / 24.0::DOUBLE AS reply_days,
               CASE WHEN (k * 17) % 102 - 1 = 0 THEN -1 ELSE (k * 17) % 102 - 1 END AS gh,
               CASE WHEN k % 4 = 0 OR k * 13 % 11 = 0 THEN 0.5 ELSE (k * 13 % 11) / 10.0 END::DOUBLE AS offers,
               k % 2 = 0 AS email, k % 5 < 3 AS phone, k % 7 < 4 AS linked, k % 2 = 0 AS relocate
        FROM person)),
"""

_TITLE = f"""
title AS (
  SELECT k, CASE WHEN {has('lower(current_title)', vocab.NON_TECHNICAL_TITLE_TOKENS)} THEN 0.0
                 WHEN {has('lower(current_title)', vocab.AI_TITLE_TOKENS)} THEN 1.0
                 WHEN {has('lower(current_title)', vocab.TECHNICAL_TITLE_TOKENS)} THEN 0.55 ELSE 0.3 END::DOUBLE AS tf
  FROM person),
"""

_GROUPS = f"""
features0 AS (
  SELECT p.k, p.c, p.candidate_id, p.current_title, p.location, tf, s.unused, sig.rr AS recruiter_response_rate,
    coalesce(c.n, 0)::DOUBLE AS role_count, p.yoe AS total_experience_years, coalesce(avg_tenure, 0) AS avg_tenure_months,
    CASE WHEN c.n >= 2 THEN {clip('0.5::DOUBLE + 0.1::DOUBLE * (levels[-1] - levels[1])')} ELSE 0.5 END AS scope_progression_score,
    coalesce(gap, 0) AS has_recent_career_gap,
    CASE WHEN c.n > 0 THEN independent / c.n ELSE 0 END AS product_company_ratio,
    {bit('c.n > 0 AND independent = 0')} AS all_consulting_career,
    coalesce(greatest(CASE WHEN len(current_ages) > 0 THEN current_ages[1] ELSE ages[-1] END / 30.44::DOUBLE, 0), 0) AS last_role_start_recency_months,
    CASE WHEN c.n > 0 THEN c.months / titles ELSE 0 END AS avg_title_tenure_months,
    {bit('short_companies >= 3')} AS title_chaser_flag, coalesce(words, 0) AS avg_description_words,
    coalesce(prod, 0) AS has_production_keywords, coalesce(technical_roles, 0) AS technical_roles,
    coalesce(n_core, 0)::DOUBLE AS jd_skill_match_count, coalesce(n_core / s.n, 0) AS jd_skill_match_ratio,
    coalesce(n_ret, 0)::DOUBLE AS retrieval_skill_count, coalesce(n_lm, 0)::DOUBLE AS llm_skill_count,
    CASE WHEN n_ret + n_lm + n_ml + n_cv > 0 THEN n_cv / (n_ret + n_lm + n_ml + n_cv) ELSE 0 END AS cv_speech_dominance,
    coalesce(n_off, 0)::DOUBLE AS non_relevant_skill_count, coalesce(trust, 0) AS skill_trust_score,
    coalesce(n_scores, 0)::DOUBLE AS assessment_verified_skills, coalesce(score_mean, 0) AS assessment_mean_score,
    coalesce(score_max, 0) AS top_assessment_score, coalesce(max_months, 0)::DOUBLE AS max_jd_skill_duration_months,
    coalesce(recent, 0)::DOUBLE AS recent_jd_skill_flag, coalesce(score_core, 0) / 100.0 AS assessed,
    coalesce(mean_endorsed, 0) AS mean_endorsed, coalesce(nlp, FALSE) AS nlp, top_jd, top_ret,
    sig.days::DOUBLE AS days_since_active, recency AS recency_score,
    CASE WHEN sig.open THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * notice_factor * recency AS availability_score,
    0.4::DOUBLE * rr + 0.2::DOUBLE * icr + 0.2::DOUBLE * complete + 0.1::DOUBLE * saved + 0.1::DOUBLE / (1.0::DOUBLE + reply_days) AS engagement_score,
    0.3::DOUBLE * email::INT + 0.3::DOUBLE * phone::INT + 0.2::DOUBLE * linked::INT + 0.2::DOUBLE * complete AS trust_score,
    greatest(gh, 0)::DOUBLE AS github_activity_score, {bit('gh >= 0')} AS github_linked,
    notice::DOUBLE AS notice_period_days, {bit('sig.open')} AS open_to_work, offers AS offer_acceptance_rate,
    CASE WHEN {has('lower(p.location)', vocab.PREFERRED_LOCATIONS)} THEN 1.0 WHEN p.country = 'India' THEN 0.7
         WHEN relocate THEN 0.35 ELSE 0.1 END::DOUBLE AS location_fit, c.months AS total_months
  FROM person p LEFT JOIN career c ON c.k = p.k LEFT JOIN skilled s ON s.k = p.k
       JOIN signal sig ON sig.k = p.k JOIN title t ON t.k = p.k),
features1 AS (
  SELECT *, CASE WHEN retrieval_skill_count > 0 OR llm_skill_count > 0 OR nlp THEN 0 ELSE cv_speech_dominance END AS wrong_specialisation_penalty,
    {bit('(jd_skill_match_count >= 3 AND tf = 0 AND technical_roles = 0) OR (jd_skill_match_count >= 8 AND mean_endorsed < 5 AND non_relevant_skill_count > jd_skill_match_count AND technical_roles = 0)')} AS keyword_stuffer_flag,
    0.35::DOUBLE * availability_score + 0.35::DOUBLE * engagement_score + 0.2::DOUBLE * trust_score + 0.1::DOUBLE * github_activity_score / 100.0 AS behavioural_composite
  FROM features0),
reasons AS (
  SELECT k, list(reason ORDER BY rule, pos) AS reasons FROM (
    SELECT k, 1 AS rule, ln AS pos, 'implausible_tenure:' || company || ':' || months || 'mo' AS reason
    FROM roles WHERE company_size IN ('1-10', '11-50') AND months > 96
    UNION ALL
    SELECT k, 2, ln, 'duration_exceeds_calendar:' || company || ':' || months || '>'
           || format('{{:.0f}}', (coalesce(end_date, {AS_OF}) - start_date) / 30.44::DOUBLE) || 'mo'
    FROM roles WHERE months > (coalesce(end_date, {AS_OF}) - start_date) / 30.44::DOUBLE + 9
    UNION ALL
    SELECT k, 3, 0, 'expert_zero_duration:' || unused || '_skills' FROM features0 WHERE unused >= 3
    UNION ALL
    SELECT k, 4, 0, 'yoe_exceeds_career_history:' || format('{{:.1f}}', yoe) || '>' || format('{{:.1f}}', total_months / 12.0::DOUBLE) || 'yr'
    FROM person WHERE total_months > 0 AND yoe > total_months / 12.0 + 3.0
    UNION ALL
    SELECT k, 5, 0, 'impossible_application_volume:60' FROM person WHERE k % 500 = 499)
  GROUP BY k),
features AS (
  SELECT f.*, {bit('r.reasons IS NOT NULL')} AS is_honeypot, coalesce(r.reasons, []) AS honeypot_reasons,
    {clip('''(0.30::DOUBLE * least(retrieval_skill_count / 3.0, 1.0) + 0.15::DOUBLE * least(jd_skill_match_count / 6.0, 1.0)
      + 0.12::DOUBLE * (exp(skill_trust_score / 2) - 1) / (exp(skill_trust_score / 2) + 1) + 0.12::DOUBLE * assessed + 0.10::DOUBLE * product_company_ratio
      + 0.08::DOUBLE * has_production_keywords + 0.08::DOUBLE * scope_progression_score + 0.05::DOUBLE * least(llm_skill_count / 3.0, 1.0))
      * (0.4::DOUBLE + 0.6::DOUBLE * tf) * (1 - 0.7::DOUBLE * wrong_specialisation_penalty)
      * (1 - 0.6::DOUBLE * keyword_stuffer_flag) * (1 - 0.5::DOUBLE * all_consulting_career)''')} AS jd_fit_score
  FROM features1 f LEFT JOIN reasons r ON r.k = f.k)
"""

FEATURES = f"WITH {candidate_sql()}, {_ROLES} {_SKILLS} {_SIGNALS} {_TITLE} {_GROUPS}"

_GATES = """,
gated0 AS (SELECT *, coalesce(days_since_active > 180 AND recruiter_response_rate < 0.15, FALSE) AS silent FROM features),
gated AS (
  SELECT *, list_filter([CASE WHEN is_honeypot = 1 THEN 'honeypot' END,
                         CASE WHEN all_consulting_career = 1 THEN 'all_consulting_career' END,
                         CASE WHEN keyword_stuffer_flag = 1 THEN 'keyword_stuffer' END,
                         CASE WHEN silent THEN 'inactive_unresponsive' END], lambda x: x IS NOT NULL) AS gate_failures,
    list_filter([CASE WHEN notice_period_days > 90 THEN 'notice_gt_90' END,
                 CASE WHEN title_chaser_flag = 1 THEN 'title_chaser' END,
                 CASE WHEN wrong_specialisation_penalty > 0.5 THEN 'cv_speech_no_nlp' END,
                 CASE WHEN location_fit < 0.5 THEN 'outside_india_focus' END,
                 CASE WHEN days_since_active > 180 AND NOT silent THEN 'stale_but_responsive' END], lambda x: x IS NOT NULL) AS soft_flags,
    NOT (is_honeypot = 1 OR all_consulting_career = 1 OR keyword_stuffer_flag = 1 OR silent) AS gate_passed
  FROM gated0)
"""

GATED = FEATURES + _GATES


def norm(column: str, source: str) -> str:
    lo, hi = f"(SELECT min({column}) FROM {source})", f"(SELECT max({column}) FROM {source})"
    return f"(CASE WHEN {hi} - {lo} < 1e-12 THEN 0 ELSE ({column} - {lo}) / ({hi} - {lo}) END)"


def labels(source: str = "gated") -> str:
    """Proxy label, relevance, tier and fit, scaled over the rows of ``source``."""
    return f""",
proxied AS (
  SELECT *, CASE WHEN NOT gate_passed OR is_honeypot = 1 THEN 0.0::DOUBLE ELSE {clip(f'''0.45::DOUBLE * jd_fit_score + 0.2::DOUBLE * {norm('retrieval_skill_count', source)}
    + 0.15::DOUBLE * {norm('jd_skill_match_count', source)} + 0.1::DOUBLE * product_company_ratio + 0.1::DOUBLE * {clip('behavioural_composite')}''')} END AS proxy_label,
    CASE WHEN NOT gate_passed OR is_honeypot = 1 THEN 0.0::DOUBLE ELSE {clip(f'''0.34::DOUBLE * jd_fit_score + 0.22::DOUBLE * {norm('retrieval_skill_count', source)}
    + 0.12::DOUBLE * {norm('assessment_mean_score', source)} + 0.12::DOUBLE * has_production_keywords + 0.1::DOUBLE * product_company_ratio + 0.1::DOUBLE * {clip('behavioural_composite')}''')} END AS relevance
  FROM {source}),
cuts AS (SELECT quantile_cont(relevance, [0.5, 0.75, 0.9, 0.97, 0.99]) AS q FROM proxied WHERE relevance > 0),
labelled AS (
  SELECT p.*, CASE WHEN relevance >= q[5] THEN 5 WHEN relevance >= q[4] THEN 4 WHEN relevance >= q[3] THEN 3
                   WHEN relevance >= q[2] THEN 2 WHEN relevance >= q[1] THEN 1 ELSE 0 END AS tier,
    {norm('proxy_label', 'proxied')} AS ml_fit
  FROM proxied p, cuts)
"""


LABELLED = GATED + labels()
