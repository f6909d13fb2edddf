"""Queries over scored candidates: labels, fit, heads, final scores, ranked outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.catalog import sqltext as S
from laurel.catalog.profiles import matrix, profile_columns, texts
from laurel.catalog.registry import query, rounded, stored
from laurel.catalog.texts import CODE, RTOK, TOK, _key
from laurel.operators import explain, metrics, model, quality, sampling, scoring

from laurel.operators.retrieval import retrieval_scores
from laurel.operators.tournament import run_tournament
from laurel.plans import build
from laurel.sources import jobspec
from laurel.sources import tables as t

# --- labels and fit -------------------------------------------------------------------


@query("proxy_labels", f"{S.LABELLED} SELECT candidate_id, round(proxy_label, 6) AS proxy_label FROM labelled")
def proxy_labels(spark, sf):
    return rounded(scoring.with_proxy_label(matrix(spark, sf)).select(
        "candidate_id", "proxy_label"
    ))


@query("relevance_tiers", f"{S.LABELLED} SELECT candidate_id, round(relevance, 6) AS relevance, tier FROM labelled")
def relevance_tiers(spark, sf):
    df = scoring.with_tiers(scoring.stored_relevance(matrix(spark, sf)))
    return rounded(df.select("candidate_id", "relevance", "tier"))


@query("graded_labels", f"""{S.LABELLED}, g AS (SELECT 'CAND_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS candidate_id, quality * 9 - toxic AS grade FROM labels)
SELECT candidate_id, CASE WHEN grade IS NULL THEN tier ELSE least(greatest(grade, 0), 5) END AS tier FROM labelled LEFT JOIN g USING (candidate_id)""")
def graded_labels(spark, sf):
    """Tiers with the grades of an outside judge (here: the document labels) on top."""
    grades = t.load(spark, sf, "labels").select(
        F.concat(F.lit("CAND_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))
        .alias("candidate_id"), (F.col("quality") * 9 - F.col("toxic")).alias("grade"),
    )
    return scoring.graded_labels(matrix(spark, sf), grades)


@query("tier_distribution", f"{S.LABELLED} SELECT r.tier::INTEGER AS tier, count(l.tier) AS rows FROM (SELECT unnest(range(6)) AS tier) r LEFT JOIN labelled l ON l.tier = r.tier GROUP BY 1")
def tier_distribution(spark, sf):
    return scoring.tier_distribution(_labels(spark, sf))


def _labels(spark, sf):
    return stored(spark, sf, "labels", lambda: scoring.graded_labels(matrix(spark, sf)))


@query("fit_prediction", f"{S.LABELLED} SELECT candidate_id, round(ml_fit, 6) AS ml_fit FROM labelled")
def fit_prediction(spark, sf):
    return rounded(scoring.with_fit(matrix(spark, sf)).select("candidate_id", "ml_fit"))


# --- training -------------------------------------------------------------------------

_SAMPLED = f"""{S.LABELLED}, budget AS (SELECT greatest(count(*) FILTER (tier > 0), 2000 - count(*) FILTER (tier > 0)) AS b FROM labelled),
training AS (SELECT candidate_id, tier FROM labelled WHERE tier > 0 UNION ALL
  SELECT candidate_id, tier FROM (SELECT *, row_number() OVER (ORDER BY md5(candidate_id || ':42'), candidate_id) AS n FROM labelled WHERE tier = 0), budget WHERE n <= b)"""


@query("training_rows", f"{_SAMPLED} SELECT candidate_id, tier FROM training")
def training_rows(spark, sf):
    """All positives and as many sampled negatives (floor of 2000 rows)."""
    return sampling.training_rows(_labels(spark, sf), negative_ratio=1, min_rows=2000)


@query("query_groups", f"""{_SAMPLED}, g AS (SELECT *, (('0x' || substr(md5(candidate_id || ':42'), 1, 8))::UBIGINT % 24)::INTEGER AS query_group FROM training)
SELECT candidate_id, query_group, query_group >= 21 AS holdout FROM g""")
def query_groups(spark, sf):
    rows = sampling.with_query_groups(training_rows(spark, sf))
    return sampling.with_holdout(rows).select("candidate_id", "query_group", "holdout")


def _trained_fit(spark, sf):
    def build():
        labelled = scoring.with_proxy_label(matrix(spark, sf))
        return scoring.with_fit(labelled, model.train_fit(labelled, "proxy_label")).select(
            "candidate_id", "proxy_label", "ml_fit"
        )

    return stored(spark, sf, "trained_fit", build)


def _trained_ranker(spark, sf):
    def build():
        fitted = model.train_ranker(matrix(spark, sf), training_rows(spark, sf))
        return scoring.with_fit(matrix(spark, sf), fitted).select("candidate_id", "ml_fit").join(
            _labels(spark, sf), "candidate_id"
        )

    return stored(spark, sf, "trained_ranker", build)


@query("trained_fit")
def trained_fit(spark, sf):
    """Gradient-boosted trees on the proxy labels, applied to all rows (no SQL check)."""
    return rounded(_trained_fit(spark, sf))


@query("trained_ranker")
def trained_ranker(spark, sf):
    """Listwise trees on the graded tiers of the balanced training rows (no SQL check)."""
    return rounded(_trained_ranker(spark, sf).select("candidate_id", "tier", "ml_fit"))


@query("trained_report", f"""{S.LABELLED}, n AS (SELECT count(*) AS rows FROM labelled)
SELECT model, rows, TRUE AS in_range, TRUE AS follows_label FROM n, (SELECT unnest(['fit', 'ranker']) AS model)""")
def trained_report(spark, sf):
    """What must hold of both models whatever their trees: a prediction in 0..1 for every row, which
    follows its label (in-sample correlation above 0.8 and 0.3)."""
    def report(name, scored, label, least):
        return model.fit_report(scored, label).select(
            F.lit(name).alias("model"), "rows", "in_range",
            (F.col("correlation") > least).alias("follows_label"),
        )

    return report("fit", _trained_fit(spark, sf), "proxy_label", 0.8).unionByName(
        report("ranker", _trained_ranker(spark, sf), "tier", 0.3)
    )


# --- retrieval, heads and final scores per job ----------------------------------------


def jobs(spark, sf):
    return t.jobs(spark, sf)


def retrieval(spark, sf):
    return stored(spark, sf, "retrieval", lambda: retrieval_scores(
        t.spread(texts(spark, sf).select("candidate_id", "corpus_text")), jobs(spark, sf),
        "candidate_id", "corpus_text", "jd_id", "text", code="md5",
    ))


def scored(spark, sf):
    """Every candidate for every job, with fit and retrieval scores."""
    return stored(spark, sf, "scored", lambda: build.per_job(
        scoring.with_fit(scoring.with_proxy_label(matrix(spark, sf))),
        jobs(spark, sf), retrieval(spark, sf),
    ))


def heads(spark, sf):
    return stored(spark, sf, "heads", lambda: build.head_scores(
        scored(spark, sf), texts(spark, sf), jobs(spark, sf)
    ))


def final(spark, sf):
    return stored(spark, sf, "final", lambda: scoring.with_final_score(
        build.with_head_scores(scored(spark, sf), heads(spark, sf))
    ).select("jd_id", "candidate_id", "is_honeypot", "final_score"))


_JOBS = f"jobs AS (SELECT r_regionkey::BIGINT AS jd_id, {t._sql_list(t.JOB_TEXTS)}[r_regionkey % 5 + 1] AS text FROM region)"
def _profile_text(pool: str = "person") -> str:
    """Texts of the candidates in ``pool``."""
    return f"""profile AS (SELECT candidate_id, trim(concat_ws(' ', current_title || ' | profile', summary, current_title, 'Internet',
    (SELECT string_agg(title || ' ' || description, ' ' ORDER BY ln) FROM roles r WHERE r.k = p.k),
    (SELECT string_agg(name, ' ' ORDER BY part, s) FROM skills s WHERE s.k = p.k))) AS text,
  trim(concat_ws(' ', current_title, current_title || ' | profile', (SELECT arg_min(title || ' ' || description, ln) FROM roles r WHERE r.k = p.k),
    (SELECT array_to_string(list(name ORDER BY endorsements DESC, part, s), ' ') FROM skills s WHERE s.k = p.k))) AS rerank_text FROM {pool} p)"""


def _cells(table: str, id_col: str) -> str:
    return f"""(SELECT {id_col}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {id_col})) AS x FROM (
      SELECT {id_col}, h % 384 AS bucket, sum(CASE WHEN (h >> 20) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT {id_col}, {CODE} AS h FROM (SELECT {id_col}, unnest({TOK}) AS tok FROM {table})) GROUP BY ALL) WHERE v <> 0)"""


def _retrieval_sql(pool: str = "person") -> str:
    """Fused retrieval scores of the candidates in ``pool`` among each other."""
    return f""", {_JOBS}, {_profile_text(pool)},
pdocs AS (SELECT candidate_id, {TOK} AS toks FROM profile),
pstats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM pdocs),
ptf AS (SELECT candidate_id, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT candidate_id, toks, unnest(toks) AS tok FROM pdocs) GROUP BY ALL),
pterms AS (SELECT tok, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM ptf, pstats GROUP BY tok, n),
pasked AS (SELECT DISTINCT jd_id, unnest({TOK}) AS tok FROM jobs),
pbm AS (SELECT jd_id, candidate_id, sum(idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM pasked JOIN pterms USING (tok) JOIN ptf USING (tok), pstats GROUP BY ALL),
pdv AS {_cells('profile', 'candidate_id')}, pqv AS {_cells('jobs', 'jd_id')},
pcos AS (SELECT jd_id, candidate_id, sum(pdv.x * pqv.x) AS score FROM pdv JOIN pqv USING (bucket) GROUP BY ALL),
pranked AS (
  SELECT jd_id, candidate_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY jd_id ORDER BY {_key('score')} DESC, candidate_id)) AS credit FROM pbm WHERE {_key('score')} > 0
  UNION ALL SELECT jd_id, candidate_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY jd_id ORDER BY {_key('score')} DESC, candidate_id)) FROM pcos WHERE {_key('score')} > 0),
pcredits AS (SELECT jd_id, candidate_id, sum(coalesce(credit, 0)) AS credit FROM (SELECT jd_id, candidate_id FROM jobs CROSS JOIN profile) LEFT JOIN pranked USING (jd_id, candidate_id) GROUP BY ALL),
retr AS MATERIALIZED (SELECT jd_id, candidate_id, (credit - min(credit) OVER w) / (max(credit) OVER w - min(credit) OVER w) AS retrieval_score FROM pcredits WINDOW w AS (PARTITION BY jd_id))"""


_RETRIEVAL = _retrieval_sql()

_SCORED = S.LABELLED.replace("labelled AS (", "labelled AS MATERIALIZED (") + _RETRIEVAL + """,
scored AS (SELECT l.*, jd_id, retrieval_score FROM labelled l JOIN retr USING (candidate_id)),
head AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY floor((0.6::DOUBLE * proxy_label + 0.4::DOUBLE * retrieval_score) * 1e9 + 0.5) DESC, candidate_id) AS head_rank
  FROM scored WHERE is_honeypot <> 1 AND gate_passed) WHERE head_rank <= 300)"""


@query("candidate_retrieval", f"WITH x AS (SELECT 1), {_RETRIEVAL.lstrip(', ').replace('jobs AS', t.candidate_sql() + ', jobs AS', 1)} SELECT jd_id, candidate_id, round(retrieval_score, 6) AS retrieval_score FROM retr WHERE retrieval_score > 0")
def candidate_retrieval(spark, sf):
    return rounded(retrieval(spark, sf).filter("retrieval_score > 0"))


@query("provisional_head", f"{_SCORED} SELECT jd_id, candidate_id, head_rank::INTEGER AS head_rank FROM head")
def provisional_head(spark, sf):
    head = scoring.provisional_head(scored(spark, sf), 300, group="jd_id")
    return head.select("jd_id", "candidate_id", "head_rank")


_RERANK = f""",
htoks AS (SELECT jd_id, candidate_id, {RTOK} AS toks FROM (SELECT jd_id, candidate_id, p.rerank_text AS text FROM head JOIN profile p USING (candidate_id))),
hlens AS (SELECT jd_id, candidate_id, greatest(len(toks), 1) AS len, avg(greatest(len(toks), 1)) OVER (PARTITION BY jd_id) AS avg_len, count(*) OVER (PARTITION BY jd_id) AS n FROM htoks),
hq AS (SELECT DISTINCT jd_id, unnest({RTOK}) AS tok FROM jobs),
htf AS (SELECT jd_id, candidate_id, tok, count(*) AS tf FROM (SELECT jd_id, candidate_id, unnest(toks) AS tok FROM htoks) JOIN hq USING (jd_id, tok) GROUP BY ALL),
hdf AS (SELECT jd_id, tok, count(*) AS df FROM htf GROUP BY ALL),
hraw AS (SELECT jd_id, candidate_id, coalesce(s, 0) AS s FROM head LEFT JOIN (SELECT jd_id, candidate_id, sum(ln(1 + n / (1 + df)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS s
  FROM htf JOIN hdf USING (jd_id, tok) JOIN hlens USING (jd_id, candidate_id) GROUP BY ALL) USING (jd_id, candidate_id)),
rerank AS MATERIALIZED (SELECT jd_id, candidate_id, CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS rerank_score FROM hraw WINDOW w AS (PARTITION BY jd_id))"""


@query("head_rerank", f"{_SCORED}{_RERANK} SELECT jd_id, candidate_id, round(rerank_score, 6) AS rerank_score FROM rerank")
def head_rerank(spark, sf):
    return rounded(heads(spark, sf).select("jd_id", "candidate_id", "rerank_score"))


def _bradley_terry(players: str) -> str:
    """SQL of the strengths: ``players`` gives (jd_id, candidate_id, criteria columns)."""
    crit = {"jd_fit_score": 0.26, "rerank_score": 0.20, "retrieval_skill_count": 0.14,
            "jd_skill_match_count": 0.12, "assessment_mean_score": 0.12,
            "evidence_confidence_bonus": 0.05, "has_production_keywords": 0.04,
            "product_company_ratio": 0.04, "behavioural_composite": 0.03}
    duel = " + ".join(
        f"{w}::DOUBLE * (CASE WHEN {_key('a.' + c)} > {_key('b.' + c)} THEN 1.0 "
        f"WHEN {_key('a.' + c)} = {_key('b.' + c)} THEN 0.5 ELSE 0.0 END)"
        for c, w in crit.items()
    )
    return f""",
players AS MATERIALIZED ({players}),
wins AS (SELECT a.jd_id, a.candidate_id, sum(0.98::DOUBLE * ({duel}) + 0.01::DOUBLE) AS w FROM players a JOIN players b ON a.jd_id = b.jd_id AND a.candidate_id <> b.candidate_id GROUP BY ALL),
packed AS MATERIALIZED (SELECT jd_id, list(candidate_id ORDER BY candidate_id) AS ids, list(w ORDER BY candidate_id) AS w, count(*) AS n FROM wins GROUP BY jd_id),
rounds AS (
  SELECT jd_id, 0 AS i, list_transform(range(n), lambda z: 1.0::DOUBLE / n) AS p, FALSE AS done, w, n FROM packed
  UNION ALL
  SELECT jd_id, i + 1, q, list_max(list_transform(range(1, n + 1), lambda z: abs(q[z] - p[z]))) < 1e-10, w, n FROM (
    SELECT jd_id, i, p, w, n, list_transform(u, lambda z: z / list_sum(u)) AS q FROM (
      SELECT jd_id, i, p, w, n, list_transform(range(1, n + 1), lambda a: w[a] / (list_sum(list_transform(p, lambda z: 1.0::DOUBLE / (p[a] + z))) - 1.0::DOUBLE / (2 * p[a]))) AS u
      FROM rounds WHERE NOT done AND i < 200))),
ended AS (SELECT jd_id, arg_max(p, i) AS p FROM rounds GROUP BY jd_id),
played AS (SELECT jd_id, candidate_id, (p - min(p) OVER g) / (max(p) OVER g - min(p) OVER g) AS tournament_score FROM (
  SELECT jd_id, unnest(ids) AS candidate_id, unnest(e.p) AS p FROM ended e JOIN packed USING (jd_id)) WINDOW g AS (PARTITION BY jd_id))"""


_TOURNAMENT = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + _RERANK + _bradley_terry(
    "SELECT *, 0.0::DOUBLE AS evidence_confidence_bonus FROM head JOIN rerank USING (jd_id, candidate_id) WHERE head_rank <= 60"
)


@query("tournament", f"{_TOURNAMENT} SELECT jd_id, candidate_id, round(tournament_score, 5) AS tournament_score FROM played")
def tournament(spark, sf):
    top = scoring.provisional_head(scored(spark, sf), 60, group="jd_id").join(
        heads(spark, sf).drop("tournament_score"), ["jd_id", "candidate_id"]
    )
    return rounded(run_tournament(top), 5)


def _modifier() -> str:
    return S.clip(
        f"({S.clip('0.45::DOUBLE + 0.55::DOUBLE * ' + S.clip('availability_score'), '0.45')}) * "
        f"({S.clip('0.6::DOUBLE + 0.4::DOUBLE * ' + S.clip('engagement_score'), '0.6')})", "0.3"
    )


_CORE = f"(0.4::DOUBLE * ml_fit + 0.35::DOUBLE * retrieval_score + 0.25::DOUBLE * {S.clip('behavioural_composite')})"
_SHOWN = f"(0.85::DOUBLE + 0.15::DOUBLE * location_fit) * {_modifier()}"


@query("signal_modifier", f"{S.FEATURES} SELECT candidate_id, round({_modifier()}, 6) AS signal_modifier FROM features")
def signal_modifier(spark, sf):
    df = matrix(spark, sf).withColumn("signal_modifier", scoring.signal_modifier())
    return rounded(df.select("candidate_id", "signal_modifier"))


@query("core_scores", f"""{_SCORED} SELECT jd_id, candidate_id, round(CASE WHEN gate_passed AND is_honeypot <> 1 THEN {S.clip(f'{_CORE} * {_SHOWN}')} ELSE 0 END, 6) AS final_score FROM scored""")
def core_scores(spark, sf):
    """Final scores without any head signal."""
    df = scoring.with_final_score(scored(spark, sf))
    return rounded(df.select("jd_id", "candidate_id", "final_score"))


_FINAL = _TOURNAMENT + f""",
final AS MATERIALIZED (SELECT s.*, CASE WHEN gate_passed AND is_honeypot <> 1 THEN {S.clip(f'(0.75::DOUBLE * {_CORE} + 0.15::DOUBLE * coalesce(rerank_score, 0) + 0.1::DOUBLE * coalesce(tournament_score, 0)) * {_SHOWN}')} ELSE 0 END AS final_score
  FROM scored s LEFT JOIN rerank r USING (jd_id, candidate_id) LEFT JOIN played p USING (jd_id, candidate_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY {_key('final_score')} DESC, candidate_id) AS rank FROM final WHERE is_honeypot <> 1)"""


@query("final_scores", f"{_FINAL} SELECT jd_id, candidate_id, round(final_score, 5) AS final_score FROM final")
def final_scores(spark, sf):
    return rounded(final(spark, sf).select("jd_id", "candidate_id", "final_score"), 5)


def ranked(spark, sf):
    return stored(spark, sf, "ranked", lambda: build.explained_top(
        build.Scored(final(spark, sf), matrix(spark, sf)), 100
    ))


# fixed values: the same phrases, weights and bounds as in operators.explain and operators.tournament
_FMT = """, sentences AS (
SELECT jd_id, candidate_id, rank, final_score,
  CASE list_sum(list_transform(string_split(candidate_id, ''), lambda x: ascii(x))) % 3
    WHEN 0 THEN current_title || ', ' || format('{:.1f}', total_experience_years) || ' yrs'
    WHEN 1 THEN current_title || ' with ~' || format('{:.0f}', total_experience_years) || ' years'
    ELSE current_title || ' (' || format('{:.1f}', total_experience_years) || ' yrs experience)' END
  || ' - ' || array_to_string(list_filter([
    CASE WHEN retrieval_skill_count >= 2 AND len(top_ret) > 0 THEN 'retrieval/IR depth (' || array_to_string(top_ret[1:2], ', ') || ')'
         WHEN len(top_jd) > 0 THEN 'hands-on ' || array_to_string(top_jd[1:2], ', ') END,
    CASE WHEN product_company_ratio >= 0.8 THEN 'at product companies' WHEN product_company_ratio >= 0.5 THEN 'mostly at product companies'
         WHEN product_company_ratio > 0 THEN 'across product and services roles' ELSE 'in a services-heavy career' END,
    CASE WHEN scope_progression_score >= 0.65 THEN 'clear upward trajectory' END,
    CASE WHEN github_activity_score >= 40 THEN 'active GitHub (' || format('{:.0f}', github_activity_score) || '/100)' END,
    CASE WHEN recruiter_response_rate >= 0.6 THEN 'responsive to recruiters (' || format('{:.0f}', recruiter_response_rate * 100) || '%)' END,
    CASE WHEN notice_period_days <= 30 AND rank <= 60 THEN 'short notice' END], lambda x: x IS NOT NULL)[1:3], ', ') || '.'
  || coalesce(' Watch-out: ' || CASE WHEN notice_period_days > 60 THEN format('{:.0f}', notice_period_days) || '-day notice'
    WHEN days_since_active > 150 THEN 'quiet for ~' || format('{:.0f}', days_since_active / 30) || ' months'
    WHEN location_fit < 0.5 THEN 'based in ' || location
    WHEN wrong_specialisation_penalty > 0.4 THEN 'CV/speech-leaning, lighter on NLP/IR'
    WHEN rank > 60 THEN 'adjacent rather than core fit' END || '.', '') AS sentence
FROM top WHERE rank <= 100),
explained AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY jd_id, sentence ORDER BY rank) > 1
  THEN sentence[1:length(sentence) - 1] || ' [' || right(candidate_id, 4) || '].' ELSE sentence END AS reasoning FROM sentences)"""


@query("ranked_candidates", f"{_FINAL}{_FMT} SELECT jd_id, candidate_id, rank::INTEGER AS rank, reasoning FROM explained")
def ranked_candidates(spark, sf):
    return ranked(spark, sf).select("jd_id", "candidate_id", "rank", "reasoning")


_OUTPUT = f"""{_FINAL}{_FMT}, output AS (SELECT jd_id, candidate_id, row_number() OVER (PARTITION BY jd_id ORDER BY round_even(final_score, 4) DESC, candidate_id)::INTEGER AS rank,
  round_even(final_score, 4) AS score, reasoning FROM explained)"""


def output(spark, sf):
    return explain.output_table(ranked(spark, sf), 100, "jd_id")


@query("ranked_output", f"{_OUTPUT} SELECT jd_id, candidate_id, rank, score, reasoning FROM output")
def ranked_output(spark, sf):
    return output(spark, sf)


@query("ranked_output_text", f"{_OUTPUT} SELECT jd_id, candidate_id, CAST(rank AS VARCHAR) AS rank, format('{{:.4f}}', score) AS score, reasoning FROM output")
def ranked_output_text(spark, sf):
    return explain.output_text(output(spark, sf), "jd_id")


@query("output_violations", f"""{_OUTPUT}, broken AS (SELECT CASE WHEN rank = 7 THEN 'CAND_12' WHEN rank = 9 THEN '' ELSE candidate_id END AS id,
    CASE WHEN rank = 11 THEN '010' WHEN rank = 13 THEN '101' WHEN rank = 15 THEN '14' ELSE CAST(rank AS VARCHAR) END AS rank_text,
    CASE WHEN rank = 17 THEN 'high' WHEN rank = 19 THEN '0.99' ELSE format('{{:.4f}}', score) END AS score_text, rank AS r0 FROM output WHERE jd_id = 1 AND rank <> 20),
typed AS (SELECT *, CASE WHEN rank_text = '010' THEN NULL ELSE CAST(rank_text AS BIGINT) END AS rank, TRY_CAST(score_text AS DOUBLE) AS score FROM broken),
pairs AS (SELECT rank, score, id, lead(rank) OVER w AS rank2, lead(score) OVER w AS score2, lead(id) OVER w AS id2 FROM typed WHERE rank IS NOT NULL AND score IS NOT NULL AND id <> '' WINDOW w AS (ORDER BY rank, id))
SELECT 'row_count' AS rule, '99' AS detail FROM typed GROUP BY ALL HAVING count(*) <> 100 UNION ALL SELECT 'id_missing', rank_text FROM typed WHERE id = ''
UNION ALL SELECT 'id_format', id FROM typed WHERE id <> '' AND NOT regexp_matches(id, '^CAND_[0-9]{{7}}$')
UNION ALL SELECT 'rank_not_integer', rank_text FROM typed WHERE rank IS NULL UNION ALL SELECT 'rank_range', rank_text FROM typed WHERE rank NOT BETWEEN 1 AND 100
UNION ALL SELECT 'rank_repeated', CAST(rank AS VARCHAR) FROM typed WHERE rank BETWEEN 1 AND 100 GROUP BY rank HAVING count(*) > 1
UNION ALL SELECT 'rank_missing', CAST(r AS VARCHAR) FROM (SELECT unnest(range(1, 101)) AS r) WHERE r NOT IN (SELECT rank FROM typed WHERE rank IS NOT NULL)
UNION ALL SELECT 'score_not_number', score_text FROM typed WHERE score IS NULL
UNION ALL SELECT 'score_increases', CAST(rank2 AS VARCHAR) FROM pairs WHERE score < score2 UNION ALL SELECT 'tie_order', CAST(rank2 AS VARCHAR) FROM pairs WHERE score = score2 AND id > id2""")
def output_violations(spark, sf):
    """The list of job 1, spoilt in known places, must show exactly those violations."""
    c = F.col
    good = explain.output_text(output(spark, sf), "jd_id").filter("jd_id = 1 and rank <> '20'")
    swap = lambda name, changes: F.coalesce(
        *[F.when(c("rank") == r, F.lit(v)) for r, v in changes.items()], c(name)
    )
    broken = good.select(
        swap("candidate_id", {"7": "CAND_12", "9": ""}).alias("candidate_id"),
        swap("rank", {"11": "010", "13": "101", "15": "14"}).alias("rank"),
        swap("score", {"17": "high", "19": "0.99"}).alias("score"), "reasoning",
    )
    return quality.validate_ranked(broken)


@query("honeypots_on_top", f"{_OUTPUT} SELECT jd_id, sum(is_honeypot)::BIGINT AS honeypots, count(*) AS rows FROM output JOIN features USING (candidate_id) GROUP BY jd_id")
def honeypots_on_top(spark, sf):
    joined = output(spark, sf).join(
        matrix(spark, sf).select("candidate_id", "is_honeypot"), "candidate_id", "left"
    )
    return joined.groupBy("jd_id").agg(
        F.sum("is_honeypot").cast("bigint").alias("honeypots"),
        F.count(F.lit(1)).alias("rows"),
    )


# --- coverage -------------------------------------------------------------------------

_LEVELS = "[0.6, 0.44999999999999996, 0.3, 0.15000000000000002, 0.0]"
_COVER = f"""{S.GATED}, lv AS (SELECT unnest(range(5))::INTEGER AS iteration, unnest({_LEVELS}::DOUBLE[]) AS threshold),
pool AS (SELECT iteration, threshold, g.* FROM lv JOIN gated g ON gate_passed AND (jd_fit_score >= threshold OR retrieval_skill_count > 0 OR llm_skill_count > 0)),
cov AS (SELECT iteration, threshold, count(*) AS pool_size, least(count(*) FILTER (retrieval_skill_count > 0) / 6000.0, 1.0) AS retrieval_experience,
  least(count(*) FILTER (llm_skill_count > 0) / 6000.0, 1.0) AS llm_experience, least(count(*) FILTER (has_production_keywords > 0) / 6000.0, 1.0) AS production_evidence,
  least(count(*) FILTER (product_company_ratio > 0.5) / 6000.0, 1.0) AS product_company, least(count(*) FILTER (availability_score > 0.3) / 6000.0, 1.0) AS available FROM pool GROUP BY ALL),
c2 AS (SELECT *, least(retrieval_experience, llm_experience, production_evidence, product_company, available) AS min_coverage FROM cov)"""
_COLS = "retrieval_experience llm_experience production_evidence product_company available min_coverage".split()


@query("coverage_levels", f"{_COVER} SELECT iteration, round(threshold, 6) AS threshold, pool_size, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _COLS)} FROM c2")
def coverage_levels(spark, sf):
    return rounded(scoring.coverage_levels(matrix(spark, sf), target=6000))


@query("coverage_result", f"""{_COVER} SELECT iteration, pool_size, round(min_coverage::DOUBLE, 6) AS min_coverage, CASE WHEN iteration >= 4 THEN 'max_iterations' ELSE 'confident' END AS exit_reason,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {c} < 0.6 THEN '{c}' END" for c in _COLS[:-1])}], lambda x: x IS NOT NULL), ',') AS gaps
FROM c2 WHERE min_coverage >= 0.8 OR iteration >= 4 ORDER BY iteration LIMIT 1""")
def coverage_result(spark, sf):
    result = scoring.coverage_result(scoring.coverage_levels(matrix(spark, sf), target=6000))
    return rounded(result.select("iteration", "pool_size", "min_coverage", "exit_reason", "gaps"))


@query("coverage_pool", f"""{_COVER}, stop AS (SELECT min(iteration) AS i FROM c2 WHERE min_coverage >= 0.8 OR iteration >= 4)
SELECT candidate_id, round(jd_fit_score, 6) AS jd_fit_score FROM pool, stop WHERE iteration = i""")
def coverage_pool(spark, sf):
    result = scoring.coverage_result(scoring.coverage_levels(matrix(spark, sf), target=6000))
    return rounded(scoring.coverage_pool(matrix(spark, sf), result).select(
        "candidate_id", "jd_fit_score"
    ))


# --- comparing two rankings -----------------------------------------------------------

_AB = f"""{_FINAL}, llm AS (SELECT f.*, ((substr(candidate_id, 6)::BIGINT * 7919) % 1000) / 1000.0::DOUBLE AS llm_fit_score FROM scored f),
b AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY {_key('sc')} DESC, candidate_id) AS rank FROM (SELECT jd_id, candidate_id, CASE WHEN gate_passed AND is_honeypot <> 1 THEN {S.clip(f'{_CORE} * {_SHOWN}')} ELSE 0 END AS sc FROM llm WHERE is_honeypot <> 1)),
w AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY {_key('sc')} DESC, candidate_id) AS rank FROM (SELECT jd_id, candidate_id, CASE WHEN gate_passed AND is_honeypot <> 1 THEN {S.clip(f'(0.85::DOUBLE * {_CORE} + 0.15::DOUBLE * llm_fit_score) * {_SHOWN}')} ELSE 0 END AS sc FROM llm WHERE is_honeypot <> 1)),
m AS (SELECT jd_id, count(*) FILTER (b.candidate_id <> w.candidate_id) AS moved FROM b JOIN w USING (jd_id, rank) WHERE rank <= 20 GROUP BY jd_id),
o AS (SELECT b.jd_id, count(w.candidate_id) AS overlap FROM b LEFT JOIN w ON b.jd_id = w.jd_id AND b.candidate_id = w.candidate_id AND w.rank <= 100 WHERE b.rank <= 100 GROUP BY b.jd_id)"""


def _ab(spark, sf):
    """Every job ranked without and with an outside fit score."""
    base = scored(spark, sf)
    outside = (F.substring("candidate_id", 6, 7).cast("bigint") * 7919 % 1000) / F.lit(1000.0)
    with_column = base.withColumn("llm_fit_score", outside)
    lists = [explain.rank_candidates(scoring.with_final_score(df), 100, "jd_id")
             for df in (base, with_column)]
    return [df.select("jd_id", "candidate_id", "rank") for df in lists]


@query("ab_churn", f"{_AB} SELECT sum(moved)::BIGINT AS moved, sum(overlap)::BIGINT AS overlap FROM m JOIN o USING (jd_id)")
def ab_churn(spark, sf):
    """Over all jobs: how many of the first twenty moved, how many of the first hundred stay."""
    return ab_churn_by_job(spark, sf).agg(
        F.sum("moved").alias("moved"), F.sum("overlap").alias("overlap")
    )


@query("ab_churn_by_job", f"{_AB} SELECT jd_id, moved, overlap FROM m JOIN o USING (jd_id)")
def ab_churn_by_job(spark, sf):
    without, with_score = _ab(spark, sf)
    return metrics.compare_rankings(without, with_score, "candidate_id", group="jd_id")


@query("ab_metrics")
def ab_metrics(spark, sf):
    """NDCG, MAP and P@10 of both lists of every job against the graded labels (metrics are
    checked elsewhere)."""
    without, with_score = _ab(spark, sf)
    runs = without.withColumn("run", F.lit("without")).unionByName(
        with_score.withColumn("run", F.lit("with"))
    ).withColumn("run", F.struct("jd_id", "run")).drop("jd_id")
    grades = _labels(spark, sf).withColumnRenamed("tier", "grade")
    found = metrics.ranking_metrics(runs, grades)
    return found.select("run.*", *[c for c in found.columns if c != "run"])


# --- subsets --------------------------------------------------------------------------


@query("known_candidates", "SELECT 'CAND_' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS candidate_id FROM orders WHERE o_orderkey IN (SELECT user_id * 101 FROM events)")
def known_candidates(spark, sf):
    """Requested ids that the matrix knows."""
    return matrix(spark, sf).select("candidate_id").join(
        _requested(spark, sf), "candidate_id", "left_semi"
    )


def _requested(spark, sf):
    number = (F.col("user_id") * 101).cast("string")
    return t.load(spark, sf, "events").select(
        F.concat(F.lit("CAND_"), F.lpad(number, 7, "0")).alias("candidate_id")
    ).distinct()


_SUBSET_IDS = "SELECT user_id * 101 FROM events"
_LEAN = f"""scored AS (SELECT l.*, jd_id, retrieval_score FROM labelled l JOIN retr USING (candidate_id)),
final AS MATERIALIZED (SELECT s.*, CASE WHEN gate_passed AND is_honeypot <> 1 THEN {S.clip(f'{_CORE} * {_SHOWN}')} ELSE 0 END AS final_score FROM scored s),
top AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY {_key('final_score')} DESC, candidate_id) AS rank FROM final WHERE is_honeypot <> 1)
{_FMT}, output AS (SELECT jd_id, candidate_id, row_number() OVER (PARTITION BY jd_id ORDER BY round_even(final_score, 4) DESC, candidate_id)::INTEGER AS rank,
  round_even(final_score, 4) AS score, reasoning FROM explained)
SELECT jd_id, candidate_id, rank, score, reasoning FROM output"""
_POOL = f"pool AS (SELECT * FROM gated WHERE candidate_id IN (SELECT 'CAND_' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') FROM orders WHERE o_orderkey IN ({_SUBSET_IDS})))"


def _subset(spark, sf) -> build.Answer:
    return build.rank_subset(
        matrix(spark, sf), _requested(spark, sf), jobs(spark, sf), retrieval(spark, sf)
    )


@query("ranked_subset", f"{S.GATED}, {_POOL}{S.labels('pool')}{_RETRIEVAL}, {_LEAN}")
def ranked_subset(spark, sf):
    """The requested candidates alone, by their retrieval scores in the full pool."""
    return _subset(spark, sf).rows


@query("ranked_subset_gates", f"""{S.GATED}, {_POOL} SELECT count(*) AS total, count(*) FILTER (gate_passed) AS passed,
  count(*) FILTER (NOT gate_passed) AS excluded, sum(is_honeypot)::BIGINT AS honeypots, sum(keyword_stuffer_flag)::BIGINT AS keyword_stuffers FROM pool""")
def ranked_subset_gates(spark, sf):
    return _subset(spark, sf).gates


@query("ranked_adhoc", f"{S.GATED}, {_POOL}, asked AS (SELECT * FROM person WHERE candidate_id IN (SELECT candidate_id FROM pool)){S.labels('pool')}{_retrieval_sql('asked')}, {_LEAN}")
def ranked_adhoc(spark, sf):
    """The same profiles as if no matrix knew them: features are built, and they are retrieved among
    themselves."""
    raw = t.candidates(spark, sf).join(_requested(spark, sf), "candidate_id", "left_semi")
    return build.rank_adhoc(raw, jobs(spark, sf), as_of=t.CANDIDATE_AS_OF, code="md5").rows


@query("graded_sample", f"""{S.LABELLED} SELECT candidate_id, current_title, n_roles FROM (
  SELECT candidate_id, current_title, row_number() OVER (ORDER BY floor(proxy_label * 1e9 + 0.5) DESC, candidate_id) AS n,
    (SELECT count(*) FROM roles r WHERE r.k = labelled.k) AS n_roles FROM labelled) WHERE n <= 400""")
def graded_sample(spark, sf):
    """Raw profiles of the four hundred highest labels, for an outside judge."""
    labels = stored(spark, sf, "proxy", lambda: scoring.with_proxy_label(matrix(spark, sf)).select(
        "candidate_id", "proxy_label"
    ))
    raw = sampling.graded_sample(t.candidates(spark, sf), labels, 400)
    return raw.select(
        "candidate_id", F.col("profile.current_title").alias("current_title"),
        F.size("career_history").cast("bigint").alias("n_roles"),
    )


@query("unknown_candidates", "SELECT DISTINCT 'CAND_' || lpad(CAST(user_id * 101 AS VARCHAR), 7, '0') AS candidate_id FROM events WHERE user_id * 101 NOT IN (SELECT o_orderkey FROM orders)")
def unknown_candidates(spark, sf):
    """Requested ids that force a recomputation."""
    return _requested(spark, sf).join(
        profile_columns(spark, sf).select("candidate_id").distinct(), "candidate_id", "left_anti"
    )


@query("score_order", f"{S.LABELLED} SELECT candidate_id, row_number() OVER (ORDER BY floor(proxy_label * 1e9 + 0.5) DESC, candidate_id) - 1 AS rank FROM labelled")
def score_order(spark, sf):
    """Position of every candidate by proxy label, without a single-task sort."""
    from laurel.operators.ranking import rank_positions

    return rank_positions(
        scoring.with_proxy_label(matrix(spark, sf)).select("candidate_id", "proxy_label"),
        "proxy_label", "candidate_id",
    ).select("candidate_id", "rank")


# --- job specifications ---------------------------------------------------------------


@query("job_spec_requirements", f"""WITH {_JOBS}, tags AS (SELECT jd_id, unnest(['python','retrieval','ranking']) AS tag, text FROM jobs)
SELECT jd_id, 0 AS position, text AS description, 0.9::DOUBLE AS weight, tag AS skill_tag FROM tags""")
def job_spec_requirements(spark, sf):
    """Job specifications written as JSON and read back, one row per requirement tag."""
    spec = F.to_json(F.struct(F.array(F.struct(
        F.col("text").alias("description"), F.lit(0.9).alias("weight"),
        F.array(*map(F.lit, ("python", "retrieval", "ranking"))).alias("skill_tags"),
    )).alias("weighted_requirements")))
    parsed = jobspec.parse_job_specs(jobs(spark, sf).withColumn("spec", spec))
    again = jobspec.parse_job_specs(jobspec.job_spec_json(parsed).select("jd_id", "spec"))
    return jobspec.requirements(again, "jd_id")
