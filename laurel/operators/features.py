"""The forty numeric features of a candidate, plus display columns.

Everything is a projection over one candidate row: no shuffle. The nested arrays are decoded
once into typed helper arrays, and the features are folds over those. Only the word lists of
titles and companies are searched in an Arrow batch, once per distinct name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel import vocab
from laurel.functions.dates import DAYS_PER_MONTH, safe_date
from laurel.functions.numeric import clip, flag, number_or_zero
from laurel.functions.text import (
    contains_any,
    first_rule,
    text_contains_any,
    word_count,
)
from laurel.operators.quality import honeypot_reasons
from laurel.sources.candidates import roles_of, skills_of

DEFAULT_AS_OF = dt.date(2026, 6, 19)

BEHAVIOUR_WEIGHTS = {"availability": 0.35, "engagement": 0.35, "trust": 0.20, "github": 0.10}
RECENCY_DAYS = 90.0

_EPOCH = dt.date(1900, 1, 1)

DISPLAY_COLUMNS = (
    "honeypot_reasons", "current_title", "current_company", "location", "country",
    "anonymized_name", "top_jd_skills", "top_retrieval_skills", "recruiter_response_rate",
    "preferred_work_mode", "willing_to_relocate", "has_live_evidence",
    "evidence_confidence_bonus",
)


# --- scalar rules ---------------------------------------------------------------------


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def title_level(title: Column) -> Column:
    return _level(_low(title))


def _level(low: Column) -> Column:
    return first_rule(low, vocab.TITLE_LEVELS, vocab.DEFAULT_TITLE_LEVEL)


def is_consulting(company: Column) -> Column:
    """Substring rule: any firm name inside the company name."""
    return _consulting(_low(company))


def _consulting(low: Column) -> Column:
    return contains_any(low, vocab.CONSULTING_FIRMS)


def is_technical_title(title: Column) -> Column:
    return _technical(_low(title))


def _technical(low: Column) -> Column:
    return ~contains_any(low, vocab.NON_TECHNICAL_TITLE_TOKENS) & contains_any(
        low, vocab.TECHNICAL_TITLE_TOKENS
    )


def title_relevance(title: Column) -> Column:
    """0 non-technical, 1 AI/ML/data, 0.55 other technical, 0.3 unknown."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(contains_any(low, vocab.NON_TECHNICAL_TITLE_TOKENS), F.lit(0.0))
        .when(contains_any(low, vocab.AI_TITLE_TOKENS), F.lit(1.0))
        .when(contains_any(low, vocab.TECHNICAL_TITLE_TOKENS), F.lit(0.55))
        .otherwise(F.lit(0.3))
    )


def proficiency_weight(proficiency: Column, default: float) -> Column:
    return _weight(_low(proficiency), default)


def _weight(low: Column, default: float) -> Column:
    out = None
    for name, weight in vocab.PROFICIENCY_WEIGHTS.items():
        hit = low == name
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return out.otherwise(F.lit(default))


def whole(x: Column) -> Column:
    """Integer part; null counts as 0."""
    return F.coalesce(x, F.lit(0.0)).cast("int")


def location_fit() -> Column:
    place = F.lower(F.coalesce(F.col("profile.location"), F.lit("")))
    country = F.lower(F.coalesce(F.col("profile.country"), F.lit("")))
    return (
        F.when(contains_any(place, vocab.PREFERRED_LOCATIONS), F.lit(1.0))
        .when(country.contains("india"), F.lit(0.7))
        .when(F.col("signals.willing_to_relocate"), F.lit(0.35))
        .otherwise(F.lit(0.1))
    )


# --- typed helper arrays --------------------------------------------------------------


def _any_of(low: str, words) -> bool:
    return any(word in low for word in words)


def _title_code(low: str) -> int:
    """``_level`` times four, plus two for ``_technical``."""
    level = next(
        (n for n, words in vocab.TITLE_LEVELS if _any_of(low, words)), vocab.DEFAULT_TITLE_LEVEL
    )
    technical = not _any_of(low, vocab.NON_TECHNICAL_TITLE_TOKENS) and _any_of(
        low, vocab.TECHNICAL_TITLE_TOKENS
    )
    return 4 * level + 2 * technical


def _company_code(low: str) -> int:
    """One for ``_consulting``."""
    return int(_any_of(low, vocab.CONSULTING_FIRMS))


def _coded(names: pa.Array, rule: Callable[[str], int]) -> np.ndarray:
    """The rule's value for every name of the lists, found once per distinct one."""
    seen = names.flatten().dictionary_encode()
    words = [w.decode(errors="replace") for w in seen.dictionary.cast(pa.binary()).to_pylist()]
    codes = np.array([rule(w) for w in words], np.int32)
    return codes[seen.indices.to_numpy(zero_copy_only=False)]


def _role_codes() -> Column:
    """Per role of ``_typed`` its ``_title_code`` plus its ``_company_code``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def codes(titles: pa.Array, companies: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(titles.value_lengths()), dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(np.append(np.int32(0), ends)),
            pa.array(_coded(titles, _title_code) + _coded(companies, _company_code)),
        )

    return codes(F.col("_typed")["low_title"], F.col("_typed")["low_company"])


def _typed_roles() -> Column:
    """Roles in input order; an unreadable start is that of the epoch."""
    read = F.transform(
        roles_of(),
        lambda r, i: F.struct(
            i.alias("pos"), safe_date(r["start_date"]).alias("start"), r.alias("role"),
        ),
    )

    def typed(x: Column) -> Column:
        r = x["role"]
        return F.struct(
            F.coalesce(x["start"], F.lit(_EPOCH)).alias("sort_date"),
            x["pos"].alias("pos"),
            x["start"].alias("start"),
            safe_date(r["end_date"]).alias("end"),
            whole(r["duration_months"]).alias("months"),
            F.coalesce(r["company"], F.lit("")).alias("company"),
            F.coalesce(r["title"], F.lit("")).alias("title"),
            F.coalesce(r["description"], F.lit("")).alias("description"),
            r["company_size"].alias("company_size"),
            F.coalesce(r["is_current"], F.lit(False)).alias("current"),
            _low(r["title"]).alias("low_title"),
            _low(r["company"]).alias("low_company"),
        )

    return F.transform(read, typed)


def _coded_roles() -> Column:
    """The roles of ``_typed`` with what ``_codes`` says of them, by start date, input order on
    ties."""
    kept = ("sort_date", "pos", "start", "end", "months", "company", "title", "description",
            "company_size", "current")

    def coded(r: Column, code: Column) -> Column:
        return F.struct(
            *[r[name].alias(name) for name in kept],
            (code.bitwiseAND(F.lit(1)) != 0).alias("consulting"),
            (code.bitwiseAND(F.lit(2)) != 0).alias("technical"),
            F.shiftright(code, 2).alias("level"),
        )

    return F.sort_array(F.zip_with("_typed", "_codes", coded))


def _typed_skills() -> Column:
    def read(s: Column, i: Column) -> Column:
        return F.struct(
            i.alias("pos"), _low(s["name"]).alias("low"),
            _low(s["proficiency"]).alias("low_proficiency"),
            whole(s["endorsements"]).alias("endorsements"),
            whole(s["duration_months"]).alias("months"), s.alias("skill"),
        )

    def decode(x: Column) -> Column:
        s, low, proficiency = x["skill"], x["low"], x["low_proficiency"]
        endorsements, months = x["endorsements"], x["months"]
        depth = F.log1p(endorsements.cast("double")) * F.sqrt(
            F.greatest(months, F.lit(0)) / F.lit(12.0)
        )
        return F.struct(
            x["pos"].alias("pos"),
            F.coalesce(s["name"], F.lit("")).alias("name"),
            low.alias("low"),
            s["proficiency"].alias("proficiency"),
            endorsements.alias("endorsements"),
            months.alias("months"),
            (_weight(proficiency, 0.3) * depth).alias("trust"),
            (_weight(proficiency, 0.0) * (F.lit(1) + endorsements)).alias(
                "strength"
            ),
            low.isin(list(vocab.JD_CORE_SKILLS)).alias("core"),
            low.isin(list(vocab.RETRIEVAL_SKILLS)).alias("retrieval"),
            low.isin(list(vocab.LLM_SKILLS)).alias("language_model"),
            low.isin(list(vocab.CORE_ML_SKILLS)).alias("ml"),
            low.isin(list(vocab.CV_SPEECH_ROBOTICS_SKILLS)).alias("vision"),
            low.isin(list(vocab.NON_RELEVANT_SKILLS)).alias("off_topic"),
        )

    return F.transform(F.transform(skills_of(), read), decode)


def decode(candidates: DataFrame) -> DataFrame:
    """Add the typed arrays ``_roles``, ``_skills``, ``_matched`` and the score map."""
    read = candidates.withColumn("_typed", _typed_roles()).withColumn("_codes", _role_codes())
    typed = read.withColumns({
        "_roles": _coded_roles(),
        "_skills": _typed_skills(),
        "_scores": F.coalesce(
            F.col("signals.skill_assessment_scores"),
            F.create_map().cast("map<string,double>"),
        ),
        "_title_factor": title_relevance(F.col("profile.current_title")),
    })
    return typed.withColumn("_matched", F.filter("_skills", lambda s: s["core"]))


def _total(array: str | Column, value, start=0.0) -> Column:
    return F.aggregate(array, F.lit(start), lambda acc, x: acc + value(x))


def _ratio(numerator: Column, count: Column) -> Column:
    return F.when(count > 0, numerator / count).otherwise(F.lit(0.0))


def _count(array: str, predicate) -> Column:
    return F.size(F.filter(array, predicate))


# --- feature groups -------------------------------------------------------------------


def with_career_features(df: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Twelve career features and the internal count of technical roles."""
    roles, today = F.col("_roles"), F.lit(as_of)
    n = F.size(roles)
    earlier = F.slice(roles, F.lit(1), F.greatest(n - 1, F.lit(0)))
    later = F.slice(roles, F.lit(2), F.greatest(n - 1, F.lit(0)))

    def gap(before: Column, after: Column) -> Column:
        idle = F.datediff(after["start"], F.coalesce(before["end"], today))
        recent = F.datediff(today, after["start"]) < 1800
        return F.coalesce((idle > 183) & recent, F.lit(False))

    first, last = F.get(roles, F.lit(0)), F.try_element_at(roles, F.lit(-1))
    now = F.coalesce(F.get(F.filter(roles, lambda r: r["current"]), F.lit(0)), last)
    months = _total("_roles", lambda r: r["months"], 0)
    independent = _count("_roles", lambda r: ~r["consulting"])
    horizon = F.add_months(today, -48)
    short = F.filter(roles, lambda r: (r["sort_date"] >= horizon) & (r["months"] < 18))
    titles = F.size(F.array_distinct(F.transform(roles, lambda r: r["title"])))
    words = _total("_roles", lambda r: word_count(r["description"]), 0)
    text = F.lower(F.array_join(F.transform(roles, lambda r: r["description"]), " "))

    staged = df.withColumns({"_text": text, "_independent": independent, "_months": months})
    return staged.withColumns({
        "role_count": n.cast("double"),
        "total_experience_years": F.coalesce(
            F.col("profile.years_of_experience"), F.lit(0.0)
        ),
        "avg_tenure_months": _ratio(F.col("_months"), n),
        "scope_progression_score": F.when(
            n >= 2, clip(F.lit(0.5) + F.lit(0.1) * (last["level"] - first["level"]))
        ).otherwise(F.lit(0.5)),
        "has_recent_career_gap": flag(
            F.exists(F.zip_with(earlier, later, gap), lambda x: x)
        ),
        "product_company_ratio": _ratio(F.col("_independent"), n),
        "all_consulting_career": flag((n > 0) & (F.col("_independent") == 0)),
        "last_role_start_recency_months": F.coalesce(
            F.greatest(F.datediff(today, now["start"]) / F.lit(DAYS_PER_MONTH), F.lit(0.0)),
            F.lit(0.0),
        ),
        "avg_title_tenure_months": _ratio(F.col("_months"), titles),
        "title_chaser_flag": flag(
            F.size(F.array_distinct(F.transform(short, lambda r: r["company"]))) >= 3
        ),
        "avg_description_words": _ratio(words, n),
        "has_production_keywords": flag(
            text_contains_any(F.col("_text"), vocab.PRODUCTION_KEYWORDS)
        ),
        "_technical_roles": _count("_roles", lambda r: r["technical"]),
    })


def with_skill_features(df: DataFrame) -> DataFrame:
    """Thirteen skill features, the two skill lists and the internal assessment share.
    Needs ``_technical_roles``."""
    counted = df.withColumns({
        "_n_core": F.size("_matched"),
        "_n_retrieval": _count("_skills", lambda s: s["retrieval"]),
        "_n_lm": _count("_skills", lambda s: s["language_model"]),
        "_n_ml": _count("_skills", lambda s: s["ml"]),
        "_n_vision": _count("_skills", lambda s: s["vision"]),
        "_n_off": _count("_skills", lambda s: s["off_topic"]),
        "_n_scores": F.size("_scores"),
        "_relevant": F.map_values(
            F.map_filter(
                "_scores", lambda k, v: F.lower(k).isin(list(vocab.JD_CORE_SKILLS))
            )
        ),
    })
    c = F.col
    specialised = c("_n_retrieval") + c("_n_lm") + c("_n_ml") + c("_n_vision")
    endorsements = _total("_matched", lambda s: s["endorsements"], 0)
    untechnical = c("_technical_roles") == 0
    stuffed = (c("_n_core") >= 3) & (c("_title_factor") == 0.0) & untechnical
    padded = (
        (c("_n_core") >= 8)
        & (_ratio(endorsements, c("_n_core")) < 5)
        & (c("_n_off") > c("_n_core"))
        & untechnical
    )
    strongest = F.sort_array(
        F.transform(
            "_matched",
            lambda s: F.struct(
                (-s["strength"]).alias("k"), s["pos"].alias("pos"), s["name"].alias("name")
            ),
        )
    )
    values = F.map_values("_scores")
    return counted.withColumns({
        "jd_skill_match_count": c("_n_core").cast("double"),
        "jd_skill_match_ratio": c("_n_core") / F.greatest(F.size("_skills"), F.lit(1)),
        "retrieval_skill_count": c("_n_retrieval").cast("double"),
        "llm_skill_count": c("_n_lm").cast("double"),
        "cv_speech_dominance": _ratio(c("_n_vision"), specialised),
        "non_relevant_skill_count": c("_n_off").cast("double"),
        "skill_trust_score": _total("_matched", lambda s: s["trust"]),
        "keyword_stuffer_flag": flag(stuffed | padded),
        "assessment_verified_skills": c("_n_scores").cast("double"),
        "assessment_mean_score": _ratio(_total(values, lambda v: v), c("_n_scores")),
        "top_assessment_score": F.coalesce(F.array_max(values), F.lit(0.0)),
        "max_jd_skill_duration_months": F.coalesce(
            F.array_max(F.transform("_matched", lambda s: s["months"])), F.lit(0)
        ).cast("double"),
        "recent_jd_skill_flag": flag(F.exists("_matched", lambda s: s["months"] >= 12)),
        "_assessed": _ratio(_total("_relevant", lambda v: v), F.size("_relevant"))
        / F.lit(100.0),
        "top_jd_skills": F.transform(F.slice(strongest, 1, 3), lambda s: s["name"]),
        "top_retrieval_skills": F.transform(
            F.slice(F.filter("_skills", lambda s: s["retrieval"]), 1, 3),
            lambda s: s["name"],
        ),
    })


def with_signal_features(df: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """Eleven behavioural features."""

    def signal(name: str) -> Column:
        return F.coalesce(F.col(f"signals.{name}"), F.lit(0.0))

    def on(name: str) -> Column:
        return F.coalesce(F.col(f"signals.{name}"), F.lit(False))

    def zero_is_missing(name: str) -> Column:
        return F.when(signal(name) == 0.0, F.lit(-1.0)).otherwise(signal(name))

    c = F.col
    idle = F.coalesce(
        F.datediff(F.lit(as_of), safe_date(c("signals.last_active_date"))), F.lit(365)
    )
    complete = F.least(signal("profile_completeness_score") / F.lit(100.0), F.lit(1.0))
    staged = df.withColumns({
        "days_since_active": idle.cast("double"),
        "notice_period_days": whole(c("signals.notice_period_days")).cast("double"),
        "recruiter_response_rate": signal("recruiter_response_rate"),
        "_github": zero_is_missing("github_activity_score"),
        "_offers": zero_is_missing("offer_acceptance_rate"),
    }).withColumns({
        "recency_score": F.exp(
            -F.greatest(c("days_since_active"), F.lit(0.0)) / F.lit(RECENCY_DAYS)
        ),
        "github_activity_score": F.greatest(c("_github"), F.lit(0.0)),
    })
    notice = (
        F.when(c("notice_period_days") <= 30, F.lit(1.0))
        .when(c("notice_period_days") <= 60, F.lit(0.7))
        .when(c("notice_period_days") <= 90, F.lit(0.4))
        .otherwise(F.lit(0.1))
    )
    reachable = F.when(on("open_to_work_flag"), F.lit(1.0)).otherwise(F.lit(0.3))
    saved = whole(c("signals.saved_by_recruiters_30d")) / F.lit(10.0)
    scored = staged.withColumns({
        "availability_score": reachable * notice * c("recency_score"),
        "engagement_score": F.lit(0.40) * c("recruiter_response_rate")
        + F.lit(0.20) * signal("interview_completion_rate")
        + F.lit(0.20) * complete
        + F.lit(0.10) * F.least(saved, F.lit(1.0))
        + F.lit(0.10) / (F.lit(1.0) + signal("avg_response_time_hours") / F.lit(24.0)),
        "trust_score": F.lit(0.3) * flag(on("verified_email"))
        + F.lit(0.3) * flag(on("verified_phone"))
        + F.lit(0.2) * flag(on("linkedin_connected"))
        + F.lit(0.2) * complete,
        "github_linked": flag(c("_github") >= 0),
        "open_to_work": flag(on("open_to_work_flag")),
        "offer_acceptance_rate": F.when(c("_offers") >= 0, c("_offers")).otherwise(
            F.lit(0.5)
        ),
    })
    return scored.withColumn("behavioural_composite", behavioural_composite())


def behavioural_composite() -> Column:
    w, c = BEHAVIOUR_WEIGHTS, F.col
    return (
        F.lit(w["availability"]) * c("availability_score")
        + F.lit(w["engagement"]) * c("engagement_score")
        + F.lit(w["trust"]) * c("trust_score")
        + F.lit(w["github"]) * (c("github_activity_score") / F.lit(100.0))
    )


def recompute_behavioural(matrix: DataFrame) -> DataFrame:
    """The composite again, from the stored matrix, clipped to 0..1."""
    return matrix.withColumn("behavioural_composite", clip(behavioural_composite()))


def with_job_fit_features(df: DataFrame) -> DataFrame:
    """Competence fit, location fit and the wrong-specialisation penalty. Needs the career
    and skill groups."""
    c = F.col
    language_side = (
        (c("retrieval_skill_count") > 0)
        | (c("llm_skill_count") > 0)
        | F.exists("_skills", lambda s: s["low"].isin(list(vocab.NLP_SKILLS)))
    )
    staged = df.withColumns({
        "location_fit": location_fit(),
        "wrong_specialisation_penalty": F.when(language_side, F.lit(0.0)).otherwise(
            c("cv_speech_dominance")
        ),
    })
    base = (
        F.lit(0.30) * F.least(c("retrieval_skill_count") / F.lit(3.0), F.lit(1.0))
        + F.lit(0.15) * F.least(c("jd_skill_match_count") / F.lit(6.0), F.lit(1.0))
        + F.lit(0.12) * F.tanh(c("skill_trust_score") / F.lit(4.0))
        + F.lit(0.12) * c("_assessed")
        + F.lit(0.10) * c("product_company_ratio")
        + F.lit(0.08) * c("has_production_keywords")
        + F.lit(0.08) * c("scope_progression_score")
        + F.lit(0.05) * F.least(c("llm_skill_count") / F.lit(3.0), F.lit(1.0))
    )
    fit = (
        base
        * (F.lit(0.4) + F.lit(0.6) * c("_title_factor"))
        * (F.lit(1.0) - F.lit(0.7) * c("wrong_specialisation_penalty"))
        * (F.lit(1.0) - F.lit(0.6) * c("keyword_stuffer_flag"))
        * (F.lit(1.0) - F.lit(0.5) * c("all_consulting_career"))
    )
    return staged.withColumn("jd_fit_score", clip(fit))


def with_numeric_contract(df: DataFrame) -> DataFrame:
    """All forty columns present as doubles: absent or non-numeric values become 0."""
    present = set(df.columns)
    return df.withColumns({
        name: number_or_zero(F.col(name)) if name in present else F.lit(0.0)
        for name in vocab.NUMERIC_FEATURES
    })


def feature_matrix(
    candidates: DataFrame, as_of: dt.date = DEFAULT_AS_OF, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per candidate: id, forty numeric features, display columns, and any
    ``keep`` columns of the input."""
    df = decode(candidates)
    df = with_career_features(df, as_of)
    df = with_skill_features(df)
    df = with_signal_features(df, as_of)
    df = with_job_fit_features(df)
    df = df.withColumn("honeypot_reasons", honeypot_reasons(as_of)).withColumns({
        "is_honeypot": flag(F.size("honeypot_reasons") > 0),
        "has_live_evidence": F.lit(0.0),
        "evidence_confidence_bonus": F.lit(0.0),
    })
    text = {
        name: F.coalesce(F.col(f"profile.{name}"), F.lit(""))
        for name in (
            "current_title", "current_company", "location", "country", "anonymized_name"
        )
    }
    df = df.withColumns({
        **text,
        "preferred_work_mode": F.coalesce(F.col("signals.preferred_work_mode"), F.lit("")),
        "willing_to_relocate": F.coalesce(
            F.col("signals.willing_to_relocate"), F.lit(False)
        ),
    })
    return df.select("candidate_id", *vocab.NUMERIC_FEATURES, *DISPLAY_COLUMNS, *keep)


def matrix_counters(matrix: DataFrame) -> DataFrame:
    """One row: rows, impossible profiles, keyword stuffers."""
    return matrix.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_honeypot").cast("bigint").alias("honeypots"),
        F.sum("keyword_stuffer_flag").cast("bigint").alias("keyword_stuffers"),
    )


# --- evidence override ----------------------------------------------------------------

RESUME_CLAIM_CONFIDENCE = 0.2
EVIDENCE_SCALE = 5.0


def skill_confidences(matrix: DataFrame, skill_records: DataFrame) -> DataFrame:
    """(candidate_id, skill, confidence) for the top job skills of each candidate: the
    proven confidence where there is one, else that of a bare claim.

    ``skill_records``: candidate_id, skill_name, confidence.
    """
    wanted = matrix.select(
        "candidate_id", F.explode("top_jd_skills").alias("skill")
    ).withColumn("skill", F.lower("skill"))
    known = skill_records.select(
        "candidate_id", F.lower("skill_name").alias("skill"),
        F.col("confidence").cast("double").alias("known"),
    )
    return wanted.join(known, ["candidate_id", "skill"], "left").select(
        "candidate_id", "skill",
        F.coalesce("known", F.lit(RESUME_CLAIM_CONFIDENCE)).alias("confidence"),
    )


def apply_live_evidence(
    matrix: DataFrame, skill_records: DataFrame, bonus: float = 0.15
) -> DataFrame:
    """Where proven confidence beats a bare claim, trust becomes its mean times five and
    the row earns the evidence bonus."""
    proven = (
        skill_confidences(matrix, skill_records)
        .filter(F.col("confidence") > RESUME_CLAIM_CONFIDENCE)
        .groupBy("candidate_id")
        .agg(F.avg("confidence").alias("_proven"))
    )
    hit = F.col("_proven").isNotNull()
    return (
        matrix.join(proven, "candidate_id", "left")
        .withColumns({
            "skill_trust_score": F.when(hit, F.col("_proven") * EVIDENCE_SCALE).otherwise(
                F.col("skill_trust_score")
            ),
            "has_live_evidence": F.when(hit, F.lit(1.0)).otherwise(
                F.col("has_live_evidence")
            ),
            "evidence_confidence_bonus": F.when(hit, F.lit(bonus)).otherwise(
                F.col("evidence_confidence_bonus")
            ),
        })
        .drop("_proven")
    )
