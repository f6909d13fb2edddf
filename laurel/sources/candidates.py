"""Nested candidate profiles: schema, JSON-lines scan, text projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.functions.text import join_nonempty

TEXT, NUMBER, FLAG = T.StringType(), T.DoubleType(), T.BooleanType()

# Field names of the profile format, in its order.
PROFILE = T.StructType([
    T.StructField("anonymized_name", TEXT),
    T.StructField("headline", TEXT),
    T.StructField("summary", TEXT),
    T.StructField("location", TEXT),
    T.StructField("country", TEXT),
    T.StructField("years_of_experience", NUMBER),
    T.StructField("current_title", TEXT),
    T.StructField("current_company", TEXT),
    T.StructField("current_company_size", TEXT),
    T.StructField("current_industry", TEXT),
])
ROLE = T.StructType([
    T.StructField("company", TEXT),
    T.StructField("title", TEXT),
    T.StructField("start_date", TEXT),
    T.StructField("end_date", TEXT),
    T.StructField("duration_months", NUMBER),
    T.StructField("is_current", FLAG),
    T.StructField("industry", TEXT),
    T.StructField("company_size", TEXT),
    T.StructField("description", TEXT),
])
EDUCATION = T.StructType([
    T.StructField("institution", TEXT),
    T.StructField("degree", TEXT),
    T.StructField("field_of_study", TEXT),
    T.StructField("start_year", NUMBER),
    T.StructField("end_year", NUMBER),
    T.StructField("grade", TEXT),
    T.StructField("tier", TEXT),
])
SKILL = T.StructType([
    T.StructField("name", TEXT),
    T.StructField("proficiency", TEXT),
    T.StructField("endorsements", NUMBER),
    T.StructField("duration_months", NUMBER),
])
CERTIFICATION = T.StructType([
    T.StructField("name", TEXT),
    T.StructField("issuer", TEXT),
    T.StructField("year", NUMBER),
])
LANGUAGE = T.StructType([
    T.StructField("language", TEXT),
    T.StructField("proficiency", TEXT),
])
SALARY = T.StructType([
    T.StructField("min", NUMBER),
    T.StructField("max", NUMBER),
])
SIGNALS = T.StructType([
    T.StructField("profile_completeness_score", NUMBER),
    T.StructField("signup_date", TEXT),
    T.StructField("last_active_date", TEXT),
    T.StructField("open_to_work_flag", FLAG),
    T.StructField("profile_views_received_30d", NUMBER),
    T.StructField("applications_submitted_30d", NUMBER),
    T.StructField("recruiter_response_rate", NUMBER),
    T.StructField("avg_response_time_hours", NUMBER),
    T.StructField("skill_assessment_scores", T.MapType(TEXT, NUMBER)),
    T.StructField("connection_count", NUMBER),
    T.StructField("endorsements_received", NUMBER),
    T.StructField("notice_period_days", NUMBER),
    T.StructField("expected_salary_range_inr_lpa", SALARY),
    T.StructField("preferred_work_mode", TEXT),
    T.StructField("willing_to_relocate", FLAG),
    T.StructField("github_activity_score", NUMBER),
    T.StructField("search_appearance_30d", NUMBER),
    T.StructField("saved_by_recruiters_30d", NUMBER),
    T.StructField("interview_completion_rate", NUMBER),
    T.StructField("offer_acceptance_rate", NUMBER),
    T.StructField("verified_email", FLAG),
    T.StructField("verified_phone", FLAG),
    T.StructField("linkedin_connected", FLAG),
])

CORRUPT = "_corrupt"


def candidate_schema(signals_field: str = "signals") -> T.StructType:
    return T.StructType([
        T.StructField("candidate_id", T.StringType()),
        T.StructField("profile", PROFILE),
        T.StructField("career_history", T.ArrayType(ROLE)),
        T.StructField("education", T.ArrayType(EDUCATION)),
        T.StructField("skills", T.ArrayType(SKILL)),
        T.StructField("certifications", T.ArrayType(CERTIFICATION)),
        T.StructField("languages", T.ArrayType(LANGUAGE)),
        T.StructField(signals_field, SIGNALS),
    ])


def scan_candidates(
    spark: SparkSession, path: str | list[str], signals_field: str = "signals"
) -> DataFrame:
    """JSON lines with the malformed ones kept whole in ``_corrupt``; blank lines vanish.

    The signals object may carry another name in the files; it is always called
    ``signals`` here. Lines are parsed by ``from_json``, so that a count of the malformed
    ones needs no cache.
    """
    return parse_lines(spark.read.text(path), signals_field)


def parse_lines(lines: DataFrame, signals_field: str = "signals") -> DataFrame:
    """The one parsing rule of batch scans and streams."""
    schema = candidate_schema(signals_field).add(CORRUPT, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", schema, options).alias("c")
    ).select("c.*")
    return parsed.withColumnRenamed(signals_field, "signals")


def read_candidates(
    spark: SparkSession, path: str | list[str], signals_field: str = "signals"
) -> DataFrame:
    """The well-formed candidates of a JSON-lines file."""
    df = scan_candidates(spark, path, signals_field)
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def scan_quality(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """One row: parsed lines, malformed lines, all non-blank lines."""
    bad = F.col(CORRUPT).isNotNull()
    return scan_candidates(spark, path, signals_field).agg(
        F.count_if(~bad).alias("parsed"),
        F.count_if(bad).alias("malformed"),
        F.count(F.lit(1)).alias("lines"),
    )


def malformed_lines(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first ``n`` malformed lines, for the log."""
    df = scan_candidates(spark, path).select(CORRUPT)
    return df.filter(F.col(CORRUPT).isNotNull()).limit(n)


def count_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return count_source(spark, path).count()


def stream_candidates(
    spark: SparkSession, folder: str, files_per_batch: int = 1, signals_field: str = "signals"
) -> DataFrame:
    """Bounded batches of the well-formed candidates, by the rule of the batch scan."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    parsed = parse_lines(lines, signals_field)
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def first_rows(df: DataFrame, n: int, order: str = "candidate_id") -> DataFrame:
    """The first ``n`` rows in a stated order (the development limit)."""
    return df.orderBy(order).limit(n)


def nested(path: str, default=None) -> Column:
    """Null-safe nested field: missing levels and nulls give the default."""
    column = F.col(path)
    return column if default is None else F.coalesce(column, F.lit(default))


# --- text projections -----------------------------------------------------------------


def _or_empty(field: str, element: T.StructType) -> Column:
    return F.coalesce(F.col(field), F.array().cast(T.ArrayType(element)))


def roles_of() -> Column:
    return _or_empty("career_history", ROLE)


def skills_of() -> Column:
    return _or_empty("skills", SKILL)


def corpus_text() -> Column:
    """The searchable document of a candidate: profile lines, roles, skill names."""
    role_lines = F.flatten(
        F.transform(roles_of(), lambda r: F.array(r["title"], r["description"]))
    )
    names = F.transform(skills_of(), lambda s: s["name"])
    profile = [
        F.col(f"profile.{f}")
        for f in ("headline", "summary", "current_title", "current_industry")
    ]
    return join_nonempty(profile, [role_lines, names])


def rerank_text() -> Column:
    """The document for the head: title, headline, first listed role, and the skills, most
    endorsements first (profile order on ties)."""
    first = F.get(roles_of(), F.lit(0))
    keyed = F.transform(
        skills_of(),
        lambda s, i: F.struct(
            (-F.coalesce(s["endorsements"], F.lit(0.0))).alias("k"), i.alias("i"),
            F.coalesce(s["name"], F.lit("")).alias("name"),
        ),
    )
    best = F.transform(F.array_sort(keyed), lambda x: x["name"])
    return join_nonempty([
        F.col("profile.current_title"),
        F.col("profile.headline"),
        first["title"],
        first["description"],
        F.array_join(best, " "),
    ])
