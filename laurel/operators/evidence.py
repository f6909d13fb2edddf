"""Artifact summaries, skill confidence, and the evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel import vocab
from laurel.functions.dates import age_days, decay
from laurel.functions.text import (
    count_contained,
    extract_skills,
    first_rule,
    skill_category,
    text_contains_any,
)

HALF_LIFE_DAYS = 365.0
NORMALISER = 10.0
SUMMARY_CHARS = 160


# --- one artifact ---------------------------------------------------------------------


def artifact_category(low: Column) -> Column:
    return first_rule(
        low, vocab.ARTIFACT_CATEGORIES, vocab.DEFAULT_CATEGORY, text_contains_any
    )


def artifact_complexity(low: Column) -> Column:
    """1 for short trivial work, else 2 plus one per hard token and for long text, at most
    5."""
    trivial = text_contains_any(low, vocab.TRIVIAL_TOKENS) & (F.length(low) < 400)
    score = (
        F.lit(2) + count_contained(low, vocab.HARD_TOKENS)
        + (F.length(low) > 3000).cast("int")
    )
    return F.when(trivial, F.lit(1)).otherwise(F.least(score, F.lit(5)))


def with_summary(
    artifacts: DataFrame, raw: str = "raw_content", kind: str = "source_type"
) -> DataFrame:
    """Summary line, skills, complexity, category, production and collaboration flags,
    content hash and length. All rules read the whole text; only the summary line is short."""
    c = F.col
    staged = artifacts.withColumn("_text", F.col(raw)).withColumn(
        "_low", F.lower("_text")
    )
    stripped = F.regexp_replace("_text", r"^\s+|\s+$", "")
    first = F.substring(F.regexp_extract(stripped, r"^[^\r\n]*", 0), 1, SUMMARY_CHARS)
    default = F.concat(F.replace(c(kind), F.lit("_"), F.lit(" ")),
                       F.lit(" with no description"))
    return staged.withColumns({
        "summary": F.trim(F.when(first == "", default).otherwise(first)),
        "skills": extract_skills(c("_low")),
        "complexity": artifact_complexity(c("_low")),
        "category": artifact_category(c("_low")),
        "production_signal": text_contains_any(
            c("_low"), vocab.ARTIFACT_PRODUCTION_TOKENS
        ),
        "collaboration_signal": c(kind).isin("pr_review", "issue_thread")
        | text_contains_any(c("_low"), vocab.COLLABORATION_TOKENS),
        "content_hash": F.sha2(c(raw), 256) if "content_hash" not in artifacts.columns
        else c("content_hash"),
        "raw_chars": F.length(raw),
    }).drop("_text", "_low")


def new_artifacts(
    artifacts: DataFrame, stored: DataFrame | None = None, arrival: str = "arrival"
) -> DataFrame:
    """The first arrival of every content hash that is not stored yet. Hashes are unique
    over all developers: whoever comes first keeps the artifact.

    A min-by aggregate, not a window: copies are folded before the shuffle, so a hash that
    fills a third of the table costs one row per task.
    """
    others = [n for n in artifacts.columns if n != "content_hash"]
    first = artifacts.groupBy("content_hash").agg(
        F.min_by(F.struct(*others), F.col(arrival)).alias("row")
    ).select("row.*", "content_hash")
    if stored is None:
        return first
    return first.join(stored.select("content_hash"), "content_hash", "left_anti")


# --- confidence -----------------------------------------------------------------------


def source_weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    out = None
    for name, weight in (weights or vocab.SOURCE_WEIGHTS).items():
        hit = kind == name
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return out.otherwise(F.lit(vocab.DEFAULT_SOURCE_WEIGHT))


def contribution(
    as_of: Column, kind: str = "source_type", complexity: str = "complexity",
    date: str = "artifact_date", half_life: float = HALF_LIFE_DAYS,
    normaliser: float = NORMALISER, weights: dict[str, float] | None = None,
) -> Column:
    """What one artifact adds to the confidence in a skill, decayed to ``as_of``; an
    undated artifact counts as fresh."""
    level = F.least(F.greatest(F.coalesce(complexity, F.lit(1)), F.lit(1)), F.lit(5))
    age = age_days(as_of, F.coalesce(F.col(date), as_of))
    return (
        source_weight(F.col(kind), weights) * (level / F.lit(5.0)) * decay(age, half_life)
        / F.lit(normaliser)
    )


def confidence_by_skill(evidence: DataFrame, as_of: Column, **options) -> DataFrame:
    """(developer, skill, confidence): case- and space-insensitive, at most 1."""
    return (
        evidence.withColumn("skill", F.lower(F.trim("skill_name")))
        .groupBy("developer_id", "skill")
        .agg(F.least(F.sum(contribution(as_of, **options)), F.lit(1.0)).alias("confidence"))
    )


def skill_edges(evidence: DataFrame, as_of: Column, **options) -> DataFrame:
    """Developer-skill edges: confidence, number of artifacts, last sighting.

    Contributions are never negative, so capping the sum equals capping after every
    write, in any order; late artifacts simply join in.
    """
    return evidence.groupBy("developer_id", "skill_name").agg(
        F.least(F.sum(contribution(as_of, **options)), F.lit(1.0)).alias("confidence"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.max("artifact_date").alias("last_seen"),
    )


def merge_skill_records(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored records plus the edges of new artifacts."""
    cols = ["developer_id", "skill_name", "confidence", "evidence_count", "last_seen"]
    both = stored.select(cols).unionByName(fresh.select(cols))
    return both.groupBy("developer_id", "skill_name").agg(
        F.least(F.sum("confidence"), F.lit(1.0)).alias("confidence"),
        F.sum("evidence_count").alias("evidence_count"),
        F.max("last_seen").alias("last_seen"),
    ).withColumn("category", skill_category(F.col("skill_name")))


def evidence_links(artifacts: DataFrame) -> DataFrame:
    """(artifact, skill, weight 1): distinct links."""
    return (
        artifacts.select("artifact_id", F.explode("skills").alias("skill_name"))
        .dropDuplicates()
        .withColumn("contribution_weight", F.lit(1.0))
    )


def latest_nodes(writes: DataFrame, key: str, written: str) -> DataFrame:
    """Node overwrite by id: the last write wins."""
    others = [n for n in writes.columns if n != key]
    return writes.groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(written)).alias("row")
    ).select(key, "row.*")


def upsert_developers(
    stored: DataFrame, fresh: DataFrame, key: str = "github_username",
    columns: tuple[str, ...] = ("display_name", "avatar_url"),
) -> DataFrame:
    """Stored developers updated by the non-empty fields of the new ones."""
    old, new = stored.alias("o"), fresh.alias("n")
    filled = lambda x: F.when(x != "", x)
    return old.join(new, key, "full_outer").select(
        key,
        *[
            F.coalesce(filled(F.col(f"n.{name}")), F.col(f"o.{name}")).alias(name)
            for name in columns
        ],
    )


def syncable(developers: DataFrame) -> DataFrame:
    return developers.filter(
        F.col("github_username").isNotNull() & (F.col("sync_status") != "syncing")
    )


def sync_status(developers: DataFrame, artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Artifact and skill counts of every developer."""
    arts = artifacts.groupBy("developer_id").agg(F.count(F.lit(1)).alias("artifact_count"))
    skills = edges.groupBy("developer_id").agg(F.count(F.lit(1)).alias("skill_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return (
        developers.select("developer_id").join(arts, "developer_id", "left")
        .join(skills, "developer_id", "left")
        .select("developer_id", zero("artifact_count"), zero("skill_count"))
    )
