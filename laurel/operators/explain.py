"""One-sentence explanations of ranked rows, and the output table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.numeric import fixed
from laurel.functions.text import collapse_whitespace, id_seed
from laurel.operators.ranking import score_key, top_k


# The phrases and bounds of this module are fixed values: results must read like this.


def company_phrase(ratio: Column) -> Column:
    return (
        F.when(ratio >= 0.8, F.lit("at product companies"))
        .when(ratio >= 0.5, F.lit("mostly at product companies"))
        .when(ratio > 0, F.lit("across product and services roles"))
        .otherwise(F.lit("in a services-heavy career"))
    )


def reasoning(rank: str = "rank") -> Column:
    """Lead by id, up to three strengths, then the first concern."""
    c = F.col
    title = F.when(
        F.trim(F.coalesce("current_title", F.lit(""))) == "", F.lit("Candidate")
    ).otherwise(F.trim("current_title"))
    years = c("total_experience_years")
    variant = id_seed(c("candidate_id")) % 3
    lead = (
        F.when(variant == 0, F.concat(title, F.lit(", "), fixed(years, 1), F.lit(" yrs")))
        .when(variant == 1, F.concat(title, F.lit(" with ~"), fixed(years, 0),
                                     F.lit(" years")))
        .otherwise(F.concat(title, F.lit(" ("), fixed(years, 1),
                            F.lit(" yrs experience)")))
    )
    two = lambda name: F.array_join(F.slice(name, 1, 2), ", ")
    deep = (c("retrieval_skill_count") >= 2) & (F.size("top_retrieval_skills") > 0)
    notice = c("notice_period_days")
    strengths = F.array_compact(F.array(
        F.when(deep, F.concat(F.lit("retrieval/IR depth ("), two("top_retrieval_skills"),
                              F.lit(")")))
        .when(F.size("top_jd_skills") > 0, F.concat(F.lit("hands-on "),
                                                    two("top_jd_skills"))),
        company_phrase(c("product_company_ratio")),
        F.when(c("scope_progression_score") >= 0.65, F.lit("clear upward trajectory")),
        F.when(c("github_activity_score") >= 40, F.concat(
            F.lit("active GitHub ("), fixed(c("github_activity_score"), 0), F.lit("/100)")
        )),
        F.when(c("recruiter_response_rate") >= 0.6, F.concat(
            F.lit("responsive to recruiters ("),
            fixed(c("recruiter_response_rate") * 100, 0), F.lit("%)"),
        )),
        F.when((notice <= 30) & (c(rank) <= 60), F.lit("short notice")),
    ))
    place = F.trim(F.coalesce("location", F.lit("")))
    concern = F.coalesce(
        F.when(notice > 60, F.concat(fixed(notice, 0), F.lit("-day notice"))),
        F.when(c("days_since_active") > 150, F.concat(
            F.lit("quiet for ~"), fixed(c("days_since_active") / 30, 0), F.lit(" months")
        )),
        F.when(c("location_fit") < 0.5, F.concat(
            F.lit("based in "),
            F.when(place == "", F.lit("outside the India hubs")).otherwise(place),
        )),
        F.when(c("wrong_specialisation_penalty") > 0.4,
               F.lit("CV/speech-leaning, lighter on NLP/IR")),
        F.when(c(rank) > 60, F.lit("adjacent rather than core fit")),
    )
    return F.concat(
        lead, F.lit(" - "), F.array_join(F.slice(strengths, 1, 3), ", "), F.lit("."),
        F.when(concern.isNull(), F.lit("")).otherwise(
            F.concat(F.lit(" Watch-out: "), concern, F.lit("."))
        ),
    )


def with_reasoning(ranked: DataFrame, group: str | None = None, rank: str = "rank") -> DataFrame:
    """Explanations of a top-k list; a repeated sentence gets the tail of the id."""
    keys = [F.col(group)] if group else []
    repeat = F.row_number().over(Window.partitionBy(*keys, "_text").orderBy(rank)) > 1
    tail = F.concat(
        F.expr("substring(_text, 1, length(_text) - 1)"), F.lit(" ["),
        F.right("candidate_id", F.lit(4)), F.lit("]."),
    )
    return (
        ranked.withColumn("_text", reasoning(rank))
        .withColumn("_again", repeat)
        .withColumn("reasoning", F.when(F.col("_again"), tail).otherwise(F.col("_text")))
        .drop("_text", "_again")
    )


def rank_candidates(
    scored: DataFrame, k: int = 100, group: str | None = None, score: str = "final_score"
) -> DataFrame:
    """Top k by score, then id; impossible profiles never appear. Adds ``rank``."""
    return top_k(
        scored.filter(F.col("is_honeypot") != 1), k,
        [score_key(F.col(score)).desc(), F.col("candidate_id").asc()], group,
    )


def output_table(
    ranked: DataFrame, k: int = 100, group: str | None = None, score: str = "final_score"
) -> DataFrame:
    """The deliverable: scores rounded to four digits first, then ordered and ranked."""
    keys = [group] if group else []
    rounded = ranked.select(
        *keys, "candidate_id", F.bround(score, 4).alias("score"), "reasoning"
    )
    return top_k(
        rounded, k, [F.col("score").desc(), F.col("candidate_id").asc()], group
    ).select(*keys, "candidate_id", "rank", "score", "reasoning")


def output_text(output: DataFrame, group: str | None = None) -> DataFrame:
    """The same as text columns, ready for CSV."""
    keys = [group] if group else []
    return output.select(
        *keys, "candidate_id", F.col("rank").cast("string").alias("rank"),
        F.format_string("%.4f", "score").alias("score"),
        collapse_whitespace(F.col("reasoning")).alias("reasoning"),
    )
