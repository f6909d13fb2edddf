"""Impossible-profile rules, gates, and checks of a ranked output."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.dates import DAYS_PER_MONTH
from laurel.functions.numeric import fixed

# --- impossible profiles --------------------------------------------------------------

TINY_COMPANIES = ("1-10", "11-50")


def honeypot_reasons(as_of: dt.date) -> Column:
    """Reasons why a profile cannot be true, in rule order; empty for a clean one.

    Reads the typed arrays ``_roles`` and ``_skills``; reasons of one rule follow the
    order of the profile.
    """

    def calendar(r: Column) -> Column:
        end = F.coalesce(r["end"], F.lit(as_of))
        return F.datediff(end, r["start"]) / F.lit(DAYS_PER_MONTH)

    def company(r: Column) -> Column:
        return F.when(r["company"] == "", F.lit("?")).otherwise(r["company"])

    def per_role(rule, text) -> Column:
        hits = F.transform(
            F.filter("_roles", rule), lambda r: F.struct(r["pos"], text(r).alias("text"))
        )
        return F.transform(F.sort_array(hits), lambda h: h["text"])

    tiny = per_role(
        lambda r: r["company_size"].isin(*TINY_COMPANIES) & (r["months"] > 96),
        lambda r: F.format_string("implausible_tenure:%s:%dmo", company(r), r["months"]),
    )
    clash = per_role(
        lambda r: r["months"] > calendar(r) + 9,
        lambda r: F.concat(
            F.format_string("duration_exceeds_calendar:%s:%d>", company(r), r["months"]),
            fixed(calendar(r), 0), F.lit("mo"),
        ),
    )
    unused = F.size(
        F.filter("_skills", lambda s: (s["proficiency"] == "expert") & (s["months"] == 0))
    )
    total = F.aggregate("_roles", F.lit(0), lambda acc, r: acc + r["months"])
    years = F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0))
    applications = F.coalesce(
        F.col("signals.applications_submitted_30d"), F.lit(0.0)
    ).cast("int")
    single = F.array_compact(F.array(
        F.when(unused >= 3, F.format_string("expert_zero_duration:%d_skills", unused)),
        F.when(
            (total > 0) & (years > total / F.lit(12.0) + 3.0),
            F.concat(
                F.lit("yoe_exceeds_career_history:"), fixed(years, 1), F.lit(">"),
                fixed(total / F.lit(12.0), 1), F.lit("yr"),
            ),
        ),
        F.when(
            applications > 50,
            F.format_string("impossible_application_volume:%d", applications),
        ),
    ))
    return F.concat(tiny, clash, single)


# --- gates ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Gate:
    """A declared gate: the row fails when ``feature operator value`` holds."""

    reason: str
    feature: str
    operator: str
    value: float | bool

    def condition(self) -> Column:
        x = F.col(self.feature).cast("double")
        v = F.lit(float(self.value))
        tests = {
            "eq": x == v, "bool": (x != 0) == (v != 0), "lt": x < v, "lte": x <= v,
            "gt": x > v, "gte": x >= v,
        }
        if self.operator not in tests:
            raise ValueError(f"unknown gate operator {self.operator!r}")
        return F.coalesce(tests[self.operator], F.lit(False))


def _inactive() -> Column:
    silent = F.coalesce(F.col("recruiter_response_rate").cast("double"), F.lit(0.0)) < 0.15
    return F.coalesce((F.col("days_since_active") > 180) & silent, F.lit(False))


def hard_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("honeypot", c("is_honeypot") == 1),
        ("all_consulting_career", c("all_consulting_career") == 1),
        ("keyword_stuffer", c("keyword_stuffer_flag") == 1),
        ("inactive_unresponsive", _inactive()),
    ]


def soft_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("notice_gt_90", c("notice_period_days") > 90),
        ("title_chaser", c("title_chaser_flag") == 1),
        ("cv_speech_no_nlp", c("wrong_specialisation_penalty") > 0.5),
        ("outside_india_focus", c("location_fit") < 0.5),
        ("stale_but_responsive", (c("days_since_active") > 180) & ~_inactive()),
    ]


def _reasons(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def apply_gates(matrix: DataFrame, gates: list[Gate] | None = None) -> DataFrame:
    """``gate_failures``, ``soft_flags`` and ``gate_passed`` in rule order. Declared gates
    replace the standard hard rules."""
    rules = hard_rules() if gates is None else [(g.reason, g.condition()) for g in gates]
    return matrix.withColumns({
        "gate_failures": _reasons(rules),
        "soft_flags": _reasons(soft_rules()),
    }).withColumn("gate_passed", F.size("gate_failures") == 0)


def gate_breakdown(gated: DataFrame) -> DataFrame:
    """Rows per failure reason, with the totals under ``total``, ``passed``, ``excluded``."""
    totals = F.array(
        F.lit("total"),
        F.when(F.col("gate_passed"), F.lit("passed")).otherwise(F.lit("excluded")),
    )
    return (
        gated.select(F.explode(F.concat(totals, F.col("gate_failures"))).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def gate_stats(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("gate_passed").alias("passed"),
        F.count_if(~F.col("gate_passed")).alias("excluded"),
        F.coalesce(F.sum("is_honeypot"), F.lit(0)).cast("bigint").alias("honeypots"),
        F.coalesce(F.sum("keyword_stuffer_flag"), F.lit(0)).cast("bigint").alias(
            "keyword_stuffers"
        ),
    )


def rejections(gated: DataFrame) -> DataFrame:
    """The registry of excluded rows, reasons joined by a bar."""
    return gated.filter(~F.col("gate_passed")).select(
        "candidate_id", "current_title",
        F.array_join("gate_failures", "|").alias("gate_failures"),
    )


# --- checks of a ranked output --------------------------------------------------------

RANKED_COLUMNS = ("candidate_id", "rank", "score", "reasoning")
ID_PATTERN = "^CAND_[0-9]{7}$"


def _problem(df: DataFrame, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def validate_ranked(ranked: DataFrame, expected_rows: int = 100) -> DataFrame:
    """All rule violations of one ranked list as (rule, detail); empty means valid.

    ``ranked`` has the four output columns, as text or typed. The list is a top-k report
    of at most a few hundred rows, so ordering it in one window is bounded.
    """
    c = F.col
    text = ranked.select(
        F.trim(c("candidate_id")).alias("id"),
        F.trim(c("rank").cast("string")).alias("rank_text"),
        F.trim(c("score").cast("string")).alias("score_text"),
    ).withColumns({
        "rank": F.when(
            c("rank_text").rlike("^(0|-?[1-9][0-9]*)$"), c("rank_text")
        ).try_cast("bigint"),
        "score": c("score_text").try_cast("double"),
    })
    well_formed = c("id").rlike(ID_PATTERN)
    in_range = c("rank").between(1, expected_rows)
    no_id = F.coalesce(c("id") == "", F.lit(True))

    size = ranked.agg(F.count(F.lit(1)).alias("n")).filter(c("n") != expected_rows)
    repeated_id = text.filter(well_formed).groupBy("id").count().filter("count > 1")
    repeated_rank = text.filter(in_range).groupBy("rank").count().filter("count > 1")
    wanted = ranked.sparkSession.range(1, expected_rows + 1).select(c("id").alias("rank"))
    order = Window.partitionBy(F.lit(0)).orderBy("rank", "id")
    pairs = text.filter(c("rank").isNotNull() & c("score").isNotNull() & ~no_id).select(
        "rank", "score", "id",
        F.lead("rank").over(order).alias("rank2"),
        F.lead("score").over(order).alias("score2"),
        F.lead("id").over(order).alias("id2"),
    )
    found = [
        _problem(size, "row_count", c("n")),
        _problem(text.filter(no_id), "id_missing", c("rank_text")),
        _problem(text.filter(~no_id & ~well_formed), "id_format", c("id")),
        _problem(repeated_id, "id_repeated", c("id")),
        _problem(text.filter(c("rank").isNull()), "rank_not_integer", c("rank_text")),
        _problem(
            text.filter(c("rank").isNotNull() & ~in_range), "rank_range", c("rank_text")
        ),
        _problem(repeated_rank, "rank_repeated", c("rank")),
        _problem(wanted.join(text, "rank", "left_anti"), "rank_missing", c("rank")),
        _problem(text.filter(c("score").isNull()), "score_not_number", c("score_text")),
        _problem(pairs.filter("score < score2"), "score_increases", c("rank2")),
        _problem(pairs.filter("score = score2 and id > id2"), "tie_order", c("rank2")),
    ]
    return reduce(DataFrame.unionByName, found)


def validate_header(lines: DataFrame) -> DataFrame:
    """Checks a CSV scanned as text with its first line flagged: ``value``, ``is_header``.
    Every line needs four fields and the header must be exact."""
    fields = F.from_csv(
        F.col("value"), F.lit("a string, b string, c string, d string, e string"),
        {"escape": '"'},
    )
    parsed = lines.filter(F.trim("value") != "").withColumn("f", fields)
    bad_header = parsed.filter(
        F.col("is_header") & (F.col("value") != ",".join(RANKED_COLUMNS))
    )
    bad_width = parsed.filter(
        ~F.col("is_header") & (F.col("f.d").isNull() | F.col("f.e").isNotNull())
    )
    return _problem(bad_header, "header", F.col("value")).unionByName(
        _problem(bad_width, "field_count", F.col("value"))
    )
