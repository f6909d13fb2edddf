"""Relevance labels, fit prediction and the final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.numeric import clip, scaled
from laurel.operators.ranking import exact_quantiles, minmax, score_key, top_k
from laurel.session import materialise

# fixed values: weights and percentiles that results depend on
MERGE_WEIGHTS = {"fit": 0.40, "retrieval": 0.35, "signal": 0.25}
HEAD_WEIGHTS = {"rerank_score": 0.15, "tournament_score": 0.10, "llm_fit_score": 0.15}
TIER_QUANTILES = ((1, 0.50), (2, 0.75), (3, 0.90), (4, 0.97), (5, 0.99))


def _bounds(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The frame with one struct column ``_b`` of minima and maxima, from one pass."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.withColumn("_b", df.agg(F.struct(*parts).alias("b")).scalar())


def _norm(column: str, eps: float) -> Column:
    return scaled(F.col(column), F.col(f"_b.{column}_lo"), F.col(f"_b.{column}_hi"), eps)


def _ungated(df: DataFrame, value: Column) -> Column:
    """0 for gate failures and impossible profiles."""
    bad = F.col("is_honeypot") == 1
    if "gate_passed" in df.columns:
        bad = bad | ~F.col("gate_passed")
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(0.0)).otherwise(value)


def with_proxy_label(df: DataFrame, name: str = "proxy_label") -> DataFrame:
    """Proxy relevance in 0..1 from the most trusted features."""
    c = F.col
    staged = _bounds(df, ("retrieval_skill_count", "jd_skill_match_count"))
    label = (
        F.lit(0.45) * c("jd_fit_score")
        + F.lit(0.20) * _norm("retrieval_skill_count", 1e-12)
        + F.lit(0.15) * _norm("jd_skill_match_count", 1e-12)
        + F.lit(0.10) * c("product_company_ratio")
        + F.lit(0.10) * clip(c("behavioural_composite"))
    )
    return staged.withColumn(name, _ungated(df, clip(label))).drop("_b")


def with_relevance(df: DataFrame, name: str = "relevance") -> DataFrame:
    """A more discriminating relevance in 0..1, the basis of the graded tiers."""
    c = F.col
    staged = _bounds(df, ("retrieval_skill_count", "assessment_mean_score"))
    rel = (
        F.lit(0.34) * c("jd_fit_score")
        + F.lit(0.22) * _norm("retrieval_skill_count", 1e-9)
        + F.lit(0.12) * _norm("assessment_mean_score", 1e-9)
        + F.lit(0.12) * c("has_production_keywords")
        + F.lit(0.10) * c("product_company_ratio")
        + F.lit(0.10) * clip(c("behavioural_composite"))
    )
    return staged.withColumn(name, clip(_ungated(df, rel))).drop("_b")


def stored_relevance(df: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """(id, relevance), written once: quantiles read their column once per pass."""
    return materialise(with_relevance(df).select(id_col, "relevance"), "relevance")


def with_tiers(df: DataFrame, relevance: str = "relevance", name: str = "tier") -> DataFrame:
    """Integer tiers 0..5 by the percentiles of the positive values."""
    cuts = exact_quantiles(
        df.filter(F.col(relevance) > 0), relevance, [q for _, q in TIER_QUANTILES]
    )
    by_tier = cuts.agg(
        F.struct(*[
            F.max(F.when(F.col("probability") == q, F.col("value"))).alias(f"t{tier}")
            for tier, q in TIER_QUANTILES
        ]).alias("cuts")
    )
    staged = df.withColumn("_cuts", by_tier.scalar())
    out = F
    for tier, _ in reversed(TIER_QUANTILES):
        out = out.when(F.col(relevance) >= F.col(f"_cuts.t{tier}"), F.lit(tier))
    return staged.withColumn(name, out.otherwise(F.lit(0))).drop("_cuts")


def graded_labels(
    df: DataFrame, grades: DataFrame | None = None, id_col: str = "candidate_id"
) -> DataFrame:
    """(id, tier) for every row; an external grade (clamped to 0..5) wins where given."""
    tiers = with_tiers(stored_relevance(df, id_col)).select(id_col, "tier")
    if grades is None:
        return tiers
    given = grades.select(
        id_col, F.least(F.greatest(F.col("grade").cast("int"), F.lit(0)), F.lit(5)).alias("_g")
    )
    return tiers.join(given, id_col, "left").select(
        id_col, F.coalesce("_g", "tier").alias("tier")
    )


def tier_distribution(labels: DataFrame) -> DataFrame:
    """(tier, rows) for all six tiers."""
    all_tiers = labels.sparkSession.range(6).select(F.col("id").cast("int").alias("tier"))
    counted = labels.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return all_tiers.join(counted, "tier", "left").select(
        "tier", F.coalesce("n", F.lit(0)).alias("rows")
    )


def with_fit(df: DataFrame, model=None, name: str = "ml_fit") -> DataFrame:
    """Fit in 0..1, scaled over the rows being ranked. ``model`` is any fitted Spark ML
    transformer that gives ``prediction``; without one the proxy formula is used."""
    if model is None:
        return minmax(with_proxy_label(df, name), name)
    kept = df.columns
    return minmax(
        model.transform(df).select(*kept, F.col("prediction").alias(name)), name
    )


# --- final score ----------------------------------------------------------------------


def availability_multiplier(floor: float = 0.45) -> Column:
    return clip(F.lit(floor) + F.lit(1 - floor) * clip(F.col("availability_score")), floor)


def engagement_multiplier(floor: float = 0.6) -> Column:
    return clip(F.lit(floor) + F.lit(1 - floor) * clip(F.col("engagement_score")), floor)


def signal_modifier() -> Column:
    return clip(availability_multiplier() * engagement_multiplier(), 0.3)


def with_final_score(
    df: DataFrame, fit: str = "ml_fit", retrieval: str = "retrieval_score",
    name: str = "final_score", head_weights: dict[str, float] | None = None,
) -> DataFrame:
    """Core score, blended with the head signals whose columns exist, times location and
    behaviour, plus the evidence bonus; 0 for excluded rows; clipped to 0..1."""
    c, w = F.col, MERGE_WEIGHTS
    base = (
        F.lit(w["fit"]) * clip(c(fit))
        + F.lit(w["retrieval"]) * clip(c(retrieval))
        + F.lit(w["signal"]) * clip(c("behavioural_composite"))
    )
    weights = HEAD_WEIGHTS if head_weights is None else head_weights
    present = {k: v for k, v in weights.items() if k in df.columns and v > 0}
    if present:
        base = F.lit(1.0 - sum(present.values())) * base
        for column, weight in present.items():
            base = base + F.lit(weight) * clip(
                F.coalesce(c(column).cast("double"), F.lit(0.0))
            )
    score = base * (F.lit(0.85) + F.lit(0.15) * clip(c("location_fit"))) * signal_modifier()
    if "evidence_confidence_bonus" in df.columns:
        score = score + F.coalesce(c("evidence_confidence_bonus"), F.lit(0.0))
    return df.withColumn(name, clip(_ungated(df, score)))


# --- head selection and coverage ------------------------------------------------------


def provisional_head(
    df: DataFrame, k: int, proxy: str = "proxy_label", group: str | None = None,
    id_col: str = "candidate_id",
) -> DataFrame:
    """The ``k`` most promising admitted rows (0.6 proxy + 0.4 retrieval), with
    ``head_rank`` from 1."""
    score = F.col(proxy)
    if "retrieval_score" in df.columns:
        score = F.lit(0.6) * F.col(proxy) + F.lit(0.4) * F.col("retrieval_score")
    admitted = df.filter(F.col("is_honeypot") != 1)
    if "gate_passed" in df.columns:
        admitted = admitted.filter("gate_passed")
    return top_k(
        admitted.withColumn("provisional", score), k,
        [score_key(F.col("provisional")).desc(), F.col(id_col).asc()], group, "head_rank",
    )


COVERAGE = {
    "retrieval_experience": lambda: F.col("retrieval_skill_count") > 0,
    "llm_experience": lambda: F.col("llm_skill_count") > 0,
    "production_evidence": lambda: F.col("has_production_keywords") > 0,
    "product_company": lambda: F.col("product_company_ratio") > 0.5,
    "available": lambda: F.col("availability_score") > 0.3,
}


def _levels(base_fit: float, step: float, iterations: int) -> list[float]:
    """Fit thresholds of the successive passes, never below 0."""
    out, relaxed = [], 0.0
    for _ in range(iterations + 1):
        out.append(max(base_fit - relaxed, 0.0))
        relaxed += step
    return out


def _admits(threshold: float) -> Column:
    skilled = (F.col("retrieval_skill_count") > 0) | (F.col("llm_skill_count") > 0)
    return F.col("gate_passed") & ((F.col("jd_fit_score") >= threshold) | skilled)


def coverage_levels(
    gated: DataFrame, target: int = 100, base_fit: float = 0.6, step: float = 0.15,
    iterations: int = 4, dimensions: dict | None = None,
) -> DataFrame:
    """One row per pass (iteration, threshold, pool_size, one coverage column per
    dimension, min_coverage): all passes come out of a single aggregation."""
    dims = COVERAGE if dimensions is None else dimensions
    levels = _levels(base_fit, step, iterations)
    sums = []
    for i, level in enumerate(levels):
        inside = _admits(level)
        sums.append(F.count_if(inside).alias(f"p{i}"))
        sums += [F.count_if(inside & p()).alias(f"{d}{i}") for d, p in dims.items()]
    share = lambda n: F.least(n / F.lit(float(max(target, 1))), F.lit(1.0))
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("iteration"), F.lit(level).alias("threshold"),
            F.col(f"p{i}").alias("pool_size"),
            *[share(F.col(f"{d}{i}")).alias(d) for d in dims],
        )
        for i, level in enumerate(levels)
    ])
    return gated.agg(*sums).select(F.inline(rows)).withColumn(
        "min_coverage", F.least(*[F.col(d) for d in dims])
    )


def coverage_result(
    levels: DataFrame, confident: float = 0.80, gap: float = 0.60, iterations: int = 4,
    dimensions: dict | None = None,
) -> DataFrame:
    """The pass at which widening stops, why, and the dimensions still short."""
    dims = list(COVERAGE if dimensions is None else dimensions)
    stop = levels.filter(
        (F.col("min_coverage") >= confident) | (F.col("iteration") >= iterations)
    )
    best = stop.orderBy("iteration").limit(1)
    gaps = F.array_compact(F.array(*[F.when(F.col(d) < gap, F.lit(d)) for d in dims]))
    return best.withColumns({
        "exit_reason": F.when(
            F.col("iteration") >= iterations, F.lit("max_iterations")
        ).otherwise(F.lit("confident")),
        "gaps": F.array_join(gaps, ","),
    })


def coverage_pool(gated: DataFrame, result: DataFrame) -> DataFrame:
    """The candidates admitted at the final pass."""
    threshold = result.select("threshold").scalar()
    skilled = (F.col("retrieval_skill_count") > 0) | (F.col("llm_skill_count") > 0)
    return gated.withColumn("_t", threshold).filter(
        F.col("gate_passed") & ((F.col("jd_fit_score") >= F.col("_t")) | skilled)
    ).drop("_t")
