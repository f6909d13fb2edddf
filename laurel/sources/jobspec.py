"""Job specifications: gates, weighted requirements and text lists as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_SPEC_DDL = (
    "hard_gates array<struct<description:string,feature_key:string,operator:string,"
    "value:boolean>>, "
    "weighted_requirements array<struct<description:string,weight:double,"
    "skill_tags:array<string>>>, "
    "latent_requirements array<string>, jd_core_skills array<string>, "
    "anti_patterns array<string>, boilerplate_removed array<string>, source string"
)


def parse_job_specs(texts: DataFrame, text: str = "spec") -> DataFrame:
    """JSON text to a struct column ``job_spec``; missing lists become empty, a missing
    source ``fallback``."""
    parsed = F.from_json(F.col(text), JOB_SPEC_DDL)
    staged = texts.withColumn("job_spec", parsed)
    spec = F.col("job_spec")
    for name in ("hard_gates", "weighted_requirements", "latent_requirements",
                 "jd_core_skills", "anti_patterns", "boilerplate_removed"):
        kind = staged.schema["job_spec"].dataType[name].dataType
        spec = spec.withField(
            name, F.coalesce(F.col(f"job_spec.{name}"), F.array().cast(kind))
        )
    spec = spec.withField("source", F.coalesce("job_spec.source", F.lit("fallback")))
    return staged.withColumn("job_spec", spec)


def job_spec_json(specs: DataFrame, column: str = "job_spec") -> DataFrame:
    return specs.withColumn("spec", F.to_json(column))


def requirements(specs: DataFrame, key: str) -> DataFrame:
    """(key, position, description, weight, skill_tag): one row per requirement and tag."""
    rows = specs.select(
        key, F.posexplode("job_spec.weighted_requirements").alias("position", "r")
    )
    return rows.select(
        key, "position", "r.description", "r.weight",
        F.explode("r.skill_tags").alias("skill_tag"),
    )


def spec_gates(specs: DataFrame, key: str) -> DataFrame:
    return specs.select(key, F.inline("job_spec.hard_gates"))


def save_job_specs(specs: DataFrame, path: str) -> None:
    job_spec_json(specs).select("spec").write.mode("overwrite").text(path)


def load_job_specs(spark: SparkSession, path: str) -> DataFrame:
    return parse_job_specs(spark.read.text(path).withColumnRenamed("value", "spec"))
