"""Sinks: feature matrix, registry, ranked CSV, manifest, results; and stage freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel import vocab
from laurel.operators.explain import output_text
from laurel.operators.quality import rejections, validate_header, validate_ranked


class ContractError(ValueError):
    """A stored table does not have the agreed shape."""


# --- feature matrix -------------------------------------------------------------------


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, manifest_path: str | None = None) -> DataFrame:
    """The stored matrix, checked against the column contract and its manifest."""
    matrix = spark.read.parquet(path)
    expected = None
    if manifest_path:
        expected = spark.read.json(manifest_path).first()["rows"]
    return check_matrix(matrix, expected)


def check_matrix(matrix: DataFrame, expected_rows: int | None = None) -> DataFrame:
    missing = [
        c for c in ("candidate_id", *vocab.NUMERIC_FEATURES) if c not in matrix.columns
    ]
    if missing:
        raise ContractError(f"feature matrix lacks columns: {missing[:8]}")
    if expected_rows is not None and matrix.count() != expected_rows:
        raise ContractError("manifest row count differs from the feature matrix")
    return matrix


def contract_report(matrix: DataFrame) -> DataFrame:
    """One row per contract column: present or not, and how many values are not numbers."""
    have = set(matrix.columns)
    numeric = [c for c in vocab.NUMERIC_FEATURES if c in have]
    counts = matrix.agg(
        *[F.count_if(F.col(c).try_cast("double").isNull()).alias(c) for c in numeric]
    )
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(c in have).alias("present"),
            (F.col(c) if c in have else F.lit(0).cast("bigint")).alias("bad_values"),
        )
        for c in vocab.NUMERIC_FEATURES
    ])
    return counts.select(F.inline(cells))


# --- small text outputs ---------------------------------------------------------------


def write_registry(gated: DataFrame, path: str) -> bool:
    """The rejection registry as CSV; nothing is written when no row failed."""
    rows = rejections(gated)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return True


def write_ranked_csv(output: DataFrame, path: str) -> None:
    """One ranked list, at most a few hundred rows, as one CSV file in rank order."""
    (
        output_text(output.orderBy("rank")).coalesce(1)
        .write.mode("overwrite").options(header=True, escape='"').csv(path)
    )


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, the way a checker sees them."""
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path)


def check_ranked_csv(spark: SparkSession, path: str, expected_rows: int = 100) -> DataFrame:
    """Rule violations of a written list: header and field count, then the rows."""
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\r?\n")).alias("at", "value")
    ).select("value", (F.col("at") == 0).alias("is_header"))
    return validate_header(lines).unionByName(validate_ranked(
        read_ranked_csv(spark, path), expected_rows
    ))


def write_and_check(output: DataFrame, path: str, expected_rows: int = 100) -> None:
    """Write, read back, and refuse an invalid list."""
    write_ranked_csv(output, path)
    errors = check_ranked_csv(output.sparkSession, path, expected_rows).limit(20).collect()
    if errors:
        raise ContractError("; ".join(f"{e['rule']}: {e['detail']}" for e in errors))


# --- manifest and freshness -----------------------------------------------------------


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with the content: rows and two order-free hash totals."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def stage_key(*parts: object) -> str:
    """Key of a stage from its inputs, in order."""
    import hashlib

    text = "\x1f".join(repr(p) for p in parts)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def write_manifest(df: DataFrame, path: str, key: str, **extra: object) -> None:
    """Record what was built: the content summary, the stage key, any further facts."""
    row = fingerprint(df).withColumns(
        {"key": F.lit(key), **{k: F.lit(v) for k, v in extra.items()}}
    )
    row.coalesce(1).write.mode("overwrite").json(path)


def is_fresh(spark: SparkSession, manifest_path: str, key: str) -> bool:
    """True when a manifest exists and carries this key."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("key string").json(manifest_path).head(1)
    except AnalysisException:
        return False
    return bool(rows) and rows[0]["key"] == key


# --- results --------------------------------------------------------------------------


def write_results(
    root: str, job: DataFrame, output: DataFrame, group: str = "jd_id"
) -> None:
    """Store the job row, its ranked rows and an audit row. Everything lies in folders by job
    or list, and writing one again replaces it."""
    def store(rows: DataFrame, key: str, name: str) -> None:
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(key).parquet(f"{root}/{name}")
        )

    store(job, "job_id", "job_runs")
    store(output, group, "ranking_results")
    audit = job.select(
        F.lit("job.completed").alias("action"), F.col("job_id").alias("target"),
        F.col("finished_at").alias("created_at"),
    )
    store(audit, "target", "audit_log")


def job_results(spark: SparkSession, root: str, job: int | str, group: str = "jd_id"
                ) -> DataFrame:
    """The rows of one job in rank order; only its folder is read."""
    rows = spark.read.parquet(f"{root}/ranking_results")
    return rows.filter(F.col(group) == job).orderBy("rank")


def export_job(spark: SparkSession, root: str, job: int | str, path: str, group: str = "jd_id",
               expected_rows: int | None = None) -> None:
    """The stored rows of one job as a checked CSV file."""
    rows = job_results(spark, root, job, group).drop(group)
    write_and_check(rows, path, rows.count() if expected_rows is None else expected_rows)
