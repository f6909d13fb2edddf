"""Message rules as Structured Streaming transformations.

Each has a batch twin in ``laurel.operators.service``. State is kept per key by built-in aggregates in
update mode, so that late rows correct what was said before; ``sinks.latest_updates`` reads the last
word. The rule whose answer depends on the whole order of a key (first sightings) is
``sinks.first_sightings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators.service import MAX_ATTEMPTS


def quota_windows(
    requests: DataFrame, identity: str, ts: str, per_minute: int = 120,
    lateness: str | None = None,
) -> DataFrame:
    """Requests, grants and refusals per identity and minute, as they change.

    Every request counts, however late; a ``lateness`` forgets older minutes and with them
    the requests that come after."""
    n = F.count(F.lit(1))
    return (
        (requests.withWatermark(ts, lateness) if lateness else requests)
        .groupBy(F.window(ts, "1 minute"), identity)
        .agg(n.alias("requests"))
        .select(
            identity, F.col("window.start").alias("minute"), "requests",
            F.least("requests", F.lit(per_minute)).cast("bigint").alias("allowed"),
            F.greatest(F.col("requests") - per_minute, F.lit(0)).cast("bigint").alias(
                "refused"
            ),
        )
    )


def failure_counts(failures: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Running number of failures per key with its outcome (update mode)."""
    counted = failures.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.withColumn(
        "outcome",
        F.when(F.col("attempts") >= max_attempts, F.lit("dead_letter")).otherwise(
            F.lit("retry")
        ),
    )


def first_terminal(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The earliest of each job's terminal events, as they change (update mode): a late event that
    lies before the one known so far takes its place. State is one event per job, and the rows of a
    micro-batch are folded before they are shuffled."""
    others = [n for n in events.columns if n != job]
    return events.groupBy(job).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    ).select(job, "row.*")


def current_status(
    events: DataFrame, job: str, status: str, ts: str, id_col: str | None = None
) -> DataFrame:
    """Last status per job (update mode); equal times are decided by the id, else the status."""
    return events.groupBy(job).agg(
        F.max_by(status, F.struct(ts, id_col or status)).alias(status),
        F.max(ts).alias("as_of"),
    )
