"""Running streams to completion, with one folder per micro-batch.

A folder is overwritten when its micro-batch is replayed after a failure, so every sink
here is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from laurel.operators import evidence, service


def files(spark: SparkSession, folder: str, schema, pattern: str = "*", per_batch: int = 1,
          fmt: str = "parquet") -> DataFrame:
    """A file stream with a bounded number of files per micro-batch."""
    return (
        spark.readStream.format(fmt).schema(schema)
        .option("maxFilesPerTrigger", per_batch)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )


def each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> DataStreamWriter:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
                  ) -> StreamingQuery:
    """Each micro-batch as a folder ``batch_id=N`` below ``path``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each_batch(stream, save, checkpoint, mode).start()


def first_sightings(
    stream: DataFrame, key: str, ts: str, id_col: str, path: str, checkpoint: str,
    ttl_seconds: int = 300,
) -> DataFrame:
    """Accepted messages (key, ts, id) of a stream run to its end, however late they come.

    A late message can change what is accepted after it, so the micro-batches are stored and
    the rule is applied to the table, by the batch twin, which splits hot keys."""
    write_batches(stream.select(key, ts, id_col), path, checkpoint).awaitTermination()
    stored = stream.sparkSession.read.schema(stream.select(key, ts, id_col).schema).parquet(path)
    return service.dedup_first_sighting(stored, key, ts, id_col, ttl_seconds).filter(
        "accepted"
    ).drop("accepted")


def split_batches(stream: DataFrame, outcome: str, root: str, checkpoint: str
                  ) -> StreamingQuery:
    """Micro-batches split by outcome into one table each."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(outcome, "batch_id").parquet(root)

    return each_batch(stream, save, checkpoint, "update").start()


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key in a table of update-mode micro-batches."""
    others = [n for n in rows.columns if n not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r")).select(
        *keys, "r.*"
    )


# --- evidence ingestion ---------------------------------------------------------------


def ingest_evidence(
    stream: DataFrame, root: str, checkpoint: str, as_of, arrival: str = "arrival"
) -> StreamingQuery:
    """New artifact files to summarised artifacts and skill contributions.

    Per micro-batch: copies collapse, hashes of earlier batches are skipped, the rest is
    summarised, and the batch's own skill edges are written. Hashes are stored in folders by their
    first two digits, and a batch reads only the folders of its own hashes. Edges of different batches add up in any order (``skill_records``), so
    late evidence needs no watermark.
    """
    spark = stream.sparkSession
    artifacts, edges, hashes = f"{root}/artifacts", f"{root}/edges", f"{root}/hashes"

    def handle(batch: DataFrame, batch_id: int) -> None:
        hashed = batch.withColumn("content_hash", F.sha2("raw_content", 256)).filter(
            F.trim("raw_content") != ""
        )
        stored = known_hashes(spark, hashes, hashed, batch_id) if batch_id > 0 else None
        fresh = evidence.with_summary(evidence.new_artifacts(hashed, stored, arrival))
        target = f"{artifacts}/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(target)
        spark.read.parquet(target).select(
            "content_hash", hash_prefix().alias("prefix"), F.lit(batch_id).alias("batch_id")
        ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "prefix", "batch_id"
        ).parquet(hashes)
        rows = spark.read.parquet(target).withColumn("skill_name", F.explode("skills"))
        evidence.skill_edges(rows, as_of).write.mode("overwrite").parquet(
            f"{edges}/batch_id={batch_id}"
        )

    return each_batch(stream, handle, checkpoint).start()


def hash_prefix() -> Column:
    return F.substring("content_hash", 1, 2)


def known_hashes(spark: SparkSession, path: str, batch: DataFrame, batch_id: int) -> DataFrame:
    """Hashes of earlier batches that can equal one of this batch: at most 256 folders are named."""
    prefixes = sorted(r[0] for r in batch.select(hash_prefix()).distinct().collect())
    # prefixes such as 00 are text, whatever the folders look like
    rows = spark.read.schema("content_hash string, prefix string, batch_id long").parquet(path)
    return rows.filter(F.col("prefix").isin(prefixes) & (F.col("batch_id") < batch_id))


def skill_records(spark: SparkSession, root: str) -> DataFrame:
    """Skill records over all ingested batches."""
    edges = spark.read.parquet(f"{root}/edges")
    return evidence.merge_skill_records(edges.limit(0), edges)
