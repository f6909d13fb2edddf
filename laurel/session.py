"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: whether a finished query removes the shuffle files that it alone has read
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def build_session(app: str = "laurel", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for local runs and tests. On a cluster the submitter sets the resources;
    only the semantics (UTC, ANSI, AQE) matter there."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in
    ``spark.checkpoint.dir``. Only a local master may fall back to a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"laurel-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, and makes every later
    use see the same rows in the same order."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once as Parquet in the shared folder and read it back. Later stages
    then prune columns and push filters instead of computing the stage again, and a lost
    executor costs only its own tasks."""
    path = scratch_path(df.sparkSession, name)
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write a table and let go of the shuffle files it was made from, which nothing else reads."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes inside is removed at the end. Only for work whose own result is
    stored by then, so that nothing reads those tables again."""
    token = _passing.set([])
    try:
        yield
    finally:
        paths = _passing.get()
        _passing.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
