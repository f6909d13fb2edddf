"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.plans.stages import StageStore
from laurel.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its check if SQL can state it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _store(spark: SparkSession) -> StageStore:
    return StageStore(spark, f"{shared_dir(spark).rstrip('/')}/stages")


def stored_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> str:
    """The folder of an artifact of several tables that queries start from, built once for the given
    tables as they are."""
    store = _store(spark)
    return store.folder(name, build, store.listed(sf_dir))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
           ) -> DataFrame:
    """A table that several queries start from: the feature matrix and its like are artifacts that
    rankings read, not something each one repeats."""
    store = _store(spark)
    return store.stage(name, build, store.listed(sf_dir))


def stored_or_derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
                      ) -> DataFrame:
    """The same table for a query that reads it once: the stored one where it has been built, else the
    rows as they are derived, of which only the columns that are read get computed."""
    store = _store(spark)
    found = store.found(name, store.listed(sf_dir))
    return build() if found is None else found


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; arrays of strings joined by commas."""
    out = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            # adding zero turns -0.0 into 0.0
            column = F.round(column, digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        out.append(column.alias(field.name))
    return df.select(*out)
