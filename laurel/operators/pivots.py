"""Exact nearest vectors by pivots: stored groups that the triangle inequality skips whole.

Every vector is stored in the folder of its nearest pivot, and of each group the range of angles to
its pivot is kept. The angle between a query and a vector of a group is at least the distance of the
query's angle to the pivot from that range, so a group whose bound is below a score that ``k`` vectors
are known to reach is never opened. A query first opens its most promising groups until they hold
``k`` vectors, then those that can still hold a better one. The answer is that of a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from laurel.operators.ranking import SCORE_UNITS, score_key, top_k
from laurel.operators.retrieval import _as_lists, _best_rows, _dense_rows, _query_blocks
from laurel.session import cut_lineage

PIVOTS = 64
#: the group of vectors without a direction, whose every score is 0
NO_DIRECTION = -1


@dataclass
class VectorIndex:
    """``vectors``: id, vector (unit), pivot, the latter a folder. ``groups``: pivot, centre, lo, hi
    (angles to the centre), n: one row per pivot."""

    vectors: DataFrame
    groups: DataFrame


def write_vectors(vectors: DataFrame, id_col: str, vector_col: str, path: str, pivots: int = PIVOTS
                  ) -> VectorIndex:
    """Store (id, vector) by nearest pivot below ``path``. Pivots are the ``pivots`` vectors of least
    id hash: a table of fixed size. Ids are unique; null, ragged and zero vectors have no direction."""
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 1
    width = max(width, 1)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    some = top_k(rows.withColumn("_h", F.xxhash64("id")), pivots, [F.col("_h"), F.col("id")]).collect()
    given = pa.array([r.vector for r in some], pa.list_(pa.float64()))
    centres = np.unique(np.round(_dense_rows(given, width), 12), axis=0) if some else np.zeros((0, width))
    centres = centres[np.abs(centres).sum(axis=1) > 0]
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _dense_rows(batch.column(1), width)
            live = np.abs(unit).sum(axis=1) > 0
            pivot, angle = np.full(len(unit), NO_DIRECTION), np.full(len(unit), np.pi / 2)
            if len(centres):
                cosine = unit @ centres.T
                best = cosine.argmax(axis=1)
                pivot = np.where(live, best, pivot)
                angle = np.where(live, np.arccos(np.clip(cosine[np.arange(len(unit)), best], -1, 1)), angle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _as_lists(unit, pa.float64()), pa.array(angle),
                 pa.array(pivot, pa.int32())], ["id", "vector", "angle", "pivot"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"id {kind}, vector array<double>, angle double, pivot int")
    placed.write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/vectors")
    stored = _stored(spark, path, kind)
    sizes = stored.groupBy("pivot").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    named = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)] + [(NO_DIRECTION, [0.0] * width)],
        "pivot int, centre array<double>",
    )
    named.join(sizes, "pivot").coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    spark.range(1).select(F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/kind")
    return read_vectors(spark, path)


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id {kind}, vector array<double>, angle double, pivot int").parquet(
        f"{path}/vectors")


def read_vectors(spark: SparkSession, path: str) -> VectorIndex:
    kind = spark.read.parquet(f"{path}/kind").first().kind
    return VectorIndex(_stored(spark, path, kind).drop("angle"), spark.read.parquet(f"{path}/groups"))


def _bounds(unit: np.ndarray, groups: list) -> np.ndarray:
    """(queries, groups): the largest score that any vector of a group can have."""
    centres = np.array([g.centre for g in groups])
    angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
    lo, hi = (np.array([g[x] for g in groups]) for x in ("lo", "hi"))
    # stored angles and this one are rounded
    least = np.maximum(0, np.maximum(angle - hi, lo - angle) - 1e-7)
    bound = np.cos(np.minimum(least, np.pi))
    bound[:, [g.pivot == NO_DIRECTION for g in groups]] = 0
    bound[np.abs(unit).sum(axis=1) == 0] = 0
    return np.floor(bound * SCORE_UNITS + 0.5) + 1


def nearest(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str, k: int = 50
            ) -> tuple[DataFrame, float]:
    """(query id, id, score, rank from 1) of the ``k`` vectors nearest to each query by cosine (ties:
    smallest id), and the share of all comparisons that were made."""
    spark = queries.sparkSession
    groups = index.groups.orderBy("pivot").collect()  # at most one row per pivot
    id_type = queries.schema[query_id].dataType
    schema = T.StructType([
        T.StructField(query_id, id_type), index.vectors.schema["id"], T.StructField("score", T.DoubleType()),
    ])
    found = spark.createDataFrame([], schema)
    made = whole = 0
    sizes = np.array([g.n for g in groups])
    width = len(groups[0].centre) if groups else 1
    for ids, unit in _query_blocks(queries, query_id, query_vector, width):
        if not groups:
            continue
        bound = _bounds(unit, groups)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        first = np.zeros(bound.shape, bool)
        # the best groups, up to the one with which k vectors are held
        np.put_along_axis(first, order, np.hstack([np.full((len(ids), 1), True), held[:, :-1] < k]), axis=1)
        early = cut_lineage(_best(_open(index, groups, first, ids, unit, schema, k), query_id, k))
        least = np.full(len(ids), -np.inf)
        place = {i: n for n, i in enumerate(ids)}
        for r in early.filter(F.col("rank") == k).select(query_id, "_key").toLocalIterator():
            least[place[r[0]]] = r[1]
        second = ~first & (bound >= least[:, None])
        late = _open(index, groups, second, ids, unit, schema, k)
        found = found.unionByName(early.select(*schema.names)).unionByName(late)
        made += int(((first | second) * sizes).sum())
        whole += int(sizes.sum()) * len(ids)
    return _best(found, query_id, k).drop("_key"), made / max(whole, 1)


def _best(rows: DataFrame, query_id: str, k: int) -> DataFrame:
    keyed = rows.withColumn("_key", score_key(F.col("score")))
    return top_k(keyed, k, [F.col("_key").desc(), F.col("id")], query_id)


def _open(index: VectorIndex, groups: list, wanted: np.ndarray, ids: list, unit: np.ndarray,
          schema: T.StructType, k: int) -> DataFrame:
    """Scores of the vectors of the wanted (query, group) pairs, of a batch and group its best ``k``
    per query; other folders are not read."""
    spark = index.vectors.sparkSession
    pivots = [g.pivot for g, used in zip(groups, wanted.any(axis=0)) if used]
    if not pivots:
        return spark.createDataFrame([], schema)
    asked = {g.pivot: np.flatnonzero(wanted[:, i]) for i, g in enumerate(groups)}
    out_type = to_arrow_type(schema[0].dataType)
    shipped = spark.sparkContext.broadcast((pa.array(ids), unit, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, asked = shipped.value
        for batch in batches:
            pivot = batch.column(2).to_numpy()
            data = _dense_rows(batch.column(1), vectors.shape[1])
            for p in np.unique(pivot):
                rows, queries = np.flatnonzero(pivot == p), asked[int(p)]
                scores = data[rows] @ vectors[queries].T
                row, col = _best_rows(scores, batch.column(0), k)
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(queries[col])).cast(out_type),
                    batch.column(0).take(pa.array(rows[row])), pa.array(scores[row, col]),
                ], schema.names)

    return index.vectors.filter(F.col("pivot").isin(pivots)).mapInArrow(run, schema)
