"""Global ranks, exact quantiles and rank fusion without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.numeric import scaled
from laurel.session import materialise

# Scores are compared in billionths, so that equal texts tie whatever the order in which
# their terms were added up; the id then decides.
SCORE_UNITS = 1e9
#: buckets that a range of values is cut into when a quantile is looked for
BUCKETS = 1024


def score_key(score: Column) -> Column:
    return F.floor(score * F.lit(SCORE_UNITS) + F.lit(0.5))


def global_rank(
    df: DataFrame, order: Sequence[Column], group: str | None = None, name: str = "rank",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Exact 0-based position of every row in ``order`` (within ``group``); of the columns only
    ``keep`` are written and given back, if named.

    A plain window would sort each group, here the whole pool, in one task. Instead the
    rows are range-partitioned on (group, order), which splits even a run of equal scores
    because the order ends in the id; the sorted rows are written with their partition and
    position, so that later steps read only the columns they need; then one small table with the row count of each
    (partition, group) gives the offsets, joined on both, which no hot group can skew.
    """
    keys = [F.col(group)] if group else []
    placed = materialise(
        df.orderBy(*keys, *order).select(
            *(df.columns if keep is None else keep), F.monotonically_increasing_id().alias("_at")
        ), "placed"
    ).withColumn("_part", F.shiftright("_at", 33))
    cells = placed.groupBy("_part", *keys).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = cells.select(
        "_part", *keys, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    return (
        placed.join(offsets, ["_part", *([group] if group else [])])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_at", "_part", "_first", "_before")
    )


def rank_positions(
    scores: DataFrame, score: str, id_col: str, group: str | None = None,
    name: str = "rank",
) -> DataFrame:
    """0-based rank by descending score, id ascending on ties."""
    keyed = scores.withColumn("_key", score_key(F.col(score)))
    return global_rank(
        keyed, [F.col("_key").desc(), F.col(id_col).asc()], group, name
    ).drop("_key")


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """(probability, value) with linear interpolation between neighbours; nulls and NaN do not count.

    No row moves: a pass counts the rows per bucket of the ranges that hold a wanted rank, and each
    range shrinks to one bucket of itself, until a bucket holds one value. The driver sees at most
    ``BUCKETS`` rows per wanted rank and pass, of which doubles need a handful. ``df`` is read once per
    pass and should be stored.
    """
    spark = df.sparkSession
    known = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    schema = "probability double, value double"
    if not total.n:
        return spark.createDataFrame([], schema)
    spots = {float(p): p * (total.n - 1) for p in probabilities}
    ranks = sorted({int(f(at)) for at in spots.values() for f in (math.floor, math.ceil)})
    # per wanted rank: the range that holds it, and how many rows lie before that range
    where = {r: (total.lo, total.hi, 0) for r in ranks}
    while True:
        open_ = sorted({w[:2] for w in where.values() if w[0] < w[1]})
        if not open_:
            break
        cells = _cells(known, open_)
        for rank, (lo, hi, before) in where.items():
            if lo < hi:
                for cell in cells[lo, hi]:
                    if rank < before + cell.n:
                        where[rank] = (cell.lo, cell.hi, before)
                        break
                    before += cell.n
    values = []
    for p, at in spots.items():
        lo, hi = where[math.floor(at)][0], where[math.ceil(at)][0]
        values.append((p, float(lo + (hi - lo) * (at - math.floor(at)))))
    return spark.createDataFrame(values, schema)


def _cells(known: DataFrame, ranges: Sequence[tuple[float, float]]) -> dict:
    """(range) to its non-empty buckets in order: number of rows, least and largest value."""
    x = F.col("x")
    which = bucket = None
    for i, (lo, hi) in enumerate(ranges):
        inside = x.between(lo, hi)
        share = (x / F.lit(hi - lo) - F.lit(lo / (hi - lo))) if math.isfinite(hi - lo) else F.lit(0.5) + (
            x / F.lit(hi) - F.lit(lo / hi)) / 2
        at = F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
        which = F.when(inside, F.lit(i)) if which is None else which.when(inside, F.lit(i))
        bucket = F.when(inside, at) if bucket is None else bucket.when(inside, at)
    rows = known.select("x", which.alias("i"), bucket.alias("b")).filter("i IS NOT NULL").groupBy(
        "i", "b"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict = {r: [] for r in ranges}
    for row in sorted(rows, key=lambda r: r.lo):
        out[ranges[row.i]].append(row)
    return out


def minmax(
    df: DataFrame, column: str, name: str | None = None, group: str | None = None,
    eps: float = 1e-12,
) -> DataFrame:
    """Min-max scaled column, over the whole frame or per group.

    Over the frame the two bounds are a scalar subquery; per group they are a table with
    one row per group, and a group is one job or query.
    """
    lo, hi = F.min(column).alias("_lo"), F.max(column).alias("_hi")
    if group is None:
        bounds = df.agg(F.struct(lo, hi).alias("b")).scalar()
        return df.withColumn("_b", bounds).withColumn(
            name or column,
            scaled(F.col(column), F.col("_b._lo"), F.col("_b._hi"), eps),
        ).drop("_b")
    bounds = df.groupBy(group).agg(lo, hi)
    return (
        df.join(bounds, group)
        .withColumn(name or column, scaled(F.col(column), F.col("_lo"), F.col("_hi"), eps))
        .drop("_lo", "_hi")
    )


def rrf_credit(rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank credit of a 0-based rank."""
    return F.lit(1.0) / (rank + F.lit(k + 1))


def fuse_scores(
    lists: Sequence[DataFrame], id_col: str, group: str, k: int = 60
) -> DataFrame:
    """Fuse score lists (group, id, score) into (group, id, ``retrieval_score``) in 0..1.

    Only rows with a positive score earn credit. Rows that are in no list, or only with
    zero scores, are absent: their raw credit is 0. The scaling therefore takes 0 as its
    lower bound whenever such rows exist in the pool, see ``retrieval_scores``.
    """
    credits = None
    for scores in lists:
        # the sort moves and writes nothing but what the ranks need
        keyed = scores.select(group, id_col, score_key(F.col("score")).alias("_key"))
        ranked = global_rank(
            keyed.filter("_key > 0"), [F.col("_key").desc(), F.col(id_col).asc()], group,
            keep=(group, id_col),
        )
        part = ranked.select(group, id_col, rrf_credit(F.col("rank"), k).alias("credit"))
        credits = part if credits is None else credits.unionByName(part)
    return credits.groupBy(group, id_col).agg(F.sum("credit").alias("credit"))


def fuse_rankings(rankings: DataFrame, id_col: str, group: str, k: int = 60) -> DataFrame:
    """Classic fusion of ranked id lists: rows (group, list, id, 0-based rank) become
    (group, id, rrf_score)."""
    return rankings.groupBy(group, id_col).agg(
        F.sum(rrf_credit(F.col("rank"), k)).alias("rrf_score")
    )


def top_k(df: DataFrame, k: int, order: Sequence[Column], group: str | None = None,
          name: str = "rank") -> DataFrame:
    """The first ``k`` rows per group with their 1-based rank. Each task keeps only its
    own ``k`` best rows before the shuffle."""
    keys = [F.col(group)] if group else []
    if not keys:
        df = df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
