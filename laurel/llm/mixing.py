"""Mixing sources to target weights by Pareto order sampling.

The words that a mix takes are shared over the sources by weight, no source more often than
``cap`` times. Inside a source every document expects ``rate * importance`` copies, at most
``cap``; its whole copies are certain, and the fraction left is the inclusion probability p of
one more. For those the documents are ranked by (u / (1 - u)) / (p / (1 - p)) with a fixed
random u per document, and the first ones are taken until the source's size is met: a fixed
size in words, whatever the run.

Texts never move: the plan shuffles (id, source, size). A source with any share of the rows is
ranked by range partitions on (source, rank key, id), and totals are summed before a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.words import words
from laurel.operators.ranking import global_rank
from laurel.session import cut_lineage

#: weights of the sources in code point order, repeating
WEIGHTS = (5, 2, 1)
#: copies of one document, and of a whole source, at most
CAP = 3
#: 52 random bits per document
UNIT = float(2**52)


def importance(size: Column) -> Column:
    """A longer document is a little likelier to be taken: 8 plus the bits of its size."""
    return F.lit(8) + F.length(F.bin(size))


def uniform(key: Column, seed: int) -> Column:
    """A fixed number in (0, 1) per key."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(UNIT)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP
                   ) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The level that turns weights into words rises as capped sources hand on their excess.
    Each round is one small aggregate; at least one more source is capped per round.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], name="_place")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")
    )
    table = cut_lineage(ranked.select("source", "source_size", weight.alias("_w")))
    most = F.col("source_size") * cap
    level, capped = 0.0, -1
    while True:
        full = most <= F.col("_w") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("total"), F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, most)).alias("held"), F.sum(F.when(~full, F.col("_w"))).alias("w"),
        ).first()
        if row["w"] is None or row["n"] == capped:
            break
        level = float(row["total"] - (row["held"] or 0)) / float(row["w"])
        capped = row["n"]
    target = F.least(most.cast("double"), F.col("_w") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def class_rates(sized: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies that each (source, importance) expects, so that a source meets its target.

    (source, _m, expected, certain, rest): ``rest`` is the source's words left for the draw.
    """
    cells = sized.filter("size > 0").groupBy("source", "_m").agg(F.sum("size").alias("_x"))
    above = Window.partitionBy("source").orderBy(F.desc("_m"))
    down = above.rowsBetween(Window.unboundedPreceding, -1)
    below = above.rowsBetween(0, Window.unboundedFollowing)
    rated = cells.join(
        targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))
    ).withColumn(
        "_rate",
        (F.col("target") - cap * F.coalesce(F.sum("_x").over(down), F.lit(0)))
        / F.sum(F.col("_x") * F.col("_m")).over(below),
    ).withColumn("_fits", F.col("_rate") * F.col("_m") <= cap)
    whole = Window.partitionBy("source")
    first = F.max(F.when(F.col("_fits"), F.struct("_m", "_rate"))).over(whole)["_rate"]
    expected = F.coalesce(F.least(F.lit(float(cap)), first * F.col("_m")), F.lit(float(cap)))
    return (
        rated.withColumn("expected", expected)
        .withColumn("certain", F.floor("expected"))
        .withColumn("rest", F.col("target") - F.sum(F.col("certain") * F.col("_x")).over(whole))
        .select("source", "_m", "expected", "certain", "rest")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 8,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, text) to (doc_id, source, size, source_size, target, copies, taken) and
    the ``keep`` columns.

    One row per input row. Null source is a source, after all others; null or blank text has
    size 0 and is never taken; repeated rows are drawn one by one, ties of the random number
    (the same id) go by size, then by ``keep``. An empty
    table gives an empty result. Other columns are ignored.
    """
    sized = cut_lineage(docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), *keep
    ).withColumn("_m", importance(F.col("size"))))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(totals, weights, cap))
    rates = class_rates(sized, targets, cap).withColumnsRenamed({"source": "_s", "_m": "_c"})
    # one row per (source, length class); AQE replicates it or splits a hot source
    drawn = sized.join(
        rates, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_m") == F.col("_c")), "left"
    )
    p, u = F.col("expected") - F.col("certain"), uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    odds = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    ranked = _running(drawn.withColumn("_q", F.when(p > 0, odds)), keep)
    extra = F.col("_q").isNotNull() & (2 * F.col("_cum") - F.col("size") <= 2 * F.col("rest"))
    copies = F.coalesce(F.col("certain"), F.lit(0)) + extra.cast("bigint")
    counted = ranked.select(
        "doc_id", "source", "size", F.coalesce(copies, F.lit(0)).alias("copies"), *keep
    )
    named = targets.withColumnRenamed("source", "_s")
    return counted.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *keep,
    )


def _running(drawn: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``_cum``: words of the source's drawn documents up to and with this one.

    Range partitions keep even one source with all rows spread; each adds the words that
    earlier partitions hold of the same source (one small row per partition and source).
    """
    order = [F.col("source"), F.col("_q").asc_nulls_last(), F.col("doc_id"), F.col("size"),
             *map(F.col, keep)]
    placed = cut_lineage(
        drawn.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    counts = F.when(F.col("_q").isNotNull(), F.col("size")).otherwise(0)
    cells = placed.groupBy("_part", F.col("source").alias("_g")).agg(F.sum(counts).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col("_part").alias("_p"), "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b")
    )
    inside = Window.partitionBy("_part", "source").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return placed.withColumn("_own", F.sum(counts).over(inside)).join(
        offsets,
        (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_g")), "left",
    ).withColumn("_cum", F.col("_own") + F.col("_b"))
