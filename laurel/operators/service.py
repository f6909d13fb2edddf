"""Batch rules over the tables of a ranking service: jobs, messages, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.operators.ranking import global_rank, top_k
from laurel.session import cut_lineage

LATENCY_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
MAX_ATTEMPTS = 3


# --- first sighting -------------------------------------------------------------------


def dedup_first_sighting(
    messages: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int = 300
) -> DataFrame:
    """Messages with ``accepted``: a repeat within ``ttl`` of the last accepted message of
    its key is a duplicate, and does not extend the window.

    Acceptance is a chain (each accepted message decides the next), yet no key is folded
    in one task. A message after a silence of ``ttl`` is accepted whatever came before.
    For the others, ``next`` of a message is the first one at least ``ttl`` later, found
    among the messages of two neighbouring time buckets; the chain from the certain
    messages is then followed by doubling the step, which takes log2(chain) joins on
    (key, position).
    """
    c = F.col
    ttl = F.lit(ttl_seconds * 1_000_000)
    # one node per key and moment; the first id stands for it, later ones are duplicates
    moments = messages.select(key, F.unix_micros(ts).alias("at"), id_col).groupBy(
        key, "at"
    ).agg(F.min(id_col).alias("node"))
    nxt = cut_lineage(_next_moment(moments, key, ttl))
    # a moment is certain when no other lies within ttl before it
    certain = cut_lineage(
        moments.join(_followed(moments, key, ttl), [key, "at"], "left_anti").select(key, "at")
    )
    jump = nxt.select(key, "at", c("next_any").alias("to")).filter(c("to").isNotNull())
    reached, frontier_size = certain, -1
    while True:
        grown = cut_lineage(
            reached.unionByName(
                reached.join(jump, [key, "at"]).select(key, c("to").alias("at"))
            ).distinct()
        )
        size = grown.count()
        if size == frontier_size:
            break
        frontier_size, reached = size, grown
        step = jump.select(key, c("at").alias("to"), c("to").alias("beyond"))
        jump = cut_lineage(
            jump.join(step, [key, "to"]).select(key, "at", c("beyond").alias("to"))
        )
    accepted = reached.join(moments, [key, "at"]).select(
        c("node").alias(id_col), F.lit(True).alias("_hit")
    )
    return messages.join(accepted, id_col, "left").withColumn(
        "accepted", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def _next_moment(moments: DataFrame, key: str, ttl: Column) -> DataFrame:
    """(key, at, next_any): the first moment at least ``ttl`` after ``at``."""
    c = F.col
    bucket = lambda x: F.floor(x / ttl)
    own = moments.select(key, bucket(c("at")).alias("b"), c("at").alias("t"),
                         F.lit(None).cast("bigint").alias("src"))
    asked = moments.select(key, bucket(c("at") + ttl).alias("b"), (c("at") + ttl).alias("t"),
                           c("at").alias("src"))
    # latest first; at equal times the message itself precedes the question
    w = Window.partitionBy(key, "b").orderBy(
        c("t").desc(), c("src").isNotNull().cast("int")
    ).rowsBetween(Window.unboundedPreceding, 0)
    within = own.unionByName(asked).withColumn(
        "hit", F.min(F.when(c("src").isNull(), c("t"))).over(w)
    ).filter(c("src").isNotNull())
    # nothing left in that bucket: the first moment of the key's next filled bucket. A key
    # has one row per filled bucket here, a number that grows with time, not with traffic
    filled = moments.groupBy(key, bucket(c("at")).alias("b")).agg(F.min("at").alias("head"))
    heads = filled.withColumn(
        "after", F.lead("head").over(Window.partitionBy(key).orderBy("b"))
    ).select(key, "b", "head", "after")
    asked_bucket = within.withColumn("own_b", bucket(c("src"))).join(heads, [key, "b"], "left")
    # an empty bucket is no row: then the bucket of the moment itself knows what follows
    own_bucket = heads.select(key, c("b").alias("own_b"), c("after").alias("own_after"))
    following = F.when(c("head").isNull(), c("own_after")).otherwise(c("after"))
    return asked_bucket.join(own_bucket, [key, "own_b"], "left").select(
        key, c("src").alias("at"), F.coalesce("hit", following).alias("next_any")
    )


def _followed(moments: DataFrame, key: str, ttl: Column) -> DataFrame:
    """Moments that have another one less than ``ttl`` before them."""
    c = F.col
    b = F.floor(c("at") / ttl)
    spread = moments.select(key, "at", F.lit(True).alias("real"), b.alias("b")).unionByName(
        moments.select(key, "at", F.lit(False).alias("real"), (b + 1).alias("b"))
    )
    w = Window.partitionBy(key, "b").orderBy("at")
    return spread.withColumn("before", F.lag("at").over(w)).filter(
        c("real") & (c("at") - c("before") < ttl)
    ).select(key, "at")


# --- quota ----------------------------------------------------------------------------


def quota_decisions(
    requests: DataFrame, identity: str, ts: str, id_col: str, per_minute: int = 120
) -> DataFrame:
    """Fixed one-minute windows: allowed, remaining and retry_after of every request.

    Only the first ``per_minute`` requests of a window are numbered (each task keeps no
    more of them); all others are refused without being sorted.
    """
    c = F.col
    keyed = requests.withColumn("_w", F.struct(identity, F.date_trunc("minute", ts).alias("m")))
    granted = top_k(
        keyed.select("_w", ts, id_col), per_minute, [c(ts), c(id_col)], "_w", "_n"
    ).select(id_col, "_n")
    left = F.lit(60) - F.second(ts)
    return requests.join(granted, id_col, "left").select(
        *requests.columns,
        c("_n").isNotNull().alias("allowed"),
        F.coalesce(F.lit(per_minute) - c("_n"), F.lit(0)).alias("remaining"),
        F.when(c("_n").isNull(), left).otherwise(F.lit(0)).cast("int").alias("retry_after"),
    )


def quota_windows(
    requests: DataFrame, identity: str, ts: str, per_minute: int = 120
) -> DataFrame:
    """Requests, grants and refusals per identity and minute."""
    n = F.count(F.lit(1))
    return requests.groupBy(identity, F.window(ts, "1 minute").start.alias("minute")).agg(
        n.alias("requests"), F.least(n, F.lit(per_minute)).alias("allowed"),
        F.greatest(n - per_minute, F.lit(0)).alias("refused"),
    )


# --- messages and jobs ----------------------------------------------------------------


def split_dead_letters(
    attempts: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """(key, attempts, outcome): ``dead_letter`` once the failures reach the budget."""
    return attempts.groupBy(key).agg(F.count(F.lit(1)).alias("attempts")).withColumn(
        "outcome",
        F.when(F.col("attempts") >= max_attempts, F.lit("dead_letter")).otherwise(
            F.lit("retry")
        ),
    )


def delivery_order(messages: DataFrame, priority: str, arrival: list[str]) -> DataFrame:
    """``position`` from 0: priority first, then arrival."""
    return global_rank(messages, [F.col(priority), *map(F.col, arrival)], name="position")


def queue_stats(messages: DataFrame, status: str) -> DataFrame:
    return messages.groupBy(status).agg(F.count(F.lit(1)).alias("messages"))


def first_terminal(events: DataFrame, job: str, order: list[str],
                   terminal: Column) -> DataFrame:
    """The first terminal event of each job; later ones are ignored."""
    others = [n for n in events.columns if n != job]
    return events.filter(terminal).groupBy(job).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    ).select(job, "row.*")


def current_status(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each job."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(*order)).alias(status))


def recent(df: DataFrame, created: str, n: int, id_col: str) -> DataFrame:
    """The latest ``n`` rows."""
    return df.orderBy(F.col(created).desc(), F.col(id_col).desc()).limit(n)


def job_rollup(jobs: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Requests by source and cache result, and the cumulative latency histogram: rows
    (metric, label, value). ``jobs``: source, cache_hit, elapsed_ms. With the gated pool of the jobs
    also its exclusions by reason and its impossible profiles."""
    requests = jobs.groupBy(
        F.concat_ws(",", "source", F.col("cache_hit").cast("string")).alias("label")
    ).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("requests").alias("metric"), "label", "value"
    )
    seconds = F.col("elapsed_ms") / F.lit(1000.0)
    sums = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    cells = F.array(*[
        F.struct(F.lit("latency_le").alias("metric"),
                 F.lit(f"{b:g}").alias("label"), F.col(f"b{i}").alias("value"))
        for i, b in enumerate(LATENCY_BOUNDS)
    ])
    out = requests.unionByName(jobs.agg(*sums).select(F.inline(cells)))
    if gated is None:
        return out
    excluded = gated.filter(~F.col("gate_passed")).select(
        F.explode("gate_failures").alias("label")
    ).groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    impossible = gated.agg(F.count_if(F.col("is_honeypot") == 1).alias("value"))
    return out.unionByName(
        excluded.select(F.lit("gate_exclusions").alias("metric"), "label", "value")
    ).unionByName(impossible.select(
        F.lit("honeypots").alias("metric"), F.lit("").alias("label"), "value"
    ))


def request_key(jd_hash: Column, ids: Column | None, top_k_: Column) -> Column:
    """Cache key of a request: job hash, size, sorted ids."""
    listed = F.array_join(F.array_sort(ids), "") if ids is not None else F.lit("")
    text = F.concat(jd_hash, top_k_.cast("string"), F.coalesce(listed, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 24)
