"""Queries over service tables: first sightings, quotas, retries, jobs, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.catalog import sqltext as S
from laurel.catalog.profiles import matrix
from laurel.catalog.registry import query, rounded
from laurel.functions import text as X
from laurel.operators import service
from laurel.sources import sinks
from laurel.sources import tables as t

# Several keys per minute in the event table: the event type is the message key.
_CHAIN = """WITH RECURSIVE m AS (SELECT event_type AS key, epoch_us(ts) AS tick, min(event_id) AS node FROM events GROUP BY ALL),
chain AS (SELECT key, min(tick) AS tick FROM m GROUP BY key
  UNION ALL SELECT c.key, (SELECT min(m.tick) FROM m WHERE m.key = c.key AND m.tick >= c.tick + 300000000) FROM chain c
  WHERE (SELECT min(m.tick) FROM m WHERE m.key = c.key AND m.tick >= c.tick + 300000000) IS NOT NULL)
"""


@query("first_sightings", f"{_CHAIN} SELECT event_id, event_type, event_id IN (SELECT node FROM chain JOIN m USING (key, tick)) AS accepted FROM events")
def first_sightings(spark, sf):
    """Repeats within 300 s of the last accepted event of their type are duplicates."""
    df = t.events(spark, sf).select("event_id", "event_type", "ts")
    return service.dedup_first_sighting(df, "event_type", "ts", "event_id", 300).select(
        "event_id", "event_type", "accepted"
    )


@query("quota_decisions", """SELECT event_id, n <= 2 AS allowed, greatest(2 - n, 0)::INTEGER AS remaining, CASE WHEN n <= 2 THEN 0 ELSE 60 - second(ts) END::INTEGER AS retry_after FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM events)""")
def quota_decisions(spark, sf):
    """Two requests per minute and event type."""
    df = t.events(spark, sf).select("event_id", "event_type", "ts")
    return service.quota_decisions(df, "event_type", "ts", "event_id", 2).select(
        "event_id", "allowed", "remaining", "retry_after"
    )


@query("quota_windows", """SELECT event_type, strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests,
  least(count(*), 2)::BIGINT AS allowed, greatest(count(*) - 2, 0)::BIGINT AS refused FROM events GROUP BY ALL""")
def quota_windows(spark, sf):
    df = service.quota_windows(t.events(spark, sf), "event_type", "ts", 2)
    return df.select(
        "event_type", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"),
        "requests", F.col("allowed").cast("bigint").alias("allowed"), "refused",
    )


@query("dead_letters", """SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 15 THEN 'dead_letter' ELSE 'retry' END AS outcome FROM events WHERE event_type = 'error' GROUP BY user_id""")
def dead_letters(spark, sf):
    failures = t.load(spark, sf, "events").filter("event_type = 'error'")
    return service.split_dead_letters(failures, "user_id", 15)


@query("delivery_order", "SELECT event_id, row_number() OVER (ORDER BY event_id % 10, ts, event_id) - 1 AS position FROM events")
def delivery_order(spark, sf):
    df = t.events(spark, sf).select(
        "event_id", (F.col("event_id") % 10).alias("priority"), "ts"
    )
    return service.delivery_order(df, "priority", ["ts", "event_id"]).select(
        "event_id", "position"
    )


@query("queue_stats", "SELECT event_type, count(*) AS messages FROM events GROUP BY event_type")
def queue_stats(spark, sf):
    return service.queue_stats(t.load(spark, sf, "events"), "event_type")


@query("first_terminal_events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error')) WHERE n = 1")
def first_terminal_events(spark, sf):
    """Purchases and errors end a job; a second end is ignored."""
    return service.first_terminal(
        t.events(spark, sf), "user_id", ["ts", "event_id"],
        F.col("event_type").isin("purchase", "error"),
    ).select("user_id", "event_type", "event_id")


@query("current_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def current_status(spark, sf):
    return service.current_status(
        t.events(spark, sf), "user_id", "event_type", ["ts", "event_id"]
    )


@query("recent_jobs", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_jobs(spark, sf):
    return service.recent(
        t.load(spark, sf, "orders"), "o_orderdate", 50, "o_orderkey"
    ).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query("job_results", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def job_results(spark, sf):
    """Jobs joined with their result rows in rank order."""
    from laurel.operators.ranking import rank_positions

    jobs = t.load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    rows = t.load(spark, sf, "orders").join(
        jobs, F.col("c_custkey") == F.col("o_custkey")
    ).select("o_custkey", "o_orderkey", "o_totalprice")
    return rank_positions(rows, "o_totalprice", "o_orderkey", "o_custkey").select(
        "o_custkey", "o_orderkey", "rank"
    )


_BOUNDS = "[0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60, 120, 300]"


@query("job_rollup", f"""{S.GATED}, j AS (SELECT event_type AS source, user_id % 2 = 0 AS hit, value / 1000.0 AS s FROM events)
SELECT 'requests' AS metric, source || ',' || CASE WHEN hit THEN 'true' ELSE 'false' END AS label, count(*) AS value FROM j GROUP BY ALL
UNION ALL SELECT 'latency_le', CASE WHEN b = floor(b) THEN CAST(b::INT AS VARCHAR) ELSE CAST(b AS VARCHAR) END, (SELECT count(*) FROM j WHERE s <= b) FROM (SELECT unnest({_BOUNDS}::DOUBLE[]) AS b)
UNION ALL SELECT 'gate_exclusions', reason, count(*) FROM (SELECT unnest(gate_failures) AS reason FROM gated WHERE NOT gate_passed) GROUP BY reason
UNION ALL SELECT 'honeypots', '', count(*) FROM gated WHERE is_honeypot = 1""")
def job_rollup(spark, sf):
    jobs = t.load(spark, sf, "events").select(
        F.col("event_type").alias("source"), (F.col("user_id") % 2 == 0).alias("cache_hit"),
        F.col("value").alias("elapsed_ms"),
    )
    return service.job_rollup(jobs, matrix(spark, sf))


@query("request_keys", """SELECT o_orderkey, substr(sha256(sha256(o_orderpriority) || '100' || coalesce((SELECT string_agg(id, '' ORDER BY id) FROM (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS id FROM lineitem WHERE l_orderkey = o_orderkey)), '')), 1, 24) AS key FROM orders""")
def request_keys(spark, sf):
    """Cache key of each order: its priority as the job, its line numbers as the ids."""
    ids = t.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.col("l_linenumber").cast("string")).alias("ids")
    )
    orders = t.load(spark, sf, "orders").join(
        ids, F.col("l_orderkey") == F.col("o_orderkey"), "left"
    )
    return orders.select("o_orderkey", service.request_key(
        F.sha2("o_orderpriority", 256), F.col("ids"), F.lit(100)
    ).alias("key"))


@query("shared_ids", "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)")
def shared_ids(spark, sf):
    """Membership overlap of two id sets."""
    a = t.load(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    b = t.load(spark, sf, "events").select(F.col("user_id").alias("id"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared"))


@query("missing_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def missing_ids(spark, sf):
    a = t.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    b = t.load(spark, sf, "events").select(F.col("user_id").alias("id"))
    return a.join(b, "id", "left_anti")


@query("table_fingerprint")
def table_fingerprint(spark, sf):
    """Content summary of the order table, as manifests record it (hashes have no SQL)."""
    return sinks.fingerprint(t.load(spark, sf, "orders"))


@query("manifest_rows", "SELECT count(*) AS rows, sha256('rows=' || count(*)) AS summary FROM lineitem")
def manifest_rows(spark, sf):
    return sinks.fingerprint(t.load(spark, sf, "lineitem")).select(
        "rows", X.content_hash(F.concat(F.lit("rows="), F.col("rows").cast("string")))
        .alias("summary"),
    )
