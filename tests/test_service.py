"""Message rules, in batch and as streams, against plain loops."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from conftest import profile
from pyspark.sql import functions as F

from laurel.operators import service
from laurel.sources import candidates, jobspec, sinks
from laurel.streaming import rules
from laurel.streaming import sinks as streams

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def messages():
    """One busy key with a third of all rows and no pause, sparse keys, exact repeats."""
    rng = random.Random(5)
    rows, number = [], 0
    for key, gap in (("hot", 20), ("warm", 150), ("cold", 2000)):
        moment = 0.0
        for _ in range(400 if key == "hot" else 100):
            moment += rng.choice([0.0, rng.random() * gap, rng.random() * gap, 300.0 if key == "cold" else 1.0])
            rows.append((number, key, START + dt.timedelta(seconds=round(moment, 3))))
            number += 1
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def accepted(messages):
    last, kept = {}, set()
    for number, key, moment in sorted(messages, key=lambda r: (r[2], r[0])):
        if key not in last or (moment - last[key]).total_seconds() >= 300:
            kept.add(number)
            last[key] = moment
    return kept


@pytest.fixture(scope="module")
def frame(spark, messages):
    return spark.createDataFrame(messages, "id long, key string, ts timestamp").repartition(4)


def test_first_sightings(frame, accepted):
    got = service.dedup_first_sighting(frame, "key", "ts", "id", 300)
    assert got.count() == 600
    assert {r["id"] for r in got.filter("accepted").collect()} == accepted


def test_quota(frame, messages):
    seen, expected = {}, {}
    for number, key, moment in sorted(messages, key=lambda r: (r[2], r[0])):
        window = (key, moment.replace(second=0, microsecond=0))
        seen[window] = seen.get(window, 0) + 1
        n = seen[window]
        expected[number] = (n <= 3, max(3 - n, 0), 0 if n <= 3 else 60 - moment.second)
    got = service.quota_decisions(frame, "key", "ts", "id", 3).collect()
    assert {r["id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in got} == expected


def test_delivery_order(spark):
    df = spark.createDataFrame([(1, 9), (2, 1), (3, 5), (4, 1)], "id int, priority int")
    got = service.delivery_order(df, "priority", ["id"]).orderBy("position")
    assert [r["id"] for r in got.collect()] == [2, 4, 3, 1]


def test_dead_letters_and_terminals(spark):
    df = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "failed"), ("b", 4, "ok"), ("b", 5, "failed")],
                               "job string, n int, status string")
    out = {r["job"]: r["outcome"] for r in service.split_dead_letters(
        df.filter("status = 'failed'"), "job").collect()}
    assert out == {"a": "dead_letter", "b": "retry"}
    first = service.first_terminal(df, "job", ["n"], F.col("status").isin("ok", "failed"))
    assert {r["job"]: r["n"] for r in first.collect()} == {"a": 1, "b": 4}
    last = service.current_status(df, "job", "status", ["n"])
    assert {r["job"]: r["status"] for r in last.collect()} == {"a": "failed", "b": "failed"}


def test_request_key_ignores_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],), (["a"],)], "ids array<string>")
    keys = [r[0] for r in df.select(service.request_key(F.lit("h"), F.col("ids"), F.lit(10))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 24


# --- streams --------------------------------------------------------------------------


@pytest.fixture
def folder(spark, messages, tmp_path):
    """The messages in time order, four files."""
    ordered = sorted(messages, key=lambda r: (r[2], r[0]))
    size = len(ordered) // 4
    for i in range(4):
        part = ordered[i * size:(i + 1) * size]
        spark.createDataFrame(part, "id long, key string, ts timestamp").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    return tmp_path


def test_stream_first_sightings(spark, folder, accepted):
    source = streams.files(spark, str(folder / "in"), "id long, key string, ts timestamp")
    out = streams.first_sightings(source, "key", "ts", "id", str(folder / "out"), str(folder / "cp"), 300)
    assert {r["id"] for r in out.collect()} == accepted


def test_stream_quota(spark, folder, messages):
    schema = "id long, key string, ts timestamp"
    source = streams.files(spark, str(folder / "in"), schema)
    out = rules.quota_windows(source, "key", "ts", 3, "2 days")
    streams.write_batches(out, str(folder / "q"), str(folder / "qcp"), "update").awaitTermination()
    rows = streams.latest_updates(spark.read.parquet(str(folder / "q")), ["key", "minute"])
    assert sum(r["requests"] for r in rows.collect()) == len(messages)


def test_streams_keep_late_rows(spark, folder, messages):
    """Files in the wrong order: nothing is dropped."""
    schema = "id long, key string, ts timestamp"
    ordered = sorted(messages, key=lambda r: r[2], reverse=True)
    for i in range(4):
        spark.createDataFrame(ordered[i::4][: len(ordered)], schema).coalesce(1).write.mode(
            "append").parquet(str(folder / "mixed"))
    counts = rules.quota_windows(streams.files(spark, str(folder / "mixed"), schema), "key", "ts", 3)
    streams.write_batches(counts, str(folder / "lq"), str(folder / "lqcp"), "update").awaitTermination()
    rows = streams.latest_updates(spark.read.parquet(str(folder / "lq")), ["key", "minute"])
    assert sum(r["requests"] for r in rows.collect()) == len(messages)
    ended = rules.first_terminal(streams.files(spark, str(folder / "mixed"), schema), "key", ["ts", "id"])
    streams.write_batches(ended, str(folder / "ft"), str(folder / "ftcp"), "update").awaitTermination()
    # the first files hold the latest messages: the earliest one wins all the same
    first = {}
    for number, key, moment in sorted(messages, key=lambda m: (m[2], m[0])):
        first.setdefault(key, number)
    last = streams.latest_updates(spark.read.parquet(str(folder / "ft")), ["key"]).collect()
    assert {r["key"]: r["id"] for r in last} == first


def test_stream_dead_letters(spark, folder):
    source = streams.files(spark, str(folder / "in"), "id long, key string, ts timestamp")
    streams.split_batches(rules.failure_counts(source, "key", 200), "outcome",
                          str(folder / "d"), str(folder / "dcp")).awaitTermination()
    rows = spark.read.parquet(str(folder / "d"))
    assert {r["key"] for r in rows.filter("outcome = 'dead_letter'").collect()} == {"hot"}


def test_stream_ingest_is_idempotent_over_batches(spark, tmp_path):
    rows = [(1, "d1", "commit_diff", "Add kafka consumer"), (2, "d1", "pr_review", "Fix rust deadlock")]
    cols = "arrival int, developer_id string, source_type string, raw_content string"
    full = cols + ", artifact_date timestamp, artifact_id int"
    for part in ([rows[0]], [rows[1], (3, "d2", "commit_diff", "Add kafka consumer")]):
        spark.createDataFrame(part, cols).withColumns({
            "artifact_date": F.lit(None).cast("timestamp"), "artifact_id": F.col("arrival"),
        }).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.files(spark, str(tmp_path / "in"), full, "*.parquet")
        streams.ingest_evidence(source, str(tmp_path / "s"), str(tmp_path / "cp"),
                                F.lit(START)).awaitTermination()
    got = {(r["developer_id"], r["skill_name"]): r["evidence_count"]
           for r in streams.skill_records(spark, str(tmp_path / "s")).collect()}
    assert got == {("d1", "kafka"): 1, ("d1", "rust"): 1, ("d1", "concurrency"): 1}


def test_ingest_reads_only_the_folders_of_its_hashes(spark, tmp_path):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    stored = rows.withColumns({"prefix": streams.hash_prefix(), "batch_id": F.lit(0)})
    stored.write.partitionBy("prefix", "batch_id").parquet(str(tmp_path / "h"))
    batch = rows.filter("content_hash < '03'").limit(9)
    known = streams.known_hashes(spark, str(tmp_path / "h"), batch, 1)
    assert batch.join(known, "content_hash", "left_anti").count() == 0
    found = known.collect()
    scan = known._jdf.queryExecution().executedPlan().collectLeaves().head()
    prefixes = {r["content_hash"][:2] for r in batch.collect()}
    assert {r["prefix"] for r in found} == prefixes and len(found) < 100
    assert scan.metrics().get("numPartitions").get().value() == len(prefixes)
    assert streams.known_hashes(spark, str(tmp_path / "h"), batch, 0).count() == 0


# --- sources and sinks ----------------------------------------------------------------


def test_json_lines(spark, tmp_path):
    good = json.dumps(profile(1))
    other = json.dumps({**{k: v for k, v in profile(2).items() if k != "signals"},
                        "my_signals": profile(2)["signals"]})
    path = tmp_path / "c.jsonl"
    path.write_text(good + "\n\n{broken\n")
    counts = candidates.scan_quality(spark, str(path)).first()
    assert (counts["parsed"], counts["malformed"], counts["lines"]) == (1, 1, 2)
    assert candidates.count_lines(spark, str(path)) == 3
    assert candidates.read_candidates(spark, str(path)).count() == 1
    assert candidates.malformed_lines(spark, str(path)).first()[0] == "{broken"
    (tmp_path / "o.jsonl").write_text(other)
    row = candidates.read_candidates(spark, str(tmp_path / "o.jsonl"), "my_signals").first()
    assert row["signals"]["notice_period_days"] == 45.0


def test_rerank_text_of_a_sparse_profile(candidates_of):
    bare = {**profile(3, roles=[], skills=[]), "career_history": None, "skills": None}
    got = candidates_of(bare).select(candidates.rerank_text().alias("t"), candidates.corpus_text().alias("c")).first()
    assert got["t"].startswith("Search Engineer") and "Builds search." in got["c"]


def test_freshness_and_contract(spark, tmp_path):
    df = spark.range(10).withColumn("candidate_id", F.col("id").cast("string"))
    key, path = sinks.stage_key("a", 1), str(tmp_path / "m")
    assert key != sinks.stage_key(1, "a")
    assert not sinks.is_fresh(spark, path, key)
    sinks.write_manifest(df, path, key)
    assert sinks.is_fresh(spark, path, key) and not sinks.is_fresh(spark, path, "other")
    a, b = sinks.fingerprint(df).first(), sinks.fingerprint(df.repartition(7)).first()
    assert a == b and sinks.fingerprint(df.limit(9)).first() != a
    with pytest.raises(sinks.ContractError):
        sinks.check_matrix(df)


def test_job_spec_round_trip(spark, tmp_path):
    spec = {"hard_gates": [{"description": "x", "feature_key": "is_honeypot", "operator": "bool", "value": True}],
            "weighted_requirements": [{"description": "y", "weight": 0.9, "skill_tags": ["a", "b"]}]}
    df = spark.createDataFrame([(1, json.dumps(spec))], "jd_id int, spec string")
    parsed = jobspec.parse_job_specs(df)
    jobspec.save_job_specs(parsed, str(tmp_path / "s"))
    row = jobspec.load_job_specs(spark, str(tmp_path / "s")).first()["job_spec"]
    assert row["source"] == "fallback" and row["latent_requirements"] == []
    assert jobspec.requirements(parsed, "jd_id").count() == 2
    assert jobspec.spec_gates(parsed, "jd_id").first()["feature_key"] == "is_honeypot"


def test_event_table_as_a_file_or_a_folder(spark, tmp_path):
    """The same table as one file and as a folder of parts."""
    from laurel.catalog import streams as registered

    rows = [(i, dt.datetime(2024, 1, 1 + i % 3), i % 7, "error", 1.0, "{}") for i in range(200)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    table = spark.createDataFrame(rows, kind)
    (tmp_path / "folder").mkdir()
    table.repartition(3).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    (tmp_path / "file").mkdir()
    table.toPandas().to_parquet(tmp_path / "file" / "events.parquet", coerce_timestamps="us")
    counts = [sorted(map(tuple, registered.stream_dead_letters(spark, str(tmp_path / k)).collect()))
              for k in ("folder", "file")]
    assert counts[0] == counts[1] and sum(r[1] for r in counts[0]) == 200


def test_stream_first_sightings_out_of_order(spark, messages, accepted, tmp_path):
    """The latest messages come in the first file; the registered query reads them all."""
    from laurel.catalog import all_queries

    ordered = sorted(messages, key=lambda r: (r[2], r[0]), reverse=True)
    size = -(-len(ordered) // 4)
    for i in range(4):
        rows = [(number, key, moment) for number, key, moment in ordered[i * size:(i + 1) * size]]
        spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp").coalesce(
            1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = all_queries()["stream_first_sightings"](spark, str(tmp_path))
    assert {r["event_id"] for r in out.collect()} == accepted
