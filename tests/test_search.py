"""Evidence search on a small graph with known answers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from laurel.operators import graph, metrics, retrieval

NOW = dt.datetime(2026, 1, 1)
WORK = {
    "dev_cluster": ("kubernetes", ["Ran kubernetes clusters and wrote charts for rollouts",
                                   "Moved workloads to kubernetes with no downtime"]),
    "dev_stream": ("kafka", ["Wrote a streaming consumer for telemetry events",
                             "Scaled the streaming path to a firehose of telemetry"]),
    "dev_lockfree": ("rust", ["Lock-free concurrent allocator for low latency",
                              "Cut tail latency with a lock-free ring buffer"]),
    "dev_tables": ("postgresql", ["Tuned query plans and partitioned a huge table",
                                  "Rewrote slow joins with covering indexes"]),
}
GOLD = {"kubernetes": "dev_cluster", "rust": "dev_lockfree", "postgresql": "dev_tables",
        "telemetry event streaming": "dev_stream",
        "lock-free low latency allocator": "dev_lockfree"}


@pytest.fixture(scope="module")
def small(spark):
    arts, links, edges, number = [], [], [], 0
    for dev, (skill, lines) in WORK.items():
        for line in lines:
            arts.append((number, dev, "commit_diff", 4, NOW, True, line))
            links.append((number, skill))
            number += 1
        edges.append((dev, skill, 0.6, 2, NOW))
    return graph.EvidenceGraph(
        spark.createDataFrame([(d, d, None) for d in WORK], "developer_id string, github_username string, display_name string"),
        spark.createDataFrame(arts, "artifact_id long, developer_id string, source_type string, complexity int, artifact_date timestamp, production_signal boolean, summary string"),
        spark.createDataFrame(links, "artifact_id long, skill_name string"),
        spark.createDataFrame(edges, "developer_id string, skill_name string, confidence double, evidence_count long, last_seen timestamp"),
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(GOLD)), "query_id int, text string")


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(list(enumerate(GOLD.values())), "query_id int, developer_id string")


def test_hybrid_recalls_paraphrases(small, queries, gold):
    both = graph.search(small, queries)
    plain = graph.search(small, queries, hybrid=False)
    a = metrics.retrieval_metrics(plain, gold).first()
    b = metrics.retrieval_metrics(both, gold).first()
    assert b["recall_5"] == 1.0 and a["recall_5"] == 0.6 and b["mrr"] >= a["mrr"]
    rows = {(r["query_id"], r["rank"]): r for r in both.collect()}
    assert rows[0, 1]["developer_id"] == "dev_cluster" and rows[0, 1]["match_via"] == "both"
    assert rows[0, 1]["evidence"] and rows[0, 1]["confidence"] == 0.6
    assert not any(r["query_id"] == 3 for r in plain.collect())


def test_traversals(spark, small):
    skills = spark.createDataFrame([("rust",), ("kafka",)], "skill_name string")
    found = {r["skill_name"]: r for r in graph.find_by_skill(small, skills, 0.5).collect()}
    assert found["rust"]["developer_id"] == "dev_lockfree" and found["rust"]["evidence"] == [4, 5]
    assert graph.find_by_skill(small, skills, 0.9).count() == 0
    hard = graph.find_production_debuggers(small, skills).collect()
    assert {r["developer_id"] for r in hard} == {"dev_stream", "dev_lockfree"}
    assert graph.find_production_debuggers(small, skills, min_complexity=5).count() == 0


def test_intents(spark):
    texts = ["who debugged a race condition in production", "python developer", "gardening",
             "somebody for race condition hunts"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = {r["query_id"]: r for r in graph.query_intent(df).collect()}
    assert got[0]["require_production"] and got[0]["min_complexity"] == 4
    assert got[0]["skill_names"] == got[3]["skill_names"] == ["concurrency"]
    assert got[1]["skill_names"] == ["python"] and got[1]["min_complexity"] == 1
    assert got[2]["skill_names"] == [] and not got[2]["require_production"]


def test_strict_query_relaxes_when_nothing_is_hard(spark, small):
    easy = graph.EvidenceGraph(small.developers, small.artifacts.withColumn(
        "complexity", small.artifacts.complexity - 2), small.demonstrates, small.edges)
    df = spark.createDataFrame([(1, "shipped rust to users")], "query_id int, text string")
    rows = graph.structured_rows(easy, graph.query_intent(df)).collect()
    assert [r["developer_id"] for r in rows] == ["dev_lockfree"]


def one_busy_developer(spark):
    """67 near artifacts of one developer, a little less near ones of three others."""
    arts = [(i, "busy", "commit_diff", 2, NOW, True, f"streaming telemetry events part {i % 3}") for i in range(67)]
    arts += [(100 + 10 * d + i, f"other{d}", "commit_diff", 2, NOW, True,
              f"streaming telemetry and {' '.join(['billing'] * (1 + i + d))}") for d in range(3) for i in range(5)]
    return spark.createDataFrame(arts, "artifact_id long, developer_id string, source_type string, complexity int, artifact_date timestamp, production_signal boolean, summary string")


def test_a_busy_developer_hides_nobody(spark):
    arts = one_busy_developer(spark).withColumn("skills", F.array().cast("array<string>"))
    ask = spark.createDataFrame([(1, "streaming telemetry events"), (2, "billing")], "query_id int, text string")
    got = graph.semantic_rows(arts.repartition(5), ask, developers=3).collect()
    first = {r["rank"]: r for r in got if r["query_id"] == 1}
    assert first[0]["developer_id"] == "busy" and len(first) == 3
    assert all(len(r["evidence"]) == 3 for r in got)
    # against all pairs
    pairs = retrieval.hashed_cosine(
        arts.withColumn("_doc", graph.evidence_text()), ask, "artifact_id", "_doc", "query_id", "text",
        keep=("developer_id",)).collect()
    for query in (1, 2):
        best = {}
        for r in sorted((p for p in pairs if p["query_id"] == query),
                        key=lambda p: (-round(p["score"], 9), p["artifact_id"])):
            best.setdefault(r["developer_id"], []).append((-round(r["score"], 9), r["artifact_id"]))
        order = sorted(best, key=lambda d: best[d][0])[:3]
        mine = {r["rank"]: r for r in got if r["query_id"] == query}
        assert [mine[i]["developer_id"] for i in range(3)] == order
        assert all(mine[i]["evidence"] == [a for _, a in best[d][:3]] for i, d in enumerate(order))


def test_query_blocks_give_the_same_answer(spark, small, queries, monkeypatch):
    key = lambda rows: sorted(map(str, rows.collect()))
    whole = key(graph.search(small, queries))
    monkeypatch.setattr(retrieval, "SHIPPED", 2)
    assert key(graph.search(small, queries)) == whole


def intent(spark, **changed):
    row = {"query_id": 1, "skill_names": ["rust"], "min_confidence": 0.5, "min_complexity": 1,
           "require_production": False, "limit": 10, **changed}
    return spark.createDataFrame([row], "query_id int, skill_names array<string>, min_confidence double, "
                                 "min_complexity int, require_production boolean, limit int")


def test_the_intents_own_bounds_hold(spark, small):
    trusted = graph.EvidenceGraph(small.developers, small.artifacts, small.demonstrates, spark.createDataFrame(
        [("dev_lockfree", "rust", 0.7, 2, NOW), ("dev_tables", "rust", 0.9, 1, NOW), ("dev_stream", "rust", 0.8, 1, NOW)],
        "developer_id string, skill_name string, confidence double, evidence_count long, last_seen timestamp"))
    found = lambda **x: [r["developer_id"] for r in sorted(
        graph.structured_rows(trusted, intent(spark, **x)).collect(), key=lambda r: r["rank"])]
    assert found() == ["dev_tables", "dev_stream", "dev_lockfree"]
    assert found(min_confidence=0.8) == ["dev_tables", "dev_stream"]
    assert found(limit=1) == ["dev_tables"]
    assert found(require_production=True) == ["dev_lockfree"]
    # nothing as hard as that: anybody with the skill
    assert found(min_complexity=5) == ["dev_tables", "dev_stream", "dev_lockfree"]


def test_answers_tell_names_hits_and_relaxation(spark, small):
    named = graph.EvidenceGraph(
        small.developers.withColumn("display_name", F.upper("developer_id")), small.artifacts,
        small.demonstrates, small.edges)
    ask = spark.createDataFrame([(1, "rust")], "query_id int, text string")
    rows = graph.search(named, ask, intents=intent(spark, min_complexity=5, limit=2)).collect()
    assert len(rows) == 2 and all(r["relaxed"] for r in rows)
    assert {(r["skill_hits"], r["semantic_hits"]) for r in rows} == {(1, 4)}
    best = min(rows, key=lambda r: r["rank"])
    assert (best["developer_id"], best["display_name"]) == ("dev_lockfree", "DEV_LOCKFREE")
    assert best["github_username"] == "dev_lockfree"


def test_subgraph_order(spark, small):
    who = spark.createDataFrame([("dev_lockfree",), ("nobody",)], "developer_id string")
    people, skills, arts = graph.developer_subgraph(small, who)
    assert [r["developer_id"] for r in people.collect()] == ["dev_lockfree"]
    assert [(r["skill_name"], r["position"]) for r in skills.collect()] == [("rust", 0)]
    assert sorted((r["position"], r["artifact_id"]) for r in arts.collect()) == [(0, 4), (1, 5)]
