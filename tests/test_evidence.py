from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from laurel.functions import text as X
from laurel.operators import evidence
from laurel.sources import artifacts

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def confidences(spark, rows, **options):
    df = spark.createDataFrame(
        rows, "developer_id string, skill_name string, source_type string, complexity int, artifact_date timestamp")
    return {r["developer_id"]: r["confidence"]
            for r in evidence.confidence_by_skill(df, F.lit(NOW), **options).collect()}


def test_confidence(spark):
    rows = [("ten", " Kubernetes", "commit_diff", 5, NOW)] * 10
    rows += [("claim", "kubernetes", "resume_claim", 3, NOW), ("odd", "go", "letter", 9, NOW),
             ("old", "go", "commit_diff", 5, NOW - dt.timedelta(days=730)),
             ("future", "go", "commit_diff", 5, NOW + dt.timedelta(days=9)),
             ("undated", "go", "commit_diff", 5, None)]
    got = confidences(spark, rows)
    assert got["ten"] == pytest.approx(1.0)
    assert got["claim"] == pytest.approx(0.2 * 0.6 / 10)
    assert got["old"] == pytest.approx(0.1 / 4)
    assert got["future"] == got["undated"] == pytest.approx(0.1)
    assert got["odd"] == pytest.approx(0.02)
    assert confidences(spark, rows, normaliser=1.0)["old"] == pytest.approx(0.25)


def test_merge_caps_and_moves_last_seen_forward(spark):
    cols = "developer_id string, skill_name string, confidence double, evidence_count long, last_seen timestamp"
    old = spark.createDataFrame([("d", "rust", 0.7, 3, NOW)], cols)
    new = spark.createDataFrame([("d", "rust", 0.6, 2, NOW - dt.timedelta(days=3)), ("d", "faiss", 0.1, 1, NOW)], cols)
    got = {r["skill_name"]: r for r in evidence.merge_skill_records(old, new).collect()}
    assert got["rust"]["confidence"] == 1.0 and got["rust"]["evidence_count"] == 5
    assert got["rust"]["last_seen"] == NOW.replace(tzinfo=None) and got["faiss"]["category"] == "retrieval"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "canonical"), [
    ("k8s", "kubernetes"), ("postgres", "postgresql"), ("  RAG ", "rag"), ("gardening", None),
    ("ir basics", "information retrieval"), ("PyTorch lightning", "python"),
])
def test_canonical(spark, name, canonical):
    assert one(spark, name, X.canonical_skill) == canonical


def test_extract_skills(spark):
    got = one(spark, "Built a service in Go using Kubernetes and Postgres", X.extract_skills)
    assert got == ["go", "kubernetes", "postgresql"]
    assert one(spark, "An essential step", X.extract_skills) == ["elasticsearch"]
    assert one(spark, "An essential step", lambda c: X.extract_skills(c, True)) == []


@pytest.mark.parametrize(("raw", "expected"), [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('Here you are: {"a": {"b": 2}} bye', '{"a": {"b": 2}}'), ("no object", None),
    ("{broken", None), ('```\n{"a": 1}\n```', '{"a": 1}'),
])
def test_json_object(spark, raw, expected):
    got = one(spark, raw, X.json_object)
    assert (got and json.loads(got)) == (expected and json.loads(expected))


def summaries(spark, *rows):
    df = spark.createDataFrame(list(rows), "source_type string, raw_content string")
    return [r for r in evidence.with_summary(df).collect()]


def test_summaries(spark):
    hard, trivial, empty, review, long = summaries(
        spark,
        ("commit_diff", "Fix race condition causing deadlock in the distributed scheduler under load in production"),
        ("commit_diff", "Fix a typo in the README"),
        ("issue_thread", "   \n "),
        ("so_answer", "please approve this lgtm"),
        ("commit_diff", "Add a thing\n" + "x" * 9000 + " kafka"),
    )
    assert hard["complexity"] == 5 and hard["production_signal"] and hard["category"] == "debugging"
    assert "concurrency" in hard["skills"] and not hard["collaboration_signal"]
    assert trivial["complexity"] == 1 and not trivial["production_signal"]
    assert empty["summary"] == "issue thread with no description" and empty["collaboration_signal"]
    assert review["category"] == "review" and review["collaboration_signal"]
    assert long["summary"] == "Add a thing" and long["complexity"] == 3
    assert "kafka" in long["skills"] and long["raw_chars"] == 9018


def test_new_artifacts_keep_the_first_arrival(spark):
    rows = [("h1", "d2", 2), ("h1", "d1", 1), ("h2", "d1", 3), ("h3", "d9", 4)]
    df = spark.createDataFrame(rows, "content_hash string, developer_id string, arrival int")
    stored = spark.createDataFrame([("h3",)], "content_hash string")
    got = {(r["content_hash"], r["developer_id"]) for r in evidence.new_artifacts(df, stored).collect()}
    assert got == {("h1", "d1"), ("h2", "d1")}


EXPORT = {"user": {"login": "octo", "repositories": {"nodes": [
    {"name": "infra",
     "defaultBranchRef": {"target": {"history": {"nodes": [
         {"oid": "abc", "message": "fix deadlock", "additions": 40, "deletions": 5,
          "committedDate": "2026-01-01T00:00:00Z", "url": "u"}]}}},
     "pullRequests": {"nodes": [
         {"title": "Add retrieval", "body": "vector search", "state": "MERGED",
          "createdAt": "2026-02-01T00:00:00Z", "mergedAt": None, "url": "p",
          "reviews": {"nodes": [{"body": "lgtm"}]}}]},
     "issues": {"nodes": [{"title": "", "body": None, "url": "i"}]}},
    {"name": "empty"}]}}}


def test_export(spark, tmp_path):
    (tmp_path / "octo.json").write_text(json.dumps(EXPORT, indent=1))
    (tmp_path / "none.json").write_text(json.dumps({"user": None}))
    got = {r["source_type"]: r for r in artifacts.flatten_export(
        artifacts.read_export(spark, str(tmp_path))).collect()}
    assert set(got) == {"commit_diff", "pr_review"}  # the blank issue is skipped
    assert got["commit_diff"]["raw_content"] == "fix deadlock\n(+40 -5 in infra)"
    assert got["pr_review"]["raw_content"] == "Add retrieval\nvector search\nlgtm"
    assert got["commit_diff"]["artifact_date"] == dt.datetime(2026, 1, 1)
    later = artifacts.since(artifacts.flatten_export(artifacts.read_export(spark, str(tmp_path))),
                            F.lit("2026-01-15").cast("timestamp"))
    assert [r["source_type"] for r in later.collect()] == ["pr_review"]


def test_resumes(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" Ten years of Kafka\nand rust ")
    row = artifacts.read_resumes(spark, str(tmp_path)).first()
    assert row["skills"] == ["kafka", "rust"] and row["char_count"] == 29
    claims = artifacts.resume_claims(artifacts.read_resumes(spark, str(tmp_path)))
    assert {r["skill_name"] for r in claims.collect()} == {"kafka", "rust"}


def test_developer_upsert(spark):
    cols = "github_username string, display_name string, avatar_url string"
    old = spark.createDataFrame([("a", "Ann", "x"), ("b", "Bo", None)], cols)
    new = spark.createDataFrame([("a", "", "y"), ("c", "Cy", None)], cols)
    got = {r["github_username"]: (r["display_name"], r["avatar_url"])
           for r in evidence.upsert_developers(old, new).collect()}
    assert got == {"a": ("Ann", "y"), "b": ("Bo", None), "c": ("Cy", None)}
