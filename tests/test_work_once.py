"""Steps that are costly per row are done once per row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laurel import vocab
from laurel.functions.text import contains_any
from laurel.operators import features, ranking, retrieval, scoring, textindex


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def docs(spark):
    rows = [(i, f"alpha beta w{i % 7} w{i % 3}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_token_is_hashed_once(docs):
    buckets = retrieval.token_buckets(F.col("text"), code="md5")
    assert plan(docs.select(buckets.alias("b"))).count("md5(") == 1
    assert plan(textindex.folded(docs, "doc_id", "text", "md5")).count("md5(") == 1


def test_vectors_are_compared_once(spark, docs, monkeypatch):
    seen = []
    whole = retrieval.fuse_scores
    monkeypatch.setattr(retrieval, "fuse_scores", lambda lists, *a: seen.extend(lists) or whole(lists, *a))
    asked = spark.createDataFrame([(1, "alpha w3")], "qid long, question string")
    found = retrieval.retrieval_scores(docs, asked, "doc_id", "text", "qid", "question").collect()
    assert len(found) == 60
    # a sort by ranges runs its input twice
    assert not any("MapInArrow" in plan(df) for df in seen)


def test_ranks_read_only_what_is_asked(docs):
    ranked = ranking.rank_positions(docs.withColumn("score", F.col("doc_id") * 1.0), "score", "doc_id")
    physical = ranked.select("doc_id", "rank")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in physical
    assert not any("text" in line for line in physical.splitlines() if "ReadSchema" in line)
    assert {(r.doc_id, r["rank"]) for r in ranked.collect()} == {(i, 59 - i) for i in range(60)}


def test_a_role_is_lowered_once():
    # its title and its company
    assert str(features._typed_roles()).count("lower(") == 2


def test_tiers_read_the_stored_relevance(spark, monkeypatch):
    seen = []
    whole = scoring.exact_quantiles
    monkeypatch.setattr(scoring, "exact_quantiles", lambda df, *a: seen.append(df) or whole(df, *a))
    names = ("jd_fit_score", "retrieval_skill_count", "assessment_mean_score", "has_production_keywords",
             "product_company_ratio", "behavioural_composite")
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("candidate_id"), F.lit(0.0).alias("is_honeypot"),
        *[(F.col("id") / 40.0).alias(n) for n in names])
    tiers = {r.candidate_id: r.tier for r in scoring.graded_labels(rows).collect()}
    assert tiers["39"] == 5 and tiers["0"] == 0 and len(tiers) == 40
    assert seen[0].columns == ["candidate_id", "relevance"]


def test_contained_tokens(spark):
    tokens = (*vocab.CONSULTING_FIRMS, "sr.", "sr ", "a/b", "c++", "]x", "^y", "-z", "[q", "&&", "a")
    texts = ["", "x", "sr", "the sr. one", "sr one", "b c++ d", "c+", "]x", "q]", "^y", "y", "-z", "[q", "&&",
             "&", "infosys ltd", "tata consultancy", "line\nsr. two", "tcs", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for some in (tokens, tokens[-9:-1], ("sr.",), ("ab", "abc", "b")):
        got = [r[0] for r in df.select(contains_any(F.col("t"), some)).collect()]
        assert got == [None if x is None else any(s in x for s in some) for x in texts]
