from __future__ import annotations

import datetime as dt

import pytest

from laurel.catalog import profiles as P
from laurel.sources import tables as t


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three orders; one is there twice, one has no lines, some lines have no order."""
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        [(1, 3), (2, 25), (2, 67), (3, 9), (None, 4)], "o_orderkey long, o_custkey long"
    ).write.parquet(f"{root}/orders.parquet")
    day = dt.datetime(1997, 3, 1)
    spark.createDataFrame(
        [(1, 24, 5, 2, 7.0, day), (1, 48, 4, 1, 8.0, day), (1, 13, 2, 1, 9.0, day),
         (2, 17, 9, 1, 1.0, day), (2, 18, 1, None, 2.0, None), (9, 5, 5, 1, 3.0, day),
         (None, 6, 6, 1, 4.0, day)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz",
    ).write.parquet(f"{root}/lineitem.parquet")
    return root


@pytest.fixture
def unstored(monkeypatch):
    monkeypatch.setattr(P, "stored", lambda spark, sf, name, build: build())
    monkeypatch.setattr(P, "stored_or_derived", lambda spark, sf, name, build: build())


def test_lines_move_once_per_grouping(spark, tables):
    plan = t.candidates(spark, tables)._jdf.queryExecution().executedPlan().toString()
    # the orders, and the lines for roles and for skills
    assert plan.count("Exchange hashpartitioning") == 3


def test_candidates_keep_roles_and_skills_in_order(spark, tables):
    rows = t.candidates(spark, tables).collect()
    assert sorted(r.candidate_id or "" for r in rows) == [
        "", "CAND_0000001", "CAND_0000002", "CAND_0000002", "CAND_0000003"]
    one = next(r for r in rows if r.candidate_id == "CAND_0000001")
    assert [r.company for r in one.career_history] == ["Infosys", "Zomato"]
    # parts 24 and 48 are one skill, whose least part is 24
    assert [(s.name, s.endorsements) for s in one.skills] == [("NLP", 9.0), ("Vector Search", 15.0)]
    twice = [r for r in rows if r.candidate_id == "CAND_0000002"]
    assert [len(r.career_history) for r in twice] == [2, 2]
    assert all(not r.skills and not r.career_history for r in rows if r.candidate_id in (None, "CAND_0000003"))


def test_title_and_company_rules_store_nothing(spark, tables, monkeypatch):
    def stored(*_):
        raise AssertionError("a stage was asked for")

    monkeypatch.setattr(P, "stored", stored)
    assert sum(r["roles"] for r in P.title_rules(spark, tables).collect()) == 6
    assert sum(r["roles"] for r in P.consulting_rules(spark, tables).collect()) == 6


def test_texts_lie_beside_the_matrix(spark, tables, unstored):
    assert not {"corpus_text", "rerank_text"} & set(P.matrix(spark, tables).columns)
    assert not {"corpus_text", "rerank_text"} & set(P.profiles(spark, tables).columns)
    assert P.texts(spark, tables).columns == ["candidate_id", "corpus_text", "rerank_text"]
    assert P.texts(spark, tables).count() == 5
