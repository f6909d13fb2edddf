"""What is small travels to what is large, and nothing is built that a query does not read."""

from __future__ import annotations

import datetime as dt

from conftest import profile
from laurel.catalog import profiles, rankings
from laurel.plans import build


def test_the_first_rows_are_replicated_not_the_matrix(spark, candidates_of):
    asked = spark.createDataFrame([(1, "vector search"), (2, "nlp")], "jd_id long, text string")
    scored = build.build_scored(candidates_of(*map(profile, (1, 2, 3))), asked, accuracy=False)
    top = build.explained_top(scored, 2)
    assert "strategy=broadcast" in top._jdf.queryExecution().analyzed().toString()
    assert sorted((r.jd_id, r["rank"]) for r in top.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_unknown_candidates_build_no_matrix(spark, tmp_path, monkeypatch):
    sf = str(tmp_path)
    day = dt.datetime(1998, 1, 2)
    spark.createDataFrame([(101, 7), (101, 7), (202, 9), (None, 3)], "o_orderkey long, o_custkey long").write.parquet(
        f"{sf}/orders.parquet")
    spark.createDataFrame([(101, 5, 6, 1, 2.0, day)], "l_orderkey long, l_partkey long, l_suppkey long, "
                          "l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "user_id long").write.parquet(f"{sf}/events.parquet")

    def refuse(*_):
        raise AssertionError("a stage was built")

    for module in (profiles, rankings):
        monkeypatch.setattr(module, "stored", refuse)
    found = rankings.unknown_candidates(spark, sf)
    assert "l_linenumber" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r[0] for r in found.collect()), key=str) == ["CAND_0000303", None]


def test_final_scores_are_stored_without_what_they_were_made_of(spark, monkeypatch):
    made = spark.createDataFrame([(1, "CAND_0000001", 0.0, 0.5, "x")],
                                 "jd_id long, candidate_id string, is_honeypot double, final_score double, more string")
    monkeypatch.setattr(rankings, "stored", lambda spark, sf, name, make: make())
    monkeypatch.setattr(rankings, "scored", lambda *_: made)
    monkeypatch.setattr(rankings, "heads", lambda *_: made)
    monkeypatch.setattr(rankings.build, "with_head_scores", lambda scored, heads: scored)
    monkeypatch.setattr(rankings.scoring, "with_final_score", lambda df: df)
    assert rankings.final(spark, "").columns == ["jd_id", "candidate_id", "is_honeypot", "final_score"]
