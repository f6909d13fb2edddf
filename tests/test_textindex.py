"""The stored index against full scoring of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from laurel.operators import ranking, retrieval, textindex

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed, common="the"):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 40)))) for i in range(n)]
    return [(i, f"{common} {text}" if i % 2 else text) for i, text in rows]


def pool(seed):
    """Random texts, a third of all rows the same text, empty, blank and null texts."""
    rows = texts(400, seed)
    rows += [(1000 + i, "w3 w5 w5 the w9") for i in range(210)]
    return rows + [(2000, None), (2001, ""), (2002, " , "), (2003, "w1 " * 3000)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(pool(1), "doc_id long, text string")
    stored = textindex.write_index(docs, "doc_id", "text", str(tmp_path_factory.mktemp("index")))
    # a null text is an empty one
    return docs.na.fill(""), stored


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "w3 w5 the"), (2, "the w17 w17 w44"), (3, "unknown words only"), (4, ""), (5, None),
            (6, "w59"), (7, "w3 w5 w9 the"), (8, " ".join(WORDS))]
    return spark.createDataFrame(rows, "qid long, question string")


@pytest.mark.parametrize("k", [3, 25])
def test_bm25_top_is_the_head_of_full_scoring(index, asked, k):
    docs, stored = index
    full = retrieval.bm25_scores(docs, asked, "doc_id", "text", "qid", "question")
    keyed = full.withColumn("key", ranking.score_key(F.col("score")))
    want = ranking.top_k(keyed, k, [F.desc("key"), F.col("doc_id")], "qid").collect()
    got = textindex.bm25_top(stored, asked, "qid", "question", k, first=2).collect()
    assert {(r.qid, r.rank): r.doc_id for r in want} == {(r.qid, r.rank): r.id for r in got}
    scores = {(r.qid, r.rank): r.score for r in want}
    assert all(abs(scores[r.qid, r.rank] - r.score) < 1e-9 for r in got)


def test_questions_of_thousands_of_terms(spark, tmp_path):
    # a filter that names them one after the other overflowed the planner's stack
    words = [f"v{i}" for i in range(4000)]
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = textindex.write_index(docs, "doc_id", "text", str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, " ".join(words))], "qid long, question string")
    full = retrieval.bm25_scores(docs, asked, "doc_id", "text", "qid", "question").collect()
    got = textindex.bm25_top(stored, asked, "qid", "question", 40).collect()
    assert {r.id for r in got} == set(range(40))
    scores = {r.doc_id: r.score for r in full}
    assert all(abs(scores[r.id] - r.score) < 1e-9 for r in got)


def test_buckets_below_the_reached_score_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BUCKET_DOCS", 8)
    rows = [(i, "rare rare rare rare" if i < 4 else "rare " + "x " * 200) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = textindex.write_index(docs, "doc_id", "text", str(tmp_path / "i"))
    opened = []
    plain = textindex.top_k

    def watch(df, k, order, group=None, name="rank"):
        if "d" not in df.columns and "score" in df.columns:
            opened.append(df.count())
        return plain(df, k, order, group, name)

    monkeypatch.setattr(textindex, "top_k", watch)
    ask = spark.createDataFrame([(1, "rare")], "qid long, question string")
    got = textindex.bm25_top(stored, ask, "qid", "question", 3, first=4).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [0, 1, 2]
    # scored: the first buckets, then the few whose bound reaches the third score
    assert max(opened) < 100


def test_only_the_folders_of_its_terms_are_read(index, spark):
    _, stored = index
    ask = spark.createDataFrame([(1, "w17 w44")], "qid long, question string")
    terms = textindex.asked_terms(stored, ask, "qid", "question")
    codes = {r.term for r in terms.collect()}
    read = textindex._of_terms(stored.blocks, terms)
    assert len(codes) == 2 and {r.term for r in read.collect()} == codes
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    files, rows = (scan.metrics().get(name).get().value() for name in ("numFiles", "numOutputRows"))
    folders = [c % textindex.SHARDS for c in codes]
    here = stored.blocks.filter(F.col("shard").isin(folders))
    assert files == here.select(F.input_file_name()).distinct().count() <= 2 * textindex.SPLITS
    assert rows <= here.count() < stored.blocks.count() / 4


def head(rows, k):
    keyed = rows.withColumn("key", ranking.score_key(F.col("retrieval_score")))
    best = ranking.top_k(keyed, k, [F.desc("key"), F.col("doc_id")], "qid").collect()
    return {(r.qid, r.rank): (r.doc_id, round(r.retrieval_score, 9)) for r in best}


@pytest.mark.parametrize("k", [2, 20])
def test_fused_top_is_the_head_of_the_fused_pool(index, asked, k, monkeypatch):
    docs, stored = index
    monkeypatch.setattr(textindex, "QUERY_BLOCK", 3)
    want = head(retrieval.retrieval_scores(
        docs, asked, "doc_id", "text", "qid", "question"), k)
    got = textindex.fused_top(stored, asked, "qid", "question", k).collect()
    assert {(r.qid, r.rank): (r.id, round(r.retrieval_score, 9)) for r in got} == want
    lists = {
        "bm25_rank": retrieval.bm25_scores(docs, asked, "doc_id", "text", "qid", "question"),
        "cosine_rank": retrieval.hashed_cosine(docs, asked, "doc_id", "text", "qid", "question"),
    }
    for name, scores in lists.items():
        ranks = ranking.rank_positions(
            scores.filter(ranking.score_key(F.col("score")) > 0), "score", "doc_id", "qid")
        place = {(r.qid, r.doc_id): r["rank"] + 1 for r in ranks.collect()}
        assert all(r[name] == place.get((r.qid, r.id)) for r in got)


def test_every_document_with_credit(spark, tmp_path):
    rows = [(f"d{i:03d}", f"all w{i % 7} w{i % 5}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    ask = spark.createDataFrame([(1, "all w1"), (2, "w2 w3")], "qid long, question string")
    stored = textindex.write_index(docs, "doc_id", "text", str(tmp_path / "i"))
    want = head(retrieval.retrieval_scores(docs, ask, "doc_id", "text", "qid", "question"), 10)
    got = textindex.fused_top(stored, ask, "qid", "question", 10).collect()
    assert {(r.qid, r.rank): (r.id, round(r.retrieval_score, 9)) for r in got} == want


def test_no_table_of_pairs(index, asked):
    """No plan of the fusion sorts by range or joins documents with queries."""
    _, stored = index
    plan = textindex.fused_top(stored, asked, "qid", "question", 5)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "w1")], "qid long, question string")
    stored = textindex.write_index(none, "doc_id", "text", str(tmp_path / "none"))
    assert textindex.bm25_top(stored, ask, "qid", "question").count() == 0
    assert textindex.fused_top(stored, ask, "qid", "question").count() == 0
    one = spark.createDataFrame([(7, "w1")], "doc_id long, text string")
    stored = textindex.write_index(one, "doc_id", "text", str(tmp_path / "one"))
    assert textindex.fused_top(stored, ask.limit(0), "qid", "question").count() == 0
    assert [r.id for r in textindex.fused_top(stored, ask, "qid", "question").collect()] == [7]


def test_only_blocks_move_in_a_search(spark, monkeypatch, tmp_path):
    """A document's pairs are added up where its bucket is; gains are not shuffled on their way there."""
    docs = spark.createDataFrame([(i, f"tin w{i % 5} w{i % 3} tin") for i in range(900)], "doc_id long, text string")
    monkeypatch.setattr(textindex, "BUCKET_DOCS", 50)
    index = textindex.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    assert index.blocks.agg(F.sum("n")).first()[0] == index.blocks.select(F.explode("docs")).count()
    asked = spark.createDataFrame([(q, f"w{q} tin") for q in range(6)], "qid long, question string")
    found = textindex.bm25_top(index, asked, "qid", "question", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("hashpartitioning(qid" in line and " id#" in line for line in moved)
    full = {(r.qid, r.doc_id): r.score for r in retrieval.bm25_scores(
        docs, asked, "doc_id", "text", "qid", "question").collect()}
    got = {(r.qid, r.id): r.score for r in found.collect()}
    assert len(got) == 30 and all(full[k] == pytest.approx(v, abs=1e-9) for k, v in got.items())
