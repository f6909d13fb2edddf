"""BM25 and hashed cosine where the documents are: no row moves, and shared ids still count once."""

from __future__ import annotations

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laurel.functions.text import tokenize
from laurel.operators import ranking, retrieval

TEXTS = [
    (1, "tin whistle and tin drum"), (2, "drum"), (3, None), (4, ""),
    (5, "Whistle over the harbour, whistle!"), (6, "harbour lights"),
]
ASKED = [(70, "tin whistle"), (71, "harbour drum drum"), (72, "absent"), (None, "tin"), (73, None)]
SCHEMA = "qid long, question string"


def expected(rows, asked, k1=1.5, b=0.75):
    """Rows of one id and length are one document for the counts, rows of one id one for the sum."""
    words = lambda t: [w.strip(",!") for w in (t or "").lower().split()]
    docs = [(i, words(t), t is not None) for i, t in rows]
    n = len(docs)
    avgdl = sum(len(w) for _, w, _ in docs) / sum(k for *_, k in docs)
    merged = {}
    for i, w, _ in docs:
        merged.setdefault((i, len(w)), []).extend(w)
    out = {}
    for q, text in asked:
        for term in set(words(text)) if q is not None else ():
            df = sum(term in w for _, w, _ in docs)
            for (i, length), w in merged.items():
                tf = w.count(term)
                if tf:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    gain = idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / avgdl))
                    out[q, i] = out.get((q, i), 0.0) + gain
    return out


def scores(spark, rows, asked=ASKED):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame(asked, SCHEMA)
    return retrieval.bm25_scores(docs, queries, "doc_id", "text", "qid", "question")


def test_no_document_is_shuffled(spark):
    plan = scores(spark, TEXTS)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("extra", [
    [], [(1, "tin whistle and tin drum"), (5, "harbour")], [(None, "tin"), (None, "tin drum")],
])
def test_scores(spark, extra):
    found = scores(spark, TEXTS + extra).collect()
    got = {(r.qid, r.doc_id): r.score for r in found}
    assert len(found) == len(got)
    assert got == pytest.approx(expected(TEXTS + extra, ASKED), abs=1e-9)


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHIPPED", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    asked = [(q, " ".join(["tin", "drum", "whistle", "harbour"][q % 4:])) for q in range(9)]
    got = {(r.qid, r.doc_id): r.score for r in scores(spark, TEXTS, asked).collect()}
    assert got == pytest.approx(expected(TEXTS, asked), abs=1e-9)


@pytest.mark.parametrize("code", ["crc32", "md5"])
def test_tokens_of_a_batch_give_the_vectors(spark, code):
    docs = spark.createDataFrame([*TEXTS, (7, "Straße naïve c++ a/b")], "doc_id long, text string")
    rows = docs.select("doc_id", tokenize(F.col("text")).alias("tokens")).collect()
    want = {r.doc_id: r.vector for r in
            retrieval.hashed_vectors(docs, "doc_id", "text", 48, code).collect()}
    lists = pa.array([r.tokens for r in rows], pa.list_(pa.string()))
    for r, vector in zip(rows, retrieval._token_vectors(lists, 48, code), strict=True):
        assert list(vector) == pytest.approx(list(want[r.doc_id]))


def test_only_ids_and_places_are_written_for_ranks(spark, monkeypatch):
    written = []
    whole = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, name: written.append(df.columns) or whole(df, name))
    lists = [spark.createDataFrame([(1, i, s + i % 3) for i in range(9)], "qid long, id long, score double")
             for s in (0.0, 1.0)]
    got = {r.id: r.credit for r in ranking.fuse_scores(lists, "id", "qid").collect()}
    assert written == [["qid", "id", "_at"]] * 2
    want = {}
    for s in (0.0, 1.0):
        best = sorted((-(s + i % 3), i) for i in range(9) if s + i % 3 > 0)
        for rank, (_, i) in enumerate(best, 1):
            want[i] = want.get(i, 0.0) + 1 / (60 + rank)
    assert got == pytest.approx(want)


def many_rows():
    """Two in three rows share an id or have none; the words of an id go on over batches."""
    words = ["tin", "drum", "whistle", "harbour", "tin drum tin", "lights"]
    return [(None if i % 11 == 0 else i % 7 if i % 3 else 1000 + i,
             " ".join(words[(i + j) % 6] for j in range(i % 4 + 1))) for i in range(400)]


@pytest.mark.parametrize("shared", [0, 3, 100_000])
def test_rows_of_one_id_are_added_up_over_batches(spark, monkeypatch, shared):
    monkeypatch.setattr(retrieval, "SHARED_IDS", shared)
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = scores(spark, many_rows()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.qid, r.doc_id): r.score for r in found}
    assert len(found) == len(got)
    assert got == pytest.approx(expected(many_rows(), ASKED), abs=1e-9)


def test_no_tokens_move_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARED_IDS", 0)
    plan = scores(spark, many_rows())._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and plan.index("Exchange") < plan.index("tokens")
    assert "Join" not in plan
