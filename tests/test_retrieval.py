"""Retrieval against plain-Python brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from laurel.operators import ranking, retrieval

WORDS = "vector search rank python data graph model the of and c++ a/b node.js k8s go".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [texts[3]] * 25 + ["", "!!!"]  # a run of copies, and two without tokens
    texts.append("the of and " * 90 + "data c++")  # what is asked for stands after token 200
    return {i: t for i, t in enumerate(texts)}


QUERIES = {1: "Vector search, ranking and C++", 2: "python data data model", 3: "unseen words"}


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(list(QUERIES.items()), "qid long, question string")
    return docs, queries


def tokens(text):
    return re.findall(r"[a-z0-9+#./-]+", text.lower())


def brute_bm25(corpus):
    docs = {i: tokens(t) for i, t in corpus.items()}
    n = len(docs)
    avg = sum(map(len, docs.values())) / n
    df = {}
    for toks in docs.values():
        for w in set(toks):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in QUERIES.items():
        for i, toks in docs.items():
            s = 0.0
            for w in set(tokens(text)):
                f = toks.count(w)
                if f:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks) / avg))
            if s:
                out[q, i] = s
    return out


def brute_vector(text, dim=384):
    v = np.zeros(dim)
    for w in tokens(text):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if (h >> 20) & 1 else -1.0
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def brute_cosine(corpus):
    return {(q, i): float(brute_vector(t) @ brute_vector(text))
            for q, text in QUERIES.items() for i, t in corpus.items()}


def found(df):
    return {(r["qid"], r["doc_id"]): r["score"] for r in df.collect()}


def test_bm25(frames, corpus):
    docs, queries = frames
    got = found(retrieval.bm25_scores(docs, queries, "doc_id", "text", "qid", "question"))
    assert got == pytest.approx(brute_bm25(corpus))


def test_hashed_vectors(frames, corpus):
    docs, _ = frames
    for r in retrieval.hashed_vectors(docs, "doc_id", "text").collect():
        assert np.allclose(r["vector"], brute_vector(corpus[r["doc_id"]]))


def test_hashed_cosine(frames, corpus):
    docs, queries = frames
    got = found(retrieval.hashed_cosine(docs, queries, "doc_id", "text", "qid", "question"))
    want = {k: x for k, x in brute_cosine(corpus).items() if abs(x) > 1e-12}
    assert {k: x for k, x in got.items() if abs(x) > 1e-12} == pytest.approx(want)


def test_fusion_over_the_whole_pool(frames, corpus):
    docs, queries = frames
    expected = {}
    bm, cos = brute_bm25(corpus), brute_cosine(corpus)
    for q in QUERIES:
        credit = dict.fromkeys(corpus, 0.0)
        for scores in (bm, cos):
            mine = {i: round(scores.get((q, i), 0.0), 9) for i in corpus}
            for rank, i in enumerate(sorted(corpus, key=lambda i: (-mine[i], i))):
                if mine[i] > 0:
                    credit[i] += 1 / (61 + rank)
        lo, hi = min(credit.values()), max(credit.values())
        for i, x in credit.items():
            if x > lo:
                expected[q, i] = (x - lo) / (hi - lo)
    got = retrieval.retrieval_scores(docs, queries, "doc_id", "text", "qid", "question")
    got = found(got.filter("retrieval_score > 0").withColumnRenamed("retrieval_score", "score"))
    assert got == pytest.approx(expected)


def test_no_modality_left(frames):
    docs, queries = frames
    empty = retrieval.retrieval_scores(docs, queries, "doc_id", "text", "qid", "question",
                                       modalities=())
    assert empty.count() == 0


def test_more_queries_than_a_block(spark, frames, corpus):
    docs, _ = frames
    some = docs.filter("doc_id < 30")
    queries = spark.createDataFrame(
        [(i, f"{corpus[i % len(corpus)]} {i}") for i in range(11_000)], "qid long, question string"
    )
    best = found(retrieval.hashed_cosine(
        some, queries, "doc_id", "text", "qid", "question", k=2))
    every = retrieval.hashed_cosine(some, queries.filter("qid % 1000 = 7"), "doc_id", "text", "qid",
                                    "question")
    assert len(best) == 22_000
    want = {}
    for (q, i), x in found(every).items():
        want.setdefault(q, []).append((-retrieval_key(x), i))
    for q, scores in want.items():
        assert {i for _, i in sorted(scores)[:2]} == {i for p, i in best if p == q}
    scored = retrieval.bm25_scores(some, queries, "doc_id", "text", "qid", "question")
    assert scored.select("qid").distinct().count() > 10_000


def retrieval_key(x):
    return math.floor(x * 1e9 + 0.5)


def test_null_and_ragged_vectors(spark):
    kind = "id long, v array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, -2.0]),
                                  (5, [None, 1.0])], kind)
    queries = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "qid long, q array<double>")
    got = {(r.qid, r.id): r.score for r in retrieval.dense_cosine(
        rows, queries, "id", "v", "qid", "q").collect()}
    assert got == {(9, 1): 1.0}
    top = retrieval.dense_cosine(rows, queries, "id", "v", "qid", "q", k=3).collect()
    assert sorted((r.qid, r.id, r.score) for r in top) == [
        (8, 1, 0.0), (8, 2, 0.0), (8, 3, 0.0), (9, 1, 1.0), (9, 2, 0.0), (9, 3, 0.0)]


def test_lexical_head(spark):
    head = spark.createDataFrame(
        [(1, "match", "Built production LLM and RAG vector search ranking in Python."),
         (1, "noise", "Experienced retail store manager handling inventory."),
         (2, "only", "nothing in common")], "qid long, doc string, text string")
    queries = spark.createDataFrame(
        [(1, "senior engineer building production llm and rag vector search"), (2, "")],
        "qid long, question string")
    got = {(r["qid"], r["doc"]): r["score"] for r in retrieval.lexical_scores(
        head, queries, "doc", "text", "qid", "question").collect()}
    assert got == {(1, "match"): 1.0, (1, "noise"): 0.0, (2, "only"): 0.0}


@pytest.mark.parametrize("group", [None, "g"])
def test_global_rank_with_a_hot_tie(spark, group):
    rows = [(i, 1.0 if i % 3 else float(i % 7), "hot" if i % 3 else "cold") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double, g string").repartition(6)
    got = {r["id"]: r["rank"] for r in ranking.rank_positions(df, "score", "id", group).collect()}
    keys = {r[2] for r in rows} if group else {None}
    for k in keys:
        mine = sorted((r for r in rows if k is None or r[2] == k), key=lambda r: (-r[1], r[0]))
        assert [got[r[0]] for r in mine] == list(range(len(mine)))


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(501)] + [0.5] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 90, "x double").repartition(4)
    qs = [0.0, 0.5, 0.75, 0.9, 0.97, 1.0]
    got = {r["probability"]: r["value"] for r in ranking.exact_quantiles(df, "x", qs).collect()}
    assert got == pytest.approx({q: float(np.quantile(values, q)) for q in qs})


def test_classic_fusion(spark):
    lists = [["a", "b", "c"], ["c", "a"]]
    rows = [("q", i, x) for ranked in lists for i, x in enumerate(ranked)]
    df = spark.createDataFrame(rows, "q string, rank long, id string")
    got = {r["id"]: r["rrf_score"] for r in ranking.fuse_rankings(df, "id", "q").collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 62, "c": 1 / 63 + 1 / 61})


def test_top_k_without_group(spark):
    df = spark.range(100)
    got = [r["id"] for r in ranking.top_k(df, 5, [F.col("id").desc()]).orderBy("rank").collect()]
    assert got == [99, 98, 97, 96, 95]


def test_rank_of_very_many_groups(spark):
    df = spark.range(500).selectExpr("id", "id % 50 AS g", "cast(id AS double) AS score")
    got = {r["id"]: r["rank"] for r in ranking.rank_positions(df, "score", "id", "g").collect()}
    assert got == {i: 9 - i // 50 for i in range(500)}
