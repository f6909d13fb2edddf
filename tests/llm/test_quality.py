from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from laurel.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else {
        g: n for g, n in __import__("collections").Counter(grams).items()}
    hit = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit), failed)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)],
                                 "doc_id long, quality int, toxic int")


def test_rules(spark, documents, corpus, labels):
    texts = corpus + [(500, "a#b $% <x>|&*\n\na#b\na#b"), (501, "a b c a b c a b c d")]
    got = {r.doc_id: r for r in quality.judge(documents(texts), labels).collect()}
    for i, text in texts:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == rules(text), i
        assert not (r.base_failed and r.kept)


def test_ratio_separates(spark, documents):
    good = [(i, " ".join(f"good{(i * 7 + j) % 40}" for j in range(60))) for i in range(60)]
    bad = [(100 + i, " ".join(f"BAD{(i * 7 + j) % 40}!!" for j in range(60))) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(documents(good + bad), labels).collect()}
    assert all(got[i].score > got[j].score for i, _ in good for j, _ in bad)
    assert all(not got[j].kept for j, _ in bad)


def test_edges(spark, documents, labels):
    assert quality.judge(documents([]), labels).count() == 0
    row = quality.judge(documents([(None, None)]), labels.limit(0)).first()
    assert row.n_words == 0 and row.base_failed and not row.kept and row.score == 0.0
    extra = documents([(1, "a b")] * 2).withColumn("quality", F.lit(3)).withColumn("b", F.lit(1))
    assert quality.judge(extra, labels).count() == 2
