from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laurel.llm import queries, statements, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            name = "" if doc_id is None else doc_id
            h = zlib.crc32(f"{name}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_brute(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    return near


def brute(words):
    near = near_brute(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=3, max_size=4), min_size=1, max_size=40),
       st.sets(st.text("abé", min_size=4, max_size=4), max_size=40), st.integers(1, 6))
def test_composition_accepts_each_pair_once(shorter, longer, most):
    shorter = {w for w in shorter if len(w) == 3} or {"aba"}
    acceptor = variants.Acceptor()
    start = [acceptor.state(sorted(s)) if s else None for s in (shorter, longer)]
    got = [(a, b) for a, b, _ in acceptor.pairs(*start, most)]

    def before(a, b):
        """Where they first differ, counted from 0."""
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a)) < most

    pairs = [(a, b) for a in shorter for b in shorter if a < b and one_edit(a, b)]
    pairs += [(a, b) for a in shorter for b in longer if one_edit(a, b)]
    assert sorted(tuple(sorted(p, key=lambda w: (len(w), w))) for p in got) == sorted(
        p for p in pairs if before(*p))


def test_acceptor_is_minimal():
    acceptor = variants.Acceptor()
    acceptor.state(sorted(x + y for x in ("ab", "cd", "xy") for y in ("ion", "ous")))
    # two ways on from the first letter, ten states in all: no two accept the same words
    assert len(acceptor.arcs) == 10
    assert acceptor.sizes[-1] == 6


WORDS = "word string, n long"


def dense(seed, n, letters="abcé", low=7, high=10):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    for w in list(words)[: n // 3]:
        at = rng.randrange(len(w))
        words.add(w[:at] + w[at + 1:] if len(w) > low else w[:at] + "b" + w[at:])
    return {w: rng.choice([2, 3, 20, 30, 400, 5000]) for w in words}


@pytest.mark.parametrize("most", [3, 20, 20_000])
def test_near_words_against_brute_force(spark, most):
    words = dense(most, 350) | dense(most, 60, "ab", 7, 8)
    got = variants.near_words(spark.createDataFrame(list(words.items()), WORDS), most).collect()
    near = near_brute(words)
    assert {r.word: r.n_near for r in got} == {w: len(near[w]) for w in words}
    for r in got:
        best = min(near[r.word], key=lambda x: (-words[x], x), default=None)
        assert (r.near, r.best) == (best, words.get(best))


def test_hot_groups_are_split(spark):
    # all words share their first five letters, and all their last five
    words = {f"qqqqq{a}{b}{c}zzzzz": 2 for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    df = spark.createDataFrame(list(words.items()), WORDS)
    groups = variants.bounded_groups(df, 12)
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 12
    got = variants.near_words(df, 12).collect()
    assert {r.n_near for r in got} == {15} and len(got) == 216


def test_query_and_sql(spark, documents, tmp_path):
    rng = random.Random(4)
    vocabulary = list(dense(8, 120)) + ["Straße", "ÉCOLIERS", "École", "naïvement"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)) + rng.choice([" x1y", "×÷ÿ", "\n"]))
            for i in range(80)]
    rows += [(500, None), (501, ""), (None, " ".join(vocabulary)), (502, "longestword" * 3000)]
    # one frequent word, its rare and rarer spellings
    rows += [(600 + i, "Thousand thousand thousand-THOUSAND " * 40) for i in range(20)]
    rows += [(700 + i, "thousnd thousnd thosnd") for i in range(60)]
    rows += [(i, "international") for i in range(3)] * 2
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    want = brute(counts(rows))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r[1] and r[2] != r[1] for r in want) or any(r[1] for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(key, con.execute(statements.VARIANTS).fetchall())) == sorted(map(key, want))


def test_roots_of_long_ways(spark):
    rows = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)] + [("x", "w05"), ("y", "z")]
    got = dict(map(tuple, variants.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {f"w{i:02d}": "w13" for i in range(13)} | {"x": "w13", "y": "z"}


def test_edges(spark, documents):
    assert variants.variant_forms(documents([])).count() == 0
    extra = documents([(1, "sevenly sevenly"), (1, "sevenly sevenly"), (None, None)]).selectExpr(
        "*", "1 AS word", "2 AS n", "3 AS g", "4 AS _id", "5 AS _run"
    )
    rows = variants.variant_forms(extra).collect()
    assert sorted(tuple(r) for r in rows) == brute(counts([(1, "sevenly sevenly")] * 2))
