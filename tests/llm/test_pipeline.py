from __future__ import annotations

import random
import re

import corpus_pipeline as cp
import pytest

from laurel.llm import mixing

from .test_mixing import expected_targets
from .test_packing import check_packed
from .test_pii import base
from .test_quality import rules
from .test_simhash import brute_components, plain_mark


@pytest.fixture(scope="module")
def folder(spark, corpus, documents, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows = [(i, t, f"s{i % 3}") for i, t in corpus]
    rows += [(600 + i, " ".join(f"v{(i * 31 + j * 7) % 500}" for j in range(80))
              + " mail me.x@host.org or 10.2.3.4 now", "s1") for i in range(40)]
    rows += [(700 + i, f"v{(i * 31) % 500} " + rows[-40 + i][1], "s2") for i in range(10)]
    rows += [(800, rows[-1][1], None), (801, None, None)]
    documents(rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(600, 640)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        result = stage(spark, docs, folder).cache()
        rows = result.collect()
        assert result.columns == columns, name
        ids = [r.doc_id for r in rows]
        if name == "quality_rules":
            assert all(not rules(r.text)[-1] for r in rows) and set(range(600, 640)) <= set(ids)
        elif name == "near_dedup":
            label = brute_components({i: plain_mark(r.text) for i, r in before.items()})
            assert sorted(ids) == sorted(i for i, first in label.items() if i == first)
        elif name == "personal_data":
            assert sorted(ids) == sorted(before)
            for r in rows:
                want, at = "", 0
                for start, kind, end in base(before[r.doc_id].text):
                    if start >= at:
                        want += before[r.doc_id].text[at:start] + f"[{['EMAIL', 'IP', 'CARD', 'PHONE'][kind]}]"
                    at = max(at, end)
                assert r.text == want + before[r.doc_id].text[at:] and r.n_chars == len(r.text)
        else:
            size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in before.items()}
            sources = {}
            for i, r in before.items():
                sources[r.source] = sources.get(r.source, 0) + size[i]
            for s, want in expected_targets(sources).items():
                got = sum(size[r.doc_id] for r in rows if r.source == s)
                assert abs(got - want) <= max(size.values())
            assert max(ids.count(i) for i in ids) <= 3
        if name != "mixing":
            before = {r.doc_id: r for r in rows}
            assert len(before) == len(rows)
        docs = result
    single = docs.dropDuplicates(["doc_id"])
    packed = cp.STAGES[-1][1](spark, single, folder).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in single.collect()], 2048)
    everything = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in everything) == docs.count()


def test_run(spark, folder):
    out = cp.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_extra_columns_and_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.selectExpr("*", "1 AS kept", "2 AS score", "3 AS spans", "4 AS fp", "5 AS copies", "6 AS _n")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, wide, folder).columns == wide.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert cp.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one(spark, documents, folder):
    text = lambda k: " ".join(f"w{(k * 997 + j * 61) % 5003}" for j in range(70))
    near = text(1) + "."  # other punctuation at one word: checked to be a near copy below
    mark = {t: plain_mark(t) for t in [*map(text, range(12)), near]}
    assert bin(mark[near] ^ mark[text(1)]).count("1") <= 3
    assert len(set(brute_components(dict(enumerate(mark[text(k)] for k in range(12)))).values())) == 12
    rows = [(1, text(1)), (None, near), (None, text(2)), (None, text(3)), (None, text(3)),
            (None, text(4)),              # null ids: a near copy, different texts, a repeated row
            (5, text(1)), (5, text(5)),   # one id: a near copy of 1 and a clean text
            (6, text(6)), (6, text(7)), (6, text(6)),
            (8, text(8)), (9, text(8)), (None, text(8))]
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (None, text(4)), (5, text(5)),
            (6, text(6)), (6, text(7)), (8, text(8))]
    order = lambda pairs: sorted(pairs, key=str)
    kept = cp.near_dedup(spark, documents(rows), folder)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(want)
    # the mix takes each of them by its own copies
    named = {r["_key"]: (r.doc_id, r.text) for r in cp._keyed(kept).drop("_row").collect()}
    copies = mixing.mix(cp._keyed(kept, "source").drop("_row"), keep=("_key",)).collect()
    expected = [named[r["_key"]] for r in copies for _ in range(r.copies)]
    mixed = cp.mix_sources(spark, kept, folder)
    assert order((r.doc_id, r.text) for r in mixed.collect()) == order(expected)
    assert {t for _, t in expected} == {t for _, t in want}


def test_rows_equal_but_for_other_columns(spark, documents, folder):
    text = " ".join(f"w{j * 61 % 503}" for j in range(70))
    rows = [(1, text, "z"), (1, text, "x"), (1, text, None), (1, text, "y")]
    for seed in range(4):
        docs = documents(rows[seed:] + rows[:seed]).repartition(1 + seed)
        assert [r.source for r in cp.near_dedup(spark, docs, folder).collect()] == [None]


def test_copies_of_repeated_rows_are_all_taken(spark, documents, folder):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, t, "s2") for i, t in enumerate(texts) for _ in range(3)]
    rows += [(100 + i, t, f"s{i % 2}") for i, t in enumerate(texts)]
    docs = documents(rows).repartition(5)
    taken = cp.mix_sources(spark, docs, folder).collect()
    per_source = mixing.mix(docs).groupBy("source").sum("taken").collect()
    size = lambda t: len(t.split())
    for source, want in per_source:
        assert sum(size(r.text) for r in taken if r.source == source) == want
    again = cp.mix_sources(spark, documents(rows[::-1]).repartition(3), folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))
