from __future__ import annotations

import random
import re
import struct
from collections import Counter

import xxhash
from laurel.llm import fingerprints as fp
from pyspark.sql import functions as F


def chained(*values):
    """The engine's 64-bit hash of some values: each seeds the next, null leaves the seed."""
    seed = 42
    for v in values:
        if isinstance(v, str):
            seed = xxhash.xxh64_intdigest(v.encode(), seed)
        elif v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain_mark(text, k=fp.K):
    """Occurrence-numbered k-mers, the two least of each bin, in text order, hashed as a pair."""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = fp.POSITION & (2**64 - 1)
    cleared = lambda h: h & ~low & (2**64 - 1)
    grams = [cleared(chained(*tokens[i:i + k])) for i in range(max(len(tokens) - k + 1, min(len(tokens), 1)))]
    seen, entries = Counter(), []
    for at, gram in enumerate(grams):
        name = struct.pack("<q", signed(gram))
        number = struct.pack("<i", seen[gram])
        seen[gram] += 1
        entries.append((cleared(xxhash.xxh64_intdigest(number, xxhash.xxh64_intdigest(name, 42))), at))
    bits = fp.BINS.bit_length() - 1
    bins = {}
    for value, at in sorted(entries, key=lambda e: (signed(e[0] | e[1]))):
        bins.setdefault(value >> (64 - bits), []).append((value, at))
    out = []
    for number in sorted(bins, key=lambda b: signed(b << (64 - bits))):
        two = sorted(bins[number][:2], key=lambda e: e[1])
        pair = [struct.pack("<q", signed(v)) for v, _ in two]
        seed = xxhash.xxh64_intdigest(pair[0], 42)
        if len(pair) == 2:
            seed = xxhash.xxh64_intdigest(pair[1], seed)
        out.append(number << 32 | seed & (2**32 - 1))
    return out


def test_marks_are_those_of_a_plain_twin(spark, corpus):
    rng = random.Random(2)
    texts = [t for _, t in corpus] + [" ".join(rng.choices("abc", k=n)) for n in (1, 2, 3, 4, 40, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: list(r.m) for r in fp.with_fingerprint(df, "text", "m").collect()}
    assert got == {i: plain_mark(t) for i, t in enumerate(texts)}


def test_many_rows_without_an_id(spark, documents):
    rows = [(i, f"named {i} text") for i in range(6)] + [(None, f"text {i} " * (i % 4 + 1)) for i in range(300)]
    rows += [(None, "text 7 " * 4)] * 2
    found = fp.with_next(documents(rows)).collect()
    assert len(found) == len(rows)
    # following the next ones runs through all rows: each text is next as often as it is there
    said = Counter(t or "" for _, t in rows)
    assert Counter(r.next_text for r in found) == said
    by_id = {r.doc_id: r.next_text for r in found if r.doc_id is not None}
    assert all(by_id[i] == f"named {i - 1} text" for i in range(1, 6))
    none = [t for _, t in sorted((signed(chained(t)), t) for i, t in rows if i is None)]
    got = Counter((r.text, r.next_text) for r in found if r.doc_id is None)
    assert got == Counter(zip(none, [*none[1:], "named 5 text"])) and by_id[0] == none[0]



def test_next_and_edited(spark, documents, corpus):
    got = {r.doc_id: r for r in fp.edit_study(documents(corpus)).collect()}
    ids = sorted(got, reverse=True)
    text = {i: t or "" for i, t in corpus}
    assert len(ids) == len(corpus)
    for at, i in enumerate(ids):
        after = text[ids[(at + 1) % len(ids)]]
        half = len(text[i]) // 2
        want = text[i][:len(text[i]) - half] + after[:half]
        assert got[i].edited == want
        assert 0.0 <= got[i].near_edited <= 1.0 and 0.0 <= got[i].near_next <= 1.0
    by_text = {}
    for i in ids:
        by_text.setdefault(text[i], set()).add(tuple(got[i].mark))
    assert all(len(marks) == 1 for marks in by_text.values())
    long = [i for i in ids if len(text[i].split()) > 60]
    better = [got[i].near_edited > got[i].near_next for i in long]
    assert sum(better) > 0.8 * len(better)




def test_order_and_occurrence_matter(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [("same", " ".join(base)), ("edit", " ".join(base[:50] + ["new"] + base[51:])),
            ("moved", " ".join(base[100:] + base[:100])), ("twice", " ".join(base + base)),
            ("other", " ".join(f"z{i}" for i in range(200)))]
    df = fp.with_fingerprint(spark.createDataFrame(rows, "k string, text string"), "text", "m")
    marks = {r.k: r.m for r in df.collect()}
    pairs = spark.createDataFrame([(marks["same"], marks[k]) for k in
                                   ("same", "edit", "moved", "twice", "other")],
                                  "a array<bigint>, b array<bigint>")
    near = [r[0] for r in pairs.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1.0 and 0.8 < near[1] < 1.0 and near[4] == 0.0
    # content alone would give moved about 1: half of its tuples stand in another order
    assert near[2] < 0.75 and near[3] < 0.6


def test_edges(spark, documents):
    assert fp.edit_study(documents([])).count() == 0
    one = fp.edit_study(documents([(4, "a b c d")])).first()
    assert one.edited == "a b a b"[:4] + "a b"
    assert one.near_next == 1.0
    rows = [(None, None), (3, ""), (3, ""), (2**62, "x"), (-5, "y z"), (10**12, "w " * 9)]
    extra = documents(rows).withColumn("mark", F.lit(1)).withColumn("_next", F.lit(1))
    got = {r.doc_id: r for r in fp.edit_study(extra).collect()}
    assert got[-5].edited == "y " and got[3].edited == "" and len(got) == 5
