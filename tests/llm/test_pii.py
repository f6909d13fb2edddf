from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from laurel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text)
            if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def cases():
    rng = random.Random(4)
    bits = ["a@b.c", "a@b.c_d@e.f", "x.y+z@mail.example.com.", "@", "no@dot", "a@b..c@d.e",
            "1.2.3.4", "256.1.1.1", "001.2.3.0255", "1.2.3.4.5.6.7.8", "9.9.9", "12.13.14.150",
            "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111-", "0000 0000 0000 00",
            "+1 (509) 555-6973", "+12345", "+1 (826) 555-4081 190.137.223.204", "++1 2 3",
            "(509) 555-6973", "é", "日本", "\n", " ", "word", "user [at] host [dot] org", "+1(((5"]
    return [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "  ", "x"])
                        for _ in range(rng.randint(0, 25)))) for i in range(400)]


def test_base_spans(spark, documents, corpus):
    rows = cases() + [(1000 + i, t) for i, t in corpus]
    rows += [(5000, "1.2.3.4 " * 3000), (5001, "7" * 60_000), (5002, "1 " * 40_000),
             (5003, "a@" + "b." * 30_000 + "c"), (5004, "x" * 90_000 + "@y.z"), (5005, "0.0.0.00")]
    found = pii.find(documents(rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == base(text[r.doc_id]), r.doc_id


def test_query_columns(spark, documents, tmp_path):
    import hashlib

    from laurel.llm.queries import QUERIES

    rows = cases()
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    text = dict(rows)
    for r in QUERIES["op9_pii_boosted_spans"](spark, str(tmp_path)).collect():
        want = base(text[r.doc_id])
        count = [sum(k == kind for _, kind, _ in want) for k in range(4)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == count
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",") if r.spans else [])


def test_model_adds_what_looks_like_the_real_ones(spark, documents):
    rows = [(i, f"call +1 (50{i % 10}) 555-69{i % 90 + 10} now") for i in range(300)]
    rows += [(900, "call (509) 555-6973 now"), (901, "call +1 (826) 555-4081 190.137.223.204 x"),
             (902, "nothing 12.5 here"), (903, "4111111111111112 fails")]
    rows += [(1000 + i, f"number {4000000000000000 + 7919 * i} here") for i in range(300)]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert [(s.kind, s.base) for s in got[900].spans] == [(3, False)]
    assert (3, False) in [(s.kind, s.base) for s in got[901].spans]
    assert not got[902].spans and not got[903].spans
    assert all(s.base for i in range(1000, 1300) for s in got[i].spans)


def test_redaction(spark, documents):
    rows = cases()
    df = pii.find(documents(rows)).withColumn("clean", pii.redacted(F.col("text"), F.col("spans")))
    for r in df.collect():
        want, at = "", 0
        for s in r.spans:
            if s.start >= at:
                want += r.text[at:s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        assert r.clean == want + r.text[at:]


def test_edges(spark, documents):
    assert pii.find(documents([])).count() == 0
    extra = documents([(1, None), (1, None), (None, "a@b.c")]).selectExpr("*", "1 AS _p", "2 AS _base")
    assert sorted(len(r.spans) for r in pii.find(extra).collect()) == [0, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_running_sums(spark, n):
    values = [i * 7 % 13 for i in range(n)]
    df = spark.createDataFrame([(values,)], "a array<bigint>")
    got = df.select(pii.running_sums(F.col("a"))).first()[0]
    assert got == [sum(values[:i + 1]) for i in range(n)]
