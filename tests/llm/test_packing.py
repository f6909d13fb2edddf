from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laurel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: the library as it loads
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids + [0]
    assert packing.encode(text, PATH).tolist() == want


def test_control_strings_and_long_runs():
    for text in ("<|endoftext|>a", "x" * 30_000, " " * 9_000, "ab, " * 5_000, "\n" * 99 + "'s"):
        assert packing.encode(text, PATH).tolist() == LIBRARY.encode(
            text, add_special_tokens=False).ids + [0]


def test_best_fit_against_a_plain_list():
    rng = random.Random(2)
    bins, plain, nxt = packing.OpenBins(50, 4), [], 0  # plain: [free, order, id]
    for _ in range(3000):
        n = rng.randint(1, 50)
        fits = [b for b in plain if b[0] >= n]
        at, offset = bins.place(n)
        if fits:
            best = min(b[0] for b in fits)
            assert offset == 50 - best and at in [b[1] for b in fits if b[0] == best]
            chosen = next(b for b in plain if b[1] == at)
        else:
            if len(plain) == 4:
                fullest = min(b[0] for b in plain)
                gone = [b for b in plain if b[0] == fullest]
                still = {i for cell in bins.bins for i in cell}
                plain.remove(next(b for b in gone if b[1] not in still))
            assert offset == 0 and at == nxt
            chosen, nxt = [50, nxt], nxt + 1
            plain.append(chosen)
        chosen[0] -= n
        if not chosen[0]:
            plain.remove(chosen)


def check_packed(rows, texts, capacity):
    ids, places = {}, {}
    for r in rows:
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length and 1 <= r.length <= capacity
        ids.setdefault(r.doc_id, []).append((r.piece, r.start, part))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts:
        pieces = sorted(ids[i])
        whole = [x for _, _, part in pieces for x in part]
        assert whole == LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert all(len(part) == capacity for p, _, part in pieces if p)
        at = 0
        for _, start, part in pieces:
            assert start == at
            at += len(part)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack(spark, documents, corpus):
    rows = packing.pack(documents(corpus), PATH, capacity=256, open_bins=16).collect()
    used = check_packed(rows, corpus, 256)
    total = sum(r.length for r in rows)
    assert used <= 1.1 * total / 256 + 8


def test_many_partitions_cost_no_sequences(spark, documents):
    rng = random.Random(6)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 60)))) for i in range(4000)]
    docs = documents(rows).repartition(40)
    found = packing.pack(docs, PATH, capacity=256, open_bins=32).collect()
    used = check_packed(found, rows, 256)
    total = sum(r.length for r in found)
    assert used <= 1.01 * total / 256 + 1


def test_closed_bins_are_told(spark):
    rng = random.Random(8)
    bins, told, filled = packing.OpenBins(40, 3), set(), {}
    for _ in range(500):
        n = rng.randint(1, 40)
        at, offset = bins.place(n)
        assert at not in told and offset == filled.get(at, 0)
        filled[at] = offset + n
        told |= set(bins.closed)
        bins.closed.clear()
    still = {b for cell in bins.bins for b in cell}
    assert told | still == set(filled) and not told & still


def test_edges(spark, documents):
    assert packing.pack(documents([]), PATH).count() == 0
    extra = documents([(1, None), (1, None), (None, "a")]).selectExpr("*", "1 AS piece", "2 AS ids")
    rows = packing.pack(extra, PATH).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2]


def test_added_tokens_get_the_ids_of_the_library_as_it_loads(spark, documents):
    token = "<|endoftext|>"
    texts = [f"a {token} b", token, f" {token}{token} ", f"x\n\n{token}\n y  {token}z", "<|endoftext|",
             f"{'word ' * 900}{token} {'word ' * 900}"]
    for text in texts:
        want = LIBRARY.encode(text, add_special_tokens=False).ids + [0]
        assert packing.encode(text, PATH).tolist() == want
    found = {}
    for r in packing.pack(documents(list(enumerate(texts))), PATH, capacity=256).collect():
        found.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in enumerate(texts):
        got = [x for _, part in sorted(found[i]) for x in part]
        assert got == LIBRARY.encode(text, add_special_tokens=False).ids + [0]
    assert found[0] == [(0, [64, 220, 50256, 275, 0])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just("<|endoftext|>"), st.text(max_size=20)), max_size=8))
def test_added_tokens_between_any_text(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert packing.encode(text, PATH).tolist() == want + [0]
