from __future__ import annotations

import json
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laurel.llm import queries, simple8b

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: the library as it loads
LIBRARY = Tokenizer.from_file(PATH)

ID = st.one_of(
    st.integers(0, 3), st.integers(0, 1100), st.integers(0, 50256), st.integers(0, 2**32 - 1),
    st.sampled_from([2**w - 1 for w in (1, 2, 3, 10, 12, 15, 20, 30, 32)]),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(ID, max_size=300))
def test_words_round_trip(ids):
    given_ids = np.array(ids, "<u4")
    words, escapes = simple8b.pack(given_ids)
    assert simple8b.unpack(words, escapes, len(ids)).tolist() == ids


def plain_decode(words, escapes, n):
    """One word and one slot at a time."""
    out, rest = [], iter(escapes.tolist())
    for word in words.tolist():
        count, width = simple8b.LAYOUTS[word >> 60]
        for slot in range(count):
            value = word >> (slot * width) & ((1 << width) - 1)
            if len(out) < n:
                out.append(next(rest) if value == (1 << width) - 1 else value)
    return out


def test_vectorised_decoding_is_that_of_single_slots():
    rng = np.random.default_rng(3)
    for high in (2, 9, 700, 50_257, 2**32):
        ids = rng.integers(0, high, 4000, dtype=np.uint64).astype("<u4")
        ids[::97] = 2**32 - 1
        words, escapes = simple8b.pack(ids)
        assert plain_decode(words, escapes, len(ids)) == ids.tolist()


def test_one_wide_id_does_not_widen_its_neighbours():
    ids = np.full(600, 5, "<u4")
    ids[300] = 50_000
    words, escapes = simple8b.pack(ids)
    assert len(words) <= 41 and escapes.tolist() == [50_000]


def test_damaged_words_are_refused():
    words, escapes = simple8b.pack(np.arange(100, dtype="<u4"))
    with pytest.raises(ValueError):
        simple8b.unpack(words | np.uint64(15 << 60), escapes, 100)
    with pytest.raises(ValueError):
        simple8b.unpack(words[:-5], escapes, 100)


def want(rows):
    """(doc_id, start, ids) of the contract, for rows with ids that differ."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, ids))
        at += len(ids)
    return out


def read(rows):
    found = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows.collect()]
    return sorted(found, key=lambda r: r[1])


def test_documents_in_order_against_the_library(spark, documents, corpus, tmp_path):
    rows = [*corpus, (900, "a <|endoftext|> b"), (901, "x" * 30_000), (None, "no id")]
    path = str(tmp_path / "ids")
    found = simple8b.store_documents(documents(rows).repartition(7), PATH, path)
    assert read(found) == want(rows)


def test_query_columns(spark, documents, corpus, tmp_path):
    documents(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_simple8b_ids"](spark, str(tmp_path)).collect()}
    assert len(got) == len(corpus)
    for doc_id, start, ids in want(corpus):
        r = got[doc_id]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc)


def test_edges(spark, documents, tmp_path):
    empty = simple8b.store_documents(documents([]), PATH, str(tmp_path / "none"))
    assert empty.count() == 0
    rows = documents([(1, None), (1, None), (None, "a"), (None, "a"), (None, "b")]).selectExpr(
        "*", "1 AS ids", "2 AS start", "3 AS _h"
    )
    found = read(simple8b.store_documents(rows, PATH, str(tmp_path / "ties")))
    assert [r[0] for r in found] == [None] * 3 + [1, 1]
    assert sorted(r[2] for r in found) == [[2], [2], [64, 2], [64, 2], [65, 2]]
    assert [r[1] for r in found] == [0, 2, 4, 6, 7]


def test_ranges_decode_only_their_blocks(spark, tmp_path):
    ids = np.random.default_rng(4).integers(0, 50_257, 5 * simple8b.BLOCK + 77).astype("<u4")
    path = str(tmp_path / "one")
    rows = spark.createDataFrame([(0, ids[:9].tobytes()), (1, ids[9:].tobytes())], "doc_id long, ids binary")
    simple8b.write_ids(rows.coalesce(1), path)
    name = json.load(open(f"{path}/manifest.json"))["files"][0]["name"]
    file = simple8b.IdFile(f"{path}/{name}")
    decoded = []
    whole = file._block
    file._block = lambda n: (decoded.append(n), whole(n))[1]
    low, high = simple8b.BLOCK - 3, 2 * simple8b.BLOCK + 5
    assert file.ids(low, high).tolist() == ids[low:high].tolist()
    assert decoded == [0, 1, 2]
    assert file.ids(7, 7).tolist() == []


def test_files_of_repeated_tasks_do_not_count(spark, tmp_path):
    path = str(tmp_path / "twice")
    rows = spark.createDataFrame([(0, np.array([7, 8], "<u4").tobytes())], "doc_id long, ids binary")
    simple8b.write_ids(rows, path)
    before = set(os.listdir(path))
    simple8b.write_ids(rows, path)
    assert before < set(os.listdir(path))
    assert simple8b.read_ids(spark, path).count() == 1
