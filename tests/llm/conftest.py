from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text[, source]) rows as a documents table."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Some hundred texts: random, copies, near copies, empty, blank, null, long."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(rng.randint(1, 120))) for i in range(60)]
    shared = text(40)
    rows += [(100 + i, text(9) + "\n" + shared + "\t" + text(7)) for i in range(12)]
    rows += [(200 + i, rows[i][1]) for i in range(8)]
    rows += [(300 + i, rows[i][1].replace("a", "b", 2)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, text(6000)),
             (405, "é" * 300), (406, (text(8) + "\n") * 30), (407, "x y " * 90)]
    return rows
