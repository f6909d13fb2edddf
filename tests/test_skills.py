from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from laurel import vocab
from laurel.functions import text as X


def plain(text):
    """One search per skill."""
    low = (text or "").lower()
    return sorted(s for s, spellings in vocab.skill_aliases().items() if any(
        re.search("(?<![a-z0-9])" + re.escape(x), low) for x in spellings))


def test_skills_in_one_pass_are_those_of_single_searches(spark):
    rng = random.Random(1)
    spellings = [x for group in vocab.skill_aliases().values() for x in group]
    glue = ["", " ", "-", "x", "9", "/", "\n", ".", "é"]
    texts = ["".join(rng.choice(spellings)[: rng.choice([2, 99, 99])] + rng.choice(glue)
                     for _ in range(rng.randint(0, 8))) for _ in range(600)]
    texts += [*spellings, *(a + b for a in spellings[:30] for b in spellings[-30:]), None, "", "PyTorch, TORCH"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: list(r.skills) for r in df.select("id", X.extract_skills(F.col("text")).alias("skills")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_the_longest_word_is_found(spark):
    words = ["ab", "abc", "a", "b.c", "b+"]
    pattern = re.compile(X.longest_of(words))
    for text in ("abcd", "abd", "ax", "b.c", "b+c"):
        assert pattern.match(text)[0] == max((w for w in words if text.startswith(w)), key=len)
