"""Spelling variants by composing the vocabulary's acceptor with a one-edit transducer.

Two words one edit apart agree before their first difference and after it. With m the shorter
length, a difference past the first half leaves the first m // 2 code points equal, an earlier one
leaves the last m - m // 2 equal. So every word stands in a group by its first half and in one by
its last, once as the shorter and once as the longer word, and each pair meets in exactly one group.
A group is an initial state: the words' rests are accepted from there.

In a task the rests of all groups build one minimised acyclic acceptor (equal states are found by
their arcs). From each initial state the composition acceptor - one edit - acceptor is walked: both
sides in step up to the edit, then through the common part of what two states accept, which is kept
for each pair of states. Accepted pairs go out as counts and best partner per word.

A group of more than ``GROUP`` words is split at its initial state, as often as it takes: pairs whose
edit is right there agree on all that follows and meet by that, the others meet by one more code
point. Nothing is left out, and no group has more words than that in one place.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.words import filled
from laurel.session import cut_lineage, materialise

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
GROUP = 20_000
#: words whose acceptor states a task keeps before it starts a new acceptor
BLOCK = 200_000
#: one run in so many loses a code point
NOISE = 31
NO_LIMIT = 1 << 30

GROUPED = ["g", "most", "rest", "longer", "word", "n"]


# --- words ----------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of letters in (doc_id, text), A-Z lower-cased, with the noise of the
    contract; words of at least seven code points that occur twice or more.

    Null text has no run; a null id counts as the empty text before the colon. Repeated rows count
    again. Counts are complete per task before the shuffle.
    """
    # a run shorter than a word cannot become one
    found = F.regexp_extract_all(
        filled(F.col("text")), F.lit(f"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1)
    )
    lower = F.translate(F.col("_run"), string.ascii_uppercase, string.ascii_lowercase)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(name.alias("_id"), F.explode(found).alias("_run")).select(
        "_id", lower.alias("_run")
    )
    h = F.crc32(F.concat("_id", F.lit(":"), F.col("_run")))
    at = (h % F.length("_run")).cast("int")
    shortened = F.concat(
        F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run"))
    )
    words = runs.select(F.when(h % NOISE == 0, shortened).otherwise(F.col("_run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH))


# --- groups ---------------------------------------------------------------------------


def grouped(words: DataFrame) -> DataFrame:
    """(word, n) to ``GROUPED``: every word as the shorter and as the longer of a pair, by its
    first half and by its last. ``most`` is how far into ``rest`` an edit may lie."""
    c = F.col
    size = F.length("word")
    roles = words.filter(size > 0).select("word", "n", F.explode(F.array(
        F.struct(size.alias("m"), F.lit(False).alias("longer")),
        F.struct((size - 1).alias("m"), F.lit(True).alias("longer")),
    )).alias("r")).select("word", "n", "r.*").withColumn("k", F.floor(c("m") / 2).cast("int"))

    def side(mark: str, key: Column, rest: Column, most: Column) -> Column:
        group = F.concat(F.lit(mark), c("m"), F.lit(":"), key)
        return F.struct(group.alias("g"), most.alias("most"), rest.alias("rest"))

    shared = c("m") - c("k")
    first = side("p", F.substring("word", F.lit(1), c("k")),
                 F.substring("word", c("k") + 1, F.length("word")), F.lit(NO_LIMIT))
    last = side("s", F.substring("word", F.length("word") - shared + 1, shared),
                F.substring("word", F.lit(1), F.length("word") - shared), c("k"))
    return roles.select("word", "n", "longer", F.explode(F.array(first, last)).alias("x")).filter(
        "x.most > 0"
    ).select("x.*", "longer", "word", "n").select(*GROUPED)


def split(rows: DataFrame) -> DataFrame:
    """Groups taken apart at their initial state: edits right there, and edits further on."""
    c = F.col
    head = F.substring("rest", F.lit(1), F.lit(1))
    tail = F.substring("rest", F.lit(2), F.length("rest"))

    def part(when: Column, mark: str, key: Column, rest: Column, most: Column) -> Column:
        return F.when(when, F.struct(
            F.concat("g", F.lit(mark), key).alias("g"), most.alias("most"), rest.alias("rest")
        ))

    some = F.length("rest") > 0
    parts = F.array(
        part(some & ~c("longer"), "=", tail, c("rest"), F.lit(1)),
        part(some & c("longer"), "-", tail, c("rest"), F.lit(1)),
        part(~c("longer"), "-", c("rest"), c("rest"), F.lit(1)),
        part(some & (c("most") > 1), ">", head, tail, c("most") - 1),
    )
    return rows.select("longer", "word", "n", F.explode(F.array_compact(parts)).alias("x")).select(
        "x.*", "longer", "word", "n"
    ).select(*GROUPED)


def bounded_groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """``GROUPED`` rows in which no group has more than ``most`` words, but for those whose words
    all differ in one and the same place (at most as many as there are letters)."""
    rows, done = grouped(words), None
    while True:
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
        # a group in which all agree but for its start cannot be split, and needs not be
        large = cut_lineage(sizes.filter(
            (F.col("_n") > most) & ~F.col("g").rlike("[=-]")
        ).select("g"))
        none = large.isEmpty()
        small = rows if none else rows.join(large, "g", "left_anti")
        done = small if done is None else done.unionByName(small)
        if none:
            return done
        rows = materialise(split(rows.join(large, "g", "left_semi")), "variants")


# --- acceptor and composition ---------------------------------------------------------


class Acceptor:
    """A minimised acyclic acceptor, grown from sorted words; state 0 accepts the empty word."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.sizes = [1]  # words accepted from a state
        self.known: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def state(self, rests: list[str], low: int = 0, high: int | None = None, at: int = 0) -> int:
        """The state that accepts these distinct, sorted words of one length, from ``at`` on."""
        high = len(rests) if high is None else high
        if len(rests[low]) == at:
            return 0
        arcs = {}
        if high - low == 1:
            arcs[rests[low][at]] = self.state(rests, low, high, at + 1)
        else:
            while low < high:
                letter, start = rests[low][at], low
                while low < high and rests[low][at] == letter:
                    low += 1
                arcs[letter] = self.state(rests, start, low, at + 1)
        key = tuple(arcs.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.sizes.append(sum(self.sizes[s] for s in arcs.values()))
        return found

    def common(self, a: int, b: int) -> list[str]:
        """The words that both states accept."""
        if a == 0 and b == 0:
            return [""]
        key = (a, b) if a <= b else (b, a)
        found = self.shared.get(key)
        if found is None:
            one, two = self.arcs[a], self.arcs[b]
            found = [
                letter + rest for letter, s in one.items() if letter in two
                for rest in self.common(s, two[letter])
            ]
            self.shared[key] = found
        return found

    def pairs(self, shorter: int | None, longer: int | None, most: int
              ) -> Iterator[tuple[str, str, bool]]:
        """Pairs of words one edit apart, the edit before position ``most``, each once: two of the
        shorter (replaced) or a shorter and a longer one (True, deleted)."""
        stack = [(shorter, longer, "")]
        while stack:
            s, t, x = stack.pop()
            if s is None or (t is None and self.sizes[s] == 1):
                continue
            arcs = self.arcs[s]
            further = len(x) + 1 < most
            seen = []
            for a, p in arcs.items():
                for b, q in seen:
                    for rest in self.common(p, q):
                        yield x + b + rest, x + a + rest, False
                seen.append((a, p))
                if further:
                    stack.append((p, self.arcs[t].get(a) if t is not None else None, x + a))
            if t is not None:
                for a, p in self.arcs[t].items():
                    for rest in self.common(p, s):
                        # of a run of equal letters the last one goes
                        if not rest.startswith(a):
                            yield x + rest, x + a + rest, True


def group_partners(acceptor: Acceptor, rows: list[tuple], most: int) -> Iterator[tuple]:
    """(word, partners, best count, best partner) of a group of (rest, longer, word, n)."""
    sides = [{}, {}]
    for rest, longer, word, n in rows:
        sides[longer][rest] = [word, n, 0, 0, None]
    if not sides[0]:
        return
    start = [acceptor.state(sorted(s)) if s else None for s in sides]
    for one, two, deleted in acceptor.pairs(*start, most):
        x, y = sides[0][one], sides[deleted][two]
        for own, other in ((x, y), (y, x)):
            own[2] += 1
            if other[1] > own[3] or (other[1] == own[3] and other[0] < own[4]):
                own[3], own[4] = other[1], other[0]
    for side in sides:
        for word, _, count, best, partner in side.values():
            if count:
                yield word, count, best, partner


def partners(groups: DataFrame) -> DataFrame:
    """``GROUPED`` rows to (word, n_near, best, near) of every word with partners in its group."""
    names = ["word", "n_near", "best", "near"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acceptor, held = Acceptor(), 0
        group, most, rows = None, 0, []
        for batch in batches:
            out = []
            for g, edits, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if g != group:
                    out += group_partners(acceptor, rows, most)
                    held += len(rows)
                    if held > BLOCK:
                        acceptor, held = Acceptor(), 0
                    group, most, rows = g, edits, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], types[i]) for i in range(4)], names
            )
        out = list(group_partners(acceptor, rows, most))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], types[i]) for i in range(4)], names
        )

    # one shuffle: a word alone in its group goes no further, nor do longer words alone
    own = Window.partitionBy("g")
    paired = groups.withColumns({
        "_c": F.count(F.lit(1)).over(own), "_s": F.count_if(~F.col("longer")).over(own)
    }).filter("_c > 1 AND _s > 0").drop("_c", "_s")
    return paired.sortWithinPartitions("g").select(*GROUPED).mapInArrow(
        run, "word string, n_near long, best long, near string"
    )


# --- forms ----------------------------------------------------------------------------


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n) to (word, n, n_near, best, near): how many words are one inserted, deleted or
    replaced code point away, and the one of largest n among them (ties: the smallest)."""
    found = partners(bounded_groups(words, most))
    # the best of the best: largest count, then smallest word
    order = F.struct((-F.col("best")).alias("best"), "near")
    best = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(order).alias("b")
    ).select("word", "n_near", (-F.col("b.best")).alias("best"), "b.near")
    return words.join(best, "word", "left").withColumn(
        "n_near", F.coalesce("n_near", F.lit(0).cast("bigint"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): where following the forms ends. Every step is at least tenfold
    in count, so that a way is short; it is halved by each round."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        if at.join(beyond, "root", "left_semi").isEmpty():
            return at
        at = cut_lineage(at.join(beyond, "root", "left").select(
            "word", F.coalesce("_further", "root").alias("root")
        ))


def variant_forms(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """(doc_id, text) to (word, form, root, n, n_near, form_n): all words, the common word each is a
    rare spelling of, and the word at which those forms end (itself if it has none).

    An empty table gives no row; other columns are ignored; for nulls and repeats see
    ``word_counts``.
    """
    words = materialise(word_counts(docs), "words")
    near = near_words(words, most)
    rare = F.col("best") >= FORM_RATIO * F.col("n")
    found = materialise(near.select(
        "word", "n", "n_near", F.when(rare, F.col("near")).alias("form"),
        F.when(rare, F.col("best")).alias("form_n"),
    ), "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
