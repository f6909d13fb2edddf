"""SimHash near-duplicates found by anchor points of a covering code.

A 64-bit fingerprint is read as two 32-bit halves. Two fingerprints with at most three differing
bits have a half with at most one, so per half the threshold is one. The anchors of a half are
the words of a product code: the perfect Golay code on 23 bits (covering radius 3), the perfect
Hamming code on 7 bits (radius 1), and 2 bits as they are (radius 0). A fingerprint's home is its
nearest anchor; it is replicated to every anchor within covering radius plus threshold, about ten
per half, and compared at each anchor with the fingerprints that are at home there. So every link
is seen, at 2**18 anchors per half.

Equal fingerprints are one node (a partial aggregate before the shuffle). An anchor gives out a
spanning forest of its links, not its pairs. The home side of an anchor with many rows is cut
into blocks of ``BLOCK``, each compared with all rows of the anchor. Components come from rounds
of smallest labels with pointer jumps over small tables of linked fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.session import cut_lineage

THRESHOLD = 3
SHINGLE = 3
#: homes of one anchor compared in one place
BLOCK = 8192
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: generator polynomials of the two perfect codes, over GF(2)
GOLAY, HAMMING = 0b101011100011, 0b1011


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42) for i in range(n)),
        np.uint64, n,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is counted piece by piece
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp, ``keep``) with the fingerprint as a signed long; null text is the empty text."""
    kind = docs.schema[key].dataType.simpleString()
    further = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter(
                (simhash(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks.view(np.int64)), *batch.columns[2:]],
                [key, "fp", *keep],
            )

    return docs.select(key, text, *keep).mapInArrow(run, f"{key} {kind}, fp long{further}")


def _remainders(bits: int, generator: int) -> np.ndarray:
    """Remainder of every word of ``bits`` bits divided by the generator, bit by bit."""
    degree = generator.bit_length() - 1
    left = np.arange(1 << bits, dtype=np.uint32)
    for i in range(bits - 1, degree - 1, -1):
        left ^= np.where(left >> i & 1, generator << (i - degree), 0).astype(np.uint32)
    return left


def _corrections(bits: int, generator: int, radius: int) -> np.ndarray:
    """Per remainder the error of at most ``radius`` bits that leaves it; a perfect code has one
    for each."""
    errors = [sum(1 << i for i in c) for r in range(radius + 1)
              for c in itertools.combinations(range(bits), r)]
    one = np.array([_remainder(1 << i, generator) for i in range(bits)], np.uint32)
    table = np.zeros(1 << (generator.bit_length() - 1), np.uint32)
    for e in errors:
        s = 0
        for i in range(bits):
            if e >> i & 1:
                s ^= int(one[i])
        table[s] = e
    return table


def _remainder(word: int, generator: int) -> int:
    while word.bit_length() >= generator.bit_length():
        word ^= generator << (word.bit_length() - generator.bit_length())
    return word


class Anchors:
    """Anchors of 32-bit halves."""

    def __init__(self) -> None:
        low = _remainders(12, GOLAY)
        high = np.array([_remainder(i << 12, GOLAY) for i in range(1 << 11)], np.uint32)
        self.golay = (low, high, _corrections(23, GOLAY, 3))
        self.hamming = (_remainders(7, HAMMING), _corrections(7, HAMMING, 1))

    def home(self, half: np.ndarray) -> np.ndarray:
        """The nearest anchor, as the 32-bit word that it is."""
        low, high, fix = self.golay
        g = half & np.uint32(0x7FFFFF)
        g = g ^ fix[low[g & np.uint32(0xFFF)] ^ high[g >> np.uint32(12)]]
        rest, fix7 = self.hamming
        h = half >> np.uint32(23) & np.uint32(0x7F)
        return g | (h ^ fix7[rest[h]]) << np.uint32(23) | (half >> np.uint32(30)) << np.uint32(30)

    def within(self, half: np.ndarray) -> np.ndarray:
        """(n, 33): the home, then the homes of all words one bit away. These are the anchors
        within covering radius plus one; a row may name one several times."""
        flips = np.concatenate([[0], 1 << np.arange(32, dtype=np.uint64)]).astype(np.uint32)
        return self.home((half[:, None] ^ flips[None, :]).ravel()).reshape(-1, 33)


def replicas(marks: DataFrame) -> DataFrame:
    """(fp) to (anchor, fp, home), one row per anchor that a fingerprint reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                part = fp[at:at + 2048]
                for side in (0, 1):
                    half = (part.view(np.uint64) >> np.uint64(32 * side)).astype(np.uint32)
                    reached = anchors.within(half)
                    home = reached[:, 0]
                    reached = np.sort(reached, axis=1)
                    new = np.ones(reached.shape, bool)
                    new[:, 1:] = reached[:, 1:] != reached[:, :-1]
                    row, column = np.nonzero(new)
                    anchor = reached[row, column]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor.astype(np.int64) | side << 32), pa.array(part[row]),
                        pa.array(anchor == home[row]),
                    ], ["anchor", "fp", "home"])

    return marks.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links between the homes and all rows of one anchor."""
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    label = np.arange(len(fp))  # a root that was right when it was written
    bits = fp.view(np.uint64)
    homes = np.flatnonzero(home)
    step = max(1, (1 << 21) // len(fp))
    for at in range(0, len(homes), step):
        some = homes[at:at + step]
        near = np.bitwise_count(bits[some, None] ^ bits[None, :]) <= threshold
        for k, i in enumerate(some.tolist()):
            linked = np.flatnonzero(near[k])
            if len(linked) < 2:
                continue
            tops = {root(j) for j in np.unique(label[linked]).tolist()} | {root(i)}
            least = min(tops)
            for t in tops:
                parent[t] = least
            label[linked] = least
    return [(int(fp[i]), int(fp[root(i)])) for i in range(len(fp)) if root(i) != i]


def links(marks: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp), distinct, to links (a, b) that connect exactly what is within the threshold."""
    placed = replicas(marks)
    crowded = placed.groupBy("anchor").count().filter(F.col("count") > BLOCK).select(
        F.col("anchor").alias("_a"), F.ceil(F.col("count") / BLOCK).cast("int").alias("_n")
    )
    n = F.coalesce("_n", F.lit(1))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), n))
    rows = placed.join(crowded, F.col("anchor") == F.col("_a"), "left").select(
        "anchor", "fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block")
    ).select("anchor", "block", "fp", F.coalesce(F.col("_own") == F.col("block"), F.lit(False)).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, fp, home in _runs(batches):
            if len(fp) > 1 and home.any():
                out += forest(fp, home, threshold)
            if len(out) >= 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    ordered = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    kind = pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["a", "b"]
    )


def _runs(batches: Iterator[pa.RecordBatch]):
    """Rows of one (anchor, block) after another from sorted batches."""
    held, kept = None, []
    for batch in batches:
        anchor, block, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(fp):
            continue
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])) + 1
        ends = np.append(cut, len(fp)).tolist()
        start = 0
        for end in ends:
            key = (anchor[start], block[start])
            if key != held and kept:
                yield held, *(np.concatenate(x) for x in zip(*kept))
                kept = []
            held = key
            kept.append((fp[start:end], home[start:end]))
            start = end
    if kept:
        yield held, *(np.concatenate(x) for x in zip(*kept))


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) to (node, label): the smallest node of the component, for linked nodes.

    Each round takes the smallest label among the neighbours, then jumps to the label's label.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")
    ))
    while True:
        there = labels.withColumnsRenamed({"node": "_n", "label": "_l"})
        seen = both.join(there, F.col("b") == F.col("_n")).groupBy("a").agg(F.min("_l").alias("_m"))
        best = labels.join(seen, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "_m").alias("_best")
        )
        best = cut_lineage(best)
        ahead = best.select(F.col("node").alias("_n"), F.col("_best").alias("_jump"))
        moved = cut_lineage(best.join(ahead, F.col("_best") == F.col("_n"), "left").select(
            "node", "label", F.least("_best", "_jump").alias("_new")
        ))
        labels = moved.select("node", F.col("_new").alias("label"))
        if moved.filter("label <> _new").isEmpty():
            return labels


def _labelled(nodes: DataFrame, threshold: int) -> DataFrame:
    """(fp, first) with the ``label`` of the fingerprint's component."""
    labels = components(cut_lineage(links(nodes, threshold)))
    return nodes.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id): the smallest id reachable over links.

    One row per input row. Null text is the empty text (fingerprint zero, linked like any
    other). Rows that repeat an id count as that document; rows without an id get the smallest
    id of their component if it has one. An empty table gives an empty result.
    """
    if threshold != THRESHOLD:
        raise ValueError("the anchors are laid out for a threshold of three bits")
    marked = cut_lineage(fingerprints(docs))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = _labelled(nodes, threshold)
    names = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = joined.select("fp", F.col("label").alias("_l")).join(
        names, F.col("_l") == F.col("label")
    ).select(F.col("fp").alias("_fp"), "component_id")
    # one row per fingerprint on the right; a fingerprint with very many copies is split by AQE
    return marked.join(named, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", "fp", "component_id"
    )


def first_of_each(docs: DataFrame, key: str, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text, key) to (key): that of one row per component of near-duplicates, the row
    with the smallest id, without an id the last, at equal ids the one with the smallest key.

    A component is one of fingerprints: rows of one id, or without an id, that are no near copies
    of each other stay apart.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))
    marked = fingerprints(docs, keep=(key,))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(order).alias("first")))
    firsts = _labelled(nodes, threshold).groupBy("label").agg(F.min("first").alias("first"))
    return firsts.select(F.col("first.key").alias(key))
