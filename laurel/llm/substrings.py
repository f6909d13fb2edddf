"""Substring dedup with a compressed FM-index per shard.

Removes every word in a window of 20 words that also starts earlier in the corpus. An index per
shard of documents would be searched by all documents; here a shard holds what can match at all.
Each window has an anchor that depends on its words alone (the ``GRAM`` words of smallest hash),
so equal windows go to the shard of their anchor. Only anchors that occur twice are sent, with the
words around them, each distinct surrounding once per part and once per index.

A shard builds an FM-index (``fmindex``) over its surroundings and streams them through backward
search: windows whose match is a full window long and repeated share an interval of the suffix
order; the earliest of each interval stays. Parts read the documents from one reused exchange.

An anchor with more than ``HOT`` different surroundings in the corpus (a common phrase among other
words each time) would fill one shard. Its windows are sent one by one instead, each to the shard of
a hash of all its words, where the index treats them like any other surrounding.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.fmindex import FMIndex
from laurel.llm.suffixes import NO_ID, ODD, PART_BYTES, find_anchors, mixed

LENGTH, GRAM = 20, 8
#: windows that can share an anchor
SPREAD = LENGTH - GRAM + 1
#: different surroundings of one anchor that go to one shard
HOT = 500


class Part:
    """The words of one part's documents in order of (id, text), with their anchors."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").to_pylist()
        text = [(t or "").encode() for t in table.column("text").to_pylist()]
        # documents without an id are ordered by a hash, the same in every part
        turn = [0 if i is not None else xxhash.xxh3_64_intdigest(t) for i, t in zip(ids, text)]
        rows = sorted(range(len(ids)), key=lambda i: (
            ids[i] is None, ids[i] if ids[i] is not None else 0, turn[i], text[i]))
        self.ids = [ids[i] for i in rows]
        self.texts = [text[i] for i in rows]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        coded = []
        for t in self.texts:
            words = t.split()
            coded.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.ends = np.cumsum(self.sizes)
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        self.words = word[np.concatenate(coded)] if len(number) else word
        self.anchor, self.first, self.last, self.hash = find_anchors(
            self.words, self.ends, LENGTH, GRAM)
        owner = np.searchsorted(self.ends, self.anchor, "right")
        key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.doc = key[owner]
        self.turn = np.array([turn[i] for i in rows], np.uint64)[owner]

    def names(self, shards: int):
        """Distinct anchors by (shard, hash): (shard, hash, number of each anchor, repeated)."""
        name, number, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        shard = (name % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((name, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return shard[order], name[order], place[number], count[order] > 1

    def varied(self, number: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """How many different surroundings each name has here."""
        if not len(number):
            return np.zeros(0, np.uint16)
        kept, _ = self.distinct(np.flatnonzero(repeated[number]))
        count = np.bincount(number[kept], minlength=len(repeated))
        return np.clip(count, 1, np.iinfo(np.uint16).max).astype(np.uint16)

    def chosen(self, shards: int, bits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that occur twice in the corpus: common ones, and those that are hot."""
        shard, name, number, shared = self.names(shards)
        hot = np.zeros(len(shared), bool)
        known = zip(*(bits.column(c).to_pylist() for c in ("shard", "bits", "hot")))
        known = {k[0]: k[1:] for k in known}
        for s, low, high in spans(shard):
            for flags, raw in zip((shared, hot), known.get(s, ())):
                if raw:
                    own = np.unpackbits(np.frombuffer(raw, np.uint8), count=high - low)
                    flags[low:high] |= own.astype(bool)
        if not len(number):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.flatnonzero((shared & ~hot)[number]), np.flatnonzero(hot[number])

    def windows(self, hot: np.ndarray):
        """The windows of hot anchors, each distinct one once: (anchor, which of its windows, hash
        of the words); and the later ones (anchor, which)."""
        count = self.last[hot] - self.first[hot] + 1
        row = np.repeat(hot, count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = self.first[row] + nth
        key = around(self.words, start, start + LENGTH)
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(row), bool)
        later[first] = False
        first = np.sort(first)
        return (row[first], nth[first], key[first]), (row[later], nth[later])

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first anchor of each distinct surrounding, the later ones)."""
        order = np.argsort(self.anchor[chosen], kind="stable")
        chosen = chosen[order]
        key = around(self.words, self.first[chosen], self.last[chosen] + LENGTH)
        with np.errstate(over="ignore"):
            key = mixed(key * ODD + (self.anchor - self.first)[chosen].astype(np.uint64))
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(chosen), bool)
        later[first] = False
        return chosen[np.sort(first)], chosen[later]


def around(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words low .. high of each row."""
    key = (high - low).astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in range(LENGTH + SPREAD - 1):
            at = low + step
            live = at < high
            key[live] = mixed(key[live] * ODD + words[at[live]])
    return key


def spans(values: np.ndarray):
    """(value, low, high) of the runs of a sorted array."""
    low = 0
    for high in [*(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]:
        if high > low:
            yield int(values[low]), low, high
        low = high


def _rows(names: tuple[str, ...], rows: list[tuple], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))


def _name_anchors(shards: int):
    def run(key, table):
        part = Part(table)
        shard, name, number, repeated = part.names(shards)
        varied = part.varied(number, repeated)
        # the five high bytes find candidates; the index compares words
        short = np.ascontiguousarray(name.view(np.uint8).reshape(-1, 8)[:, 3:])
        rows = [(s, key[0].as_py(), short[a:b].tobytes(), varied[a:b].tobytes())
                for s, a, b in spans(shard)]
        return _rows(("shard", "part", "names", "varied"), rows,
                     [pa.int32(), pa.int32(), pa.binary(), pa.binary()])
    return run


def _shared_names(most: int):
    def run(key, table):
        blobs = [np.frombuffer(b, np.uint8).reshape(-1, 5) for b in table.column("names").to_pylist()]
        varied = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("varied").to_pylist()])
        value = np.zeros((sum(map(len, blobs)), 8), np.uint8)
        value[:, :5] = np.concatenate(blobs)
        _, number, count = np.unique(
            value.view(np.uint64)[:, 0], return_inverse=True, return_counts=True)
        shared = count[number] > 1
        hot = (np.bincount(number, varied) > most)[number]
        at = np.cumsum([0, *map(len, blobs)])
        rows = [(key[0].as_py(), p, np.packbits(shared[a:b]).tobytes(),
                 np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else b"")
                for p, a, b in zip(table.column("part").to_pylist(), at, at[1:])]
        return _rows(("shard", "part", "bits", "hot"), rows,
                     [pa.int32(), pa.int32(), pa.binary(), pa.binary()])
    return run


PIECE = (("size", np.uint8), ("ahead", np.uint8), ("doc", np.int64), ("turn", np.uint64),
         ("place", np.int64), ("at", np.int32), ("shift", np.uint8))


def _send(shards: int):
    def run(key, docs, bits):
        rows = []
        if docs.num_rows:
            part = Part(docs)
            common, hot = part.chosen(shards, bits)
            kept, _ = part.distinct(common)
            (row, nth, name), _ = part.windows(hot)
            at = np.concatenate([kept, row])
            shift = np.concatenate([np.zeros(len(kept), np.int64), nth])
            lows = part.first[at] + shift
            sizes = np.concatenate([
                part.last[kept] + LENGTH - part.first[kept], np.full(len(row), LENGTH)])
            shard = (np.concatenate([part.hash[kept], name]) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for s, a, b in spans(shard[order]):
                o = order[a:b]
                r, low, size = at[o], lows[o], sizes[o]
                flat = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                words, code = np.unique(part.words[flat], return_inverse=True)
                raw = b"".join(x.tobytes() for x in (
                    size.astype(np.uint8), (part.anchor[r] - low).astype(np.uint8), part.doc[r],
                    part.turn[r], part.anchor[r], r.astype(np.int32), shift[o].astype(np.uint8),
                    words, code.astype(np.int32)))
                rows.append((s, key[0].as_py(), len(r), len(words), len(code), len(raw),
                             pa.compress(raw, codec="zstd", asbytes=True)))
        return _rows(("shard", "part", "n", "w", "c", "size", "blob"), rows,
                     [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()])
    return run


def _unpack(n: int, w: int, c: int, size: int, blob: bytes) -> list[np.ndarray]:
    raw, out, at = pa.decompress(blob, decompressed_size=size, codec="zstd"), [], 0
    for kind, count in [*((k, n) for _, k in PIECE), (np.uint64, w), (np.int32, c)]:
        value = np.frombuffer(raw, kind, count, at)
        at += value.nbytes
        out.append(value)
    return out


def repeated_windows(size: np.ndarray, words: np.ndarray, ahead: np.ndarray, doc: np.ndarray,
                     turn: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Per surrounding a bit for each of its windows: the same words start earlier.

    Surrounding i is ``size[i]`` words of the concatenated ``words``; (doc, turn, place) orders them.
    """
    start = np.cumsum(size) - size
    rank = np.empty(len(size), np.int64)
    rank[np.lexsort((place, turn, doc))] = np.arange(len(size))
    # equal surroundings, from different parts, are indexed once
    with np.errstate(over="ignore"):
        key = mixed(around(words, start, start + size) * ODD + ahead.astype(np.uint64))
    _, one, number = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, number, rank)
    # the text of the index: each surrounding, then 0
    length = size[one].astype(np.int64)
    alphabet, code = np.unique(words, return_inverse=True)
    begin = np.cumsum(length + 1) - length - 1
    text = np.zeros(int((length + 1).sum()), np.int64)
    source = np.repeat(start[one] - np.cumsum(length) + length, length) + np.arange(length.sum())
    text[np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())] = code[source] + 1
    index = FMIndex(text, len(alphabet) + 1, LENGTH)
    # stream every window: row, and which of its windows
    count = length - LENGTH + 1
    row = np.repeat(np.arange(len(one)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    matched, low, high = index.search(text, begin[row] + nth + LENGTH, LENGTH)
    best = least[row].copy()
    hit = np.flatnonzero((matched == LENGTH) & (high - low > 1))
    if len(hit):
        order = hit[np.argsort(low[hit], kind="stable")]
        new = np.append(True, low[order][1:] != low[order][:-1])
        best[order] = np.minimum.reduceat(best[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    # a window of a surrounding is repeated where the earliest of its interval comes before
    first = np.cumsum(count) - count
    bits = np.zeros(len(size), np.int64)
    for k in range(SPREAD):
        live = np.flatnonzero(count[number] > k)
        bits[live] |= (best[first[number[live]] + k] < rank[live]).astype(np.int64) << k
    return bits


def _search(key, table):
    columns = [table.column(c).to_pylist() for c in ("n", "w", "c", "size", "blob")]
    parts = [_unpack(*row) for row in zip(*columns)]
    size, ahead, doc, turn, place, at, shift = (
        np.concatenate([p[i] for p in parts]) for i in range(len(PIECE)))
    words = np.concatenate([p[-2][p[-1]] for p in parts])
    bits = repeated_windows(size.astype(np.int64), words, ahead, doc, turn, place)
    bits = (bits << shift).astype(np.int32)
    ends = np.cumsum(columns[0]).tolist()
    rows = []
    for p, low, high in zip(table.column("part").to_pylist(), [0, *ends], ends):
        hit = np.flatnonzero(bits[low:high]) + low
        rows.append((p, at[hit].tobytes(), bits[hit].tobytes()))
    return _rows(("part", "at", "bits"), rows, [pa.int32(), pa.binary(), pa.binary()])


def _remove(shards: int, kind: pa.DataType):
    kinds = [kind, pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
             pa.string()]
    names = ("doc_id", "n_words", "spans", "kept")

    def run(key, docs, found):
        if not docs.num_rows:
            return _rows(names, [], kinds)
        part = Part(docs)
        named = found.column("names")
        common, hot = part.chosen(shards, found.filter(named))
        _, later = part.distinct(common)
        _, (row, nth) = part.windows(hot)
        verdicts = found.filter(pc.invert(named))
        bits = np.zeros(len(part.anchor), np.int64)
        for at, b in zip(verdicts.column("at").to_pylist(), verdicts.column("bits").to_pylist()):
            # a hot anchor has a verdict for each of its windows
            np.bitwise_or.at(bits, np.frombuffer(at, np.int32), np.frombuffer(b, np.int32))
        # the same words stand earlier in this part
        bits[later] = -1
        np.bitwise_or.at(bits, row, 1 << nth)
        change = np.zeros(len(part.words) + 1, np.int32)
        for k in range(SPREAD):
            start = part.first + k
            start = start[(bits >> k & 1 > 0) & (start <= part.last)]
            change[start] += 1
            change[start + LENGTH] -= 1
        gone = np.cumsum(change[:-1]) > 0
        rows, low = [], 0
        for i, text, n in zip(part.ids, part.texts, part.sizes.tolist()):
            mine, words = gone[low:low + n], text.split()
            if mine.any():
                words = [w for w, g in zip(words, mine.tolist()) if not g]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            rows.append((i, n, [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)],
                         b" ".join(words).decode()))
            low += n
        return _rows(names, rows, kinds)
    return run


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, spans, kept): ``kept`` is the words left, joined by a
    space; ``spans`` are the removed runs (start, end) in words.

    Null text has no words. Documents without an id come after all others, in the order of a hash of
    their text; rows of one id follow each other by their text, so that a repeated row is removed as
    a later part of its document. Ids are integers. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    # rows without an id are dealt by their text
    name = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    own = F.pmod(name, F.lit(parts)).cast("int")
    dealt = docs.select("doc_id", "text", own.alias("part")).repartition(parts, "part")
    named = dealt.groupBy("part").applyInArrow(
        _name_anchors(parts), "shard int, part int, names binary, varied binary"
    )
    shared = named.groupBy("shard").applyInArrow(
        _shared_names(hot), "shard int, part int, bits binary, hot binary"
    )
    sent = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        _send(parts), "shard int, part int, n long, w long, c long, size long, blob binary"
    )
    verdicts = sent.groupBy("shard").applyInArrow(_search, "part int, at binary, bits binary")
    both = shared.select(
        "part", "shard", F.lit(True).alias("names"), F.lit(None).cast("binary").alias("at"), "bits",
        "hot",
    ).unionByName(verdicts.select(
        "part", F.lit(None).cast("int").alias("shard"), F.lit(False).alias("names"), "at", "bits",
        F.lit(None).cast("binary").alias("hot"),
    ))
    small = docs.schema["doc_id"].dataType.simpleString() == "int"
    return dealt.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(
        _remove(parts, pa.int32() if small else pa.int64()),
        f"doc_id {'int' if small else 'bigint'}, n_words bigint, "
        "spans array<struct<start:bigint,end:bigint>>, kept string",
    )
