"""Suffix-array dedup of long repeated byte strings across documents.

Sorting the suffix at every byte would move each byte fifty times. Suffixes are taken at anchors
instead: the byte string of the smallest hash among the ``GRAM``-byte strings of every window of
``LENGTH`` bytes. A window's anchor depends on its bytes alone, so equal windows have their anchor
at the same place, and comparing what stands around equal anchors finds every equal window.

1. Documents are dealt to parts by a hash of their id: one exchange, which all steps reuse.
2. Each part names its distinct anchors; a reduction finds those known in two documents.
3. Each part sends the surroundings of such anchors, each distinct one once with the smallest
   id. Splitters sampled from the corpus range-partition them by the suffix's leading bytes.
4. A bucket sorts its suffixes by multikey quicksort on eight-byte symbols and reads runs of equal
   windows off the sorted order. Splitters cut between leading symbols, so that an equal run never
   crosses a boundary between buckets: nothing is left to compare there.
5. Parts turn the windows found in a smaller document into removed bytes.

A copied text sends its surroundings once per part, whatever the number of its copies.

An anchor with more than ``HOT`` different surroundings in the corpus (a common phrase between other
words each time) would fill one bucket. Its windows are sent one by one instead, as suffixes of their
own from the window's first byte, and dealt by a hash of their fifty bytes; equal windows meet there
and are sorted and compared like all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 24
LEFT = LENGTH - GRAM
#: text of one part, and of what is hashed at a time
PART_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20
#: documents and anchors of each that splitters are sampled from
SAMPLE_DOCS, SAMPLE_EACH = 4000, 16
#: different surroundings of one anchor that go to one bucket
HOT = 500
#: stands for a missing id: after all others
NO_ID = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` symbols, built by doubling."""
    powers, whole, have = {1: ODD}, None, 0
    level, width = data.astype(np.uint64) + np.uint64(1), 1
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & width:
                n = len(data) - have - width + 1
                whole = level[:n] if whole is None else (
                    whole[:n] * powers[width] + level[have:have + n])
                have, left = have + width, left - width
            if left:
                level = level[:-width] * powers[width] + level[width:]
                powers[2 * width] = powers[width] * powers[width]
                width *= 2
        return mixed(whole)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return x if have == width else np.minimum(x[:n], x[width - have:width - have + n])


def find_anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first window, last window, gram hash) over documents that end at ``ends``.

    Windows that share an anchor are consecutive. Among equal hashes the leftmost counts.
    """
    found = []
    starts = np.concatenate([[0], ends[:-1]])
    at, high = 0, 0
    while at < len(ends):
        # documents together up to a chunk; a longer one in overlapping segments
        high = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, "right")))
        base, stop = int(starts[at]), int(ends[high - 1])
        for low in range(base, stop, CHUNK_BYTES):
            top = min(stop, low + CHUNK_BYTES + length - 1)
            if top - low < length:
                continue
            h = gram_hashes(data[low:top], gram)
            packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            best = (sliding_minimum(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            window = np.arange(len(best))
            doc_end = ends[np.searchsorted(ends, window + low, "right")] - low
            window = window[window + length <= doc_end]
            if not len(window):
                continue
            best = best[window]
            first = np.ones(len(window), bool)
            first[1:] = (best[1:] != best[:-1]) | (window[1:] != window[:-1] + 1)
            first = np.flatnonzero(first)
            last = np.append(first[1:], len(window)) - 1
            anchor = best[first]
            found.append((anchor + low, window[first] + low, window[last] + low, h[anchor]))
            if top == stop:
                break
        at = high
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def symbols(data: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """(n, count) big-endian eight-byte symbols from ``at`` on; zeros after the end."""
    view = sliding_window_view(np.concatenate([data, np.zeros(8 * count, np.uint8)]), 8 * count)
    return np.ascontiguousarray(view[at]).view(">u8").astype(np.uint64)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of symbols: sort by one symbol, then each run of equals by the next."""
    order = np.argsort(keys[:, 0], kind="stable")
    run = np.zeros(len(order), np.int64)
    for k in range(keys.shape[1] - 1):
        value = keys[order, k]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        part = order[tied]
        order[tied] = part[np.lexsort((keys[part, k + 1], run[tied]))]
    return order


class Part:
    """The documents of one part, in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table) -> None:
        text = table.column("text").to_pylist()
        ids = table.column("doc_id").to_pylist()
        rows = sorted(range(len(ids)), key=lambda i: (
            ids[i] is None, ids[i] if ids[i] is not None else 0, text[i] or ""))
        self.ids = [ids[i] for i in rows]
        said = [(text[i] or "").encode() for i in rows]
        self.data = np.frombuffer(b"".join(said), np.uint8)
        self.ends = np.cumsum([len(s) for s in said]).astype(np.int64)
        self.anchor, self.first, self.last, self.hash = find_anchors(self.data, self.ends)
        owner = np.searchsorted(self.ends, self.anchor, "right")
        key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.doc = key[owner] if len(owner) else key[:0]

    def buckets(self, at: np.ndarray, splitters: np.ndarray) -> np.ndarray:
        return np.searchsorted(splitters, symbols(self.data, at, 1)[:, 0], "right")

    def names(self, splitters: np.ndarray):
        """Distinct anchors by (bucket, hash): (bucket, hash, number of each anchor, in two
        documents here)."""
        name, first, number = np.unique(self.hash, return_index=True, return_inverse=True)
        bucket = self.buckets(self.anchor[first], splitters)
        order = np.lexsort((name, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = place[number]
        low = np.full(len(order), NO_ID)
        high = np.full(len(order), np.iinfo(np.int64).min)
        np.minimum.at(low, number, self.doc)
        np.maximum.at(high, number, self.doc)
        return bucket[order], name[order], number, low != high

    def surroundings(self, chosen: np.ndarray):
        """Of the chosen anchors, each distinct surrounding once, from the smallest id:
        (rows, copies): copies are anchors whose windows all stand in a smaller document here."""
        a, f, t = self.anchor[chosen], self.first[chosen], self.last[chosen]
        right = symbols(self.data, a, 7)
        left = symbols(self._reversed(), len(self.data) - a, 4)
        near, far = a - t, a - f
        key = np.zeros(len(chosen), np.uint64)
        with np.errstate(over="ignore"):
            for part in (masked(right, LENGTH - near), masked(left, far)):
                for word in part.T:
                    key = mixed(key * ODD + word)
            key = mixed(key * ODD + (near * 64 + far).astype(np.uint64))
        rows, copies, same, twins = least_of_each(key, self.doc[chosen])
        # a document's own repeats share the verdict of its first one
        return (
            (chosen[rows], right[rows], left[rows], near[rows], far[rows], self.doc[chosen][rows]),
            chosen[copies], (chosen[same], chosen[twins]),
        )

    def windows(self, hot: np.ndarray):
        """The windows of hot anchors, each distinct one once, from the smallest id: (anchor,
        distance of the anchor from the window's start, bytes, hash); copies (anchor, distance) that
        stand in a smaller document here; and a document's own repeats with their first ones."""
        count = self.last[hot] - self.first[hot] + 1
        row = np.repeat(hot, count)
        start = self.first[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        far = self.anchor[row] - start
        whole = masked(symbols(self.data, start, 7), np.full(len(row), LENGTH))
        key = np.zeros(len(row), np.uint64)
        with np.errstate(over="ignore"):
            for word in whole.T:
                key = mixed(key * ODD + word)
        rows, copies, same, twins = least_of_each(key, self.doc[row])
        return (
            (row[rows], far[rows], whole[rows], key[rows]), (row[copies], far[copies]),
            (row[same], row[twins], far[same]),
        )

    def varied(self, number: np.ndarray, names: int) -> np.ndarray:
        """How many different surroundings each name has here."""
        count = np.bincount(number, minlength=names)
        if not len(number):
            return np.zeros(0, np.uint16)
        repeated = np.flatnonzero((count > 1)[number])
        (at, *_), _, _ = self.surroundings(repeated)
        where = np.zeros(len(number), np.int64)
        where[repeated] = number[repeated]
        found = np.bincount(where[at], minlength=names)
        return np.clip(found, 1, np.iinfo(np.uint16).max).astype(np.uint16)

    def _reversed(self) -> np.ndarray:
        return self.data[::-1]


def least_of_each(key: np.ndarray, doc: np.ndarray):
    """Of each key one row of the smallest document; the rows of larger documents; and further rows
    of the smallest one with the row that stands for them."""
    order = np.lexsort((doc, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    run = np.cumsum(new) - 1
    least = doc[order][np.flatnonzero(new)][run] if len(order) else doc
    same = (doc[order] == least) & ~new
    rows = order[new]
    return rows, order[doc[order] > least], order[same], rows[run[same]]


def masked(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of eight-byte symbols with all bytes after the first ``size`` set to zero."""
    bits = np.clip(size[:, None] - 8 * np.arange(words.shape[1]), 0, 8) * 8
    high = ~np.uint64(0) << np.minimum(64 - bits, 63).astype(np.uint64)
    return np.where(bits == 0, np.uint64(0), words & high)


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _short(hashes: np.ndarray) -> np.ndarray:
    """Five bytes of each hash: enough to find candidates, which step 4 compares exactly."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 3:])


def _spans(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, low, high) of the runs of a sorted array."""
    cut = np.flatnonzero(np.diff(values)) + 1
    low = 0
    for high in [*cut.tolist(), len(values)]:
        if high > low:
            yield int(values[low]), low, high
        low = high


def _name_anchors(splitters: np.ndarray):
    def run(key, table):
        part = Part(table)
        bucket, name, number, _ = part.names(splitters)
        varied = part.varied(number, len(name))
        rows = [(b, key[0].as_py(), _short(name[low:h]).tobytes(), varied[low:h].tobytes())
                for b, low, h in _spans(bucket)]
        return pa.Table.from_pylist(
            [dict(zip(("bucket", "part", "names", "varied"), r)) for r in rows],
            pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("names", pa.binary()),
                       ("varied", pa.binary())]))
    return run


def _shared_names(most: int):
    """Per part one bit for each of its names: known in another part too; and one for the hot ones."""
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
        return pa.table({
            "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int32()),
            "part": table.column("part").combine_chunks(),
            "bits": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
            "hot": pa.array([np.packbits(hot[a:b]).tobytes() if hot[a:b].any() else b""
                             for a, b in zip(at, at[1:])], pa.binary()),
        })
    return run


def _chosen(part: Part, splitters: np.ndarray, bits: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Anchors known in two documents: common ones, and those that are hot."""
    bucket, name, number, twice = part.names(splitters)
    known = zip(*(bits.column(c).to_pylist() for c in ("bucket", "bits", "hot")))
    known = {k[0]: k[1:] for k in known}
    shared, hot = twice.copy(), np.zeros(len(twice), bool)
    for b, low, high in _spans(bucket):
        for flags, raw in zip((shared, hot), known.get(b, ())):
            if raw:
                own = np.unpackbits(np.frombuffer(raw, np.uint8), count=high - low)
                flags[low:high] |= own.astype(bool)
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.flatnonzero((shared & ~hot)[number]), np.flatnonzero((shared & hot)[number])


def _send(splitters: np.ndarray):
    def run(key, docs, bits):
        out = []
        if docs.num_rows:
            part = Part(docs)
            common, hot = _chosen(part, splitters, bits)
            (at, right, left, near, far, doc), _, _ = part.surroundings(common)
            (row, away, whole, name), _, _ = part.windows(hot)
            bucket = np.concatenate([
                part.buckets(part.anchor[at], splitters),
                (name % np.uint64(len(splitters) + 1)).astype(np.int64),
            ])
            none = np.zeros(len(row), np.int64)
            columns = (
                np.concatenate([right, whole]),
                np.concatenate([left, np.zeros((len(row), 4), np.uint64)]),
                np.concatenate([doc, part.doc[row]]), np.concatenate([at, row]).astype(np.int32),
                np.concatenate([near, none]).astype(np.int8),
                np.concatenate([far, none]).astype(np.int8),
                np.concatenate([np.zeros(len(at), np.int64), away]).astype(np.int8),
            )
            order = np.argsort(bucket, kind="stable")
            for b, low, high in _spans(bucket[order]):
                r = order[low:high]
                out.append((b, key[0].as_py(), high - low, _pack(*(x[r] for x in columns))))
        return pa.Table.from_pylist(
            [dict(zip(("bucket", "part", "n", "rows"), r)) for r in out],
            pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()),
                       ("rows", pa.binary())]))
    return run


ROW = (("right", np.uint64, 7), ("left", np.uint64, 4), ("doc", np.int64, 1),
       ("at", np.int32, 1), ("near", np.int8, 1), ("far", np.int8, 1), ("shift", np.int8, 1))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    size = n * sum(np.dtype(t).itemsize * c for _, t, c in ROW)
    raw, out, at = pa.decompress(blob, decompressed_size=size, codec="zstd"), [], 0
    for _, kind, count in ROW:
        value = np.frombuffer(raw, kind, n * count, at)
        at += value.nbytes
        out.append(value.reshape(n, count) if count > 1 else value)
    return out


def equal_windows(right, left, doc, near, far) -> np.ndarray:
    """Per row a bit for each distance of a window's start to the anchor: the window also starts
    in a smaller document."""
    order = multikey_order(right)
    right, left, doc, near, far = (x[order] for x in (right, left, doc, near, far))
    found = np.zeros(len(order), np.int64)
    with np.errstate(over="ignore"):
        for d in range(LEFT + 1):
            rows = np.flatnonzero((near <= d) & (d <= far))
            if len(rows) < 2:
                continue
            size = np.full(len(rows), LENGTH - d)
            ahead = masked(right[rows], size)
            # the sorted order keeps equal prefixes together: number the runs
            key = np.cumsum(np.append(True, (ahead[1:] != ahead[:-1]).any(1))).astype(np.uint64)
            for word in masked(left[rows], np.full(len(rows), d)).T:
                key = mixed(key * ODD + word)
            by = np.argsort(key, kind="stable")
            new = np.append(True, key[by][1:] != key[by][:-1])
            least = np.minimum.reduceat(doc[rows][by], np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = rows[by[doc[rows][by] > least]]
            found[hit] |= 1 << d
    back = np.empty_like(found)
    back[order] = found
    return back


def _compare(key, table):
    counts = table.column("n").to_pylist()
    parts = [_unpack(b, n) for b, n in zip(table.column("rows").to_pylist(), counts)]
    right, left, doc, at, near, far, shift = (np.concatenate(x) for x in zip(*parts))
    bits = (equal_windows(right, left, doc, near, far) << shift).astype(np.int32)
    out, low = [], 0
    for n in counts:
        hit = np.flatnonzero(bits[low:low + n])
        out.append((at[low:low + n][hit].tobytes(), bits[low:low + n][hit].tobytes()))
        low += n
    return pa.table({
        "part": table.column("part").combine_chunks(),
        "at": pa.array([o[0] for o in out], pa.binary()),
        "bits": pa.array([o[1] for o in out], pa.binary()),
    })


def _remove(splitters: np.ndarray, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n_bytes", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ("kept", pa.binary())])

    def run(key, docs, found):
        if not docs.num_rows:
            return schema.empty_table()
        part = Part(docs)
        names, verdicts = found.filter(found.column("names")), found.filter(
            pa.compute.invert(found.column("names")))
        common, hot = _chosen(part, splitters, names)
        _, copies, twins = part.surroundings(common)
        _, (row, away), (again, one, d) = part.windows(hot)
        bits = np.zeros(len(part.anchor), np.int64)
        for at, b in zip(verdicts.column("at").to_pylist(), verdicts.column("bits").to_pylist()):
            # a hot anchor has a verdict for each of its windows
            np.bitwise_or.at(bits, np.frombuffer(at, np.int32), np.frombuffer(b, np.int32))
        bits[copies] = -1
        bits[twins[0]] = bits[twins[1]]
        np.bitwise_or.at(bits, row, 1 << away)
        np.bitwise_or.at(bits, again, (bits[one] >> d & 1) << d)
        change = np.zeros(len(part.data) + 1, np.int32)
        for d in range(LEFT + 1):
            start = part.anchor - d
            start = start[(bits >> d & 1 > 0) & (part.first <= start) & (start <= part.last)]
            change[start] += 1
            change[start + LENGTH] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans, kept, sizes, low = [], [], [], 0
        for high in part.ends.tolist():
            mine = gone[low:high]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            kept.append(part.data[low:high][~mine].tobytes())
            sizes.append(high - low)
            low = high
        return pa.table([pa.array(part.ids, kind), pa.array(sizes, pa.int64()),
                         pa.array(spans, schema.field("spans").type),
                         pa.array(kept, pa.binary())], schema=schema)
    return run


def sample_splitters(docs: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """Leading symbols that cut the anchors of a sample of about ``SAMPLE_DOCS`` documents into
    ``buckets`` even ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = np.frombuffer((text or "").encode(), np.uint8)
                anchor = find_anchors(data, np.array([len(data)]))[0] if len(data) else []
                if len(anchor):
                    some = anchor[np.linspace(0, len(anchor) - 1, SAMPLE_EACH).astype(int)]
                    lead = symbols(data, some, 1)[:, 0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lead)], ["lead"])

    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    found = docs.select("text").sample(fraction=share, seed=2).mapInArrow(run, "lead long").collect()
    lead = np.sort(np.array([r.lead for r in found], np.int64).view(np.uint64))
    if not len(lead):
        return lead
    return np.unique(lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, spans, kept): ``kept`` is what is left of the text's
    UTF-8 bytes without every byte in a 50-byte string that also starts in a document with a
    smaller id; ``spans`` are the removed runs (start, end) in bytes.

    Null text is the empty text. Documents without an id come after all others; rows of one id do
    not remove each other. Ids are integers. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil((size[1] or 0) / PART_BYTES))
    splitters = sample_splitters(docs, size[0], parts)
    kind = pa.int32() if docs.schema["doc_id"].dataType.simpleString() == "int" else pa.int64()
    # rows without an id are dealt by their text
    name = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))
    own = F.pmod(name, F.lit(parts)).cast("int")
    dealt = docs.select("doc_id", "text", own.alias("part")).repartition(parts, "part")
    named = dealt.groupBy("part").applyInArrow(
        _name_anchors(splitters), "bucket int, part int, names binary, varied binary"
    )
    shared = named.groupBy("bucket").applyInArrow(
        _shared_names(hot), "bucket int, part int, bits binary, hot binary"
    )
    sent = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        _send(splitters), "bucket int, part int, n int, rows binary"
    )
    verdicts = sent.groupBy("bucket").applyInArrow(_compare, "part int, at binary, bits binary")
    both = shared.select(
        "part", "bucket", F.lit(True).alias("names"), F.lit(None).cast("binary").alias("at"), "bits",
        "hot",
    ).unionByName(verdicts.select(
        "part", F.lit(None).cast("int").alias("bucket"), F.lit(False).alias("names"), "at", "bits",
        F.lit(None).cast("binary").alias("hot"),
    ))
    back = "int" if kind == pa.int32() else "bigint"
    return dealt.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(
        _remove(splitters, kind),
        f"doc_id {back}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
