"""Best-fit packing of token sequences with a bounded number of open bins.

Every partition tokenizes its documents and packs them at once, with state of a fixed size. Open
bins stand in a bitset keyed by free space: the best fit is the lowest set bit at or above an item's
length. If no open bin fits and all places are taken, the fullest bin is closed for a new one. Each
record batch is fed longest first, which leaves small items for the gaps. Text longer than a sequence
is cut so that only its first piece is shorter.

A bin's items go out when it closes. What stands in open bins at the end of a partition (at most
``OPEN_BINS`` sequences of it) is no sequence yet: the items of all partitions are packed once more,
longest first, in tasks of ``LEFT_BYTES``, so that the number of partitions costs no sequences.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.session import materialise

CAPACITY = 2048
OPEN_BINS = 512
SEPARATOR = 0
#: ids of open bins that one task packs again
LEFT_BYTES = 64 << 20
#: sequence numbers of the second packing start here, above those of any partition
SECOND = 1 << 60
#: word pattern of the byte-level vocabulary (fixed by the vocabulary)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class OpenBins:
    """Online best fit over at most ``limit`` open bins of ``capacity``."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS, first: int = 0) -> None:
        self.capacity, self.limit = capacity, limit
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
        self.bits = 0
        self.open = 0
        self.next = first
        self.closed: list[int] = []  # since the caller last took them

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to ``capacity``."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open == self.limit:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            chosen, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.bins[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(chosen)
        return chosen, self.capacity - free

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found


@functools.cache
def _encoder(path: str):
    """An encoder over the merge ranks and added tokens in the vocabulary file, once per process.
    It gives the ids that the file's own library gives, at four times the speed."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    # the printable stand-ins of bytes in a byte-level vocabulary: shifted up where a byte is
    # no printable Latin character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items()
             if token not in special}
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks,
                             special_tokens=special)


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and the separator. The vocabulary's added tokens in a text get their own ids,
    as its library gives them."""
    ids = _encoder(path).encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
    return np.append(ids, SEPARATOR).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than a sequence."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


class _Packer:
    """Fills bins and gives out the rows of closed ones; holds only the rows of open bins."""

    def __init__(self, schema: pa.Schema, bins: OpenBins) -> None:
        self.schema, self.bins = schema, bins
        self.held: dict[int, list[tuple]] = {}
        self.ready: list[tuple] = []

    def add(self, row: tuple, length: int) -> None:
        at, offset = self.bins.place(length)
        self.held.setdefault(at, []).append((*row, at, offset))
        for closed in self.bins.closed:
            self.ready += self.held.pop(closed)
        self.bins.closed.clear()

    def batch(self) -> pa.RecordBatch:
        rows, self.ready = self.ready, []
        columns = zip(*rows) if rows else [[]] * len(self.schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, self.schema)], schema=self.schema
        )

    def open_rows(self, final: bool) -> None:
        """Give out what stands in open bins: as sequences, or as rows without one."""
        for rows in self.held.values():
            self.ready += rows if final else [(*r[:-2], None, None) for r in rows]
        self.held = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, text) to one row per piece:

    ``keep`` columns, piece, start, length, ids (little-endian 4-byte ids), sequence_id, offset.
    The vocabulary's added tokens in a text get their own ids. Null text is the empty text: its
    separator alone. Repeated rows are packed one by one; an empty table gives an empty result.
    Sequence ids are unique: partition number, then a count. ``tokenizer`` is the vocabulary's path
    on every machine.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    tail = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            if packer is None:
                own = [pa.field(c, batch.schema.field(i).type) for i, c in enumerate(keep)]
                packer = _Packer(pa.schema(own + [pa.field(*f) for f in tail]), OpenBins(
                    capacity, open_bins, TaskContext.get().partitionId() << 36))
            texts = batch.column(len(keep))
            # a few documents at a time bound the ids in memory, however long the texts
            for low, high in _slices(texts):
                items = []
                for row in range(low, high):
                    ids = encode(texts[row].as_py(), tokenizer)
                    names = tuple(batch.column(i)[row].as_py() for i in range(len(keep)))
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        items.append((length, (*names, piece, start, length,
                                               ids[start:start + length].tobytes())))
                items.sort(key=lambda x: -x[0])
                for length, row in items:
                    packer.add(row, length)
                yield packer.batch()
        if packer is not None:
            packer.open_rows(final=False)
            yield packer.batch()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            if packer is None:
                first = SECOND + (TaskContext.get().partitionId() << 36)
                packer = _Packer(batch.schema, OpenBins(capacity, open_bins, first))
            columns = [c.to_pylist() for c in batch.columns[:-2]]
            for row in zip(*columns):
                packer.add(row, row[len(keep) + 2])
            yield packer.batch()
        if packer is not None:
            packer.open_rows(final=True)
            yield packer.batch()

    # written once: texts are not cut into ids again for the second packing
    first = materialise(docs.select(*keep, "text").mapInArrow(run, schema), "packed")
    open_ = first.filter("sequence_id IS NULL")
    left = open_.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(4 * left / LEFT_BYTES))
    second = open_.repartition(tasks).sortWithinPartitions(F.desc("length")).mapInArrow(again, schema)
    return first.filter("sequence_id IS NOT NULL").unionByName(second)


def _slices(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each."""
    low, size = 0, 0
    for row in range(len(texts)):
        value = texts[row]
        size += value.as_buffer().size if value.is_valid else 0
        if size >= most:
            yield low, row + 1
            low, size = row + 1, 0
    if low < len(texts):
        yield low, len(texts)
