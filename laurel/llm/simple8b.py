"""Token-id files in a Simple-8b coding: 64-bit words of one selector and 60 bits of slots.

A selector names how many ids its word holds and how wide each slot is. A slot of all ones is an
escape: the id stands in the block's escape list, in order. So one wide id among narrow ones costs
four bytes more and not a wider word for its neighbours. Which selector a word gets is decided by
bits per id, escapes included.

File (little-endian): the magic; blocks of ``BLOCK`` ids (words, then escapes, filled up to whole
words); an Arrow stream (doc_id, start, n_tokens); the block table (offset, words, escapes, ids);
a trailer (place of both, number of blocks and ids, magic). Blocks decode alone, selector by
selector, so any range of ids is read without what lies before it.

``write_ids`` and ``read_ids`` are a Spark data source: every task writes one file under a name of
its own, and only the files that the commit lists in the manifest are ever read, so lost executors
and repeated tasks leave nothing behind that counts.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from laurel.llm.packing import _slices, encode
from laurel.llm.words import filled

#: (ids in a word, bits of a slot) by selector
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
           (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([count for count, _ in LAYOUTS])
#: ids from here on are escapes in a slot of that width
LIMITS = np.array([(1 << width) - 1 for _, width in LAYOUTS], np.uint64)
NARROWEST = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.int8)
BLOCK = 8192
MAGIC = b"S8BIDS01"
TRAILER = struct.Struct("<QQQQ8s")
TABLE = np.dtype([("offset", "<u8"), ("words", "<u4"), ("escapes", "<u4"), ("ids", "<u4")])
MANIFEST = "manifest.json"
END_ID = 2


# --- coding ---------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit ids to (words, escapes)."""
    values = np.ascontiguousarray(ids, "<u4").astype(np.uint64)
    n = len(values)
    # the narrowest layout that holds an id, by its number; ids after the end fit everywhere
    need = np.zeros(n + 60, np.int8)
    need[:n] = NARROWEST[np.minimum(values, len(NARROWEST) - 1)]
    large = np.nonzero(values >= len(NARROWEST))[0]
    need[large] = np.searchsorted(LIMITS, values[large], "right")
    left = np.arange(n, 0, -1, dtype=np.float32)
    # bits per id in thousandths, then the selector: the least is the choice
    best = np.full(n, np.iinfo(np.int32).max, np.int32)
    wide = np.zeros(n + 61, np.int32)
    for selector, (count, _) in enumerate(LAYOUTS):
        np.cumsum(need > selector, out=wide[1:])
        bits = (64_000 + 32_000 * (wide[count:n + count] - wide[:n])).astype(np.float32)
        bits /= np.minimum(left, np.float32(count))
        np.minimum(best, bits.astype(np.int32) * 16 + selector, out=best)
    best &= 15
    step = COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    selectors = best[first]
    words = np.zeros(len(first), np.uint64)
    escaped = np.zeros(n, bool)
    for selector, (count, width) in enumerate(LAYOUTS):
        here = np.nonzero(selectors == selector)[0]
        if not len(here):
            continue
        spots = first[here, None] + np.arange(count)
        known = spots < n
        spots = np.where(known, spots, 0)
        mask = np.uint64((1 << width) - 1)
        slots = values[spots]
        wide = known & (slots >= mask)
        escaped[spots[wide]] = True
        slots = np.where(known, np.minimum(slots, mask), np.uint64(0))
        shifts = (np.arange(count) * width).astype(np.uint64)
        packed = np.bitwise_or.reduce(slots << shifts, axis=1)
        words[here] = packed | np.uint64(selector << 60)
    return words, values[escaped].astype("<u4")


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of (words, escapes), one selector at a time."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if len(selectors) and selectors.max() >= len(LAYOUTS):
        raise ValueError("a word has a selector that is not in use")
    counts = COUNTS[selectors]
    first = np.cumsum(counts) - counts
    # the last word may have slots to spare
    out = np.zeros(int(counts.sum()), np.uint32)
    escaped = np.zeros(len(out), bool)
    for selector, (count, width) in enumerate(LAYOUTS):
        here = np.nonzero(selectors == selector)[0]
        if not len(here):
            continue
        mask = np.uint64((1 << width) - 1)
        shifts = (np.arange(count) * width).astype(np.uint64)
        slots = (words[here, None] >> shifts) & mask
        spots = first[here, None] + np.arange(count)
        out[spots] = slots.astype(np.uint32)
        escaped[spots] = slots == mask
    out, escaped = out[:n], escaped[:n]
    if len(out) != n or int(escaped.sum()) != len(escapes):
        raise ValueError("words, escapes and number of ids do not agree")
    out[escaped] = escapes
    return out


# --- files ----------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class IdFileWriter:
    """Writes documents' ids to one file; keeps one block of ids and the document table."""

    def __init__(self, out, id_type: pa.DataType) -> None:
        self.out, self.id_type = out, id_type
        self.rest, self.held = [], 0
        self.blocks, self.names, self.sizes = [], [], []
        self.n_ids, self.at = 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Some documents: their ids as one array, cut by ``sizes``."""
        self.names.append(names)
        self.sizes.append(np.asarray(sizes, np.int64))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.rest)
            whole = self.held // BLOCK * BLOCK
            for low in range(0, whole, BLOCK):
                self._block(every[low:low + BLOCK])
            self.rest, self.held = [every[whole:].copy()], self.held - whole

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        body = words.astype("<u8").tobytes() + escapes.tobytes() + bytes(len(escapes) % 2 * 4)
        self.out.write(body)
        self.blocks.append((self.at, len(words), len(escapes), len(ids)))
        self.at += len(body)

    def close(self) -> tuple[int, int]:
        """(documents, ids) written."""
        if self.held:
            self._block(np.concatenate(self.rest))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        names = pa.concat_arrays(self.names) if self.names else pa.array([], self.id_type)
        table = pa.table({
            "doc_id": names, "start": pa.array(np.cumsum(sizes) - sizes),
            "n_tokens": pa.array(sizes),
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        documents = sink.getvalue().to_pybytes()
        self.out.write(documents)
        self.out.write(np.array(self.blocks, TABLE).tobytes())
        self.out.write(TRAILER.pack(
            self.at, self.at + len(documents), len(self.blocks), self.n_ids, MAGIC
        ))
        return len(sizes), self.n_ids


class IdFile:
    """One written file: its documents and any range of its ids."""

    def __init__(self, path: str) -> None:
        system, inner = _place(path)
        self.source = system.open_input_file(inner)
        size = self.source.size()
        documents, table, n_blocks, self.n_ids, magic = TRAILER.unpack(
            self.source.read_at(TRAILER.size, size - TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.documents = pa.ipc.open_stream(
            self.source.read_at(table - documents, documents)
        ).read_all()
        self.blocks = np.frombuffer(
            self.source.read_at(n_blocks * TABLE.itemsize, table), TABLE
        )

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``: reads and decodes only the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = start // BLOCK, (stop - 1) // BLOCK
        got = np.concatenate([self._block(b) for b in range(low, high + 1)])
        return got[start - low * BLOCK:stop - low * BLOCK]

    def _block(self, number: int) -> np.ndarray:
        offset, n_words, n_escapes, n = self.blocks[number].tolist()
        body = self.source.read_at(8 * n_words + 4 * n_escapes, offset)
        words = np.frombuffer(body, "<u8", n_words)
        return unpack(words, np.frombuffer(body, "<u4", n_escapes, 8 * n_words), n)

    def close(self) -> None:
        self.source.close()


# --- Spark source and sink ------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote; one such message per file reaches the driver."""

    part: int
    name: str
    n_docs: int
    n_ids: int


@dataclass
class OneFile(InputPartition):
    path: str
    start: int


class IdSource(DataSource):
    """``format("simple8b")``: rows (doc_id, ids) out, rows (doc_id, start, ids) in."""

    @classmethod
    def name(cls) -> str:
        return "simple8b"

    def schema(self) -> str:
        return f"doc_id {self.options.get('idtype', 'bigint')}, start bigint, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return IdReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return IdWriter(self.options["path"])


class IdWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}.s8b"
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        file = None
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                names, ids = batch.column("doc_id"), batch.column("ids")
                if file is None:
                    file = IdFileWriter(out, names.type)
                sizes = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in ids], np.int64)
                flat = b"".join(x.as_buffer() for x in ids if x.is_valid)
                file.add(names, sizes, np.frombuffer(flat, "<u4"))
            n_docs, n_ids = (file or IdFileWriter(out, pa.int64())).close()
        return Written(part, name, n_docs, n_ids)

    def commit(self, messages: list[Written | None]) -> None:
        files, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            if m.n_docs:
                files.append({"name": m.name, "start": start, "docs": m.n_docs, "ids": m.n_ids})
            start += m.n_ids
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"ids": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{folder}/{m.name}")


class IdReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, folder = _place(self.path)
        with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
            found = json.loads(f.read())
        return [OneFile(f"{self.path}/{x['name']}", x["start"]) for x in found["files"]]

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, OneFile):
            return
        file = IdFile(partition.path)
        names = file.documents.column("doc_id").combine_chunks()
        starts = file.documents.column("start").to_numpy()
        sizes = file.documents.column("n_tokens").to_numpy()
        low = 0
        while low < len(sizes):
            # documents of about 16 blocks at a time
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + 16 * BLOCK)))
            ids = file.ids(int(starts[low]), int(starts[high - 1] + sizes[high - 1]))
            ends = np.cumsum(sizes[low:high])
            flat = ids.astype("<u4").tobytes()
            cut = [flat[4 * (e - s):4 * e] for e, s in zip(ends, sizes[low:high])]
            yield pa.RecordBatch.from_arrays(
                [names[low:high], pa.array(starts[low:high] + partition.start),
                 pa.array(cut, pa.binary())], ["doc_id", "start", "ids"],
            )
            low = high
        file.close()


def write_ids(rows: DataFrame, path: str) -> None:
    """(doc_id, ids: little-endian unsigned 32-bit) to files below ``path``, in the order of the
    partitions and of the rows in them. What stood there before no longer counts."""
    rows.sparkSession.dataSource.register(IdSource)
    rows.select("doc_id", "ids").write.format("simple8b").mode("append").save(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) as written; ``start`` counts the ids of all documents before."""
    spark.dataSource.register(IdSource)
    return spark.read.format("simple8b").option("idtype", id_type).load(path)


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text), sorted by id over all partitions, nulls first. Rows that share an id, or
    have none, are ordered by a hash of their text and may lie in several partitions."""
    rows = docs.select("doc_id", filled(F.col("text")).alias("text"))
    keyed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_s", F.spark_partition_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_s")]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to (doc_id, ids), ``end_id`` last. Null text is the empty text. The
    vocabulary's added tokens in a text get their own ids, as its library gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for low, high in _slices(texts):
                ids = []
                for row in range(low, high):
                    # the encoder ends every text with an id of its own
                    found = encode(texts[row].as_py(), tokenizer)
                    found[-1] = end_id
                    ids.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(ids, pa.binary())], ["doc_id", "ids"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def store_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> DataFrame:
    """All documents as id files below ``path``, in ascending order of their ids, and the rows
    (doc_id, start, ids) read back from there.

    Null text is the empty text: its end id alone. Null ids come first; repeated rows are written
    one by one; an empty table gives no file and no row; other columns are ignored.
    """
    write_ids(token_ids(ordered(docs), tokenizer, end_id), path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_ids(docs.sparkSession, path, kind)
