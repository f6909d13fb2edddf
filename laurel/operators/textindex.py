"""A stored text index, and exact top-k search over it.

Two tables are written once. ``docs`` has one row per document: its distinct terms with counts and
the cells of its hashed vector. ``blocks`` is the inverted side: documents are dealt to buckets of
about ``BUCKET_DOCS``, and a block holds one term's documents of one bucket with their BM25 gains and
the largest of them. Blocks lie in folders by a hash of the term, sorted by term, so that a query reads
only the folders, and there the row groups, of its own terms. Terms are 64-bit hashes.

``bm25_top`` ends early and safely: the sum of a bucket's largest gains bounds every score in it, and
buckets whose bound is below a score that ``k`` documents are known to reach are never opened.
``fused_top`` fuses both rankings without ranking all documents, see there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.functions.text import TOKEN_CODES, tokenize
from laurel.operators.ranking import SCORE_UNITS, fuse_scores, rrf_credit, score_key, top_k
from laurel.operators.retrieval import EMBEDDING_DIM
from laurel.session import cut_lineage, materialise, shuffles_removed

BUCKET_DOCS = 256
SHARDS = 64
#: tasks that write one folder of blocks: a term in every document is not written by one
SPLITS = 8
#: distinct terms up to which a search names them in its filter
NAMED_TERMS = 4096
#: of these, the number up to which each is compared, so that row groups without them are not read
COMPARED_TERMS = 100
#: queries scored in one pass: bounds what is shipped to a task and held there
QUERY_BLOCK = 512
#: documents scored at a time
DOC_BLOCK = 1024


@dataclass
class TextIndex:
    """``docs``: id, bucket, length, terms, tfs, cells, sums. ``blocks``: shard, term, bucket, top,
    n, docs (id, gain). ``terms``: term, df. ``stats``: n_docs, avgdl, k1, b, code, dim."""

    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


# --- writing --------------------------------------------------------------------------


def folded(docs: DataFrame, id_col: str, text_col: str, code: str = "crc32",
           dim: int = EMBEDDING_DIM) -> DataFrame:
    """(id, length, terms, tfs, cells, sums): each text cut once; distinct term hashes in ascending
    order with counts, and the non-zero cells of the signed token counts. No shuffle."""

    def coded(word: Column) -> Column:
        return F.struct(F.xxhash64(word).alias("t"), TOKEN_CODES[code](word).alias("h"))

    def token(x: Column) -> Column:
        positive = F.shiftright(x["h"], 20).bitwiseAND(F.lit(1)) == 1
        cell = (F.pmod(x["h"], F.lit(dim)) + 1).cast("int")
        return F.struct(x["t"].alias("t"), F.when(positive, cell).otherwise(-cell).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            sizes = np.asarray(tokens.value_lengths().fill_null(0))
            flat = tokens.flatten()
            term, cell = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.cumsum(sizes)
            out = [[], [], [], []]
            for low, high in zip(ends - sizes, ends):
                terms, counts = np.unique(term[low:high], return_counts=True)
                signed = cell[low:high]
                sums = np.bincount(np.abs(signed) - 1, np.sign(signed), dim) if high > low else np.zeros(dim)
                some = np.nonzero(sums)[0]
                for values, column in zip((terms, counts, some, sums[some]), out):
                    column.append(values)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 *(_lists(x, k) for x, k in zip(out, kinds))],
                [id_col, "length", "terms", "tfs", "cells", "sums"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    # two steps, so that the code is computed once per token
    tokens = F.transform(F.transform(tokenize(F.col(text_col)), coded), token)
    return docs.select(id_col, tokens.alias("_t")).mapInArrow(
        run, f"`{id_col}` {kind}, length long, terms array<long>, tfs array<int>, "
        "cells array<int>, sums array<int>"
    )


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str, k1: float = 1.5,
                b: float = 0.75, code: str = "crc32", dim: int = EMBEDDING_DIM) -> TextIndex:
    """Index (id, text) below ``path``. Ids are unique; a null text is an empty one, and an empty
    document is in no block. One shuffle brings buckets together, one brings terms together."""
    c = F.col
    spark = docs.sparkSession
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    buckets = F.greatest(F.ceil(n_docs / F.lit(BUCKET_DOCS)), F.lit(1))
    dealt = folded(docs, id_col, text_col, code, dim).withColumnRenamed(id_col, "id").withColumn(
        "bucket", F.pmod(F.xxhash64("id"), buckets)
    )
    dealt.write.mode("overwrite").parquet(f"{path}/docs")
    rows = spark.read.parquet(f"{path}/docs")
    rows.agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"),
    ).withColumns({
        "k1": F.lit(float(k1)), "b": F.lit(float(b)), "code": F.lit(code), "dim": F.lit(dim),
    }).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    avgdl = spark.read.parquet(f"{path}/stats").select("avgdl").scalar()
    tf = c("p.tfs")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * c("length") / avgdl)
    gains = rows.select("id", "bucket", "length", "terms", "tfs").repartition("bucket").select(
        "id", "bucket", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    ).select("bucket", c("p.terms").alias("term"), F.struct(
        "id", (tf * F.lit(k1 + 1) / (tf + norm)).alias("gain")
    ).alias("d"))
    blocks = gains.groupBy("bucket", "term").agg(
        F.max("d.gain").alias("top"), F.count(F.lit(1)).alias("n"), F.collect_list("d").alias("docs")
    ).withColumn("shard", F.pmod("term", F.lit(SHARDS)).cast("int"))
    # a list of ids and one of gains move with less than a list of pairs
    moved = blocks.withColumns({"_id": c("docs.id"), "_gain": c("docs.gain")}).drop("docs").repartition(
        "shard", F.pmod(F.xxhash64("bucket"), F.lit(SPLITS))
    ).sortWithinPartitions("shard", "term", "bucket")
    with shuffles_removed(spark):
        moved.select(
            "bucket", "term", "top", "n",
            F.arrays_zip(c("_id").alias("id"), c("_gain").alias("gain")).alias("docs"), "shard",
        ).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
        _blocks(spark, path).groupBy("shard", "term").agg(F.sum("n").alias("df")).write.mode(
            "overwrite"
        ).parquet(f"{path}/terms")
    return read_index(spark, path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    # an index without documents has no folder to take the types from
    id_type = spark.read.parquet(f"{path}/docs").schema["id"].dataType.simpleString()
    return spark.read.schema(
        "term long, bucket long, top double, n long, "
        f"docs array<struct<id: {id_type}, gain: double>>, shard int"
    ).parquet(f"{path}/blocks")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    terms = spark.read.schema("shard int, term long, df long").parquet(f"{path}/terms")
    return TextIndex(
        spark.read.parquet(f"{path}/docs"), _blocks(spark, path), terms,
        spark.read.parquet(f"{path}/stats"),
    )


# --- BM25 -----------------------------------------------------------------------------


def _of_terms(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked terms. Up to ``NAMED_TERMS`` of them are named, so that folders, and up to
    ``COMPARED_TERMS`` row groups, of other terms are not read; beyond that the join alone selects."""
    few = asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()
    if len(few) <= NAMED_TERMS:
        terms = sorted(r.term for r in few)
        shards = sorted({t % SHARDS for t in terms})
        rows = rows.filter(F.col("shard").isin(shards))
        if len(terms) > COMPARED_TERMS:
            # a filter of thousands of values overflows the planner's stack, or compares each row
            # with each of them; that many terms stand in most row groups anyway
            return rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        # a list of more than ten values would reach the files as one wide range
        named = [F.col("term").isin(list(part)) for part in batched(terms, 10)]
        rows = rows.filter(reduce(lambda x, y: x | y, named, F.lit(False)))
    return rows


def asked_terms(index: TextIndex, queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """(query id, term, idf) of the terms that the index knows: a small table, written once."""
    asked = cut_lineage(queries.select(
        query_id, F.explode(F.array_distinct(tokenize(F.col(text_col)))).alias("_w")
    ).select(query_id, F.xxhash64("_w").alias("term")))
    n = index.stats.select("n_docs").scalar()
    df = F.col("df")
    return cut_lineage(
        asked.join(_of_terms(index.terms, asked).select("term", "df"), "term").select(
            query_id, "term", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf")
        )
    )


def bm25_top(index: TextIndex, queries: DataFrame, query_id: str, text_col: str, k: int = 20,
             first: int = 4) -> DataFrame:
    """(query id, id, score, rank from 1): the best ``k`` documents of each query, exactly; fewer if
    fewer match. ``first``: buckets opened to learn what score ``k`` documents reach."""
    c = F.col
    asked = asked_terms(index, queries, query_id, text_col)
    blocks = _of_terms(index.blocks, asked)
    bounds = cut_lineage(
        blocks.select("term", "bucket", "top").join(asked, "term")
        .groupBy(query_id, "bucket").agg(F.sum(c("idf") * c("top")).alias("bound"))
    )
    opened = cut_lineage(top_k(bounds, first, [c("bound").desc(), c("bucket")], query_id, "_at"))

    def of_buckets(places: DataFrame) -> DataFrame:
        return places.groupBy("bucket").agg(F.collect_set(query_id).alias("_open"))

    def scores(opened: DataFrame) -> DataFrame:
        """From blocks (term, bucket, docs, queries that open the bucket), all of a bucket in one task: a
        document is in one bucket, so that its pairs are added up there and do not move."""
        return opened.join(F.broadcast(asked), "term").filter(
            F.array_contains("_open", c(query_id))
        ).select(query_id, "bucket", "idf", F.explode("docs").alias("d")).groupBy(
            query_id, "bucket", c("d.id").alias("id")
        ).agg(F.sum(c("idf") * c("d.gain")).alias("score")).drop("bucket")

    def best(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_key", score_key(c("score")))
        return top_k(keyed, k, [c("_key").desc(), c("id")], query_id)

    some = blocks.select("term", "bucket", "docs")
    early = cut_lineage(best(scores(
        some.join(F.broadcast(of_buckets(opened)), "bucket").repartition("bucket")
    )))
    reached = early.filter(c("rank") == k).select(query_id, c("_key").alias("_least"))
    rest = bounds.join(opened.select(query_id, "bucket"), [query_id, "bucket"], "left_anti").join(
        reached, query_id, "left"
    ).filter(c("_least").isNull() | (score_key(c("bound")) >= c("_least")))
    late = scores(some.repartition("bucket").join(of_buckets(rest), "bucket")).withColumn(
        "_key", score_key(c("score"))
    )
    return best(early.drop("rank", "_key").unionByName(late.drop("_key"))).filter(
        c("_key") > 0
    ).drop("_key")


# --- both rankings at once ------------------------------------------------------------


class _Questions:
    """A block of queries as the tasks need it."""

    def __init__(self, rows: list, n_docs: int, stats, dim: int) -> None:
        self.ids = [r[0] for r in rows]
        self.k1, self.b, self.avgdl, self.dim = stats.k1, stats.b, stats.avgdl or 1.0, dim
        # terms in order; the queries of term i are ``who[first[i]:first[i + 1]]``
        pairs = sorted((t.term, q, t.idf) for q, r in enumerate(rows) for t in r["known"] or ())
        terms = np.array([p[0] for p in pairs], np.int64)
        self.terms, start = np.unique(terms, return_index=True)
        self.first = np.append(start, len(pairs))
        self.who = np.array([p[1] for p in pairs], np.int64)
        self.idf = np.array([p[2] for p in pairs])
        self.vectors = np.zeros((len(rows), dim))
        for q, r in enumerate(rows):
            self.vectors[q, r["cells"]] = r["sums"]
        self.vectors = _unit(self.vectors)

    def keys(self, batch: pa.RecordBatch) -> np.ndarray:
        """(2, documents, queries) scores in units: BM25, cosine."""
        n, width = batch.num_rows, len(self.ids)
        length = batch.column(1).to_numpy(zero_copy_only=False)
        terms, tfs, cells, sums = (batch.column(i) for i in range(2, 6))
        row = np.repeat(np.arange(n), np.asarray(terms.value_lengths()))
        term, tf = np.asarray(terms.flatten()), np.asarray(tfs.flatten()).astype(float)
        at = np.searchsorted(self.terms, term)
        hit = np.nonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == term)[0] if len(
            self.terms) else np.zeros(0, np.int64)
        row, tf, at = row[hit], tf[hit], at[hit]
        norm = self.k1 * (1 - self.b + self.b * length[row] / self.avgdl)
        gain = tf * (self.k1 + 1) / (tf + norm)
        # a term counts for every query that has it
        times = self.first[at + 1] - self.first[at]
        spread = np.repeat(np.arange(len(at)), times)
        step = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
        asked = self.first[at][spread] + step
        bm25 = np.bincount(
            row[spread] * width + self.who[asked], gain[spread] * self.idf[asked], n * width
        ).reshape(n, width)
        vectors = np.zeros((n, self.dim))
        vectors[np.repeat(np.arange(n), np.asarray(cells.value_lengths())),
                np.asarray(cells.flatten())] = np.asarray(sums.flatten())
        cosine = _unit(vectors) @ self.vectors.T
        return np.floor(np.stack([bm25, cosine]) * SCORE_UNITS + 0.5).astype(np.int64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, DOC_BLOCK):
            yield batch.slice(low, DOC_BLOCK)


def fused_top(index: TextIndex, queries: DataFrame, query_id: str, text_col: str, k: int = 20,
              credit: int = 60) -> DataFrame:
    """(query id, id, bm25_rank, cosine_rank, retrieval_score, rank): the best ``k`` documents of each
    query by the reciprocal ranks of both lists, exactly, as ``retrieval_scores`` would score them.

    No table of pairs arises and nothing is sorted as a whole. The k-th best document of one list has
    a credit of 1 / (credit + k), so a document of the fused ``k`` has a rank of at most credit + 2 k
    in one of them. A first pass keeps that many of each list; a second counts how many documents
    stand before those candidates in the other list. Documents are scored where they are, and a batch
    gives out its own best, or its counts per candidate. Queries are taken ``QUERY_BLOCK`` at a time.

    Ranks count from 1 and are null where the list gives no credit. Documents without any credit are
    not returned; a query without known terms is matched by its vector alone.
    """
    spark = queries.sparkSession
    stats = index.stats.first()
    asked = asked_terms(index, queries, query_id, text_col)
    known = asked.groupBy(query_id).agg(F.collect_list(F.struct("term", "idf")).alias("known"))
    prepared = folded(queries, query_id, text_col, stats.code, stats.dim).select(
        query_id, "cells", "sums"
    ).join(known, query_id, "left")
    found = None
    for rows in batched(cut_lineage(prepared).toLocalIterator(), QUERY_BLOCK):
        part = _fused_block(index, queries, query_id, text_col, list(rows), stats, k, credit)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = T.StructType([
            queries.schema[query_id], T.StructField("id", index.docs.schema["id"].dataType),
            T.StructField("bm25_rank", T.LongType()), T.StructField("cosine_rank", T.LongType()),
            T.StructField("retrieval_score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
        ])
        return spark.createDataFrame([], kind)
    return found


def _fused_block(index, queries, query_id, text_col, rows, stats, k, credit) -> DataFrame:
    c = F.col
    spark = queries.sparkSession
    docs = index.docs.select("id", "length", "terms", "tfs", "cells", "sums")
    shipped = spark.sparkContext.broadcast(_Questions(rows, stats.n_docs, stats, stats.dim))
    most = credit + 2 * k + 1
    id_type = index.docs.schema["id"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        for batch in _slices(batches):
            keys = asked.keys(batch)
            for side in (0, 1):
                own = keys[side]
                least = np.ones(own.shape[1], np.int64)
                if len(own) > most:
                    least = np.maximum(np.partition(own, len(own) - most, axis=0)[len(own) - most], 1)
                row, col = np.nonzero(own >= least)
                yield pa.RecordBatch.from_arrays([
                    pa.array(col, pa.int32()), batch.column(0).take(pa.array(row)),
                    pa.array(np.full(len(row), side), pa.int32()),
                    *(pa.array(keys[s][row, col]) for s in (0, 1)),
                ], ["q", "id", "side", "key0", "key1"])
            credited = (keys > 0).any(axis=0).sum(axis=0)
            width = len(credited)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(width), pa.int32()), pa.nulls(width, batch.column(0).type),
                pa.array(np.full(width, 2), pa.int32()), pa.array(credited.astype(np.int64)),
                pa.array(np.zeros(width, np.int64)),
            ], ["q", "id", "side", "key0", "key1"])

    first = docs.mapInArrow(best, f"q int, id {id_type}, side int, key0 long, key1 long")
    # both kinds of rows come from one pass: counts are added up, lists are cut
    folded_ = first.withColumn("_g", F.struct("q", "side")).withColumn(
        "_key", F.when(c("side") == 0, c("key0")).when(c("side") == 1, c("key1"))
    )
    kept = materialise(folded_, "fusion")
    lists = cut_lineage(top_k(
        kept.filter("side < 2"), most, [c("_key").desc(), c("id")], "_g", "place"
    ).select("q", "id", "side", "key0", "key1", c("place").cast("bigint").alias("place")))
    credited = kept.filter("side = 2").groupBy("q").agg(F.sum("key0").alias("credited"))

    # candidates whose rank in the other list is not known yet: at most two lists per query
    pairs = lists.groupBy("q", "id").agg(
        F.max("key0").alias("key0"), F.max("key1").alias("key1"),
        *[F.max(F.when(c("side") == s, c("place"))).alias(f"rank{s}") for s in (0, 1)],
    )
    open_ = [
        pairs.filter((c(f"key{s}") > 0) & c(f"rank{s}").isNull()).select(
            "q", F.lit(s).alias("side"), c(f"key{s}").alias("key"), "id"
        ) for s in (0, 1)
    ]
    wanted = {}
    for r in open_[0].unionByName(open_[1]).toLocalIterator():
        wanted.setdefault((r.q, r.side), []).append((-r.key, r.id))
    marks = spark.sparkContext.broadcast({
        place: (np.array([x[0] for x in sorted(found)]), [x[1] for x in sorted(found)])
        for place, found in wanted.items()
    })

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, thresholds = shipped.value, marks.value
        counts = {place: np.zeros(len(x[1]) + 1, np.int64) for place, x in thresholds.items()}
        for batch in _slices(batches):
            keys = asked.keys(batch)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for (q, side), (limits, names) in thresholds.items():
                own = -keys[side][:, q]
                # the first candidate that a document stands before
                slot = np.searchsorted(limits, own, "left")
                tied = np.nonzero(limits[np.minimum(slot, len(limits) - 1)] == own)[0]
                for key in np.unique(own[tied]):
                    low, high = np.searchsorted(limits, key, "left"), np.searchsorted(limits, key, "right")
                    same = tied[own[tied] == key]
                    slot[same] = low + np.searchsorted(
                        np.array(names[low:high], ids.dtype), ids[same], "right"
                    )
                counts[q, side] += np.bincount(slot, minlength=len(names) + 1)
        cells = [(q, side, at, int(n)) for (q, side), x in counts.items() for at, n in enumerate(x[:-1])
                 if n]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[i] for x in cells], kind)
            for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))
        ], ["q", "side", "at", "n"])

    order = Window.partitionBy("q", "side").orderBy((-c("key")).asc(), "id")
    numbered = open_[0].unionByName(open_[1]).withColumn("at", F.row_number().over(order) - 1)
    before = docs.mapInArrow(ahead, "q int, side int, at int, n long").groupBy("q", "side", "at").agg(
        F.sum("n").alias("n")
    )
    running = Window.partitionBy("q", "side").orderBy("at")
    ranks = numbered.join(before, ["q", "side", "at"], "left").withColumn(
        "_rank", F.sum(F.coalesce("n", F.lit(0))).over(running) + 1
    ).groupBy("q", "id").agg(
        *[F.max(F.when(c("side") == s, c("_rank"))).alias(f"far{s}") for s in (0, 1)]
    )
    one = [F.coalesce(rrf_credit(F.coalesce(f"rank{s}", f"far{s}") - 1, credit), F.lit(0.0))
           for s in (0, 1)]
    credits = cut_lineage(pairs.join(ranks, ["q", "id"], "left").select(
        "q", "id", F.coalesce("rank0", "far0").alias("bm25_rank"),
        F.coalesce("rank1", "far1").alias("cosine_rank"), (one[0] + one[1]).alias("credit"),
    ))
    names = _names(spark, queries, query_id, rows)
    bounds = credits.groupBy("q").agg(F.max("credit").alias("_hi")).join(credited, "q").withColumn(
        "_lo", F.lit(0.0)
    )
    full = [r.q for r in credited.filter(c("credited") >= F.lit(stats.n_docs)).collect()]
    if full:
        # every document has credit: then the least one is no longer 0, and all must be ranked
        least = _least_credit(index, full, shipped, id_type, credit)
        bounds = bounds.drop("_lo").join(least, "q", "left").withColumn(
            "_lo", F.coalesce("_lo", F.lit(0.0))
        )
    spread = c("_hi") - c("_lo")
    scored = credits.join(bounds, "q").join(names, "q").select(
        query_id, "id", "bm25_rank", "cosine_rank",
        F.when(spread < 1e-12, F.lit(0.0)).otherwise((c("credit") - c("_lo")) / spread)
        .alias("retrieval_score"),
    )
    keyed = scored.withColumn("_key", score_key(c("retrieval_score")))
    return top_k(keyed, k, [c("_key").desc(), c("id")], query_id).drop("_key")


def _names(spark: SparkSession, queries: DataFrame, query_id: str, rows: list) -> DataFrame:
    kind = T.StructType([T.StructField("q", T.IntegerType()), queries.schema[query_id]])
    return spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], kind)


def _least_credit(index, wanted: list[int], shipped, id_type: str, credit: int) -> DataFrame:
    """(q, _lo) of queries that give every document credit, by ranking all of theirs."""
    docs = index.docs.select("id", "length", "terms", "tfs", "cells", "sums")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.array(wanted)
        for batch in _slices(batches):
            keys = shipped.value.keys(batch)[:, :, columns]
            row = np.repeat(np.arange(batch.num_rows), len(columns))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(columns, batch.num_rows), pa.int32()),
                batch.column(0).take(pa.array(row)),
                *(pa.array(keys[s].ravel() / SCORE_UNITS) for s in (0, 1)),
            ], ["q", "id", "s0", "s1"])

    both = docs.mapInArrow(pairs, f"q int, id {id_type}, s0 double, s1 double")
    lists = [both.select("q", "id", F.col(f"s{s}").alias("score")) for s in (0, 1)]
    return fuse_scores(lists, "id", "q", credit).groupBy("q").agg(F.min("credit").alias("_lo"))
