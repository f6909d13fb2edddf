"""Order MinHash fingerprints: sketches that follow edit distance, not only shared content.

A text's k-mers of words are numbered by occurrence and hashed once. The hash range is cut into
``bins``; in every bin the ``per_bin`` smallest k-mers are taken, put back into text order, and
the tuple is hashed: one component. Two texts agree in a component if the same minimal k-mers
stand in the same order. Bins that hold nothing have no component.

All built-in expressions on arrays of longs, inside the row: (hash | position) in one long, so
that sorting is a primitive sort. Only pairing a document with its neighbour shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.words import filled, words
from laurel.operators.ranking import global_rank

K = 3
BINS = 64
#: the low bits of a packed long hold a position, which a string cannot exceed
POSITION = (1 << 31) - 1
#: neighbours are looked up inside runs of so many ids
RUN_BITS = 7


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~POSITION))


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(POSITION))


def _pack(hashed: Column, position: Column) -> Column:
    return _hash(hashed).bitwiseOR(position.cast("bigint"))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS.bit_length() + 1)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add ``name``: array of longs, one per filled bin: bin in the high half, tuple hash below.

    Null text is the empty text; a text without words has an empty array; one with fewer than k
    words has one k-mer of all its words. Equal texts have equal arrays.
    """
    t, p, o, v, s = (f"_{x}" for x in ("tokens", "packed", "numbered", "sorted", "smallest"))
    tokens = F.col(t)

    def kmer(w: Column, i: Column) -> Column:
        return _pack(F.xxhash64(w, *[F.get(tokens, i + j) for j in range(1, k)]), i)

    def changes(a: Column, j: Column, step: int, part) -> Column:
        """Whether entry j of a sorted array differs from the one ``step`` before it."""
        return (j < step) | (part(F.get(a, j)) != part(F.get(a, j - step)))

    packed = F.sort_array(F.slice(
        F.transform(tokens, kmer), F.lit(1),
        F.greatest(F.size(t) - (k - 1), F.least(F.size(t), F.lit(1))),
    ))
    plain = F.transform(p, lambda x: _pack(F.xxhash64(_hash(x), F.lit(0)), _position(x)))
    at = F.sequence(F.lit(0), F.size(p) - 1)
    starts = F.filter(at, lambda j: changes(F.col(p), j, 1, _hash))
    # a run of equal k-mers, in text order: its n-th entry is occurrence n
    runs = F.get(F.transform(F.array(starts), lambda b: F.flatten(F.transform(b, lambda at_, r: (
        F.transform(
            F.slice(F.col(p), at_ + 1, F.coalesce(F.get(b, r + 1), F.size(p)) - at_),
            lambda x, n: _pack(F.xxhash64(_hash(x), n), _position(x)),
        )
    )))), F.lit(0))
    distinct = F.size(F.array_distinct(F.transform(p, _hash))) == F.size(p)
    smallest = F.filter(v, lambda x, j: changes(F.col(v), j, 2, _bin))

    def component(x: Column, j: Column) -> Column:
        after = F.get(F.col(s), j + 1)
        pair = after.isNotNull() & (_bin(after) == _bin(x))
        lead = F.when(pair & (_position(after) < _position(x)), after).otherwise(x)
        last = F.when(pair & (_position(after) < _position(x)), x).when(pair, after)
        tuple_hash = F.xxhash64(_hash(lead), _hash(last)).bitwiseAND(F.lit((1 << 32) - 1))
        value = F.shiftleft(_bin(x), 32).bitwiseOR(tuple_hash)
        return F.when(changes(F.col(s), j, 1, _bin), value)

    return (
        df.withColumn(t, words(F.col(text)))
        .withColumn(p, packed)
        .withColumn(o, F.when(distinct, plain).otherwise(runs))
        .withColumn(v, F.sort_array(o))
        .withColumn(s, smallest)
        .withColumn(name, F.filter(F.transform(s, component), lambda x: x.isNotNull()))
        .drop(t, p, o, v, s)
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either text whose components agree; 1 for two empty ones."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ``mark``, and ``next_text``, ``next_mark`` of the document with the
    next smaller id (after the last: of the first). Null ids come last; they, and repeated ids, follow
    in the order of their text's hash.

    Ids are cut into runs of 128; inside a run the neighbour is the next row of a window. The
    last row of a run takes the first row of the next run that has rows: one row per run. Texts
    are dealt out once: the stated repartition is the same exchange for both uses.
    """
    # rows without an id stand in many runs of their own, after all others, by the hash of their text
    unnamed = F.lit(-(2**62)) - F.shiftright(F.xxhash64("text"), 44)
    run = F.coalesce(F.shiftright("doc_id", RUN_BITS), unnamed)
    order = Window.partitionBy("_run").orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    placed = docs.select("doc_id", "text", run.alias("_run")).repartition("_run")
    inside = placed.withColumns({
        "_after": F.lead("text").over(order), "_first": F.lag(F.lit(1)).over(order).isNull(),
    })
    marked = with_fingerprint(inside, "text", "mark").withColumn(
        "_mark_after", F.lead("mark").over(order)
    )
    firsts = inside.filter("_first").select(F.col("_run").alias("_at"), F.col("text").alias("_head"))
    ranked = global_rank(docs.select(run.alias("_run")).distinct(), [F.desc("_run")], name="_rank")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    links = ranked.select(F.col("_run").alias("_from"), ((F.col("_rank") + 1) % n).alias("_to"))
    heads = with_fingerprint(firsts, "_head", "_mark_head").join(
        ranked, F.col("_at") == F.col("_run")
    ).select("_rank", "_head", "_mark_head")
    after = links.join(heads, F.col("_to") == F.col("_rank")).select("_from", "_head", "_mark_head")
    return marked.join(after, F.col("_run") == F.col("_from"), "left").select(
        "doc_id", "text", "mark", F.coalesce("_after", "_head").alias("next_text"),
        F.coalesce("_mark_after", "_mark_head").alias("next_mark"),
    )


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its half replaced by the next document's, and likeness.

    Null text is the empty text; null and repeated ids are ordered as ``with_next`` says; an empty
    table gives an empty result; other columns are ignored.
    """
    base = docs.select("doc_id", filled(F.col("text")).alias("text"))
    paired = with_next(base)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    both = with_fingerprint(paired.withColumn("edited", edited), "edited", "edited_mark")
    return both.select(
        "doc_id", "text", "edited", "mark", "edited_mark",
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
