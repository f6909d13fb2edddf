"""Quality rules: counted text rules, then a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed word 1- and 2-grams: the trusted target
(documents labelled good) and the raw corpus (all documents). A document's score is the mean
log ratio of its n-grams, so it does not grow with length, and every document meets the same
fixed threshold. All of it is built-in expressions: counts are kept per hash bucket (a fixed
number), summed before the shuffle, and the finished table of ``2**bits`` numbers is a scalar
subquery that each task reads by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.words import filled, words

BITS = 14
#: a document whose mean log ratio is below this is rejected
THRESHOLD = -0.1
SYMBOLS = "[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50


def _repeated(tokens: Column, hashes: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Windows are sorted by (hash, start), so that the starts of equal windows are neighbours;
    the repeated starts, sorted again, give the covered words without comparing pairs.
    """
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    # the sorted array is bound once, as the variable of a one-element transform
    def count(k: Column) -> Column:
        hit = F.filter(k, lambda x, j: (
            F.coalesce(F.get(k, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(k, j + 1)["h"] == x["h"], F.lit(False))
        ))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            F.sort_array(F.transform(hit, lambda x: x["i"])), start,
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        )

    return F.get(F.transform(F.array(keyed), count), F.lit(0))


def text_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_words`` (the words), the counts and ``base_failed`` to every row."""
    w, body = F.col("_words"), filled(F.col(text))
    windows = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)),
    )
    return docs.withColumn("_words", words(F.col(text))).withColumns({
        "_windows": windows,
        "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(NOT_SPACE)),
    }).withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("bigint")
        ).otherwise(_repeated(w, F.col("_windows"))),
    }).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ).drop("_windows", "_lines")


def ngram_buckets(tokens: Column, word: Column, at: Column, bits: int = BITS
                  ) -> tuple[Column, Column]:
    """Buckets of the 1-gram and of the 2-gram that start at one word (null at the last)."""
    mask = F.lit((1 << bits) - 1)
    following = F.get(tokens, at + 1)
    one, two = F.xxhash64(word), F.xxhash64(word, following)
    return (
        one.bitwiseAND(mask).cast("int"),
        F.when(following.isNotNull(), two.bitwiseAND(mask).cast("int")),
    )


def bucket_log_ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> Column:
    """The array of ``2**bits`` log ratios target : raw, as a scalar subquery.

    ``docs`` (doc_id, _words) is the whole raw corpus; ``trusted`` (doc_id) names at most
    ``TRUSTED_ROWS`` rows of it, which bounds what is replicated. Both counts start at one.
    """
    n = 1 << bits
    flagged = docs.select("doc_id", "_words").join(
        F.broadcast(trusted.select(F.col("doc_id").alias("_t")).distinct()),
        F.col("doc_id") == F.col("_t"), "left",
    )
    starts = flagged.select(
        F.col("_t").isNotNull().alias("good"), "_words", F.posexplode("_words").alias("i", "w")
    )
    grams = starts.select("good", F.explode(F.array(
        *ngram_buckets(F.col("_words"), F.col("w"), F.col("i"), bits)
    )).alias("b")).filter("b IS NOT NULL")
    counts = grams.groupBy("b").agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("good"), 1)).alias("good")
    )
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("b"))
    table = every.join(counts, "b", "left").select(
        "b", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"),
        (F.coalesce("good", F.lit(0)) + 1).alias("good"),
    )
    cells = table.agg(
        F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("c"),
        F.sum("raw").alias("r"), F.sum("good").alias("g"),
    )
    return cells.select(F.transform("c", lambda x: (
        F.log(x["good"] / F.col("g")) - F.log(x["raw"] / F.col("r"))
    ))).scalar()


def trusted_ids(labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """At most ``bound`` ids of documents labelled good: the bounded sample that the target
    is fitted on, the same whatever the partitioning."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS,
          trusted_bound: int = 20_000, text: str = "text") -> DataFrame:
    """Add the rule columns, ``score`` (mean log ratio) and ``kept`` to every document.

    Null text is the empty text: no words, score 0, ``base_failed``. Without any trusted
    document the target is flat and only the rules decide. Repeated rows are judged alike.
    """
    ruled = text_rules(docs, text)
    trusted = trusted_ids(labels, trusted_bound)
    ratios = bucket_log_ratios(
        docs.select("doc_id", words(F.col(text)).alias("_words")), trusted, bits
    )
    some = labels.filter("quality = 1").limit(1).agg(F.count(F.lit(1))).scalar()

    def ratio(word: Column, at: Column) -> Column:
        one, two = ngram_buckets(F.col("_words"), word, at, bits)
        r = F.col("_ratios")
        return F.get(r, one) + F.coalesce(F.get(r, two), F.lit(0.0))

    total = F.aggregate(F.transform("_words", ratio), F.lit(0.0), lambda a, b: a + b)
    n = F.greatest(2 * F.size("_words") - 1, F.lit(1))
    return ruled.withColumn("_ratios", ratios).withColumn(
        "score", F.when(some > 0, total / n).otherwise(0.0)
    ).withColumn(
        "kept", ~F.col("base_failed") & (F.round("score", 9) >= threshold)
    ).drop("_words", "_ratios")
