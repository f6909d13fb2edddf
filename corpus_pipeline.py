"""The corpus pipeline: documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last give
rows with the columns of ``docs``. Null texts are empty texts, null sources a source of their own;
further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import mixing, packing, pii, quality, simhash
from laurel.session import materialise

TOKENIZER = "byte_bpe_50k.json"


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the whole row as ``_row``, so that no name can clash."""
    return docs.select(*columns, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, every row judged by its own text: null and
    empty texts have too few words and go, repeated rows all stay or all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(_carried(docs, "doc_id", "text"), labels)
    # a filter would be pushed down and repeat the rules in its condition; this one is not
    return judged.select(F.inline(F.when(F.col("kept"), F.array("_row"))))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The carried rows with a ``_key`` of id and text, by which rows that share an id, or have
    none, are told apart."""
    name = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("none"))
    key = F.unhex(F.md5(F.concat(name, F.coalesce("text", F.lit("")))))
    return _carried(docs, "doc_id", "text", *columns).withColumn("_key", key)


def _others(docs: DataFrame) -> Column:
    """All columns but id and text as one text, by which rows of one key are put in order."""
    row = F.col("_row")
    return F.to_json(F.struct(*[row[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest id, or if none
    has an id, any one of a fixed order. Different texts under one id, or none, all stay. Of rows
    that repeat id and text the least by all other columns stays, whatever their order. Null text
    is the empty text; an empty table stays empty."""
    rows = _keyed(docs).withColumn("_others", _others(docs))
    kept = simhash.first_of_each(rows.select("doc_id", "text", "_key"), "_key")
    # what is left of a key is one id and text, repeated
    return rows.join(kept, "_key", "left_semi").groupBy("_key").agg(
        F.min_by("_row", "_others").alias("_row")
    ).select("_row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows the new text. Null text
    becomes the empty text; every row stays."""
    found = pii.find(_carried(docs, "text"))
    clean = found.withColumn("_clean", pii.redacted(F.col("text"), F.col("spans")))
    return clean.select(
        F.col("_row").withField("text", F.col("_clean"))
        .withField("n_chars", F.length("_clean").cast(docs.schema["n_chars"].dataType)).alias("_row")
    ).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that repeat id and text are drawn one by one,
    each by its own number of copies. Null source is a source of its own; null or blank text is
    never taken; an empty table stays empty."""
    # the rows are numbered once and read back, so that every use sees the same numbers; equal
    # draws go by content first
    key = F.md5(F.concat_ws(":", F.hex("_key"), _others(docs)))
    rows = materialise(
        _keyed(docs, "source").withColumn("_key", F.unhex(key))
        .withColumn("_nth", F.monotonically_increasing_id()), "numbered",
    )
    copies = mixing.mix(rows.drop("_row"), keep=("_key", "_nth")).filter("copies > 0").select(
        "_nth", F.col("copies").cast("int").alias("_n")
    )
    taken = rows.join(copies, "_nth")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all rows into sequences; null text is a separator alone."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: fingerprints, boosted trees and token ids cannot be stated in SQL; the tests state them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every stage is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
