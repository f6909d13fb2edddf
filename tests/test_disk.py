"""What a query leaves on disk on its way to a stored result."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from laurel import session
from laurel.operators import retrieval
from laurel.plans import build
from laurel.plans.stages import StageStore


def left(root) -> dict[str, int]:
    out: dict[str, int] = {}
    for folder, _, names in os.walk(root):
        top = os.path.relpath(folder, root).split(os.sep)[0]
        out[top] = out.get(top, 0) + sum(os.path.getsize(os.path.join(folder, n)) for n in names)
    return out


def shuffled(spark) -> int:
    """Bytes of shuffle files of this session."""
    time.sleep(1)  # they go in the background
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(os.path.getsize(f.getPath()) for f in
               spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())
               if f.getName().startswith("shuffle_"))


def test_a_stage_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "passing"))
    docs = spark.range(300).select("id", F.concat(F.lit("tin drum w"), (F.col("id") % 9).cast("string")).alias("text"))
    asked = spark.createDataFrame([(1, "tin w3"), (2, "drum")], "qid long, question string")
    store = StageStore(spark, str(tmp_path / "stages"))
    found = store.stage("retrieval", lambda: retrieval.retrieval_scores(
        docs, asked, "id", "text", "qid", "question"))
    assert found.count() == 600
    assert not any(left(tmp_path / "passing").values())


def test_tables_written_outside_a_stage_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path / "passing"))
    kept = session.materialise(spark.range(5), "kept")
    with session.passing_tables(spark):
        gone = session.materialise(spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 5
    assert [n.split("-")[0] for n in os.listdir(tmp_path / "passing")] == ["kept"]


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.uuid().alias("x"))
    before, setting = shuffled(spark), spark.conf.get(session.CLEANUP, None)
    session.write_parquet(rows.repartition("k").groupBy("k").agg(F.max("x").alias("x")), str(tmp_path / "t"))
    assert shuffled(spark) <= before
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50_000
    assert spark.conf.get(session.CLEANUP, None) == setting


def test_texts_stay_where_they_are_for_a_head(spark, monkeypatch):
    class Seen(Exception):
        pass

    def lexical(texts, *_):
        raise Seen(texts._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(build, "lexical_scores", lexical)
    scored = spark.range(50).select(
        F.lit(1).alias("jd_id"), F.col("id").cast("string").alias("candidate_id"), F.lit(0).alias("is_honeypot"),
        (F.col("id") / 50.0).alias("proxy_label"))
    texts = spark.range(50).select(F.col("id").cast("string").alias("candidate_id"), F.lit("x").alias("rerank_text"))
    with pytest.raises(Seen) as seen:
        build.head_scores(scored, texts, None)
    assert "BroadcastHashJoin" in str(seen.value) and "Exchange hashpartitioning" not in str(seen.value)
