from __future__ import annotations

from laurel.llm import chat
from pyspark.sql import functions as F

SCHEMA = "message_id string, parent_id string, role string, text string, score double"


def forest(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    """Best path per root by mean score, then leaf id."""
    nodes = {r[0]: r for r in rows}
    answered = {r[1] for r in rows if r[1] in nodes}
    best = {}
    for leaf in nodes:
        if leaf in answered:
            continue
        path, at, seen = [], leaf, set()
        while at in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[at][1]
        if at in seen:
            continue
        mean = sum(nodes[x][4] or 0.0 for x in path) / len(path)
        best.setdefault(path[-1], []).append((-mean, leaf, path[::-1]))
    return {root: sorted(found)[0][2] for root, found in best.items()}


def test_best_paths(spark):
    import random

    rng = random.Random(3)
    rows = [("r0", None, "user", "hi", 1.0)]
    for i in range(1, 150):
        parent = f"r{rng.randrange(i)}" if rng.random() < 0.95 else None
        rows.append((f"r{i}", parent, rng.choice(["user", "assistant"]), f"t{i}", rng.random()))
    rows += [(f"c{i}", f"c{i - 1}" if i else None, "user", "x", 0.5) for i in range(70)]
    rows += [("y1", "y2", "user", "cycle", 1.0), ("y2", "y1", "user", "cycle", 1.0),
             ("y3", "y2", "user", "on a cycle", 1.0), ("o", "missing", "user", "orphan", None)]
    got = {}
    for r in chat.best_branches(forest(spark, rows)).collect():
        got.setdefault(r.tree, []).append((-r.from_leaf, r.message_id))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == brute(rows)
    everything = chat.best_branches(forest(spark, rows), None)
    leaves = {r[0] for r in rows} - {r[1] for r in rows} - {"y3"}
    assert {r.leaf for r in everything.select("leaf").distinct().collect()} == leaves


def test_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\n", "<\\|x", "<\\\\|", "\\", "", None, "a\nb", "<|", "é<||>"]
    roles = ["user", "assistant", "a\nb", "x\\ny", "<|im_start|>", None, "", "\\", "assistant"]
    rows = [(f"{i:02}", f"{i - 1:02}" if i else None, roles[i], nasty[i], 1.0) for i in range(9)]
    out = chat.format_trees(forest(spark, rows))
    row = out.select(
        "n_turns", chat.parse(F.col("formatted")).alias("said"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("lost"),
    ).first()
    assert row.n_turns == 9
    assert [(x.role, x.text) for x in row.said] == [(r or "", t or "") for r, t in zip(roles, nasty)]
    assert row.lost == "<\\|x" + "é<||>"


def test_edges(spark):
    assert chat.format_trees(forest(spark, [])).count() == 0
    rows = [(None, None, "user", "alone", 1.0), (None, None, "user", "alone", 1.0),
            ("a", None, "user", "x", 1.0), ("a", None, "user", "x", 1.0)]
    extra = forest(spark, rows).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit(2))
    assert chat.format_trees(extra).count() == 3
