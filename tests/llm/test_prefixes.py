from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from laurel.llm import prefixes, queries, statements

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The contract, conversation by conversation."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        # the remainder has the sign of c, as in SQL
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)

    def size(path):
        return len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0

    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(ids) - 1) * size(path)
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if whole[c] == path)
        out.append((
            ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), kids[path],
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def conversations(seed, n, start=0):
    """Few openings and answers, so that prefixes repeat; whole copies; gaps; empty texts."""
    rng = random.Random(seed)
    rows = []
    copied = [(i, "user", rng.choice("ab") * (i + 1)) for i in range(4)]
    for c in range(start, start + n):
        if rng.random() < 0.1:
            continue
        if rng.random() < 0.4:
            rows += [(c, i, r, t) for i, r, t in copied]
            continue
        for i in range(rng.randint(1, 6)):
            text = rng.choice(["", None, "x", "x y", "y\tz  w", " ", "é x", f"only {c}"])
            rows.append((c, rng.choice([i, i, i, None]), rng.choice(["user", "assistant", None]), text))
    # turns of one conversation that tie are the same turn: their order says nothing
    seen = {}
    return [seen.setdefault((r[0], r[1]), r) for r in rows]


def found(spark, rows, shard):
    df = spark.createDataFrame(rows, TURNS)
    got = prefixes.with_end_digests(prefixes.trie(prefixes.rebuilt(df), shard))
    return sorted(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
         r.saved_tokens, r.ends_sha256) for r in got.collect()
    )


@pytest.mark.parametrize("seed,shard", [(1, 1), (2, 3), (3, 7), (4, 4096)])
def test_against_brute_force(spark, seed, shard):
    rows = conversations(seed, 90) + conversations(seed + 50, 30, -40)
    assert found(spark, rows, shard) == brute(rows)


def test_one_opening_in_all_conversations(spark):
    rows = [(c, i, "user", "same" if i < 5 else f"own {c % 3}") for c in range(150) for i in range(7)]
    for shard in (10, 64):
        assert found(spark, rows, shard) == brute(rows)


def test_long_conversations(spark):
    rows = [(c, i, "user", f"t {i}") for c in (20, 21, 25) for i in range(1500)]
    rows += [(c, i, "user", f"t {i}") for c in (22, 26) for i in range(900)]
    got = found(spark, rows, 2)
    assert len(got) == 1501
    by_depth = {r[1]: r for r in got}
    assert by_depth[0][3] == by_depth[900][3] == 5 and by_depth[901][3] == 3
    assert by_depth[1400][4:6] == (1, 1) and by_depth[1500][4:6] == (0, 1)
    assert by_depth[0][6] == 2 * (900 * 4 + 600 * 2) and by_depth[1500][6] == 4
    assert by_depth[900][7] == hashlib.sha256(b"22,26").hexdigest()


def test_shards_have_a_bounded_number_of_members(spark):
    rows = spark.range(1000).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'t' AS text")
    parts = prefixes.shard_parts(prefixes.rebuilt(rows), 100)
    assert parts.selectExpr("max(n_convs)").first()[0] <= 100
    assert parts.selectExpr("max(size(ends))").first()[0] <= 100


def test_edges(spark):
    assert found(spark, [], 5) == []
    # conversations whose family head is absent and whose own turns are all given up: only the root
    lost = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "a") for c in lost]
    assert found(spark, rows, 5) == brute(rows) and len(brute(rows)) == 1
    rows = [(None, 0, "user", "a"), (20, None, None, None), (20, 5, "user", "b"), (20, 5, "user", "b")]
    assert found(spark, rows, 5) == brute(rows)
    extra = spark.createDataFrame(rows, TURNS).selectExpr(
        "*", "1 AS path", "2 AS words", "3 AS base", "4 AS t", "5 AS node"
    )
    got = prefixes.with_end_digests(prefixes.trie(prefixes.rebuilt(extra)))
    assert got.count() == len(brute(rows))


def test_query_and_sql(spark, tmp_path):
    rows = conversations(9, 120)
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, TURNS).write.parquet(folder)
    got = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/*.parquet'")
    want = con.execute(statements.PREFIXES).fetchall()
    key = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want)) == sorted(map(key, brute(rows)))
