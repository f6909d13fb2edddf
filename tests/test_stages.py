"""Reuse of stages: what changes is built again, and nothing else."""

from __future__ import annotations

import json
import os
import time

import pytest
from conftest import profile, skill

from laurel.plans import build, stages


def people(numbers, title="Search Engineer"):
    return [profile(n, title=title, skills=[skill("BM25"), skill("Python"), skill("RAG")]) for n in numbers]


def write(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", people(range(1, 9)))
    write(tmp_path / "in" / "b.jsonl", people(range(20, 25), "Data Engineer"))
    return tmp_path


@pytest.fixture
def run(spark, folder):
    def go(text="bm25 ranking engineer"):
        store = stages.StageStore(spark, str(folder / "store"))
        jobs = spark.createDataFrame([(1, text)], "jd_id long, text string")
        scored = stages.build_stored(store, str(folder / "in"), jobs, signals_field="signals")
        rows = sorted((r["rank"], r["candidate_id"], r["score"]) for r in build.rank(scored, 100).collect())
        return store.built, rows

    return go


def test_only_what_changed_is_built(run, folder):
    assert run()[0] == ["matrix", "retrieval", "heads"]
    first = run()
    assert first[0] == []
    # new job text: the matrix stays
    other = run("python data platform")
    assert other[0] == ["retrieval", "heads"] and other[1] != first[1]
    # back to the first text: both results are still there
    assert run() == ([], first[1])
    # a file written again with its rows in another order: read, and nothing built
    write(folder / "in" / "a.jsonl", people(range(1, 9))[::-1])
    os.utime(folder / "in" / "a.jsonl", (time.time() + 50,) * 2)
    assert run() == ([], first[1])
    # a changed file: everything
    write(folder / "in" / "b.jsonl", people(range(20, 26), "Data Engineer"))
    changed = run()
    assert changed[0] == ["matrix", "retrieval", "heads"] and len(changed[1]) == len(first[1]) + 1


def test_unchanged_files_are_not_read(spark, folder, run, monkeypatch):
    run()
    asked = []
    hashes = stages.StageStore._hashes
    monkeypatch.setattr(stages.StageStore, "_hashes", lambda self, paths, fmt: (
        asked.extend(paths), hashes(self, paths, fmt))[1])
    store = stages.StageStore(spark, str(folder / "store"))
    before = store.content(str(folder / "in"), "text")
    assert asked == []
    write(folder / "in" / "c.jsonl", people([70]))
    assert store.content(str(folder / "in"), "text") != before
    assert [p.rsplit("/", 1)[1] for p in asked] == ["c.jsonl"]
    os.remove(folder / "in" / "c.jsonl")
    assert store.content(str(folder / "in"), "text") == before and len(asked) == 1


def test_a_changed_rule_builds_anew(run, monkeypatch):
    run()
    monkeypatch.setattr(stages, "code_key", lambda: "another version")
    assert run()[0] == ["matrix", "retrieval", "heads"]


def test_code_key_follows_the_source(tmp_path, monkeypatch):
    (tmp_path / "pkg" / "llm").mkdir(parents=True)
    source = tmp_path / "pkg" / "__init__.py"
    source.write_text("X = 1\n")
    monkeypatch.setattr(stages.laurel, "__file__", str(source))
    keys = []
    for text in ("X = 1\n", "X = 2\n", "X = 1\n"):
        source.write_text(text)
        keys.append(stages.code_key.__wrapped__())
        (tmp_path / "pkg" / "llm" / "other.py").write_text(text)
    assert keys[0] == keys[2] != keys[1]


def test_lost_and_stale_results(spark, tmp_path):
    store = stages.StageStore(spark, str(tmp_path / "s"))
    made = lambda n: store.stage("t", lambda: spark.range(n), n).count()
    assert made(3) == 3 and made(3) == 3 and store.built == ["t"]
    kept = [d for d in os.listdir(tmp_path / "s" / "t") if not d.startswith(".")]
    os.remove(tmp_path / "s" / "t" / kept[0] / stages.MARKER)
    assert made(3) == 3 and store.built == ["t", "t"]
    for n in range(4, 12):
        time.sleep(0.01)
        assert made(n) == n
    left = [d for d in os.listdir(tmp_path / "s" / "t") if not d.startswith(".")]
    assert len(left) == stages.KEEP
    assert made(11) == 11 and store.built.count("t") == 10
