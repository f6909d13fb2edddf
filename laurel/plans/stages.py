"""Stages that are built once per content: reuse, renewal and removal.

A stage's result lies in a folder named by a key of everything it depends on: the stage's name, the
code of this package (so a changed constant or rule builds anew), its parameters, and the fingerprints
of its inputs. A finished folder carries a marker; one without it is the remains of a run that was
lost, and is built again. A new result of a stage removes the oldest ones beyond ``KEEP``.

The fingerprint of input files needs no reading while their length and time of change are those of
last time. Only files that look changed are read, each to an order-free hash of its rows; a file that
was merely written again keeps its hash, and nothing is rebuilt.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import laurel
from laurel.operators import scoring
from laurel.operators.features import DEFAULT_AS_OF
from laurel.operators.retrieval import retrieval_scores
from laurel.plans import build
from laurel.session import passing_tables, write_parquet
from laurel.sources.candidates import read_candidates
from laurel.sources.sinks import fingerprint, stage_key
from laurel.sources.tables import spread

#: results of one stage that stay
KEEP = 4
MARKER = "_STAGE"


@functools.cache
def code_key() -> str:
    """A hash of this package's source, without the training-text operators, which no stage uses."""
    root = Path(laurel.__file__).parent
    digest = hashlib.sha256()
    for file in sorted(root.rglob("*.py")):
        if "llm" not in file.relative_to(root).parts:
            digest.update(file.relative_to(root).as_posix().encode() + b"\0" + file.read_bytes())
    return digest.hexdigest()[:16]


class StageStore:
    """Stage results and input manifests below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.built: list[str] = []  # names of the stages that this store had to build

    # --- folders -----------------------------------------------------------------------

    def _at(self, path: str):
        """The Hadoop file system of a path, and the path for it."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _read(self, path: str) -> str | None:
        system, where = self._at(path)
        if not system.exists(where):
            return None
        rows = self.spark.read.text(path, wholetext=True).first()
        return rows.value if rows else ""

    def _write(self, path: str, text: str) -> None:
        system, where = self._at(path)
        out = system.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _files(self, path: str) -> dict[str, tuple[int, int]]:
        """Length and time of change of every data file at ``path``."""
        system, where = self._at(path)
        found = system.listFiles(where, True)
        out = {}
        while found.hasNext():
            status = found.next()
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                out[status.getPath().toString()] = (status.getLen(), status.getModificationTime())
        return out

    # --- inputs ------------------------------------------------------------------------

    def listed(self, path: str) -> str:
        """A fingerprint of files by name, length and time of change alone."""
        return stage_key(sorted((p, *seen) for p, seen in self._files(path).items()))

    def content(self, path: str, fmt: str = "parquet") -> str:
        """A fingerprint of the files' rows, whatever the order, names or times of the files. Only
        files whose length or time differs from the manifest's are read."""
        files = self._files(path)
        manifest = f"{self.root}/inputs/{stage_key(path, fmt)}.json"
        known = {p: (tuple(seen), h) for p, (seen, h) in json.loads(self._read(manifest) or "{}").items()}
        changed = sorted(p for p, seen in files.items() if known.get(p, (None,))[0] != seen)
        if changed or set(known) != set(files):
            fresh = self._hashes(changed, fmt) if changed else {}
            known = {p: (seen, fresh.get(p) or known[p][1]) for p, seen in files.items()}
            self._write(manifest, json.dumps(known))
        return stage_key(sorted(h for _, h in known.values()))

    def _hashes(self, paths: list[str], fmt: str) -> dict[str, str]:
        rows = self.spark.read.format(fmt).load(paths)
        own = rows.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in rows.columns]).alias("h"),
                          F.col("_metadata.file_path").alias("p"))
        # one row per file; a file without rows has none
        found = own.groupBy("p").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"),
            F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s"),
        ).collect()
        plain = lambda p: p.replace("file:///", "file:/")
        hashes = {plain(r.p): f"{r.n}:{r.x}:{r.s}" for r in found}
        return {p: hashes.get(plain(p), "0") for p in paths}

    # --- stages ------------------------------------------------------------------------

    def folder(self, name: str, make: Callable[[str], object], *inputs: object) -> str:
        """The folder of a stage's result, which ``make`` fills if there is none for these inputs."""
        path = f"{self.root}/{name}/{stage_key(name, code_key(), *inputs)}"
        if self._read(f"{path}/{MARKER}") is None:
            system, where = self._at(path)
            system.delete(where, True)
            with passing_tables(self.spark):
                make(path)
            self._write(f"{path}/{MARKER}", json.dumps({"name": name, "inputs": [str(i) for i in inputs]}))
            self.built.append(name)
            self._forget(name, path)
        return path

    def found(self, name: str, *inputs: object) -> DataFrame | None:
        """A stage's result for these inputs if it has been built."""
        path = f"{self.root}/{name}/{stage_key(name, code_key(), *inputs)}"
        return None if self._read(f"{path}/{MARKER}") is None else self.spark.read.parquet(path)

    def stage(self, name: str, make: Callable[[], DataFrame], *inputs: object) -> DataFrame:
        """A stage whose result is one table."""
        return self.spark.read.parquet(
            self.folder(name, lambda path: write_parquet(make(), path), *inputs))

    def _forget(self, name: str, current: str) -> None:
        system, where = self._at(f"{self.root}/{name}")
        done = sorted(system.listStatus(where), key=lambda s: -s.getModificationTime())
        others = [s.getPath() for s in done if s.getPath().getName() != current.rsplit("/", 1)[1]]
        for old in others[KEEP - 1:]:
            system.delete(old, True)


def build_stored(
    store: StageStore, candidates_path: str, jobs: DataFrame, as_of: dt.date = DEFAULT_AS_OF,
    code: str = "crc32", **reading: str,
) -> build.Scored:
    """The whole build by stages: matrix, retrieval, heads. With unchanged candidates and jobs nothing
    is built; new job texts build on the stored matrix."""
    spark = store.spark
    people = store.content(candidates_path, "text")
    asked = fingerprint(jobs).first()
    texts = ("corpus_text", "rerank_text")
    matrix = store.stage("matrix", lambda: build.gated_matrix(
        build.with_texts(read_candidates(spark, candidates_path, **reading)), as_of, keep=texts
    ), people, as_of, sorted(reading.items()))
    keys = (people, as_of, sorted(reading.items()), tuple(asked), code)
    retrieval = store.stage("retrieval", lambda: retrieval_scores(
        spread(matrix.select("candidate_id", "corpus_text")), jobs, "candidate_id", "corpus_text",
        "jd_id", "text", code=code,
    ), *keys)
    scored = build.per_job(scoring.with_fit(scoring.with_proxy_label(matrix)), jobs, retrieval)
    heads = store.stage("heads", lambda: build.head_scores(scored, matrix, jobs), *keys)
    return build.Scored(
        scoring.with_final_score(build.with_head_scores(scored, heads)), matrix
    )
