"""Headline timings. Prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run to a
no-op sink. ``build_matrix`` writes the gated feature matrix with texts; ``rank_stored``
ranks from stored matrix, retrieval and head scores, as a service would.
"""

from __future__ import annotations

import json
import os
import time

from laurel.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session("laurel-bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")

    from laurel.catalog import all_queries
    from laurel.catalog import profiles, rankings
    from laurel.plans.build import Scored, build_scored, rank
    from laurel.sources import tables

    registered = all_queries()
    run = lambda df: df.write.format("noop").mode("overwrite").save()

    def rank_stored():
        return rank(Scored(rankings.final(spark, SF_DIR), profiles.matrix(spark, SF_DIR)))

    def full_build():
        return rank(build_scored(
            tables.candidates(spark, SF_DIR), tables.jobs(spark, SF_DIR),
            tables.CANDIDATE_AS_OF,
        ))

    run(tables.load(spark, SF_DIR, "orders"))  # start the executors
    steps = {
        "build_matrix": lambda: profiles.matrix(spark, SF_DIR),
        "retrieval_scores": lambda: rankings.retrieval(spark, SF_DIR),
        "head_scores": lambda: rankings.heads(spark, SF_DIR),
        "final_scores": lambda: rankings.final(spark, SF_DIR),
        "rank_stored": rank_stored,
        "full_build_and_rank": full_build,
    }
    for name in (
        "hybrid_search", "bm25_scores", "cosine_scores", "relevance_tiers", "gate_breakdown",
        "document_skills", "artifact_summaries", "skill_edges", "find_by_skill",
        "find_production_debuggers", "evidence_search", "coverage_levels",
        "development_sample", "ranking_metrics", "quota_decisions", "first_sightings",
    ):
        steps[name] = lambda name=name: registered[name](spark, SF_DIR)
    times = {}
    for name, step in steps.items():
        start = time.perf_counter()
        run(step())
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
