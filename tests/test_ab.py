from __future__ import annotations

import duckdb

from laurel.catalog import all_oracles, all_queries
from laurel.sources import tables as t

SF = "/root/testdata/sf0.001"


def test_both_rankings_of_every_job_are_compared(spark):
    jobs = {r.jd_id for r in t.jobs(spark, SF).collect()}
    assert len(jobs) > 1
    scores = all_queries()["ab_metrics"](spark, SF).collect()
    assert {(r.jd_id, r.run) for r in scores} == {(j, run) for j in jobs for run in ("with", "without")}
    assert len(scores) == 2 * len(jobs)
    db = duckdb.connect()
    for name in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region", "events",
                 "documents", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = db.execute(all_oracles()["ab_churn_by_job"]).fetchall()
    rows = all_queries()["ab_churn_by_job"](spark, SF).collect()
    assert sorted((r.jd_id, r.moved, r.overlap) for r in rows) == sorted(want)
    one = all_queries()["ab_churn"](spark, SF).first()
    assert (one.moved, one.overlap) == (sum(w[1] for w in want), sum(w[2] for w in want))
    assert {w[0] for w in want} == jobs
