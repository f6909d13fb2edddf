from __future__ import annotations

from conftest import profile, role
from pyspark.sql import functions as F

from laurel import vocab
from laurel.operators import features


def test_names_are_searched_once_per_distinct_one(candidates_of):
    names = ["", "HR Manager", "Vice President of Sales", "sr. ML Engineer", "SR ENGINEER", "İntern",
             "Tech Lead\nSearch", "Straße Staff", None, *[w.upper() for w in vocab.CONSULTING_FIRMS]]
    roles = [role(n, n, "2019-07-01", 5) for n in names]
    df = candidates_of(
        profile(1, roles=roles), profile(2, roles=[*roles[:3], None]), profile(3, roles=[]),
        {**profile(4), "career_history": None})
    decoded = features.decode(df)
    got = decoded.select("candidate_id", F.explode("_roles").alias("r")).select("candidate_id", "r.*")
    wanted = (features.title_level, features.is_technical_title)
    rows = got.select(
        "level", "technical", "consulting", *[f(F.col("title")) for f in wanted],
        features.is_consulting(F.col("company")),
    ).collect()
    assert len(rows) == len(names) + 4
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in rows)
    assert len({tuple(r)[:3] for r in rows}) > 4
    # no pattern is left in what is done for each role but those of dates
    plan = decoded.select("_roles")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2
