"""Queries over work evidence: confidence, graph traversals, search, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel import vocab
from laurel.catalog.registry import query, rounded, stored
from laurel.catalog.sqltext import has
from laurel.catalog.texts import CODE, TOK, WORK_SQL, _skills_sql, work_items
from laurel.functions import text as X
from laurel.operators import evidence, graph, metrics, service
from laurel.sources import artifacts as art
from laurel.sources import tables as t



def as_of():
    return F.lit(t.EVIDENCE_AS_OF)


def rows(spark, sf):
    """(artifact, skill) evidence rows."""
    return t.artifacts(spark, sf).select("*", F.explode("skills").alias("skill_name"))


def evidence_graph(spark, sf) -> graph.EvidenceGraph:
    """The graph tables, written once: traversals read them like any stored graph."""
    arts = stored(spark, sf, "artifacts", lambda: t.artifacts(spark, sf))
    return graph.EvidenceGraph(
        developers=stored(spark, sf, "developers", lambda: t.developers(spark, sf)),
        artifacts=arts,
        demonstrates=stored(
            spark, sf, "demonstrates",
            lambda: evidence.evidence_links(arts).select("artifact_id", "skill_name"),
        ),
        edges=stored(
            spark, sf, "edges", lambda: evidence.skill_edges(rows(spark, sf), as_of())
        ),
    )


_WEIGHT = ("CASE source_type WHEN 'commit_diff' THEN 1.0 WHEN 'pr_review' THEN 0.9 WHEN 'issue_thread' THEN 0.7 "
           "WHEN 'so_answer' THEN 0.6 WHEN 'assessment_score' THEN 0.5 ELSE 0.2 END::DOUBLE")


def _contribution(half_life: float = 365.0, normaliser: float = 10.0) -> str:
    age = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(artifact_date)) / 86400e6"
    return f"{_WEIGHT} * complexity / 5.0 * pow(2.0, -({age}) / {half_life}) / {normaliser}"


_GRAPH = f"""WITH {t.evidence_sql()},
edges AS (SELECT developer_id, skill_name, least(sum({_contribution()}), 1.0::DOUBLE) AS confidence, count(*) AS evidence_count, max(artifact_date) AS last_seen
  FROM artifacts JOIN demonstrates USING (artifact_id) GROUP BY ALL),
work AS (SELECT a.*, skill_name FROM artifacts a JOIN demonstrates USING (artifact_id))"""

_WHEN = "strftime(last_seen, '%Y-%m-%d %H:%M:%S')"


def _seconds(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- confidence -----------------------------------------------------------------------


@query("artifact_contributions", f"{_GRAPH} SELECT artifact_id, skill_name, round({_contribution()}, 6) AS contribution FROM work")
def artifact_contributions(spark, sf):
    df = rows(spark, sf).withColumn("contribution", evidence.contribution(as_of()))
    return rounded(df.select("artifact_id", "skill_name", "contribution"))


@query("skill_confidence", f"{_GRAPH} SELECT developer_id, skill_name AS skill, round(confidence, 6) AS confidence FROM edges")
def skill_confidence(spark, sf):
    """Case- and space-insensitive: skills are written in three ways here."""
    spelled = rows(spark, sf).withColumn(
        "skill_name",
        F.when(F.col("artifact_id") % 3 == 0, F.upper("skill_name"))
        .when(F.col("artifact_id") % 3 == 1, F.concat(F.lit(" "), F.col("skill_name")))
        .otherwise(F.col("skill_name")),
    )
    return rounded(evidence.confidence_by_skill(spelled, as_of()))


@query("skill_confidence_custom", f"""WITH {t.evidence_sql()} SELECT developer_id, skill_name AS skill, round(least(sum(CASE source_type WHEN 'commit_diff' THEN 1.0 WHEN 'pr_review' THEN 0.5 ELSE 0.2 END::DOUBLE * complexity / 5.0
  * pow(2.0, -((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(artifact_date)) / 86400e6) / 30.0) / 50.0), 1.0), 6) AS confidence FROM artifacts JOIN demonstrates USING (artifact_id) GROUP BY ALL""")
def skill_confidence_custom(spark, sf):
    """Weights, half-life and normaliser are arguments."""
    return rounded(evidence.confidence_by_skill(
        rows(spark, sf), as_of(), half_life=30.0, normaliser=50.0,
        weights={"commit_diff": 1.0, "pr_review": 0.5},
    ))


@query("skill_edges", f"{_GRAPH} SELECT developer_id, skill_name, round(confidence, 6) AS confidence, evidence_count, {_WHEN} AS last_seen FROM edges")
def skill_edges(spark, sf):
    df = evidence.skill_edges(rows(spark, sf), as_of())
    return rounded(df.select(
        "developer_id", "skill_name", "confidence", "evidence_count", _seconds("last_seen")
    ))


@query("merged_skill_records", f"""{_GRAPH} SELECT developer_id, skill_name, round(confidence, 6) AS confidence, evidence_count, {_WHEN} AS last_seen,
  CASE WHEN skill_name IN ('nlp','pytorch','mlops') THEN 'ml' WHEN skill_name IN ('vector search','semantic search','elasticsearch','faiss','qdrant','embeddings','information retrieval','learning to rank') THEN 'retrieval' ELSE 'general' END AS category FROM edges""")
def merged_skill_records(spark, sf):
    """Records of the first half of the month, then the second half merged in."""
    cut = F.lit("2024-01-15").cast("timestamp")
    old = evidence.skill_edges(rows(spark, sf).filter(F.col("artifact_date") < cut), as_of())
    new = evidence.skill_edges(rows(spark, sf).filter(F.col("artifact_date") >= cut), as_of())
    df = evidence.merge_skill_records(old, new)
    return rounded(df.select(
        "developer_id", "skill_name", "confidence", "evidence_count", _seconds("last_seen"),
        "category",
    ))


@query("evidence_links", f"{_GRAPH} SELECT artifact_id, skill_name, 1.0::DOUBLE AS contribution_weight FROM demonstrates")
def evidence_links(spark, sf):
    return evidence.evidence_links(t.artifacts(spark, sf))


# --- ingestion ------------------------------------------------------------------------


@query("new_artifacts", f"""WITH w AS (SELECT *, sha256(split_part(raw, chr(10), 1)) AS content_hash FROM {WORK_SQL}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content_hash, source_type ORDER BY artifact_id) AS n FROM w) WHERE n = 1)
SELECT artifact_id, developer_id, source_type FROM (SELECT *, sha256(split_part(raw, chr(10), 1) || source_type) AS h FROM first) WHERE h NOT IN (SELECT sha256('bump readme typo' || s) FROM (SELECT unnest(['commit_diff','pr_review']) AS s))""")
def new_artifacts(spark, sf):
    """Copies collapse to their first arrival; hashes already stored are skipped. The hash
    covers the work line and the kind, so that there are many copies."""
    items = work_items(spark, sf).withColumn("content_hash", X.content_hash(
        F.substring_index("raw_content", "\n", 1), F.col("source_type")
    ))
    known = t.load(spark, sf, "region").select(
        X.content_hash(F.lit("bump readme typo"), t.pick(
            ("commit_diff", "pr_review"), F.col("r_regionkey") % 2
        )).alias("content_hash")
    ).distinct()
    return evidence.new_artifacts(items, known, "artifact_id").select(
        "artifact_id", "developer_id", "source_type"
    )


@query("artifact_union", """WITH c AS (SELECT * FROM conversations)
SELECT conv_id::VARCHAR AS developer_id, source_type, sha256(raw) AS raw_hash, content_hash FROM (
  SELECT conv_id, turn, 'commit_diff' AS source_type, text || chr(10) || '(+' || length(text) || ' -' || turn || ' in repo' || conv_id % 7 || ')' AS raw, sha256('c' || turn || text) AS content_hash FROM c WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 'pr_review', regexp_replace('turn ' || turn || chr(10) || text || chr(10) || 'lgtm', '^\\s+|\\s+$', '', 'g'), sha256('p' || turn || text) FROM c WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 'issue_thread', regexp_replace('turn ' || turn || chr(10) || text, '^\\s+|\\s+$', '', 'g'), sha256('i' || turn || text) FROM c WHERE role = 'system')""")
def artifact_union(spark, sf):
    """Nested exports built from the conversations, flattened to artifact rows."""
    c = F.col
    turns = t.load(spark, sf, "conversations")
    body = lambda x: F.struct(F.array(F.struct(x.alias("body"))).alias("nodes"))
    none = F.lit(None).cast("string")
    is_role = lambda r, x: F.when(c("role") == r, F.array(x)).otherwise(F.array())
    commit = F.struct(
        F.concat(F.lit("c"), c("turn").cast("string")).alias("oid"), c("text").alias("message"),
        F.length("text").cast("bigint").alias("additions"),
        c("turn").cast("bigint").alias("deletions"), none.alias("committedDate"), none.alias("url"),
    )
    pull = F.struct(
        F.concat(F.lit("turn "), c("turn").cast("string")).alias("title"), c("text").alias("body"),
        none.alias("state"), none.alias("createdAt"), none.alias("mergedAt"),
        F.concat(F.lit("p"), c("turn").cast("string")).alias("url"),
        body(F.lit("lgtm")).alias("reviews"),
    )
    issue = F.struct(
        F.concat(F.lit("turn "), c("turn").cast("string")).alias("title"), c("text").alias("body"),
        none.alias("state"), none.alias("createdAt"),
        F.concat(F.lit("i"), c("turn").cast("string")).alias("url"), none.alias("comments"),
    )
    repo = F.struct(
        F.concat(F.lit("repo"), (c("conv_id") % 7).cast("string")).alias("name"),
        F.struct(F.struct(F.struct(is_role("user", commit).alias("nodes")).alias("history"))
                 .alias("target")).alias("defaultBranchRef"),
        F.struct(is_role("assistant", pull).alias("nodes")).alias("pullRequests"),
        F.struct(is_role("system", issue).alias("nodes")).alias("issues"),
    )
    payload = turns.select(F.to_json(F.struct(F.struct(
        c("conv_id").cast("string").alias("login"),
        F.struct(F.array(repo).alias("nodes")).alias("repositories"),
    ).alias("user"))).alias("j"))
    export = payload.select(F.from_json("j", art.EXPORT_DDL).alias("e")).select("e.user")
    flat = art.flatten_export(export)
    return flat.select(
        "developer_id", "source_type", F.sha2("raw_content", 256).alias("raw_hash"),
        "content_hash",
    )


@query("artifacts_since", f"WITH {t.evidence_sql()} SELECT artifact_id, developer_id FROM artifacts WHERE artifact_id % 10 = 0 OR artifact_date >= TIMESTAMP '2024-01-20'")
def artifacts_since(spark, sf):
    """Incremental read: undated artifacts (every tenth here) stay."""
    df = t.artifacts(spark, sf).withColumn(
        "artifact_date", F.when(F.col("artifact_id") % 10 != 0, F.col("artifact_date"))
    )
    return art.since(df, F.lit("2024-01-20").cast("timestamp")).select(
        "artifact_id", "developer_id"
    )


@query("syncable_developers", f"WITH {t.evidence_sql()} SELECT developer_id, github_username FROM developers WHERE developer_id % 5 <> 0 AND developer_id % 4 <> 1")
def syncable_developers(spark, sf):
    df = t.developers(spark, sf).withColumns({
        "github_username": F.when(F.col("developer_id") % 5 != 0, F.col("github_username")),
        "sync_status": F.when(F.col("developer_id") % 4 == 1, F.lit("syncing"))
        .otherwise(F.lit("idle")),
    })
    return evidence.syncable(df).select("developer_id", "github_username")


@query("developer_upsert", f"""WITH {t.evidence_sql()}, old AS (SELECT github_username, display_name, 'old' || developer_id AS avatar_url FROM developers WHERE developer_id % 2 = 0),
new AS (SELECT github_username, CASE WHEN developer_id % 7 = 0 THEN '' WHEN developer_id % 3 = 0 THEN NULL ELSE 'New ' || developer_id END AS display_name, CASE WHEN developer_id % 5 = 0 THEN 'new' || developer_id END AS avatar_url FROM developers WHERE developer_id % 3 <> 1)
SELECT github_username, coalesce(nullif(n.display_name, ''), o.display_name) AS display_name, coalesce(n.avatar_url, o.avatar_url) AS avatar_url FROM old o FULL JOIN new n USING (github_username)""")
def developer_upsert(spark, sf):
    devs, n = t.developers(spark, sf), F.col("developer_id")
    text = n.cast("string")
    old = devs.filter(n % 2 == 0).select(
        "github_username", "display_name", F.concat(F.lit("old"), text).alias("avatar_url")
    )
    new = devs.filter(n % 3 != 1).select(
        "github_username",
        F.when(n % 7 == 0, F.lit("")).when(n % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("New "), text)).alias("display_name"),
        F.when(n % 5 == 0, F.concat(F.lit("new"), text)).alias("avatar_url"),
    )
    return evidence.upsert_developers(old, new)


@query("latest_artifact_nodes", "SELECT user_id AS node_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (TRUE) AS dummy FROM events GROUP BY user_id".replace(", max(event_id) FILTER (TRUE) AS dummy", ", round(arg_max(value, (ts, event_id)), 6) AS value"))
def latest_artifact_nodes(spark, sf):
    """Node overwrite: the last write of each node wins."""
    writes = t.events(spark, sf).select(
        F.col("user_id").alias("node_id"), "event_type", "value",
        F.struct("ts", "event_id").alias("written"),
    )
    df = evidence.latest_nodes(writes, "node_id", "written")
    return rounded(df.select("node_id", "event_type", "value"))


@query("produced_edges", "SELECT DISTINCT user_id AS developer_id, event_type FROM events")
def produced_edges(spark, sf):
    """Distinct edges between developers and kinds of work."""
    return t.load(spark, sf, "events").select(
        F.col("user_id").alias("developer_id"), "event_type"
    ).dropDuplicates()


@query("sync_status", f"{_GRAPH} SELECT developer_id, count(*) AS artifact_count, (SELECT count(*) FROM edges e WHERE e.developer_id = a.developer_id) AS skill_count FROM artifacts a GROUP BY developer_id")
def sync_status(spark, sf):
    g = evidence_graph(spark, sf)
    return evidence.sync_status(g.developers, g.artifacts, g.edges)


@query("distinct_counts", "SELECT count(DISTINCT event_type) AS kinds, count(DISTINCT user_id) AS developers, count(DISTINCT json_extract_string(props, '$.k')) AS keys FROM events")
def distinct_counts(spark, sf):
    return t.events(spark, sf).agg(
        F.countDistinct("event_type").alias("kinds"),
        F.countDistinct("user_id").alias("developers"), F.countDistinct("k").alias("keys"),
    )


# --- traversals -----------------------------------------------------------------------


def all_skills(spark, sf):
    return evidence_graph(spark, sf).edges.select("skill_name").distinct()


_NEWEST = "ORDER BY artifact_date DESC, artifact_id"
_BY_SKILL = """by_skill AS (SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY c DESC, evidence_count DESC, developer_id) AS rank
  FROM (SELECT *, round(confidence, 4) AS c FROM edges) WHERE confidence >= {floor})"""


@query("find_by_skill", f"""{_GRAPH}, {_BY_SKILL.format(floor='0.3')}
SELECT skill_name, b.developer_id, c AS confidence, evidence_count, rank::INTEGER AS rank, github_username, display_name,
  (SELECT array_to_string(list(artifact_id {_NEWEST})[1:3], ',') FROM work w WHERE w.skill_name = b.skill_name AND w.developer_id = b.developer_id) AS evidence
FROM by_skill b JOIN developers d ON d.developer_id = b.developer_id WHERE rank <= 20""")
def find_by_skill(spark, sf):
    df = graph.find_by_skill(evidence_graph(spark, sf), all_skills(spark, sf), 0.3, 20)
    return rounded(df.select(
        "skill_name", "developer_id", "confidence", "evidence_count", "rank",
        "github_username", "display_name", "evidence",
    ), 4)


_DEBUG = """hard AS (SELECT * FROM work WHERE source_type IN ('commit_diff','pr_review','issue_thread') AND complexity >= 4),
debug AS (SELECT h.*, round(coalesce(e.confidence, 0), 4) AS c FROM (SELECT skill_name, developer_id, count(*) AS evidence_count FROM hard GROUP BY ALL HAVING count(*) >= 2) h LEFT JOIN edges e USING (skill_name, developer_id)),
debuggers AS (SELECT *, row_number() OVER (PARTITION BY skill_name ORDER BY evidence_count DESC, c DESC, developer_id) AS rank FROM debug)"""


@query("find_production_debuggers", f"""{_GRAPH}, {_DEBUG}
SELECT skill_name, b.developer_id, c AS confidence, evidence_count, rank::INTEGER AS rank, github_username,
  (SELECT array_to_string(list(artifact_id ORDER BY complexity DESC, artifact_id)[1:3], ',') FROM hard w WHERE w.skill_name = b.skill_name AND w.developer_id = b.developer_id) AS evidence
FROM debuggers b JOIN developers d ON d.developer_id = b.developer_id WHERE rank <= 10""")
def find_production_debuggers(spark, sf):
    df = graph.find_production_debuggers(
        evidence_graph(spark, sf), all_skills(spark, sf), 4, 10
    )
    return rounded(df.select(
        "skill_name", "developer_id", "confidence", "evidence_count", "rank",
        "github_username", "evidence",
    ), 4)


@query("evidence_for", f"{_GRAPH} SELECT developer_id, skill_name, artifact_id FROM work WHERE developer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def evidence_for(spark, sf):
    """The work behind every skill of some developers."""
    g = evidence_graph(spark, sf)
    who = t.load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("developer_id")
    )
    pairs = g.edges.select("developer_id", "skill_name").join(who, "developer_id", "left_semi")
    return graph.evidence_for(g, pairs).select("developer_id", "skill_name", "artifact_id")


@query("all_evidence", f"{_GRAPH} SELECT artifact_id, developer_id, (SELECT string_agg(skill_name, ',' ORDER BY skill_name) FROM demonstrates d WHERE d.artifact_id = a.artifact_id) AS skills FROM artifacts a")
def all_evidence(spark, sf):
    df = graph.all_evidence(evidence_graph(spark, sf))
    return rounded(df.select("artifact_id", "developer_id", "skills"))


@query("developer_subgraph", f"""{_GRAPH}, who AS (SELECT c_custkey AS developer_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT developer_id, 'developer' AS node, github_username AS name, NULL::DOUBLE AS weight, 0 AS position FROM developers WHERE developer_id IN (FROM who)
UNION ALL SELECT developer_id, 'skill', skill_name, round(confidence, 6), row_number() OVER (PARTITION BY developer_id ORDER BY floor(confidence * 1e9 + 0.5) DESC, skill_name) - 1 FROM edges WHERE developer_id IN (FROM who)
UNION ALL SELECT developer_id, 'artifact', CAST(artifact_id AS VARCHAR), complexity::DOUBLE, row_number() OVER (PARTITION BY developer_id ORDER BY artifact_date DESC NULLS LAST, artifact_id) - 1 FROM artifacts WHERE developer_id IN (FROM who)""")
def developer_subgraph(spark, sf):
    """Record, skills by confidence and artifacts from the newest of some developers."""
    who = t.load(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("developer_id")
    )
    people, skills, arts = graph.developer_subgraph(evidence_graph(spark, sf), who)

    def nodes(rows, kind, name, weight, position):
        return rows.select(
            "developer_id", F.lit(kind).alias("node"), name.cast("string").alias("name"),
            weight.cast("double").alias("weight"), position.cast("bigint").alias("position"),
        )

    c = F.col
    return rounded(
        nodes(people, "developer", c("github_username"), F.lit(None), F.lit(0))
        .unionByName(nodes(skills, "skill", c("skill_name"), c("confidence"), c("position")))
        .unionByName(nodes(arts, "artifact", c("artifact_id"), c("complexity"), c("position")))
    )


@query("skill_confidence_lookup", f"""{_GRAPH}, asked AS (SELECT c_custkey AS developer_id, unnest({t._sql_list(t.EVIDENCE_SKILLS)}) AS skill_name FROM customer)
SELECT a.developer_id, a.skill_name, round(confidence, 6) AS confidence FROM asked a LEFT JOIN edges e ON e.developer_id = a.developer_id AND e.skill_name = a.skill_name""")
def skill_confidence_lookup(spark, sf):
    """Every developer asked for every skill; null where there is no edge."""
    pairs = t.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("developer_id"),
        F.explode(F.array(*map(F.lit, t.EVIDENCE_SKILLS))).alias("skill_name"),
    )
    return rounded(graph.skill_confidence(evidence_graph(spark, sf), pairs))


@query("recent_evidence", f"WITH {t.evidence_sql()} SELECT developer_id, artifact_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY developer_id ORDER BY artifact_date DESC, artifact_id) AS rank FROM artifacts) WHERE rank <= 100")
def recent_evidence(spark, sf):
    """The newest hundred artifacts of every developer."""
    from laurel.operators.ranking import top_k

    df = t.artifacts(spark, sf)
    order = [F.col("artifact_date").desc(), F.col("artifact_id")]
    return top_k(df, 100, order, "developer_id").select("developer_id", "artifact_id", "rank")


@query("skills_by_confidence", f"{_GRAPH} SELECT developer_id, skill_name, (row_number() OVER (PARTITION BY developer_id ORDER BY floor(confidence * 1e9 + 0.5) DESC, skill_name) - 1) AS rank FROM edges")
def skills_by_confidence(spark, sf):
    from laurel.operators.ranking import rank_positions

    edges = evidence_graph(spark, sf).edges.select("developer_id", "skill_name", "confidence")
    return rank_positions(edges, "confidence", "skill_name", "developer_id").select(
        "developer_id", "skill_name", "rank"
    )


# --- search ---------------------------------------------------------------------------

_Q = f"""queries AS (SELECT n_nationkey::BIGINT AS query_id, CASE WHEN n_nationkey < 8 THEN {t._sql_list(t.QUERY_TEXTS)}[n_nationkey % 8 + 1]
    ELSE {t._sql_list(t.EVIDENCE_SKILLS)}[n_nationkey % 24 + 1] || ' ' || {t._sql_list(t.QUERY_TEXTS)}[n_nationkey % 8 + 1] END AS text FROM nation),
intents AS (SELECT query_id, text, CASE WHEN len(s) = 0 AND contains(lower(text), 'race condition') THEN ['concurrency'] ELSE s END AS skill_names,
  CASE WHEN {has('lower(text)', vocab.QUERY_HARD_HINTS)} THEN 4 ELSE 1 END AS min_complexity, {has('lower(text)', vocab.QUERY_PRODUCTION_HINTS)} AS require_production
  FROM (SELECT *, {_skills_sql('lower(text)')} AS s FROM queries))"""


@query("query_intents", f"""WITH {_Q} SELECT query_id, array_to_string(skill_names, ',') AS skill_names, 0.5::DOUBLE AS min_confidence, min_complexity, require_production, 10 AS "limit" FROM intents""")
def query_intents(spark, sf):
    df = graph.query_intent(t.search_queries(spark, sf))
    return rounded(df.select(
        "query_id", "skill_names", "min_confidence", "min_complexity", "require_production",
        "limit",
    ))


def _struct(intents: str) -> str:
    """Structured hits of a table of intents (query_id, skill_names, min_confidence, min_complexity,
    require_production, lim)."""
    return f"""asks AS (SELECT query_id, lim, min_confidence, greatest(min_complexity, 4) AS hardness, require_production OR min_complexity >= 4 AS strict,
  unnest(range(len(skill_names))) AS skill_at, unnest(skill_names) AS skill_name FROM {intents}),
deb AS (SELECT *, row_number() OVER (PARTITION BY query_id, skill_at ORDER BY evidence_count DESC, c DESC, developer_id) AS rank FROM (
  SELECT h.*, round(coalesce(e.confidence, 0), 4) AS c FROM (
    SELECT a.query_id, a.skill_at, a.lim, w.skill_name, w.developer_id, count(*) AS evidence_count, list(artifact_id ORDER BY complexity DESC, artifact_id)[1:3] AS evidence
    FROM asks a JOIN work w ON a.strict AND w.skill_name = a.skill_name AND source_type IN ('commit_diff','pr_review','issue_thread') AND complexity >= hardness
    GROUP BY a.query_id, a.skill_at, a.lim, w.skill_name, w.developer_id HAVING count(*) >= 2) h LEFT JOIN edges e USING (skill_name, developer_id))),
loose AS (SELECT *, CASE WHEN strict THEN 0 ELSE min_confidence END AS least FROM asks a WHERE NOT strict OR NOT EXISTS (SELECT 1 FROM deb d WHERE d.query_id = a.query_id AND d.skill_at = a.skill_at)),
bys AS (SELECT l.query_id, l.skill_at, l.lim, e.skill_name, e.developer_id, c, evidence_count, row_number() OVER (PARTITION BY l.query_id, l.skill_at ORDER BY c DESC, evidence_count DESC, e.developer_id) AS rank
  FROM loose l JOIN (SELECT *, round(confidence, 4) AS c FROM edges) e ON e.skill_name = l.skill_name AND e.confidence >= least),
shown AS (SELECT query_id, skill_at, developer_id, c, evidence_count, rank, evidence FROM deb WHERE rank <= lim
  UNION ALL SELECT query_id, skill_at, developer_id, c, evidence_count, rank, (SELECT list(artifact_id {_NEWEST})[1:3] FROM work w WHERE w.skill_name = b.skill_name AND w.developer_id = b.developer_id) FROM bys b WHERE rank <= lim),
merged AS (SELECT query_id, developer_id, list((c, evidence_count, evidence) ORDER BY c DESC, skill_at)[1] AS r, list((skill_at, rank) ORDER BY skill_at, rank)[1] AS seen FROM shown GROUP BY ALL),
structured AS (SELECT query_id, m.developer_id, r[1] AS confidence, r[2] AS evidence_count, r[3] AS evidence, row_number() OVER (PARTITION BY query_id ORDER BY seen[1], seen[2]) - 1 AS rank,
  github_username, display_name, query_id IN (SELECT query_id FROM loose WHERE strict) AS relaxed FROM merged m LEFT JOIN developers d ON d.developer_id = m.developer_id)"""


_STRUCT = f"{_GRAPH}, {_Q}, asked AS (SELECT *, 0.5::DOUBLE AS min_confidence, 10 AS lim FROM intents), {_struct('asked')}"
_STRUCT_COLUMNS = "query_id, developer_id, confidence, evidence_count, array_to_string(evidence, ',') AS evidence, rank::INTEGER AS rank, github_username, display_name, relaxed"


@query("structured_search", f"{_STRUCT} SELECT {_STRUCT_COLUMNS} FROM structured")
def structured_search(spark, sf):
    intents = graph.query_intent(t.search_queries(spark, sf))
    return rounded(graph.structured_rows(evidence_graph(spark, sf), intents))


@query("structured_search_by_intent", f"""{_GRAPH}, {_Q}, asked AS (SELECT query_id, skill_names, require_production, [0.5, 0.8, 0.2][query_id % 3 + 1]::DOUBLE AS min_confidence,
  CASE WHEN query_id % 4 = 0 THEN 5 ELSE min_complexity END AS min_complexity, [10, 3, 5][query_id % 3 + 1] AS lim FROM intents), {_struct('asked')}
SELECT {_STRUCT_COLUMNS} FROM structured""")
def structured_search_by_intent(spark, sf):
    """Intents that differ in confidence, complexity and number of answers."""
    n = F.col("query_id")
    intents = graph.query_intent(t.search_queries(spark, sf)).withColumns({
        "min_confidence": t.pick((0.5, 0.8, 0.2), n % 3),
        "min_complexity": F.when(n % 4 == 0, F.lit(5)).otherwise(F.col("min_complexity")),
        "limit": t.pick((10, 3, 5), n % 3),
    })
    return rounded(graph.structured_rows(evidence_graph(spark, sf), intents))


def _cells(table: str, id_col: str) -> str:
    return f"""(SELECT {id_col}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {id_col})) AS x FROM (
      SELECT {id_col}, h % 384 AS bucket, sum(CASE WHEN (h >> 20) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT {id_col}, {CODE} AS h FROM (SELECT {id_col}, unnest({TOK}) AS tok FROM {table})) GROUP BY ALL) WHERE v <> 0)"""


_SEM = f"""etexts AS (SELECT artifact_id, developer_id, trim(concat_ws(' ', summary, source_type, (SELECT string_agg(skill_name, ' ' ORDER BY skill_name) FROM demonstrates d WHERE d.artifact_id = a.artifact_id))) AS text FROM artifacts a),
ev AS {_cells('etexts', 'artifact_id')}, qv AS {_cells('queries', 'query_id')},
dots AS (SELECT query_id, artifact_id, sum(ev.x * qv.x) AS s FROM ev JOIN qv USING (bucket) GROUP BY ALL),
near AS (SELECT query_id, artifact_id, developer_id, round(coalesce(s, 0), 9) AS score FROM etexts CROSS JOIN queries LEFT JOIN dots USING (query_id, artifact_id)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS pos FROM near) WHERE pos <= 50)"""


@query("semantic_hits", f"WITH {t.evidence_sql()}, {_Q}, {_SEM} SELECT query_id, artifact_id, round(score, 6) + 0.0 AS score, pos::INTEGER AS pos FROM found")
def semantic_hits(spark, sf):
    g = evidence_graph(spark, sf)
    hits = graph.evidence_hits(
        graph.all_evidence(g), t.search_queries(spark, sf), 50, code="md5"
    )
    return rounded(hits.select("query_id", "artifact_id", "score", F.col("at").alias("pos")))


_SEMANTIC = """semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, evidence[1]) - 1 AS rank FROM (
  SELECT query_id, developer_id, round(max(score), 4) AS semantic_score, max(score) AS best, list(artifact_id ORDER BY score DESC, artifact_id)[1:3] AS evidence FROM near GROUP BY ALL) QUALIFY rank < 50)"""


@query("semantic_developers", f"WITH {t.evidence_sql()}, {_Q}, {_SEM}, {_SEMANTIC} SELECT query_id, developer_id, semantic_score, array_to_string(evidence, ',') AS evidence, rank::INTEGER AS rank FROM semantic")
def semantic_developers(spark, sf):
    """The fifty developers nearest to each text, whoever has how many near artifacts."""
    g = evidence_graph(spark, sf)
    return rounded(graph.semantic_rows(
        graph.all_evidence(g), t.search_queries(spark, sf), 50, code="md5"
    ))


_HYBRID = f"""{_STRUCT}, {_SEM}, {_SEMANTIC},
lists AS (SELECT query_id, developer_id, rank, 0 AS src FROM structured UNION ALL SELECT query_id, developer_id, rank, 1 FROM semantic),
fused AS (SELECT query_id, developer_id, sum(1.0::DOUBLE / (61 + rank)) AS rrf, list((src, rank) ORDER BY src, rank)[1] AS seen FROM lists GROUP BY ALL),
joined AS (SELECT query_id, developer_id, coalesce(s.confidence, 0) AS confidence, coalesce(v.semantic_score, 0) AS semantic_score,
    CASE WHEN len(s.evidence) > 0 THEN s.evidence ELSE coalesce(v.evidence, []) END AS shown, s.evidence_count AS n,
    CASE WHEN s.confidence IS NOT NULL AND v.semantic_score IS NOT NULL THEN 'both' WHEN s.confidence IS NOT NULL THEN 'skill' ELSE 'semantic' END AS match_via, rrf, seen,
    github_username, display_name, (SELECT count(*) FROM structured x WHERE x.query_id = fused.query_id) AS skill_hits, (SELECT count(*) FROM semantic x WHERE x.query_id = fused.query_id) AS semantic_hits,
    coalesce((SELECT bool_or(relaxed) FROM structured x WHERE x.query_id = fused.query_id), FALSE) AS relaxed
  FROM fused LEFT JOIN structured s USING (query_id, developer_id) LEFT JOIN semantic v USING (query_id, developer_id)),
results AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(rrf * 1e12) DESC, seen[1], seen[2]) AS rank FROM joined)"""


@query("evidence_search", f"""{_HYBRID} SELECT query_id, developer_id, confidence, semantic_score, coalesce(n, len(shown))::BIGINT AS evidence_count, array_to_string(shown[1:3], ',') AS evidence,
  match_via, round(rrf, 5) AS rrf_score, rank::INTEGER AS rank, github_username, display_name, skill_hits, semantic_hits, relaxed FROM results WHERE rank <= 10""")
def evidence_search(spark, sf):
    return rounded(graph.search(
        evidence_graph(spark, sf), t.search_queries(spark, sf), code="md5"
    ))


_GOLD = "gold AS (SELECT DISTINCT q.query_id, developer_id FROM queries q JOIN edges ON evidence_count >= 4 AND contains(q.text, skill_name))"
_EVAL = f"""{_HYBRID}, {_GOLD}, marked AS (SELECT r.query_id, r.rank, g.developer_id IS NOT NULL AS hit FROM results r LEFT JOIN gold g ON g.query_id = r.query_id AND g.developer_id = r.developer_id WHERE r.rank <= 10),
per_query AS (SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 4)::DOUBLE AS mrr, {', '.join(f'''round(coalesce(count(*) FILTER (hit AND rank <= {k}) / nullif(count(*) FILTER (rank <= {k}), 0), 0), 4) AS precision_{k},
  round(count(*) FILTER (hit AND rank <= {k}) / any_value(n), 4) AS recall_{k}, (count(*) FILTER (hit AND rank <= {k}) > 0)::INT::DOUBLE AS hit_{k}''' for k in (1, 3, 5, 10))}
  FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) LEFT JOIN marked USING (query_id) GROUP BY query_id)"""
_METRICS = ["mrr"] + [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("precision", "recall", "hit")]


def _gold(spark, sf):
    """Developers with at least four pieces of evidence in a skill the query names."""
    g = evidence_graph(spark, sf)
    named = t.search_queries(spark, sf).withColumn(
        "skill_name", F.explode(F.array(*[F.lit(s) for s in t.EVIDENCE_SKILLS]))
    ).filter(F.col("text").contains(F.col("skill_name")))
    return named.join(g.edges.filter("evidence_count >= 4"), "skill_name").select(
        "query_id", "developer_id"
    ).distinct()


@query("search_quality_per_query", f"{_EVAL} SELECT * FROM per_query")
def search_quality_per_query(spark, sf):
    found = graph.search(evidence_graph(spark, sf), t.search_queries(spark, sf), code="md5")
    return metrics.retrieval_metrics_per_query(found, _gold(spark, sf))


@query("search_quality", f"{_EVAL} SELECT {', '.join(f'round(avg({m}), 4) AS {m}' for m in _METRICS)} FROM per_query")
def search_quality(spark, sf):
    found = graph.search(evidence_graph(spark, sf), t.search_queries(spark, sf), code="md5")
    return metrics.retrieval_metrics(found, _gold(spark, sf))


@query("recent_artifacts", "SELECT event_id AS artifact_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_artifacts(spark, sf):
    return service.recent(
        t.artifacts(spark, sf), "artifact_date", 500, "artifact_id"
    ).select("artifact_id")
