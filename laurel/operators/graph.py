"""Traversals of the evidence graph and hybrid evidence search.

Nodes: developers, skills, artifacts. Edges: developer-skill (``edges``, with confidence),
developer-artifact (a column of the artifact), artifact-skill (``demonstrates``).
Every traversal takes a table of skills or queries, so that many run in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel import vocab
from laurel.functions.text import extract_skills, join_nonempty, text_contains_any
from laurel.operators.ranking import fuse_rankings, global_rank, score_key, top_k
from laurel.operators.retrieval import hashed_cosine, nearest_groups
from laurel.session import cut_lineage

RRF_K = 60


@dataclass
class EvidenceGraph:
    developers: DataFrame  # developer_id, github_username, display_name
    artifacts: DataFrame  # artifact_id, developer_id, source_type, complexity, ...
    demonstrates: DataFrame  # artifact_id, skill_name
    edges: DataFrame  # developer_id, skill_name, confidence, evidence_count, last_seen


def work(graph: EvidenceGraph) -> DataFrame:
    """Artifacts joined with the skills they demonstrate."""
    return graph.artifacts.drop("skills").join(graph.demonstrates, "artifact_id")


def _top_evidence(rows: DataFrame, keys: list[str], order: list[Column], n: int = 3
                  ) -> DataFrame:
    """The first ``n`` artifact ids per key as an array; pruned before the shuffle."""
    keyed = rows.withColumn("_key", F.struct(*keys))
    best = top_k(keyed, n, order, "_key", "_at")
    return best.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "artifact_id"))),
            lambda x: x["artifact_id"],
        ).alias("evidence")
    )


def _newest() -> list[Column]:
    return [F.col("artifact_date").desc_nulls_last(), F.col("artifact_id").asc()]


def _asks(skills: DataFrame, own: str, value: float, limit: int) -> DataFrame:
    """Distinct (skill_name, floor, most): what each row asks for, or the defaults."""
    floor = F.col(own) if own in skills.columns else F.lit(value)
    most = F.col("limit") if "limit" in skills.columns else F.lit(limit)
    return skills.select("skill_name", floor.alias("floor"), most.alias("most")).distinct()


ASK = ["skill_name", "floor", "most"]


def _best_per_ask(rows: DataFrame, asks: DataFrame, order: list[Column]) -> DataFrame:
    """The first ``most`` rows of every ask; a task keeps no more of them than the largest asks."""
    largest = asks.agg(F.max("most")).first()[0] or 0
    return top_k(rows.withColumn("_ask", F.struct(*ASK)), largest, order, "_ask").filter(
        F.col("rank") <= F.col("most")
    )


def _work_of(graph: EvidenceGraph, pairs: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Artifacts of (skill, developer) pairs: both sides are cut before they meet."""
    asked = pairs.select("skill_name", "developer_id").distinct()
    links = graph.demonstrates.join(asked.select("skill_name").distinct(), "skill_name", "left_semi")
    mine = (graph.artifacts if artifacts is None else artifacts).drop("skills").join(
        asked.select("developer_id").distinct(), "developer_id", "left_semi"
    )
    return mine.join(links, "artifact_id").join(asked, ["skill_name", "developer_id"], "left_semi")


def find_by_skill(
    graph: EvidenceGraph, skills: DataFrame, min_confidence: float = 0.6, limit: int = 20
) -> DataFrame:
    """Per skill: the most trusted developers with their three newest artifacts, ``rank``
    from 1. ``skills``: skill_name, and optionally its own ``min_confidence`` and ``limit``; they
    come back as ``floor`` and ``most``."""
    asks = _asks(skills, "min_confidence", min_confidence, limit)
    edges = graph.edges.join(asks, "skill_name").filter(
        F.col("confidence") >= F.col("floor")
    ).withColumn("confidence", F.round("confidence", 4))
    best = _best_per_ask(
        edges, asks,
        [F.col("confidence").desc(), F.col("evidence_count").desc(), F.col("developer_id")],
    ).select(*ASK, "developer_id", "confidence", "evidence_count", "rank")
    return _with_people(graph, best, _top_evidence(
        _work_of(graph, best), ["skill_name", "developer_id"], _newest()
    ), ["skill_name", "developer_id"])


def _with_people(graph: EvidenceGraph, best: DataFrame, evidence: DataFrame, keys: list[str]
                 ) -> DataFrame:
    people = graph.developers.select("developer_id", "github_username", "display_name")
    return (
        best.join(evidence, keys, "left")
        .join(people, "developer_id", "left")
        .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))
    )


def find_production_debuggers(
    graph: EvidenceGraph, skills: DataFrame, min_complexity: int = 4, limit: int = 10
) -> DataFrame:
    """Per skill: developers with at least two hard pieces of real work, those with most
    first. ``skills``: skill_name, and optionally its own ``min_complexity`` and ``limit``; they
    come back as ``floor`` and ``most``."""
    asks = _asks(skills, "min_complexity", min_complexity, limit)
    # only asked skills and work as hard as the easiest ask meet
    easiest = asks.agg(F.min("floor")).scalar()
    real = graph.artifacts.drop("skills").filter(
        F.col("source_type").isin(*vocab.WORK_SOURCES) & (F.col("complexity") >= easiest)
    )
    links = graph.demonstrates.join(asks.select("skill_name").distinct(), "skill_name", "left_semi")
    hard = real.join(links, "artifact_id").join(asks, "skill_name").filter(
        F.col("complexity") >= F.col("floor")
    )
    counted = hard.groupBy(*ASK, "developer_id").agg(
        F.count(F.lit(1)).alias("evidence_count")
    ).filter("evidence_count >= 2")
    keys = ["skill_name", "developer_id"]
    trust = graph.edges.select(*keys, F.col("confidence").alias("_c"))
    scored = counted.join(trust, keys, "left").select(
        *ASK, "developer_id", F.round(F.coalesce("_c", F.lit(0.0)), 4).alias("confidence"),
        "evidence_count",
    )
    best = _best_per_ask(
        scored, asks,
        [F.col("evidence_count").desc(), F.col("confidence").desc(), F.col("developer_id")],
    )
    whole = [*ASK, "developer_id"]
    rows = _work_of(graph, best, real).join(best.select(*whole), keys).filter(
        F.col("complexity") >= F.col("floor")
    )
    return _with_people(graph, best, _top_evidence(
        rows, whole, [F.col("complexity").desc(), F.col("artifact_id").asc()]
    ), whole)


def evidence_for(graph: EvidenceGraph, pairs: DataFrame) -> DataFrame:
    """Artifacts of (developer, skill) pairs."""
    return work(graph).join(pairs.distinct(), ["developer_id", "skill_name"], "left_semi")


def all_evidence(graph: EvidenceGraph, with_skills_only: bool = False) -> DataFrame:
    """Every artifact with the sorted list of its skills, possibly empty."""
    listed = graph.demonstrates.groupBy("artifact_id").agg(
        F.array_sort(F.collect_set("skill_name")).alias("skills")
    )
    how = "inner" if with_skills_only else "left"
    return graph.artifacts.drop("skills").join(listed, "artifact_id", how).withColumn(
        "skills", F.coalesce("skills", F.array().cast("array<string>"))
    )


def developer_subgraph(graph: EvidenceGraph, developers: DataFrame
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the given developers: their records, their skill edges (``position`` from 0 by confidence,
    then name) and their artifacts (``position`` from 0, newest first). Rows, so that a developer
    with very many artifacts stays spread out; positions are distributed ranks."""
    wanted = developers.select("developer_id").distinct()
    mine = lambda rows: rows.join(wanted, "developer_id", "left_semi")
    skills = mine(graph.edges).withColumn("_key", score_key(F.col("confidence")))
    return (
        mine(graph.developers),
        global_rank(skills, [F.col("_key").desc(), F.col("skill_name")], "developer_id",
                    "position").drop("_key"),
        global_rank(mine(graph.artifacts), _newest(), "developer_id", "position"),
    )


def skill_confidence(graph: EvidenceGraph, pairs: DataFrame) -> DataFrame:
    """Confidence of (developer, skill) pairs, null where there is no edge."""
    keys = ["developer_id", "skill_name"]
    return pairs.join(graph.edges.select(*keys, "confidence"), keys, "left")


# --- search ---------------------------------------------------------------------------


def query_intent(queries: DataFrame, text: str = "text") -> DataFrame:
    """What a search text asks for: skills, how hard, in production or not."""
    low = F.lower(text)
    found = extract_skills(F.col(text))
    implied = (F.size(found) == 0) & low.contains("race condition")
    hard = text_contains_any(low, vocab.QUERY_HARD_HINTS)
    return queries.withColumns({
        "skill_names": F.when(implied, F.array(F.lit("concurrency"))).otherwise(found),
        "min_confidence": F.lit(0.5),
        "min_complexity": F.when(hard, F.lit(4)).otherwise(F.lit(1)),
        "require_production": text_contains_any(low, vocab.QUERY_PRODUCTION_HINTS),
        "limit": F.lit(10),
    })


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``place`` from 1 within each query. Both retrievers hand over top-k lists, so a
    query has at most a few hundred rows here."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w))


def structured_rows(graph: EvidenceGraph, intents: DataFrame) -> DataFrame:
    """Per query: developers found through its skills, by the intent's own least confidence, least
    complexity (4 at least) and limit. The best confidence wins, the place is where the developer was
    first seen. ``relaxed``: a skill had no hard work, so anybody with that skill was taken."""
    c = F.col
    # one row per query and skill: tiny, and every branch below starts from it
    wanted = cut_lineage(intents.select(
        "query_id", "min_confidence", F.greatest("min_complexity", F.lit(4)).alias("min_complexity"),
        c("limit").cast("int").alias("limit"),
        (c("require_production") | (c("min_complexity") >= 4)).alias("strict"),
        F.posexplode("skill_names").alias("skill_at", "skill_name"),
    ))
    strict = wanted.filter("strict")
    # at most ``limit`` rows per ask, read by both branches below
    debuggers = cut_lineage(find_production_debuggers(graph, strict))
    hard = debuggers.select("skill_name", c("floor").alias("min_complexity"),
                            c("most").alias("limit")).distinct()
    asked = ["skill_name", "min_complexity", "limit"]
    relaxed = strict.join(hard, asked, "left_anti").withColumn("min_confidence", F.lit(0.0))
    plain = wanted.filter(~c("strict"))
    loose = relaxed.unionByName(plain)
    by_skill = find_by_skill(graph, loose)
    found = ["developer_id", "confidence", "evidence_count", "evidence", "rank", "github_username",
             "display_name"]
    own = ["query_id", "skill_at", "strict"]
    hits = strict.select(*own, *asked).join(
        debuggers.select("skill_name", c("floor").alias("min_complexity"), c("most").alias("limit"),
                         *found), asked,
    ).select(*own, *found, F.lit(False).alias("relaxed")).unionByName(
        loose.select(*own, "skill_name", "min_confidence", "limit").join(
            by_skill.select("skill_name", c("floor").alias("min_confidence"),
                            c("most").alias("limit"), *found),
            ["skill_name", "min_confidence", "limit"],
        ).select(*own, *found, c("strict").alias("relaxed"))
    )
    # the first of equal confidences wins, which a negated position expresses
    preference = F.struct(c("confidence"), (-c("skill_at")).alias("first"))
    merged = hits.groupBy("query_id", "developer_id").agg(
        F.max_by(F.struct(*[x for x in found if x not in ("developer_id", "rank")]), preference)
        .alias("row"),
        F.min(F.struct("skill_at", "rank")).alias("seen"),
    )
    loosened = relaxed.select("query_id").distinct().withColumn("relaxed", F.lit(True))
    place = _numbered(merged, [c("seen.skill_at"), c("seen.rank")])
    return place.join(loosened, "query_id", "left").select(
        "query_id", "developer_id", "row.confidence", "row.evidence_count", "row.evidence",
        (c("place") - 1).alias("rank"), "row.github_username", "row.display_name",
        F.coalesce("relaxed", F.lit(False)).alias("relaxed"),
    )


def evidence_text() -> Column:
    return join_nonempty([
        F.col("summary"), F.col("source_type"), F.array_join("skills", " "),
    ])


def evidence_hits(
    evidence: DataFrame, queries: DataFrame, k: int = 50, text: str = "text",
    code: str = "crc32",
) -> DataFrame:
    """Per query the ``k`` artifacts nearest to the text; each task keeps its own best."""
    docs = evidence.select(
        "artifact_id", "developer_id", evidence_text().alias("_doc")
    ).filter(F.col("_doc") != "")
    asked = queries.filter(F.trim(text) != "")
    scored = hashed_cosine(
        docs, asked, "artifact_id", "_doc", "query_id", text, code=code,
        keep=("developer_id",), k=k,
    )
    keyed = scored.withColumn("score", F.round("score", 9))
    return top_k(keyed, k, [F.col("score").desc(), F.col("artifact_id")], "query_id", "at")


def semantic_rows(
    evidence: DataFrame, queries: DataFrame, developers: int = 50, text: str = "text",
    code: str = "crc32",
) -> DataFrame:
    """Per query the ``developers`` whose nearest artifact is nearest to the text: its score, their
    three nearest artifacts, 0-based rank. One with very many near artifacts hides nobody."""
    docs = evidence.select(
        "artifact_id", "developer_id", evidence_text().alias("_doc")
    ).filter(F.col("_doc") != "")
    found = nearest_groups(
        docs, queries.filter(F.trim(text) != ""), "artifact_id", "_doc", "developer_id", "query_id",
        text, developers, code=code,
    )
    return found.select(
        "query_id", "developer_id", F.round("score", 4).alias("semantic_score"),
        F.col("nearest").alias("evidence"), (F.col("rank") - 1).alias("rank"),
    )


def hybrid_results(structured: DataFrame, semantic: DataFrame, intents: DataFrame, k: int = RRF_K
                   ) -> DataFrame:
    """Both retrievers fused by rank: one row per query and developer with how it matched, best
    first, ``rank`` from 1, as many as the intent's ``limit``; with the numbers of hits of either
    retriever and whether the query was relaxed."""
    c = F.col
    keys = ["query_id", "developer_id"]
    lists = structured.select(*keys, "rank", F.lit(0).alias("source")).unionByName(
        semantic.select(*keys, "rank", F.lit(1).alias("source"))
    )
    fused = fuse_rankings(lists, "developer_id", "query_id", k)
    first_seen = lists.groupBy(*keys).agg(F.min(F.struct("source", "rank")).alias("seen"))
    counts = lists.groupBy("query_id").agg(
        F.count_if(c("source") == 0).alias("skill_hits"),
        F.count_if(c("source") == 1).alias("semantic_hits"),
    )
    loosened = structured.groupBy("query_id").agg(F.max("relaxed").alias("relaxed"))
    s = structured.select(
        *keys, "confidence", "evidence_count", c("evidence").alias("s_evidence"),
        "github_username", "display_name",
    )
    v = semantic.select(*keys, "semantic_score", c("evidence").alias("v_evidence"))
    both = s.join(v, keys, "full_outer").join(fused, keys).join(first_seen, keys)
    by_skill, by_text = c("confidence").isNotNull(), c("semantic_score").isNotNull()
    shown = F.when(F.size("s_evidence") > 0, c("s_evidence")).otherwise(
        F.coalesce("v_evidence", F.array().cast("array<bigint>"))
    )
    rows = both.select(
        *keys, "github_username", "display_name",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.coalesce("evidence_count", F.size(shown)).cast("bigint").alias("evidence_count"),
        F.slice(shown, 1, 3).alias("evidence"),
        F.when(by_skill & by_text, F.lit("both")).when(by_skill, F.lit("skill"))
        .otherwise(F.lit("semantic")).alias("match_via"),
        "rrf_score", "seen",
    )
    limits = intents.select("query_id", c("limit").alias("_limit"))
    largest = limits.agg(F.max("_limit")).first()[0] or 0
    best = top_k(
        rows.withColumn("_key", F.floor(c("rrf_score") * 1e12)), largest,
        [c("_key").desc(), c("seen.source"), c("seen.rank")], "query_id",
    ).join(limits, "query_id").filter(c("rank") <= c("_limit"))
    return best.join(counts, "query_id").join(loosened, "query_id", "left").withColumns({
        "rrf_score": F.round("rrf_score", 5), "relaxed": F.coalesce("relaxed", F.lit(False)),
    }).drop("seen", "_key", "_limit")


def search(
    graph: EvidenceGraph, queries: DataFrame, hybrid: bool = True, developers: int = 50,
    code: str = "crc32", intents: DataFrame | None = None,
) -> DataFrame:
    """Evidence search for a table of texts (query_id, text). ``intents``: what each text asks for,
    if something better than ``query_intent`` read it."""
    asked = cut_lineage(query_intent(queries) if intents is None else intents)
    # both lists are top-k sized and are read several times by the fusion
    structured = cut_lineage(structured_rows(graph, asked))
    semantic = semantic_rows(all_evidence(graph), queries, developers, code=code)
    semantic = cut_lineage(semantic if hybrid else semantic.limit(0))
    return hybrid_results(structured, semantic, asked)
