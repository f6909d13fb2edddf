"""The star-schema tables and the domain tables derived from them by arithmetic.

The analytics take nested profiles, job texts, artifacts and requests. These adapters
state such tables as functions of the given ones, row for row, so that the same functions
can be written in SQL. They keep every row: groups are bounded by the domain of a key
(seven line numbers, twenty-four skills), not by cutting.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

CANDIDATE_AS_OF = dt.date(2001, 12, 31)
EVIDENCE_AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)

TITLES = (
    "Machine Learning Engineer", "Senior AI Engineer", "Data Scientist", "HR Manager",
    "Backend Developer", "Marketing Manager", "Research Scientist", "Consultant",
    "Staff Data Engineer", "Director of Engineering", "Graphic Designer",
    "Junior Developer",
)
COMPANIES = (
    "Swiggy", "Razorpay", "Infosys", "Flipkart", "TCS", "Zomato", "Wipro",
    "Acme Industries",
)
SERVICE_COMPANIES = ("Infosys", "TCS")
COMPANY_SIZES = (
    "1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+",
)
DESCRIPTIONS = (
    "Built production retrieval and ranking services for many users.",
    "Kept the office calendar and wrote reports.",
    "Deployed embedding search with low latency at scale.",
    "Ran vendor meetings, budgets and hiring.",
    "Trained models and tracked NDCG in an A/B experiment.",
    "Drew posters and layouts for campaigns.",
)
SKILL_NAMES = (
    "Vector Search", "FAISS", "Qdrant", "BM25", "Learning to Rank", "Embeddings",
    "Information Retrieval", "Elasticsearch", "RAG", "LoRA", "LangChain",
    "Fine-tuning LLMs", "PyTorch", "NLP", "MLOps", "Python", "Computer Vision", "YOLO",
    "Robotics", "Photoshop", "Excel", "Marketing", "Sales", "Recruitment",
)
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert", "native")
PLACES = (
    ("Pune, Maharashtra", "India"), ("Bengaluru, Karnataka", "India"),
    ("Chennai, Tamil Nadu", "India"), ("Berlin", "Germany"), ("London", "United Kingdom"),
)
NOTICE_DAYS = (15, 30, 60, 90, 120)
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")
JOB_TEXTS = (
    "Senior AI engineer for production vector search and ranking with Python",
    "Data scientist with NLP, PyTorch and A/B experiment practice",
    "Backend developer for embedding search services at scale and low latency",
    "Machine learning engineer, learning to rank, BM25 and Elasticsearch retrieval",
    "Research scientist for RAG, LoRA and fine-tuning of language models",
)
EVENT_SOURCES = {
    "purchase": "commit_diff", "view": "pr_review", "error": "issue_thread",
    "click": "so_answer", "signup": "resume_claim",
}
QUERY_TEXTS = (
    "who debugged a race condition in production",
    "kubernetes and docker at scale",
    "vector search with qdrant",
    "python developer",
    "shipped retrieval or ranking to real users",
    "nlp and pytorch",
    "people who like gardening",
    "fixed a deadlock in kafka",
)
EVIDENCE_SKILLS = (
    "kubernetes", "docker", "postgresql", "redis", "kafka", "python", "go", "rust",
    "typescript", "react", "vector search", "semantic search", "elasticsearch", "faiss",
    "qdrant", "embeddings", "nlp", "information retrieval", "learning to rank",
    "distributed systems", "concurrency", "observability", "pytorch", "mlops",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on an input too small to split: a scan with
    fewer splits than cores is dealt out once. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp and the integer in ``props``."""
    return load(spark, sf_dir, "events").withColumns({
        "ts": F.col("ts").cast("timestamp"),
        "k": F.get_json_object("props", "$.k").cast("bigint"),
    })


def pick(values: tuple, index: Column) -> Column:
    """Entry ``index`` (0-based) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# --- candidates: one per order --------------------------------------------------------


def _roles(lines: DataFrame) -> DataFrame:
    """One role per (order, line number)."""
    c = F.col
    merged = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").cast("date").alias("start"),
        F.min("l_suppkey").alias("supp"),
        F.min("l_partkey").alias("part"),
    )
    return merged.withColumns({
        "raw": F.when((c("supp") * 7 + c("part")) % 97 == 0, F.lit(100)).otherwise(
            1 + (c("part") * 13) % 72
        ),
        "is_current": (c("part") + c("l_linenumber")) % 5 == 0,
        "worked": F.floor(F.datediff(F.lit(CANDIDATE_AS_OF), c("start")) / F.lit(30.44)),
    }).withColumns({
        "months": F.when(
            c("is_current") & (c("part") % 50 != 0), F.least(c("raw"), c("worked"))
        ).otherwise(c("raw")),
        "start_text": F.when(c("part") % 333 == 0, F.lit("2000-13-45")).otherwise(
            c("start").cast("string")
        ),
        "end_text": F.when(
            ~c("is_current"),
            F.date_add(
                c("start"),
                F.when(c("part") % 200 == 0, F.lit(30)).otherwise(c("raw") * 30).cast("int"),
            ).cast("string"),
        ),
    })


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested profile per order: its line numbers are the roles, its parts (modulo the
    skill list) the skills."""
    c = F.col
    # both groupings and the joins need the lines of an order together, so that they move once for
    # each; grouping them in part before would find next to nothing to fold
    lines = load(spark, sf_dir, "lineitem").repartition("l_orderkey")
    # the joins below need this partitioning anyway; stating it keeps the wide per-row
    # work parallel when the other sides are small enough to be broadcast
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(
        "o_orderkey"
    )
    roles = _roles(lines).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(
            "l_linenumber", "supp", "part", "months", "is_current", "start_text", "end_text"
        ))).alias("roles")
    )
    skills = (
        lines.groupBy("l_orderkey", (c("l_partkey") % 24).alias("s"))
        .agg(
            F.min("l_partkey").alias("part"),
            F.min("l_suppkey").alias("supp"),
            F.sum("l_quantity").cast("bigint").alias("quantity"),
        )
        .groupBy(c("l_orderkey").alias("sk_orderkey"))
        .agg(F.sort_array(F.collect_list(F.struct("part", "s", "supp", "quantity"))).alias(
            "skills"
        ))
    )
    k, cust = c("o_orderkey"), c("o_custkey")
    unused = cust % 60 == 7

    def role(r: Column) -> Column:
        service = F.lit(False) | (cust % 25 == 0)
        return F.struct(
            F.when(service, pick(SERVICE_COMPANIES, r["supp"] % 2))
            .otherwise(pick(COMPANIES, r["supp"] % 8)).alias("company"),
            F.when(cust % 24 == 3, F.lit("HR Manager"))
            .otherwise(pick(TITLES, (r["part"] * 7 + cust) % 12)).alias("title"),
            r["start_text"].alias("start_date"),
            r["end_text"].alias("end_date"),
            r["months"].cast("double").alias("duration_months"),
            r["is_current"].alias("is_current"),
            F.lit("Internet").alias("industry"),
            pick(COMPANY_SIZES, r["part"] % 8).alias("company_size"),
            pick(DESCRIPTIONS, r["part"] % 6).alias("description"),
        )

    def skill(s: Column) -> Column:
        return F.struct(
            pick(SKILL_NAMES, s["s"]).alias("name"),
            F.when(unused, F.lit("expert"))
            .otherwise(pick(PROFICIENCIES, s["supp"] % 5)).alias("proficiency"),
            (s["quantity"] % 60).cast("double").alias("endorsements"),
            F.when(unused, F.lit(0.0))
            .when(s["supp"] % 10 == 9, F.lit(None).cast("double"))
            .otherwise(((s["part"] * 7) % 72).cast("double")).alias("duration_months"),
        )

    no_roles = F.array().cast(roles.schema["roles"].dataType)
    no_skills = F.array().cast(skills.schema["skills"].dataType)
    joined = (
        orders.join(roles, k == c("l_orderkey"), "left")
        .join(skills, k == c("sk_orderkey"), "left")
        .withColumns({
            "roles": F.coalesce("roles", no_roles), "skills": F.coalesce("skills", no_skills),
        })
    )
    assessed = F.filter("skills", lambda s: s["s"] % 3 == 0)
    total = F.aggregate("roles", F.lit(0).cast("bigint"), lambda a, r: a + r["months"])
    title = F.when(cust % 24 == 3, F.lit("HR Manager")).otherwise(pick(TITLES, k % 12))
    bump = F.when(cust % 50 == 0, F.lit(8.0)).otherwise(F.lit(0.0))
    profile = F.struct(
        F.concat(F.lit("Person "), k.cast("string")).alias("anonymized_name"),
        F.concat(title, F.lit(" | profile")).alias("headline"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .otherwise(pick(JOB_TEXTS, k % 5)).alias("summary"),
        pick(tuple(p[0] for p in PLACES), cust % 5).alias("location"),
        pick(tuple(p[1] for p in PLACES), cust % 5).alias("country"),
        (F.round(total / F.lit(12.0), 1) + bump).alias("years_of_experience"),
        title.alias("current_title"),
        pick(COMPANIES, k % 8).alias("current_company"),
        pick(COMPANY_SIZES, k % 8).alias("current_company_size"),
        F.lit("Internet").alias("current_industry"),
    )
    idle = ((k * 11) % 400).cast("int")
    signals = F.struct(
        ((k * 29) % 101).cast("double").alias("profile_completeness_score"),
        F.when(k % 41 == 0, F.lit(None).cast("string"))
        .otherwise(F.date_sub(F.lit(CANDIDATE_AS_OF), idle).cast("string"))
        .alias("last_active_date"),
        (k % 3 != 0).alias("open_to_work_flag"),
        F.when(k % 500 == 499, F.lit(60.0)).otherwise((k % 25).cast("double"))
        .alias("applications_submitted_30d"),
        ((k * 37 % 101) / F.lit(100.0)).alias("recruiter_response_rate"),
        (k % 72).cast("double").alias("avg_response_time_hours"),
        F.map_from_arrays(
            F.transform(assessed, lambda s: pick(SKILL_NAMES, s["s"])),
            F.transform(assessed, lambda s: ((s["part"] * 31) % 101).cast("double")),
        ).alias("skill_assessment_scores"),
        pick(NOTICE_DAYS, k % 5).cast("double").alias("notice_period_days"),
        pick(WORK_MODES, k % 4).alias("preferred_work_mode"),
        (k % 2 == 0).alias("willing_to_relocate"),
        ((k * 17) % 102 - 1).cast("double").alias("github_activity_score"),
        (k % 15).cast("double").alias("saved_by_recruiters_30d"),
        ((k * 53 % 101) / F.lit(100.0)).alias("interview_completion_rate"),
        F.when(k % 4 == 0, F.lit(-1.0)).otherwise((k * 13 % 11) / F.lit(10.0))
        .alias("offer_acceptance_rate"),
        (k % 2 == 0).alias("verified_email"),
        (k % 5 < 3).alias("verified_phone"),
        (k % 7 < 4).alias("linkedin_connected"),
    )
    return joined.select(
        F.concat(F.lit("CAND_"), F.lpad(k.cast("string"), 7, "0")).alias("candidate_id"),
        profile.alias("profile"),
        F.transform("roles", role).alias("career_history"),
        F.transform("skills", skill).alias("skills"),
        signals.alias("signals"),
    )


CANDIDATE_SQL = """
roles AS (
  SELECT *, CASE WHEN is_current AND part % 50 <> 0 THEN least(raw, worked) ELSE raw END AS months,
         CASE WHEN part % 333 = 0 THEN NULL ELSE start END AS start_date,
         CASE WHEN NOT is_current THEN start + CAST(CASE WHEN part % 200 = 0 THEN 30 ELSE raw * 30 END AS INTEGER) END AS end_date
  FROM (
    SELECT o_orderkey AS k, o_custkey AS c, ln, start, supp, part,
           CASE WHEN (supp * 7 + part) % 97 = 0 THEN 100 ELSE 1 + (part * 13) % 72 END AS raw,
           (part + ln) % 5 = 0 AS is_current,
           CAST(floor((DATE '2001-12-31' - start) / 30.44::DOUBLE) AS BIGINT) AS worked,
           CASE WHEN o_custkey % 25 = 0 THEN ['Infosys','TCS'][supp % 2 + 1]
                ELSE ['Swiggy','Razorpay','Infosys','Flipkart','TCS','Zomato','Wipro','Acme Industries'][supp % 8 + 1] END AS company,
           CASE WHEN o_custkey % 24 = 3 THEN 'HR Manager' ELSE {titles}[(part * 7 + o_custkey) % 12 + 1] END AS title,
           ['1-10','11-50','51-200','201-500','501-1000','1001-5000','5001-10000','10001+'][part % 8 + 1] AS company_size,
           {descriptions}[part % 6 + 1] AS description
    FROM (SELECT l_orderkey, l_linenumber AS ln, CAST(min(l_shipdate) AS DATE) AS start,
                 min(l_suppkey) AS supp, min(l_partkey) AS part
          FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey)),
skills AS (
  SELECT o_orderkey AS k, o_custkey AS c, s, part, supp, {skill_names}[s + 1] AS name,
         CASE WHEN o_custkey % 60 = 7 THEN 'expert' ELSE ['beginner','intermediate','advanced','expert','native'][supp % 5 + 1] END AS proficiency,
         quantity % 60 AS endorsements,
         CASE WHEN o_custkey % 60 = 7 THEN 0 WHEN supp % 10 = 9 THEN 0 ELSE (part * 7) % 72 END AS months,
         CASE WHEN s % 3 = 0 THEN ((part * 31) % 101)::DOUBLE END AS score,
         s < 16 AS core, s < 8 AS retrieval, s BETWEEN 8 AND 11 AS lm, s BETWEEN 12 AND 14 AS ml,
         s BETWEEN 16 AND 18 AS vision, s > 18 AS off_topic, s = 13 AS nlp
  FROM (SELECT l_orderkey, l_partkey % 24 AS s, min(l_partkey) AS part, min(l_suppkey) AS supp,
               CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey),
person AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'CAND_' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS candidate_id,
         CASE WHEN o_custkey % 24 = 3 THEN 'HR Manager' ELSE {titles}[o_orderkey % 12 + 1] END AS current_title,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {jobs}[o_orderkey % 5 + 1] END AS summary,
         ['Pune, Maharashtra','Bengaluru, Karnataka','Chennai, Tamil Nadu','Berlin','London'][o_custkey % 5 + 1] AS location,
         ['India','India','India','Germany','United Kingdom'][o_custkey % 5 + 1] AS country,
         round(coalesce(total, 0) / 12.0::DOUBLE, 1) + CASE WHEN o_custkey % 50 = 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS yoe,
         coalesce(total, 0) AS total_months
  FROM orders LEFT JOIN (SELECT k, sum(months) AS total FROM roles GROUP BY k) t ON t.k = o_orderkey)
"""


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def candidate_sql() -> str:
    """The flat form of the same candidates for the SQL check: roles, skills, person."""
    return CANDIDATE_SQL.format(
        titles=_sql_list(TITLES), descriptions=_sql_list(DESCRIPTIONS),
        skill_names=_sql_list(SKILL_NAMES), jobs=_sql_list(JOB_TEXTS),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per region: (jd_id, text)."""
    c = F.col
    return load(spark, sf_dir, "region").select(
        c("r_regionkey").cast("bigint").alias("jd_id"),
        pick(JOB_TEXTS, c("r_regionkey") % 5).alias("text"),
    )


# --- evidence: one artifact per event -------------------------------------------------


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work artifacts: the user is the developer, the event type the kind of work."""
    c = F.col
    source = None
    for event_type, kind in EVENT_SOURCES.items():
        hit = c("event_type") == event_type
        source = F.when(hit, F.lit(kind)) if source is None else source.when(hit, F.lit(kind))
    first = pick(EVIDENCE_SKILLS, c("k") % 24)
    second = pick(EVIDENCE_SKILLS, (c("k") * 7 + 1) % 24)
    skills = F.when(c("k") % 4 == 0, F.array_distinct(F.array(first, second))).otherwise(
        F.array(first)
    )
    return events(spark, sf_dir).select(
        c("event_id").alias("artifact_id"),
        c("user_id").alias("developer_id"),
        source.alias("source_type"),
        (1 + F.floor("value") % 5).cast("int").alias("complexity"),
        c("ts").alias("artifact_date"),
        (c("value") > 50).alias("production_signal"),
        F.concat(c("event_type"), F.lit(" work "), c("k").cast("string")).alias("summary"),
        skills.alias("skills"),
    )


def developers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users with a user name, and a display name for two out of three."""
    c = F.col
    return (
        load(spark, sf_dir, "events").select(c("user_id").alias("developer_id")).distinct()
        .withColumns({
            "github_username": F.concat(F.lit("user"), c("developer_id").cast("string")),
            "display_name": F.when(
                c("developer_id") % 3 != 0,
                F.concat(F.lit("User "), c("developer_id").cast("string")),
            ),
        })
    )


EVIDENCE_SQL = """
artifacts AS (
  SELECT event_id AS artifact_id, user_id AS developer_id,
         CASE event_type WHEN 'purchase' THEN 'commit_diff' WHEN 'view' THEN 'pr_review'
              WHEN 'error' THEN 'issue_thread' WHEN 'click' THEN 'so_answer' WHEN 'signup' THEN 'resume_claim' END AS source_type,
         CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS complexity, ts AS artifact_date, value > 50 AS production_signal,
         event_type || ' work ' || k AS summary, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
demonstrates AS (
  SELECT DISTINCT artifact_id, unnest(CASE WHEN k % 4 = 0 THEN [{skills}[k % 24 + 1], {skills}[(k * 7 + 1) % 24 + 1]]
                                           ELSE [{skills}[k % 24 + 1]] END) AS skill_name
  FROM artifacts),
developers AS (
  SELECT DISTINCT user_id AS developer_id, 'user' || user_id AS github_username,
         CASE WHEN user_id % 3 <> 0 THEN 'User ' || user_id END AS display_name FROM events)
"""


def evidence_sql() -> str:
    return EVIDENCE_SQL.format(skills=_sql_list(EVIDENCE_SKILLS))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search text per nation: (query_id, text)."""
    c = F.col
    return load(spark, sf_dir, "nation").select(
        c("n_nationkey").cast("bigint").alias("query_id"),
        F.when(c("n_nationkey") < 8, pick(QUERY_TEXTS, c("n_nationkey") % 8))
        .otherwise(F.concat(
            pick(EVIDENCE_SKILLS, c("n_nationkey") % 24), F.lit(" "),
            pick(QUERY_TEXTS, c("n_nationkey") % 8),
        )).alias("text"),
    )
