"""Developer activity exports and plain-text resumes as artifact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel.functions.dates import safe_timestamp
from laurel.functions.text import content_hash, extract_skills

_BODY = "struct<nodes:array<struct<body:string>>>"
EXPORT_DDL = (
    "user struct<login:string,name:string,avatarUrl:string,repositories:struct<nodes:"
    "array<struct<name:string,defaultBranchRef:struct<target:struct<history:struct<nodes:"
    "array<struct<oid:string,message:string,additions:bigint,deletions:bigint,"
    "committedDate:string,url:string>>>>>,"
    "pullRequests:struct<nodes:array<struct<title:string,body:string,state:string,"
    f"createdAt:string,mergedAt:string,url:string,reviews:{_BODY}>>>,"
    "issues:struct<nodes:array<struct<title:string,body:string,state:string,"
    f"createdAt:string,url:string,comments:{_BODY}>>>>>>>"
)
ARTIFACT_COLUMNS = (
    "developer_id", "source_type", "raw_content", "content_hash", "source_url",
    "artifact_date",
)


def read_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Export payloads, one JSON object per file (or per line)."""
    return spark.read.schema(EXPORT_DDL).option("multiLine", multi_line).json(path)


def commit_content(message: Column, additions: Column, deletions: Column, repo: Column
                   ) -> Column:
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    return F.concat(
        text(message), F.lit("\n(+"), count(additions), F.lit(" -"), count(deletions),
        F.lit(" in "), text(repo), F.lit(")"),
    )


def discussion_content(title: Column, body: Column, replies: Column) -> Column:
    """Title, body and replies on lines of their own, trimmed."""
    head = F.array(F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    tail = F.coalesce(replies, F.array().cast("array<string>"))
    lines = F.concat(head, F.transform(tail, lambda x: F.coalesce(x, F.lit(""))))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def flatten_export(export: DataFrame) -> DataFrame:
    """Commits, pull requests and issues of each export as artifact rows. Missing levels
    simply give no rows."""
    c = F.col
    repos = export.select(
        c("user.login").alias("developer_id"),
        F.explode("user.repositories.nodes").alias("repo"),
    )

    def children(path: str) -> DataFrame:
        return repos.select(
            "developer_id", c("repo.name").alias("repo"), F.explode(path).alias("x")
        )

    def rows(df: DataFrame, kind: str, raw: Column, hashed: Column, date: str) -> DataFrame:
        return df.select(
            "developer_id", F.lit(kind).alias("source_type"), raw.alias("raw_content"),
            hashed.alias("content_hash"),
            F.coalesce("x.url", F.lit("")).alias("source_url"),
            safe_timestamp(c(date)).alias("artifact_date"),
        )

    commits = rows(
        children("repo.defaultBranchRef.target.history.nodes"), "commit_diff",
        commit_content(c("x.message"), c("x.additions"), c("x.deletions"), c("repo")),
        content_hash(c("x.oid"), c("x.message")), "x.committedDate",
    )
    pulls = rows(
        children("repo.pullRequests.nodes"), "pr_review",
        discussion_content(c("x.title"), c("x.body"), c("x.reviews.nodes.body")),
        content_hash(c("x.url"), c("x.body")), "x.createdAt",
    )
    issues = rows(
        children("repo.issues.nodes"), "issue_thread",
        discussion_content(c("x.title"), c("x.body"), c("x.comments.nodes.body")),
        content_hash(c("x.url"), c("x.body")), "x.createdAt",
    )
    return union_artifacts(commits, pulls, issues)


def union_artifacts(*kinds: DataFrame) -> DataFrame:
    """One artifact table; blank content is skipped."""
    out = kinds[0]
    for kind in kinds[1:]:
        out = out.unionByName(kind)
    return out.filter(F.trim("raw_content") != "")


def since(artifacts: DataFrame, moment: Column) -> DataFrame:
    """Incremental filter: undated rows stay."""
    return artifacts.filter(
        F.col("artifact_date").isNull() | (F.col("artifact_date") >= moment)
    )


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (path, text, skills, char_count)."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return resume_skills(files, "path", "value")


def resume_skills(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(
        id_col, F.trim(text_col).alias("text"),
        extract_skills(F.col(text_col)).alias("skills"),
        F.length(text_col).alias("char_count"),
    )


def resume_claims(resumes: DataFrame, id_col: str = "path") -> DataFrame:
    """Self-reported skills as weak evidence rows."""
    return resumes.select(
        F.col(id_col).alias("developer_id"), F.explode("skills").alias("skill_name"),
        F.lit("resume_claim").alias("source_type"),
        F.lit(None).cast(T.TimestampType()).alias("artifact_date"),
        F.lit(1).alias("complexity"),
    )
