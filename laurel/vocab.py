"""Reference vocabularies and weights. All names are lower case.

The entries are fixed values: results depend on them, so they are listed as they
must be, not derived.
"""

from __future__ import annotations

# --- fixed values: skill families -------------------------------------------------

RETRIEVAL_SKILLS = (
    "vector search", "semantic search", "hybrid search", "faiss", "pinecone", "qdrant",
    "weaviate", "milvus", "pgvector", "elasticsearch", "opensearch", "bm25", "haystack",
    "information retrieval", "retrieval", "recommendation systems", "recommendation",
    "learning to rank", "ltr", "ranking", "search relevance", "embeddings",
    "sentence transformers",
)

LLM_SKILLS = (
    "llms", "large language models", "fine-tuning llms", "fine-tuning", "lora", "qlora",
    "peft", "rag", "hugging face transformers", "transformers", "prompt engineering",
    "langchain", "llamaindex",
)

CORE_ML_SKILLS = (
    "nlp", "natural language processing", "machine learning", "deep learning", "pytorch",
    "tensorflow", "scikit-learn", "xgboost", "lightgbm", "feature engineering", "mlops",
    "mlflow", "kubeflow", "statistical modeling", "data science", "model serving",
    "bentoml", "weights & biases",
)

JD_CORE_SKILLS = RETRIEVAL_SKILLS + LLM_SKILLS + CORE_ML_SKILLS + ("python",)

CV_SPEECH_ROBOTICS_SKILLS = (
    "computer vision", "opencv", "cnn", "object detection", "yolo", "image classification",
    "image segmentation", "diffusion models", "gans", "asr", "tts", "speech recognition",
    "speech synthesis", "robotics", "slam", "point cloud", "optical flow",
)

NON_RELEVANT_SKILLS = (
    "photoshop", "illustrator", "figma", "solidworks", "creo", "ansys", "autocad",
    "marketing", "seo", "excel", "powerpoint", "accounting", "tally", "sap", "hr",
    "human resources", "recruitment", "salesforce crm", "salesforce", "crm", "erp",
    "content writing", "copywriting", "sales", "six sigma", "customer support",
    "project management",
)

NLP_SKILLS = ("nlp", "natural language processing")

PROFICIENCY_WEIGHTS = {
    "beginner": 0.25, "intermediate": 0.50, "advanced": 0.80, "expert": 1.00,
}

# --- fixed values: companies, titles, locations -------------------------------------

CONSULTING_FIRMS = (
    "tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini",
    "hcl", "tech mahindra", "mphasis", "ltimindtree", "mindtree", "l&t infotech", "lti",
    "igate", "syntel", "hexaware", "birlasoft", "cybage", "persistent systems",
    "ust global", "ust", "nttdata", "ntt data", "dxc technology", "dxc", "atos",
    "ibm services",
)

TECHNICAL_TITLE_TOKENS = (
    "engineer", "developer", "scientist", "ml ", "ai ", "machine learning", "data",
    "programmer", "architect", "sde", "researcher", "research", "applied scientist",
    "nlp", "devops", "sre", "backend", "platform",
)

NON_TECHNICAL_TITLE_TOKENS = (
    "marketing", "hr", "human resource", "sales", "account", "graphic", "content writer",
    "content writing", "copywriter", "operations", "recruit", "talent", "customer support",
    "business development", "civil engineer", "mechanical engineer",
    "electrical engineer", "designer", "project manager", "program manager",
)

AI_TITLE_TOKENS = (
    "ml", "ai", "machine learning", "data scientist", "applied scientist", "nlp",
    "research", "data engineer",
)

# ordered: the first rule that matches gives the level; no match means 2
TITLE_LEVELS = (
    (7, ("director", "vp", "vice president", "head of", "chief")),
    (6, ("manager", "lead manager")),
    (5, ("principal", "architect", "distinguished")),
    (4, ("staff", "lead", "tech lead")),
    (3, ("senior", "sr.", "sr ")),
    (0, ("intern", "trainee")),
    (1, ("junior", "jr.", "associate", "graduate")),
)
DEFAULT_TITLE_LEVEL = 2

PRODUCTION_KEYWORDS = (
    "production", "deployed", "deploy", "users", "scale", "scaled", "latency", "pipeline",
    "real-time", "realtime", "a/b", "experiment", "metric", "ndcg", "mrr", "recall",
    "precision", "retrieval", "ranking", "rank", "embedding", "vector", "fine-tun",
    "recommendation", "recommender", "search", "throughput", "sla", "p99", "inference",
    "serving", "index", "relevance", "click-through", "ctr",
)

PREFERRED_LOCATIONS = (
    "pune", "noida", "delhi", "new delhi", "gurgaon", "gurugram", "ncr", "hyderabad",
    "mumbai", "bangalore", "bengaluru",
)

# --- fixed values: the forty numeric columns, in contract order ---------------------

CAREER_FEATURES = (
    "role_count", "total_experience_years", "avg_tenure_months",
    "scope_progression_score", "has_recent_career_gap", "product_company_ratio",
    "all_consulting_career", "last_role_start_recency_months", "avg_title_tenure_months",
    "title_chaser_flag", "avg_description_words", "has_production_keywords",
)
SKILL_FEATURES = (
    "jd_skill_match_count", "jd_skill_match_ratio", "retrieval_skill_count",
    "llm_skill_count", "cv_speech_dominance", "non_relevant_skill_count",
    "skill_trust_score", "keyword_stuffer_flag", "assessment_verified_skills",
    "assessment_mean_score", "top_assessment_score", "max_jd_skill_duration_months",
    "recent_jd_skill_flag",
)
JOB_FIT_FEATURES = ("jd_fit_score", "location_fit", "wrong_specialisation_penalty")
SIGNAL_FEATURES = (
    "days_since_active", "recency_score", "availability_score", "engagement_score",
    "trust_score", "github_activity_score", "github_linked", "notice_period_days",
    "open_to_work", "offer_acceptance_rate", "behavioural_composite",
)
NUMERIC_FEATURES = (
    CAREER_FEATURES + SKILL_FEATURES + JOB_FIT_FEATURES + SIGNAL_FEATURES + ("is_honeypot",)
)

# --- fixed values: evidence ---------------------------------------------------------

SOURCE_WEIGHTS = {
    "commit_diff": 1.0, "pr_review": 0.9, "issue_thread": 0.7, "so_answer": 0.6,
    "assessment_score": 0.5, "resume_claim": 0.2,
}
DEFAULT_SOURCE_WEIGHT = 0.2
WORK_SOURCES = ("commit_diff", "pr_review", "issue_thread")

# canonical skill -> spellings, in the order in which a lookup tries them
EXPLICIT_ALIASES = {
    "kubernetes": ("kubernetes", "k8s"),
    "docker": ("docker", "containerization", "containers"),
    "postgresql": ("postgresql", "postgres", "psql"),
    "redis": ("redis",),
    "kafka": ("kafka", "apache kafka"),
    "python": ("python", "py"),
    "go": ("golang", "go "),
    "rust": ("rust",),
    "typescript": ("typescript", "ts"),
    "react": ("react", "reactjs", "react.js"),
    "vector search": ("vector search", "vector database", "ann", "approximate nearest"),
    "semantic search": ("semantic search",),
    "elasticsearch": ("elasticsearch", "elastic search", "es"),
    "faiss": ("faiss",),
    "pinecone": ("pinecone",),
    "qdrant": ("qdrant",),
    "embeddings": ("embeddings", "embedding"),
    "sentence transformers": ("sentence transformers", "sbert", "sentence-transformers"),
    "fine-tuning llms": ("fine-tuning", "fine tuning", "finetune", "lora", "qlora", "peft"),
    "nlp": ("nlp", "natural language processing"),
    "information retrieval": ("information retrieval", "ir ", "retrieval"),
    "learning to rank": ("learning to rank", "ltr", "lambdamart"),
    "recommendation systems": ("recommendation", "recommender", "recsys"),
    "distributed systems": (
        "distributed systems", "distributed system", "consensus", "raft",
    ),
    "concurrency": ("concurrency", "race condition", "deadlock", "mutex", "goroutine"),
    "observability": (
        "observability", "prometheus", "grafana", "tracing", "opentelemetry",
    ),
    "ci/cd": ("ci/cd", "cicd", "github actions", "jenkins"),
    "graphql": ("graphql",),
    "grpc": ("grpc",),
    "pytorch": ("pytorch", "torch"),
    "tensorflow": ("tensorflow", "tf "),
    "mlops": ("mlops", "model serving", "mlflow", "kubeflow"),
}

ARTIFACT_PRODUCTION_TOKENS = (
    "production", "deployed", "users", "scale", "latency", "incident", "monitoring",
    "a/b", "experiment", "throughput", "p99", "sla", "rollout",
)
HARD_TOKENS = (
    "race condition", "deadlock", "distributed", "consensus", "throughput", "latency",
    "scale", "optimi", "memory leak", "concurren", "sharding",
)
TRIVIAL_TOKENS = ("typo", "readme", "comment", "lint", "formatting", "rename", "bump")
COLLABORATION_TOKENS = (
    "review", "discuss", "feedback", "pair", "teammate", "approve", "comment",
)

# ordered: first match wins; no match means "feature"
ARTIFACT_CATEGORIES = (
    ("debugging", ("race condition", "deadlock", "bug", "fix", "crash", "regression")),
    ("architecture", ("architecture", "design", "rfc", "consensus", "schema")),
    ("infrastructure",
     ("deploy", "infra", "terraform", "kubernetes", "ci/cd", "pipeline")),
    ("refactoring", ("refactor", "cleanup", "rename", "migrate")),
    ("review", ("review", "lgtm", "approve")),
)
DEFAULT_CATEGORY = "feature"

QUERY_PRODUCTION_HINTS = (
    "production", "deployed", "shipped", "real users", "at scale", "incident", "live",
    "users",
)
QUERY_HARD_HINTS = (
    "debug", "race condition", "deadlock", "fixed", "bug", "crash", "memory leak",
    "concurren", "hard problem", "complex",
)

RERANK_STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "with", "on", "at", "by", "is",
    "are", "be", "as", "we", "you", "our", "your", "they", "this", "that", "from", "will",
    "can", "must", "have", "has", "it", "its", "their", "who", "whom", "able", "strong",
)

# --- end of fixed values ------------------------------------------------------------


def skill_aliases() -> dict[str, tuple[str, ...]]:
    """All canonical skills: the explicit ones first, then every other known job skill
    under its own name, alphabetically (a defined order for first-match lookups)."""
    table = dict(EXPLICIT_ALIASES)
    for skill in sorted(RETRIEVAL_SKILLS + LLM_SKILLS + CORE_ML_SKILLS):
        table.setdefault(skill, (skill,))
    return table
