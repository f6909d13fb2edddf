"""Queries over free text: tokens, BM25, hashed vectors, fusion, skills, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel import vocab
from laurel.catalog.registry import query, rounded, stored_path
from laurel.catalog.sqltext import has
from laurel.functions import text as X
from laurel.operators import evidence, metrics, pivots, ranking, retrieval, textindex
from laurel.sources import artifacts
from laurel.sources import tables as t

TOK = "regexp_extract_all(lower(text), '[a-z0-9+#./-]+')"
STOP = ",".join(f"'{w}'" for w in vocab.RERANK_STOP_WORDS)
RTOK = (f"list_filter(regexp_extract_all(lower(text), '[a-z0-9+#.]+'), "
        f"lambda x: length(x) > 1 AND x NOT IN ({STOP}))")
CODE = "('0x' || substr(md5(tok), 1, 8))::UBIGINT"


def _benchmark(spark, sf):
    return t.load(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))


@query("token_counts", f"""SELECT doc_id, len({TOK})::INTEGER AS tokens, len(list_distinct({TOK}))::INTEGER AS distinct_tokens,
  len({RTOK})::INTEGER AS rerank_tokens FROM documents""")
def token_counts(spark, sf):
    staged = t.documents(spark, sf).withColumn("toks", X.tokenize(F.col("text")))
    return staged.select(
        "doc_id", F.size("toks").alias("tokens"),
        F.size(F.array_distinct("toks")).alias("distinct_tokens"),
        F.size(X.rerank_tokens(F.col("text"))).alias("rerank_tokens"),
    )


# --- BM25 -----------------------------------------------------------------------------

_INDEX = f"""docs AS (SELECT doc_id, {TOK} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
tf AS (SELECT doc_id, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS tok FROM docs) GROUP BY ALL),
terms AS (SELECT tok, count(*) AS df, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY tok, n)"""

_BM25 = f"""{_INDEX},
asked AS (SELECT DISTINCT item_id, unnest({TOK}) AS tok FROM benchmark),
bm25 AS (SELECT item_id, doc_id, sum(idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN terms USING (tok) JOIN tf USING (tok), stats GROUP BY ALL)"""


@query("bm25_index_terms", f"WITH {_INDEX} SELECT tok AS term, df, round(idf, 6) AS idf FROM terms")
def bm25_index_terms(spark, sf):
    tokens = retrieval.token_table(t.documents(spark, sf), "doc_id", "text")
    return rounded(retrieval.term_stats(tokens))


@query("bm25_postings", f"WITH {_INDEX} SELECT tok AS term, count(*) AS docs, sum(tf)::BIGINT AS occurrences, sum(dl)::BIGINT AS doc_lengths FROM tf JOIN terms USING (tok) GROUP BY tok")
def bm25_postings(spark, sf):
    tokens = retrieval.token_table(t.documents(spark, sf), "doc_id", "text")
    return retrieval.postings(tokens, "doc_id").groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences"),
        F.sum("doc_len").alias("doc_lengths"),
    )


@query("bm25_corpus_stats", f"WITH {_INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark, sf):
    tokens = retrieval.token_table(t.documents(spark, sf), "doc_id", "text")
    return rounded(retrieval.corpus_stats(tokens))


@query("bm25_scores", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM bm25")
def bm25_scores(spark, sf):
    return rounded(retrieval.bm25_scores(
        t.documents(spark, sf), _benchmark(spark, sf), "doc_id", "text", "item_id", "question"
    ))


def text_index(spark, sf) -> textindex.TextIndex:
    """The documents' index, written once: searches read it like any stored index."""
    root = stored_path(spark, sf, "text_index", lambda path: textindex.write_index(
        t.documents(spark, sf), "doc_id", "text", path, code="md5"
    ))
    return textindex.read_index(spark, root)


@query("bm25_top", f"""WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e9 + 0.5) DESC, doc_id)::INTEGER AS rank FROM bm25 WHERE score > 0) WHERE rank <= 20""")
def bm25_top(spark, sf):
    """The best twenty documents of each benchmark text by BM25, from the stored index."""
    found = textindex.bm25_top(
        text_index(spark, sf), _benchmark(spark, sf), "item_id", "question", 20
    )
    return rounded(found.withColumnRenamed("id", "doc_id"))


@query("bm25_custom_tokens", f"""WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
tf AS (SELECT doc_id, len(toks) AS dl, tok, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS tok FROM docs) GROUP BY ALL),
terms AS (SELECT tok, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY tok, n),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM benchmark),
bm25 AS (SELECT item_id, doc_id, sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN terms USING (tok) JOIN tf USING (tok), stats GROUP BY ALL)
SELECT item_id, count(*) AS docs, round(max(score), 6) AS best, round(sum(score), 3) AS total FROM bm25 GROUP BY item_id""")
def bm25_custom_tokens(spark, sf):
    """The tokenizer is an argument; here letters only, whole texts, other constants."""
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    scores = retrieval.bm25_scores(
        t.documents(spark, sf), _benchmark(spark, sf), "doc_id", "text", "item_id",
        "question", k1=1.2, b=0.5, tok=letters,
    )
    return scores.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("docs"), F.round(F.max("score"), 6).alias("best"),
        F.round(F.sum("score"), 3).alias("total"),
    )


# --- hashed vectors and cosine --------------------------------------------------------


def _vectors(table: str, id_col: str) -> str:
    return f"""(SELECT {id_col}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {id_col})) AS x FROM (
      SELECT {id_col}, h % 384 AS bucket, sum(CASE WHEN (h >> 20) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT {id_col}, {CODE} AS h FROM (SELECT {id_col}, unnest({TOK}) AS tok FROM {table})) GROUP BY ALL) WHERE v <> 0)"""


_COSINE = f"""dv AS {_vectors('documents', 'doc_id')}, qv AS {_vectors('benchmark', 'item_id')},
dots AS (SELECT item_id, doc_id, sum(dv.x * qv.x) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL),
cosine AS (SELECT b.item_id, d.doc_id, coalesce(score, 0) AS score FROM documents d CROSS JOIN benchmark b LEFT JOIN dots USING (item_id, doc_id))"""


@query("hashed_vectors", f"""WITH dv AS {_vectors('documents', 'doc_id')}
SELECT doc_id, bucket::INTEGER AS bucket, round(x, 6) AS x FROM dv""")
def hashed_vectors(spark, sf):
    """The non-zero cells of the unit vectors (md5 codes, which the check also has)."""
    vectors = retrieval.hashed_vectors(t.documents(spark, sf), "doc_id", "text", code="md5")
    cells = vectors.select("doc_id", F.posexplode("vector").alias("bucket", "x"))
    return rounded(cells.filter("x <> 0"))


@query("hashed_vectors_crc32", f"SELECT doc_id, CASE WHEN len({TOK}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def hashed_vectors_crc32(spark, sf):
    """The same with the standard crc32 codes, as lengths: SQL has no crc32."""
    return rounded(retrieval.hashed_vectors(t.documents(spark, sf), "doc_id", "text").select(
        "doc_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("norm"),
    ))


@query("cosine_scores", f"""WITH {_COSINE} SELECT item_id, doc_id, round(score, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e9 + 0.5) DESC, doc_id) AS n FROM cosine) WHERE n <= 100""")
def cosine_scores(spark, sf):
    """The hundred nearest documents of each benchmark text."""
    return rounded(retrieval.hashed_cosine(
        t.documents(spark, sf), _benchmark(spark, sf), "doc_id", "text", "item_id",
        "question", code="md5", k=100,
    ))


@query("dense_cosine_top", """WITH q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label),
scored AS (SELECT label, vec_id, list_dot_product(embedding::DOUBLE[], qv) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(qv, qv)) AS score
  FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN q)
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 50""")
def dense_cosine_top(spark, sf):
    """Nearest fifty given vectors to the first vector of each label."""
    vectors = t.spread(t.load(spark, sf, "embeddings"))
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = retrieval.dense_cosine(
        vectors, queries, "vec_id", "embedding", "label", "q", k=60
    )
    keyed = scored.withColumn("key", F.round("score", 9))
    return rounded(ranking.top_k(
        keyed, 50, [F.col("key").desc(), F.col("vec_id")], "label"
    ).drop("key"))


_NEAREST = """WITH q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY label),
scored AS (SELECT label, vec_id, list_dot_product(embedding::DOUBLE[], qv) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(qv, qv)) AS score
  FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN q)
SELECT label, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY floor(score * 1e9 + 0.5) DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 50"""


@query("pivot_nearest", _NEAREST)
def pivot_nearest(spark, sf):
    """The same from vectors stored by pivot: groups that cannot hold a nearer one stay closed."""
    vectors = t.load(spark, sf, "embeddings")
    root = stored_path(spark, sf, "vector_index", lambda path: pivots.write_vectors(
        t.spread(vectors), "vec_id", "embedding", path
    ))
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    found, _ = pivots.nearest(pivots.read_vectors(spark, root), queries, "label", "q", 50)
    return rounded(found.withColumnRenamed("id", "vec_id"))


# --- ranks and fusion -----------------------------------------------------------------


@query("global_rank", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents")
def global_rank(spark, sf):
    docs = t.load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return ranking.rank_positions(docs, "score", "doc_id").select("doc_id", "rank")


@query("rank_per_group", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents")
def rank_per_group(spark, sf):
    docs = t.load(spark, sf, "documents").select(
        "source", "doc_id", F.col("n_chars").cast("double").alias("score")
    )
    return ranking.rank_positions(docs, "score", "doc_id", "source").select(
        "source", "doc_id", "rank"
    )


@query("minmax_scores", """SELECT doc_id, round((n_chars - lo) / (hi - lo), 6) AS overall, round(CASE WHEN ghi - glo < 1e-12 THEN 0 ELSE (n_chars - glo) / (ghi - glo) END, 6) AS by_source
FROM (SELECT *, min(n_chars) OVER () AS lo, max(n_chars) OVER () AS hi, min(n_chars) OVER (PARTITION BY source) AS glo, max(n_chars) OVER (PARTITION BY source) AS ghi FROM (SELECT doc_id, source, n_chars::DOUBLE AS n_chars FROM documents))""")
def minmax_scores(spark, sf):
    docs = t.load(spark, sf, "documents").select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("x")
    )
    overall = ranking.minmax(docs, "x", "overall")
    return rounded(ranking.minmax(overall, "x", "by_source", "source").select(
        "doc_id", "overall", "by_source"
    ))


@query("exact_quantiles", """SELECT unnest([0.5, 0.75, 0.9, 0.97, 0.99])::DOUBLE AS probability,
  round(unnest(quantile_cont(n_chars::DOUBLE, [0.5, 0.75, 0.9, 0.97, 0.99])), 6) AS value FROM documents""")
def exact_quantiles(spark, sf):
    docs = t.load(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("x"))
    return rounded(ranking.exact_quantiles(docs, "x", [0.5, 0.75, 0.9, 0.97, 0.99]))


def _key(x: str) -> str:
    return f"floor({x} * 1e9 + 0.5)"


_FUSED = f"""{_BM25}, {_COSINE},
ranked AS (
  SELECT item_id, doc_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id)) AS credit FROM bm25 WHERE {_key('score')} > 0
  UNION ALL
  SELECT item_id, doc_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id)) FROM cosine WHERE {_key('score')} > 0),
credits AS (SELECT item_id, doc_id, sum(coalesce(credit, 0)) AS credit
  FROM (SELECT item_id, doc_id FROM documents CROSS JOIN benchmark) LEFT JOIN ranked USING (item_id, doc_id) GROUP BY ALL),
fused AS (SELECT item_id, doc_id, (credit - min(credit) OVER w) / (max(credit) OVER w - min(credit) OVER w) AS retrieval_score FROM credits WINDOW w AS (PARTITION BY item_id))"""


def _fused(spark, sf):
    return retrieval.retrieval_scores(
        t.documents(spark, sf), _benchmark(spark, sf), "doc_id", "text", "item_id",
        "question", code="md5",
    )


@query("fused_retrieval", f"WITH {_FUSED} SELECT item_id, doc_id, round(retrieval_score, 6) AS retrieval_score FROM fused WHERE retrieval_score > 0")
def fused_retrieval(spark, sf):
    return rounded(_fused(spark, sf).filter("retrieval_score > 0"))


@query("hybrid_search", f"""WITH {_FUSED} SELECT item_id, doc_id, round(retrieval_score, 6) AS retrieval_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_key('retrieval_score')} DESC, doc_id)::INTEGER AS rank FROM fused) WHERE rank <= 20""")
def hybrid_search(spark, sf):
    found = textindex.fused_top(
        text_index(spark, sf), _benchmark(spark, sf), "item_id", "question", 20
    )
    return rounded(found.select("item_id", F.col("id").alias("doc_id"), "retrieval_score", "rank"))


@query("fused_top", f"""WITH {_FUSED}, places AS (
  SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id) AS bm25_rank, NULL::BIGINT AS cosine_rank FROM bm25 WHERE {_key('score')} > 0
  UNION ALL SELECT item_id, doc_id, NULL, row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id) FROM cosine WHERE {_key('score')} > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_key('retrieval_score')} DESC, doc_id)::INTEGER AS rank FROM fused)
SELECT item_id, doc_id, max(bm25_rank) AS bm25_rank, max(cosine_rank) AS cosine_rank, rank FROM top JOIN places USING (item_id, doc_id) WHERE rank <= 50 GROUP BY ALL""")
def fused_top(spark, sf):
    """The best fifty documents of each benchmark text with their exact place in both lists."""
    found = textindex.fused_top(
        text_index(spark, sf), _benchmark(spark, sf), "item_id", "question", 50
    )
    return found.select(
        "item_id", F.col("id").alias("doc_id"), "bm25_rank", "cosine_rank", "rank"
    )


_LISTS = """lists AS (
  SELECT lang, 'chars' AS list, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents
  UNION ALL
  SELECT lang, 'grade', doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) - 1 FROM documents JOIN labels USING (doc_id))"""


@query("fused_rankings", f"WITH {_LISTS} SELECT lang, doc_id, round(sum(1.0::DOUBLE / (61 + rank)), 6) AS rrf_score FROM lists GROUP BY ALL")
def fused_rankings(spark, sf):
    """Classic fusion of two ranked lists of documents per language."""
    docs = t.load(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    graded = docs.join(t.load(spark, sf, "labels"), "doc_id")
    one = ranking.rank_positions(
        docs.select("lang", "doc_id", F.col("n_chars").cast("double").alias("score")),
        "score", "doc_id", "lang",
    )
    two = ranking.rank_positions(
        graded.select("lang", "doc_id", F.col("quality").cast("double").alias("score")),
        "score", "doc_id", "lang",
    )
    cols = ["lang", "doc_id", "rank"]
    return rounded(ranking.fuse_rankings(
        one.select(cols).unionByName(two.select(cols)), "doc_id", "lang"
    ))


@query("score_lookup", """SELECT doc_id, coalesce(toxic::DOUBLE + quality, 0) AS retrieval_score FROM documents LEFT JOIN labels USING (doc_id)""")
def score_lookup(spark, sf):
    """Pool scores put on the rows to rank, 0 where an id has none."""
    scores = t.load(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") + F.col("quality")).cast("double").alias("retrieval_score")
    )
    docs = t.load(spark, sf, "documents").select("doc_id")
    return retrieval.lookup_scores(docs, scores, "doc_id")


@query("single_modality", f"""WITH {_BM25}, r AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id)) AS credit FROM bm25),
m AS (SELECT item_id, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0 ELSE min(credit) END AS lo, max(credit) AS hi FROM r GROUP BY item_id)
SELECT item_id, doc_id, round((credit - lo) / (hi - lo), 6) AS retrieval_score FROM r JOIN m USING (item_id)""")
def single_modality(spark, sf):
    """Fusion still works when one of the two score lists is missing."""
    return rounded(retrieval.retrieval_scores(
        t.documents(spark, sf), _benchmark(spark, sf), "doc_id", "text", "item_id",
        "question", modalities=("bm25",),
    ))


# --- lexical rerank of a head ---------------------------------------------------------

_RERANK = f"""WITH {_BM25}, head AS (SELECT item_id, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_key('score')} DESC, doc_id) AS rank FROM bm25) WHERE rank <= 300),
toks AS (SELECT item_id, doc_id, {RTOK} AS toks FROM head JOIN documents USING (doc_id)),
lens AS (SELECT item_id, doc_id, greatest(len(toks), 1) AS len, avg(greatest(len(toks), 1)) OVER (PARTITION BY item_id) AS avg_len, count(*) OVER (PARTITION BY item_id) AS n FROM toks),
q AS (SELECT DISTINCT item_id, unnest({RTOK}) AS tok FROM benchmark),
htf AS (SELECT item_id, doc_id, tok, count(*) AS tf FROM (SELECT item_id, doc_id, unnest(toks) AS tok FROM toks) JOIN q USING (item_id, tok) GROUP BY ALL),
hdf AS (SELECT item_id, tok, count(*) AS df FROM htf GROUP BY ALL),
raw AS (SELECT item_id, doc_id, coalesce(s, 0) AS s FROM head LEFT JOIN (SELECT item_id, doc_id, sum(ln(1 + n / (1 + df)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS s
  FROM htf JOIN hdf USING (item_id, tok) JOIN lens USING (item_id, doc_id) GROUP BY ALL) USING (item_id, doc_id))
SELECT item_id, doc_id, round(CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 6) AS score FROM raw WINDOW w AS (PARTITION BY item_id)"""


@query("lexical_rerank", _RERANK)
def lexical_rerank(spark, sf):
    """The BM25 head of each benchmark text scored again, with head-local weights."""
    docs, asked = t.documents(spark, sf), _benchmark(spark, sf)
    scores = retrieval.bm25_scores(docs, asked, "doc_id", "text", "item_id", "question")
    keyed = scores.withColumn("key", ranking.score_key(F.col("score")))
    head = ranking.top_k(
        keyed, 300, [F.col("key").desc(), F.col("doc_id")], "item_id"
    ).select("item_id", "doc_id").join(docs, "doc_id")
    return rounded(retrieval.lexical_scores(
        head, asked, "doc_id", "text", "item_id", "question"
    ))


# --- skills and summaries -------------------------------------------------------------


def _skills_sql(low: str) -> str:
    cases = []
    for skill, spellings in sorted(vocab.skill_aliases().items()):
        pattern = "(^|[^a-z0-9])(?:" + X.alternation(spellings) + ")"
        cases.append(f"CASE WHEN regexp_matches({low}, '{pattern}') THEN '{skill}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


@query("document_skills", f"""SELECT doc_id, array_to_string({_skills_sql('low')}, ',') AS skills, len({_skills_sql('low')})::INTEGER AS n_skills
  FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def document_skills(spark, sf):
    staged = t.documents(spark, sf).select("doc_id", X.extract_skills(F.col("text")).alias("skills"))
    return staged.select("doc_id", F.array_join("skills", ",").alias("skills"),
                         F.size("skills").alias("n_skills"))


@query("resume_skills", f"""SELECT conv_id, trim(text) AS text, array_to_string({_skills_sql('lower(text)')}, ',') AS skills, length(text)::INTEGER AS char_count
  FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def resume_skills(spark, sf):
    """User turns of a conversation read as one plain-text resume."""
    turns = t.load(spark, sf, "conversations").filter("role = 'user'")
    texts = turns.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                        lambda x: x["text"]), "\n",
        ).alias("text")
    )
    return rounded(artifacts.resume_skills(texts, "conv_id", "text"))


def _canonical_sql(n: str) -> str:
    table = vocab.skill_aliases()
    names = ",".join(f"'{s}'" for s in table)
    whens = " ".join(f"WHEN {has(n, sp)} THEN '{s}'" for s, sp in table.items())
    return f"CASE WHEN {n} IN ({names}) THEN {n} {whens} END"


@query("canonical_skills", f"""WITH names AS (SELECT p_partkey, unnest([p_name, p_type, 'K8s tools ' || p_brand, ['Postgres','sentence transformers v2','torch','gardening','Vector DB','ir ','mlflow','Golang'][p_partkey % 8 + 1]]) AS name FROM part),
mapped AS (SELECT p_partkey, {_canonical_sql('lower(trim(name))')} AS skill FROM names)
SELECT p_partkey, coalesce(string_agg(DISTINCT skill, ',' ORDER BY skill), '') AS skills FROM mapped GROUP BY p_partkey""")
def canonical_skills(spark, sf):
    """Messy skill strings of parts in canonical form: distinct and sorted."""
    extra = ("Postgres", "sentence transformers v2", "torch", "gardening", "Vector DB",
             "ir ", "mlflow", "Golang")
    parts = t.load(spark, sf, "part").select("p_partkey", F.array(
        F.col("p_name"), F.col("p_type"), F.concat(F.lit("K8s tools "), F.col("p_brand")),
        t.pick(extra, F.col("p_partkey") % 8),
    ).alias("names"))
    return parts.select(
        "p_partkey", F.array_join(X.canonical_skills(F.col("names")), ",").alias("skills")
    )


def _category_of(x: str) -> str:
    lists = (("ml", vocab.CORE_ML_SKILLS), ("llm", vocab.LLM_SKILLS),
             ("retrieval", vocab.RETRIEVAL_SKILLS))
    return "CASE " + " ".join(
        f"WHEN lower({x}) IN ({','.join(repr(s) for s in v)}) THEN '{k}'" for k, v in lists
    ) + " ELSE 'general' END"


@query("skill_categories", f"""WITH s AS (SELECT {t._sql_list(t.SKILL_NAMES)}[l_partkey % 24 + 1] AS skill FROM lineitem)
SELECT {_category_of('skill')} AS category, count(*) AS rows, count(DISTINCT skill) AS skills FROM s GROUP BY 1""")
def skill_categories(spark, sf):
    skills = t.load(spark, sf, "lineitem").select(
        t.pick(t.SKILL_NAMES, F.col("l_partkey") % 24).alias("skill")
    )
    return skills.groupBy(X.skill_category(F.col("skill")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("skill").alias("skills")
    )


_WORDS = ("fix race condition in production", "bump readme typo", "design review of schema",
          "refactor and migrate kubernetes deploy", "add retrieval feature for users")


def _summary_sql(source: str) -> str:
    cats = " ".join(f"WHEN {has('low', toks)} THEN '{c}'" for c, toks in vocab.ARTIFACT_CATEGORIES)
    hard = " + ".join(f"contains(low, '{h}')::INT" for h in vocab.HARD_TOKENS)
    return f"""SELECT artifact_id, coalesce(nullif(trim(regexp_extract(regexp_replace(head, '^\\s+|\\s+$', '', 'g'), '^[^\\r\\n]*')[1:160]), ''), replace(source_type, '_', ' ') || ' with no description') AS summary,
  array_to_string({_skills_sql('low')}, ',') AS skills,
  CASE WHEN {has('low', vocab.TRIVIAL_TOKENS)} AND length(low) < 400 THEN 1 ELSE least(2 + {hard} + (length(low) > 3000)::INT, 5) END AS complexity,
  CASE {cats} ELSE '{vocab.DEFAULT_CATEGORY}' END AS category, {has('low', vocab.ARTIFACT_PRODUCTION_TOKENS)} AS production_signal,
  source_type IN ('pr_review', 'issue_thread') OR {has('low', vocab.COLLABORATION_TOKENS)} AS collaboration_signal,
  sha256(raw) AS content_hash, length(raw)::INTEGER AS raw_chars
FROM (SELECT *, raw AS head, lower(raw) AS low FROM {source})"""


def work_items(spark, sf):
    """One artifact per conversation turn: a short line of work, then the text."""
    c = F.col
    return t.spread(t.load(spark, sf, "conversations")).select(
        (c("conv_id") * 100 + c("turn")).alias("artifact_id"), c("conv_id").alias("developer_id"),
        t.pick(("commit_diff", "pr_review", "issue_thread", "so_answer"), c("turn") % 4)
        .alias("source_type"),
        F.concat(t.pick(_WORDS, c("conv_id") % 5), F.lit("\n"), c("text")).alias("raw_content"),
        c("turn").alias("arrival"),
    )


WORK_SQL = f"""(SELECT conv_id * 100 + turn AS artifact_id, conv_id AS developer_id, ['commit_diff','pr_review','issue_thread','so_answer'][turn % 4 + 1] AS source_type,
  {t._sql_list(_WORDS)}[conv_id % 5 + 1] || chr(10) || text AS raw, turn AS arrival FROM conversations)"""


@query("artifact_summaries", _summary_sql(WORK_SQL))
def artifact_summaries(spark, sf):
    df = evidence.with_summary(work_items(spark, sf))
    return rounded(df.select(
        "artifact_id", "summary", "skills", "complexity", "category", "production_signal",
        "collaboration_signal", "content_hash", "raw_chars",
    ))


@query("document_summaries", _summary_sql("(SELECT doc_id AS artifact_id, 'so_answer' AS source_type, text AS raw FROM documents)"))
def document_summaries(spark, sf):
    docs = t.documents(spark, sf).select(
        F.col("doc_id").alias("artifact_id"), F.lit("so_answer").alias("source_type"),
        F.col("text").alias("raw_content"),
    )
    return rounded(evidence.with_summary(docs).select(
        "artifact_id", "summary", "skills", "complexity", "category", "production_signal",
        "collaboration_signal", "content_hash", "raw_chars",
    ))


@query("content_hashes", "SELECT page_id, sha256(url || html) AS content_hash FROM pages")
def content_hashes(spark, sf):
    return t.load(spark, sf, "pages").select(
        "page_id", X.content_hash(F.col("url"), F.col("html")).alias("content_hash")
    )


@query("noisy_json", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def noisy_json(spark, sf):
    """The JSON object in plain, fenced, chatty and broken replies."""
    c = F.col
    reply = (
        F.when(c("event_id") % 4 == 0, c("props"))
        .when(c("event_id") % 4 == 1, F.concat(F.lit("```json\n"), c("props"), F.lit("\n```")))
        .when(c("event_id") % 4 == 2, F.concat(F.lit("Sure: "), c("props"), F.lit(" ok?")))
        .otherwise(F.concat(F.lit("no object {here "), F.substring("props", 2, 20)))
    )
    found = t.load(spark, sf, "events").select("event_id", X.json_object(reply).alias("obj"))
    return found.select("event_id", F.get_json_object("obj", "$.k").cast("bigint").alias("k"))


# --- quality of ranked documents ------------------------------------------------------

RUNS_SQL = """runs AS (SELECT 'chars' AS run, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT 'id', doc_id, row_number() OVER (ORDER BY doc_id) FROM documents),
graded AS (SELECT run, doc_id, rank, coalesce(quality * 4 + toxic, 0) AS grade FROM runs LEFT JOIN labels USING (doc_id)),
ideal AS (SELECT run, grade, row_number() OVER (PARTITION BY run ORDER BY grade DESC, rank) AS pos FROM graded),
hits AS (SELECT run, rank, sum((grade >= 3)::INT) OVER (PARTITION BY run ORDER BY rank) AS h, grade FROM graded),
m AS (SELECT g.run, (SELECT sum((pow(2, grade) - 1) / log2(rank + 1)) FROM graded x WHERE x.run = g.run AND rank <= 10) / (SELECT sum((pow(2, grade) - 1) / log2(pos + 1)) FROM ideal x WHERE x.run = g.run AND pos <= 10) AS ndcg_10,
    (SELECT sum((pow(2, grade) - 1) / log2(rank + 1)) FROM graded x WHERE x.run = g.run AND rank <= 50) / (SELECT sum((pow(2, grade) - 1) / log2(pos + 1)) FROM ideal x WHERE x.run = g.run AND pos <= 50) AS ndcg_50,
    (SELECT avg(h / rank) FROM hits x WHERE x.run = g.run AND grade >= 3) AS map, (SELECT avg((grade >= 3)::INT) FROM graded x WHERE x.run = g.run AND rank <= 10) AS p_10
  FROM (SELECT DISTINCT run FROM graded) g),
metrics AS (SELECT run, round(ndcg_10, 4) AS ndcg_10, round(ndcg_50, 4) AS ndcg_50, round(map, 4) AS map, round(p_10, 4) AS p_10,
    round(0.5::DOUBLE * ndcg_10 + 0.3::DOUBLE * ndcg_50 + 0.15::DOUBLE * map + 0.05::DOUBLE * p_10, 4) AS composite FROM m)"""


def _document_metrics(spark, sf):
    docs = t.load(spark, sf, "documents").select("doc_id", "n_chars")
    grades = t.load(spark, sf, "labels").select(
        "doc_id", (F.col("quality") * 4 + F.col("toxic")).alias("grade")
    )
    both = docs.select("doc_id", F.lit("chars").alias("run"), F.col("n_chars").cast("double").alias("score")).unionByName(
        docs.select("doc_id", F.lit("id").alias("run"), (-F.col("doc_id")).cast("double").alias("score"))
    )
    ranked = ranking.rank_positions(both, "score", "doc_id", "run").withColumn(
        "rank", F.col("rank") + 1
    )
    return metrics.ranking_metrics(ranked, grades, "doc_id")


@query("ranking_metrics", f"WITH {RUNS_SQL} SELECT * FROM metrics")
def ranking_metrics(spark, sf):
    return _document_metrics(spark, sf)


@query("metric_lift", f"""WITH {RUNS_SQL} SELECT 'composite' AS metric, round(100.0::DOUBLE * (c.composite - b.composite) / b.composite, 2) AS lift
  FROM metrics b, metrics c WHERE b.run = 'id' AND c.run = 'chars'""")
def metric_lift(spark, sf):
    return metrics.lift(_document_metrics(spark, sf), "id", "chars")


@query("safe_correlation", """SELECT round(corr(n_chars::DOUBLE, quality::DOUBLE), 6) AS quality, 0.0::DOUBLE AS constant FROM documents JOIN labels USING (doc_id)""")
def safe_correlation(spark, sf):
    df = t.load(spark, sf, "documents").join(t.load(spark, sf, "labels"), "doc_id").select(
        F.col("n_chars").cast("double").alias("a"), F.col("quality").cast("double").alias("b"),
        (F.col("quality") * 0.0).alias("flat"),
    )
    constant = metrics.safe_correlation(df, "a", "flat").scalar()
    return rounded(metrics.safe_correlation(df, "a", "b").select(
        F.col("correlation").alias("quality"), constant.alias("constant")
    ))
