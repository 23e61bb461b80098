"""Queries on vectors and texts: exact search, re-ranking, context, quality of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import evaluate, retrieval
from lodestone.plans.registry import query
from lodestone.sources.overlay import read
from lodestone.sources.shared import stored

# Query vectors are those whose id is divisible by 50; each is compared with all vectors.


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return retrieval.topk(*_vectors(spark, sf_dir), k)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    hits = _hits(spark, sf_dir).join(v, "vec_id").join(q.withColumnRenamed("embedding", "qe"), "query_id")
    return hits.select("query_id", "rank", "vec_id", "distance", retrieval.negative_l1(F.col("qe"), F.col("embedding")).alias("score"))


TOP = """dist AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, q.label AS query_label, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) + 0.0 AS distance,
 -round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: abs(CAST(q.embedding[i] AS DOUBLE) - CAST(v.embedding[i] AS DOUBLE)))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist) WHERE rank <= 50)"""
UNION = """, scored AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank FROM hits),
united AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank > 10, CASE WHEN rerank > 10 THEN rank ELSE rerank END) AS position FROM scored WHERE rerank <= 10 OR rank <= 5)"""


@query("vector_topk", f"WITH {TOP} SELECT query_id, rank, vec_id, distance FROM hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


@query("rerank_union", f"WITH {TOP}{UNION} SELECT query_id, position, rank, rerank, vec_id, distance, score FROM united")
def rerank_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(_scored(spark, sf_dir)).select("query_id", "position", "rank", "rerank", "vec_id", "distance", "score")


@query("rerank_order", f"WITH {TOP}{UNION} SELECT query_id, rank, rerank, vec_id, score FROM scored")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(_scored(spark, sf_dir), 50, 50).select("query_id", "rank", "rerank", "vec_id", "score")


# Ground truth: other vectors of the query's label; those of the last label have none.


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = _scored(spark, sf_dir).where("vec_id <> query_id").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    again = W.partitionBy("query_id").orderBy(F.desc("score"), "distance", "vec_id")
    return rows.select("query_id", "vec_id", F.row_number().over(order).cast("bigint").alias("rank"), F.row_number().over(again).cast("bigint").alias("rerank"), F.when(F.col("wanted") < 9, F.col("label") == F.col("wanted")).alias("match"))


JUDGED = """, judged AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, vec_id) AS rerank, CASE WHEN query_label < 9 THEN label = query_label END AS match FROM hits WHERE vec_id <> query_id),
ranks AS (SELECT query_id, bool_and(match IS NULL) AS skipped, min(rank) FILTER (match) AS first_rank, min(rerank) FILTER (match) AS after_rank, coalesce(string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) FILTER (match), '') AS ranks FROM judged GROUP BY query_id)"""


@query("match_ranks", f"WITH {TOP}{JUDGED} SELECT query_id, skipped, first_rank, ranks FROM ranks")
def match_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_ranks(_judged(spark, sf_dir))


@query("recall_at_n", f"WITH {TOP}{JUDGED} SELECT n, h AS hits, a - h AS misses, CASE WHEN a > 0 THEN round(h / a, 6) END AS recall FROM (SELECT n, count(*) FILTER (NOT skipped AND first_rank <= n) AS h, count(*) FILTER (NOT skipped) AS a FROM ranks, (SELECT CAST(unnest([5, 10, 20, 30, 50]) AS BIGINT) AS n) GROUP BY n)")
def recall_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(evaluate.first_ranks(_judged(spark, sf_dir)))


@query("rank_histogram", f"WITH {TOP}{JUDGED} SELECT low, high, count(*) FILTER (first_rank BETWEEN low AND high) AS n FROM ranks, (VALUES (1::BIGINT, 5::BIGINT), (6, 10), (11, 15), (16, 20), (21, 30), (31, 50)) b(low, high) GROUP BY ALL")
def rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(evaluate.first_ranks(_judged(spark, sf_dir)))


@query("miss_details", f"WITH {TOP}{JUDGED} SELECT query_id, j.rank, j.vec_id FROM judged j JOIN ranks USING (query_id) WHERE NOT skipped AND (first_rank IS NULL OR first_rank > 1) AND j.rank <= 10")
def miss_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the queries whose first place is no match."""
    return evaluate.miss_details(stored(_judged(spark, sf_dir)), 1).select("query_id", "rank", "vec_id")


CHANGE = "CASE WHEN first_rank IS NULL AND after_rank IS NULL THEN 'unchanged' WHEN first_rank IS NULL THEN 'new' WHEN after_rank IS NULL THEN 'lost' WHEN after_rank < first_rank THEN 'improved' WHEN after_rank > first_rank THEN 'worsened' ELSE 'unchanged' END"


def _before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    return j.groupBy("query_id").agg(F.min(F.when(F.col("match"), F.col("rank"))).alias("before"), F.min(F.when(F.col("match"), F.col("rerank"))).alias("after"))


@query("rank_change", f'WITH {TOP}{JUDGED} SELECT query_id, first_rank AS before, after_rank AS "after", {CHANGE} AS change FROM ranks')
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _before_after(spark, sf_dir).withColumn("change", evaluate.rank_change(F.col("before"), F.col("after")))


@query("rerank_summary", f"""WITH {TOP}{JUDGED} SELECT count(*) FILTER (c IN ('improved', 'new')) AS improved, count(*) FILTER (c IN ('worsened', 'lost')) AS worsened, count(*) FILTER (c = 'unchanged') AS unchanged, round(avg(first_rank) FILTER (first_rank IS NOT NULL AND after_rank IS NOT NULL), 6) AS mean_before,
 round(avg(after_rank) FILTER (first_rank IS NOT NULL AND after_rank IS NOT NULL), 6) AS mean_after, count(*) FILTER (after_rank <= 5 AND (first_rank IS NULL OR first_rank > 5)) AS promoted FROM (SELECT *, {CHANGE} AS c FROM ranks)""")
def rerank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.change_summary(_before_after(spark, sf_dir))


SHOWN = "CASE WHEN skipped THEN 'n/a' ELSE coalesce('#' || {}, 'MISS') END"
STEP = "CASE WHEN skipped THEN 'n/a' WHEN first_rank > after_rank THEN '+' || (first_rank - after_rank) WHEN first_rank < after_rank THEN '' || (first_rank - after_rank) WHEN first_rank = after_rank THEN '=' WHEN after_rank IS NOT NULL THEN 'NEW' WHEN first_rank IS NOT NULL THEN 'LOST' ELSE '-' END"


def _pairs(judged: DataFrame) -> DataFrame:
    hit = lambda x: F.min(F.when(F.col("match"), F.col(x)))
    return judged.groupBy("query_id").agg(F.every(F.col("match").isNull()).alias("skipped"), hit("rank").alias("before"), hit("rerank").alias("after"))


@query("comparison_table", f"WITH {TOP}{JUDGED} SELECT query_id, {SHOWN.format('first_rank')} AS embedding, {SHOWN.format('after_rank')} AS reranked, {STEP} AS change FROM ranks")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.comparison(_pairs(_judged(spark, sf_dir)))


@query("comparison_detail", f"WITH {TOP}{JUDGED}, moved AS (SELECT query_id FROM ranks WHERE NOT skipped AND NOT (first_rank IS NOT DISTINCT FROM after_rank AND coalesce(first_rank <= 5, false))) SELECT query_id, 'embedding' AS ordering, rank AS place, vec_id, match AS hit FROM judged SEMI JOIN moved USING (query_id) WHERE rank <= 5 UNION ALL SELECT query_id, 'reranked', rerank, vec_id, match FROM judged SEMI JOIN moved USING (query_id) WHERE rerank <= 5")
def comparison_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = stored(_judged(spark, sf_dir))
    return evaluate.comparison_detail(judged, _pairs(judged))


# Text: every benchmark passage asks, all documents answer.


def _lexical(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical(q, read(spark, sf_dir, "documents"), k)


LEXICAL = """q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS qt FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dt FROM documents),
qw AS (SELECT query_id, len(qt) AS n, unnest(qt) AS w FROM q), dw AS (SELECT doc_id, len(dt) AS m, unnest(dt) AS w FROM d),
lex AS (SELECT query_id, doc_id, round(count(*) / max(n), 6) AS share, round(count(*) / max(m), 6) AS score FROM dw JOIN qw USING (w) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, doc_id) AS rank FROM lex) WHERE rank <= 50)"""


@query("lexical_topk", f"WITH {LEXICAL} SELECT query_id, rank, doc_id, share FROM hits")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "rank", "doc_id", "share")


def _united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(_lexical(spark, sf_dir))


@query("rag_search", f"WITH {LEXICAL}{UNION} SELECT query_id, position, doc_id FROM united")
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool of 50, best ten by the second score, best five of the pool."""
    return _united(spark, sf_dir).select("query_id", "position", "doc_id")


def _unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _united(spark, sf_dir).select(F.expr("query_id div 5").alias("session_id"), F.col("query_id").alias("call_no"), "position", F.col("doc_id").alias("section_id"))
    return retrieval.unseen(hits)


FRESH = """, fresh AS (SELECT * FROM (SELECT query_id // 5 AS session_id, query_id AS call_no, position, doc_id, min(query_id) OVER (PARTITION BY query_id // 5, doc_id) AS first_call FROM united) WHERE call_no = first_call)"""


@query("cross_call_dedup", f"WITH {LEXICAL}{UNION}{FRESH} SELECT session_id, call_no, position, doc_id AS section_id FROM fresh")
def cross_call_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five queries make a session; later calls don't repeat what earlier ones gave."""
    return _unseen(spark, sf_dir)


REF = "list_distinct(list_transform(regexp_extract_all(lower(text), 'license|copyright|reserved'), lambda x: 'Table' || x))"


@query("rag_context", f"""WITH {LEXICAL}{UNION}{FRESH}, shown AS (SELECT call_no AS query_id, position, doc_id, text, doc_id % 7 = 0 AS tab, {REF} AS refs FROM fresh JOIN documents USING (doc_id)),
one AS (SELECT query_id, string_agg(CASE WHEN tab THEN '[Table ' ELSE '[Section ' END || doc_id || ', Article ' || doc_id // 100 || ', page ' || doc_id % 100 || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS body, list_sort(list_distinct(flatten(list(refs)))) AS refs FROM shown GROUP BY query_id)
SELECT query_id, md5(body || CASE WHEN len(refs) > 0 THEN chr(10) || chr(10) || '[Tables referenced by these sections: ' || array_to_string(refs, ', ') || '. Look them up by id if needed.]' ELSE '' END) AS context_md5 FROM one""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "section")
    refs = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("license|copyright|reserved"), F.lit(0)), lambda x: F.concat(F.lit("Table"), x)))
    hits = _unseen(spark, sf_dir).withColumnRenamed("call_no", "query_id")
    rows = hits.join(docs, hits.section_id == docs.section).select("query_id", "position", F.when(F.col("section") % 7 == 0, "table").otherwise("subsection").alias("chunk_type"), F.col("section").cast("string").alias("section_id"), F.expr("section div 100").alias("article"), (F.col("section") % 100).alias("page"), refs.alias("refs"), F.col("text").alias("document"))
    return retrieval.context(rows).select("query_id", F.md5("context").alias("context_md5"))


@query("hashed_embedding")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in vectors of all benchmark passages."""
    return retrieval.hashed_embedding(read(spark, sf_dir, "benchmark")).select("item_id", "embedding")


@query("text_vector_search")
def text_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage against all documents by stand-in vectors."""
    docs = retrieval.hashed_embedding(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("vec_id"), "embedding")
    q = retrieval.hashed_embedding(read(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("query_id"), "embedding")
    return retrieval.topk(docs, q, 10)


@query("query_policy", "SELECT conv_id, turn, regexp_matches(text, '[0-9]+\\.[0-9]+') OR regexp_matches(text, '(?i)(section|table|article)\\s+[0-9]') AS flagged FROM conversations WHERE role = 'user'")
def query_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's query names an identifier, which searches shouldn't."""
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", retrieval.names_identifier(F.col("text")).alias("flagged"))


@query("pass_rate", "SELECT count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) AS total FROM labels")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pass_rate(read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed")))


@query("judge_verdicts", "SELECT a.conv_id, a.turn, trim(regexp_replace(lower(a.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')) AS passed FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline judge (equal after normalisation), applied to neighbouring turns."""
    a = read(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", evaluate.same_answer(F.col("text"), F.col("other")).alias("passed"))
