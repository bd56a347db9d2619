"""Retrieval queries: questions are benchmark items, chunks are lines of documents, knowledge bases are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens
from tessera.operators import access, retrieval
from tessera.operators.lineage import if_small, written
from tessera.plans.registry import query
from tessera.sources.tables import CHUNKS_SQL, chunk_index, table, vector_index

BM25_SQL = rf"""{CHUNKS_SQL},
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
sized AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS w FROM chunks),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS a FROM sized),
postings AS (SELECT term, chunk_id, count(*) AS tf, any_value(l) AS l FROM (SELECT chunk_id, len(w) AS l, unnest(w) AS term FROM sized) GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
weighted AS (SELECT term, chunk_id, CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a)) * 1000000) AS BIGINT) AS p FROM postings JOIN freq USING (term), corpus),
scored AS (SELECT query_id, chunk_id, CAST(sum(p) AS BIGINT) AS score FROM weighted JOIN asked USING (term) GROUP BY 1, 2),
lexical AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 12)"""

# The second channel: the vector of a document belongs to its first chunk, that of a question has the question's number.
VECTOR_SQL = """near AS (SELECT item_id AS query_id, e.vec_id || '-0' AS chunk_id, e.vec_id,
  CAST(round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) /
  (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) * 1000000) AS BIGINT) AS score
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)),
vector AS (SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 12)"""
HITS_SQL = "hits AS (SELECT query_id, 'keyword' AS channel, rank, chunk_id AS item FROM lexical UNION ALL SELECT query_id, 'vector', rank, chunk_id FROM vector)"
RRF_SQL = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, item) AS rank FROM (
  SELECT query_id, item, CAST(sum(CAST(round(CASE channel WHEN 'vector' THEN 0.5 ELSE 1.0 END / (60 + rank) * 1000000000) AS BIGINT)) AS BIGINT) AS score, count(DISTINCT channel) AS channels,
  min(channel || lpad(CAST(rank AS VARCHAR), 4, '0')) AS f FROM hits GROUP BY 1, 2))"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, sf: str, k: int = 12) -> DataFrame:
    return retrieval.bm25(_questions(spark, sf), chunk_index(spark, sf), k)


def _rows_of(spark: SparkSession, sf: str, named: DataFrame, *columns: str) -> DataFrame:
    """named (chunk_id) with columns of the stored chunks: the id has document and place in it, so only the groups that hold those chunks are read."""
    index = chunk_index(spark, sf)
    at = named.withColumn("_d", F.substring_index("chunk_id", "-", 1)).withColumn("_i", F.substring_index("chunk_id", "-", -1).cast("int"))
    where = written(index.located(at, "_d", "_i").drop("_d", "_i"))
    return index.chunks_at(where).select("group", "block", "chunk_id", *columns).join(if_small(where), ["group", "block", "chunk_id"]).drop("group", "block")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The hits of two channels, keyword and vector, 12 a question each."""
    lexical = _lexical(spark, sf).select("query_id", F.lit("keyword").alias("channel"), "rank", F.col("chunk_id").alias("item"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = _questions(spark, sf).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    stored = vectors.join(table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.nearest(asked, stored, 12).select("query_id", F.lit("vector").alias("channel"), "rank", F.concat_ws("-", "vec_id", F.lit("0")).alias("item"))
    return written(lexical.unionByName(near))


@query(f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM lexical", ints=("rank",))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(round(list_sum(list_transform(list_zip(e, embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) /
  (sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) * 1000000) AS BIGINT) AS score FROM q, embeddings)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""", ints=("rank",))
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest_in(asked, vector_index(spark, sf), 10)[0]


@query(f"WITH {BM25_SQL}, {VECTOR_SQL}, {HITS_SQL}, {RRF_SQL} SELECT query_id, item, score, channels, rank FROM fused", ints=("rank",))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_hits(spark, sf), {"vector": 0.5}).drop("first_channel")


@query(f"""WITH {BM25_SQL}, k AS (SELECT l.*, kb FROM lexical l JOIN chunks USING (chunk_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, rank) AS turn, min(rank) OVER (PARTITION BY query_id, kb) AS g FROM k)
SELECT query_id, chunk_id, turn, row_number() OVER (PARTITION BY query_id ORDER BY turn, g, rank) AS place FROM t""", ints=("place", "turn"))
def kb_interleave(spark: SparkSession, sf: str) -> DataFrame:
    hits = _rows_of(spark, sf, _lexical(spark, sf), "kb")
    return retrieval.interleave(hits, "query_id", "kb", "score", "rank").select("query_id", "chunk_id", "turn", "place")


@query(f"""WITH {BM25_SQL}, {VECTOR_SQL}, {HITS_SQL} SELECT query_id, channel, item, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, channel) AS place FROM hits) WHERE place <= 15""", ints=("place",))
def candidate_bound(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bound_candidates(_hits(spark, sf), 15).select("query_id", "channel", "item", "place")


@query(f"""WITH {BM25_SQL}, a AS (SELECT query_id, chunk_id, doc_id, chunk_index, score FROM lexical JOIN chunks USING (chunk_id) WHERE rank <= 5),
m AS (SELECT a.query_id, c.chunk_id, a.chunk_id AS nearest, a.score, abs(c.chunk_index - a.chunk_index) AS d FROM a JOIN chunks c ON a.doc_id = c.doc_id AND c.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2
  WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.query_id = a.query_id AND b.chunk_id = c.chunk_id))
SELECT query_id, chunk_id, CAST(floor(score * 0.95) AS BIGINT) AS score, nearest FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY d, score DESC, nearest) AS r FROM m) WHERE r = 1""")
def neighbor_expansion(spark: SparkSession, sf: str) -> DataFrame:
    anchors = written(_rows_of(spark, sf, _lexical(spark, sf, 5), "doc_id", "chunk_index"))
    return retrieval.expand_neighbours(anchors, chunk_index(spark, sf), 2)


@query("""WITH s AS (SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END AS enabled, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS deleted FROM documents)
SELECT doc_id FROM s h WHERE EXISTS (SELECT 1 FROM s WHERE deleted = 0 AND coalesce(enabled, 1) <> 0 AND doc_id = h.doc_id) OR EXISTS (SELECT 1 FROM s WHERE deleted = 0 AND coalesce(enabled, 1) <> 0 AND hash = h.hash)""")
def availability_filter(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
        F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 1).alias("enabled"),
        F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("deleted"),
    )
    return retrieval.available(states.select("chunk_id", "hash"), states).select(F.col("chunk_id").alias("doc_id"))


@query("""WITH v AS (SELECT user_id, event_type AS item, count(*) * 100 AS score FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
k AS (SELECT user_id, event_type AS item, count(*) * 100 AS score FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 50 GROUP BY 1, 2)
SELECT user_id, item, coalesce(v.score, 0) * 7 + coalesce(k.score, 0) * 3 AS score FROM v FULL JOIN k USING (user_id, item)""")
def weighted_fuse_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    count = lambda df: df.groupBy("user_id", F.col("event_type").alias("item")).agg((F.count("*") * 100).alias("score"))
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    return retrieval.weighted_fusion(count(events.filter(F.col("ts") < middle)), count(events.filter((F.col("ts") >= middle) & (F.col("value") > 50))), ["user_id", "item"], 7, 3)


@query("""WITH n AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id AS probe_id, label, e FROM n WHERE vec_id % 100 = 0),
s AS (SELECT probe_id, vec_id AS entry_id, CAST(round(list_sum(list_transform(list_zip(p.e, n.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(p.e, lambda x: x * x))) * sqrt(list_sum(list_transform(n.e, lambda x: x * x)))) * 1000000) AS BIGINT) AS score
  FROM p JOIN n ON p.label = n.label AND n.vec_id < p.probe_id AND p.probe_id - n.vec_id <= 400)
SELECT probe_id, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, entry_id) AS r FROM s WHERE score >= 100000) WHERE r = 1""")
def semantic_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set, ids divisible by 100, against the entries before each."""
    vectors = table(spark, sf, "embeddings").withColumnRenamed("label", "scope")
    probes = vectors.filter("vec_id % 100 = 0").withColumn("at", F.col("vec_id") - 1).withColumnRenamed("vec_id", "probe_id")
    return retrieval.cached_answers(probes, vectors.withColumn("at", F.col("vec_id")).withColumnRenamed("vec_id", "entry_id"), 0.1, 399)


ACL_SQL = """res AS (SELECT p_partkey AS resource_id, p_partkey % 3 AS tenant, p_partkey % 40 AS owner, CASE p_size % 3 WHEN 0 THEN 'TENANT' WHEN 1 THEN 'DEPARTMENT' ELSE 'PRIVATE' END AS visibility, CAST(p_size % 25 AS VARCHAR) AS department, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS deleted FROM part),
pri AS (SELECT c_custkey AS user_id, c_custkey % 3 AS tenant, CASE c_mktsegment WHEN 'MACHINERY' THEN 'admin' ELSE c_mktsegment END AS role, CAST(c_nationkey AS VARCHAR) AS department FROM customer WHERE c_custkey % 100 = 0),
gr AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'ROLE' ELSE 'DEPARTMENT' END AS subject_type, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_suppkey AS VARCHAR) WHEN 1 THEN 'BUILDING' ELSE CAST(l_suppkey % 25 AS VARCHAR) END AS subject_id,
  l_partkey AS resource_id, CASE l_returnflag WHEN 'A' THEN 'READ' WHEN 'N' THEN 'WRITE' ELSE 'MANAGE' END AS permission, CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END AS deleted FROM lineitem)"""


def _acl(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    resources = table(spark, sf, "part").selectExpr(
        "p_partkey as resource_id", "p_partkey % 3 as tenant", "p_partkey % 40 as owner", "case p_size % 3 when 0 then 'TENANT' when 1 then 'DEPARTMENT' else 'PRIVATE' end as visibility",
        "cast(p_size % 25 as string) as department", "case when p_partkey % 11 = 0 then 1 else 0 end as deleted",
    )
    principals = table(spark, sf, "customer").filter("c_custkey % 100 = 0").selectExpr(
        "c_custkey as user_id", "c_custkey % 3 as tenant", "case c_mktsegment when 'MACHINERY' then 'admin' else c_mktsegment end as role", "cast(c_nationkey as string) as department"
    )
    grants = table(spark, sf, "lineitem").selectExpr(
        "case l_linenumber % 3 when 0 then 'USER' when 1 then 'ROLE' else 'DEPARTMENT' end as subject_type",
        "case l_linenumber % 3 when 0 then cast(l_suppkey as string) when 1 then 'BUILDING' else cast(l_suppkey % 25 as string) end as subject_id", "l_partkey as resource_id",
        "case l_returnflag when 'A' then 'READ' when 'N' then 'WRITE' else 'MANAGE' end as permission", "case when l_quantity < 5 then 1 else 0 end as deleted",
    )
    return resources, grants, principals


@query(f"""WITH {ACL_SQL} SELECT user_id, resource_id FROM pri p JOIN res r ON r.deleted = 0 AND p.tenant = r.tenant WHERE p.role = 'admin' OR r.owner = p.user_id OR r.visibility = 'TENANT' OR (r.visibility = 'DEPARTMENT' AND r.department = p.department)
OR EXISTS (SELECT 1 FROM gr WHERE gr.deleted = 0 AND gr.resource_id = r.resource_id AND ((subject_type = 'USER' AND subject_id = CAST(p.user_id AS VARCHAR)) OR (subject_type = 'ROLE' AND subject_id = p.role) OR (subject_type = 'DEPARTMENT' AND subject_id = p.department)))""")
def acl_exists_filter(spark: SparkSession, sf: str) -> DataFrame:
    return access.allowed_resources(*_acl(spark, sf))


@query(f"""WITH {ACL_SQL} SELECT user_id, resource_id FROM pri p JOIN res r ON r.deleted = 0 AND p.tenant = r.tenant WHERE p.role = 'admin' OR r.owner = p.user_id
OR EXISTS (SELECT 1 FROM gr WHERE gr.deleted = 0 AND gr.permission IN ('WRITE', 'MANAGE') AND gr.resource_id = r.resource_id AND ((subject_type = 'USER' AND subject_id = CAST(p.user_id AS VARCHAR)) OR (subject_type = 'ROLE' AND subject_id = p.role) OR (subject_type = 'DEPARTMENT' AND subject_id = p.department)))""")
def acl_write_filter(spark: SparkSession, sf: str) -> DataFrame:
    return access.allowed_resources(*_acl(spark, sf), required="WRITE")


@query()
def greedy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical hits without near-copies of better ones. Its acceptance feeds back on itself, which SQL doesn't express; a test holds it against brute force."""
    hits = _rows_of(spark, sf, _lexical(spark, sf), "content")
    return retrieval.greedy_distinct(hits, "query_id", "rank", "content", "chunk_id")


@query()
def answer_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from questions to contexts: two channels, bounded, fused, near-copies dropped, neighbours added, cut to a budget of tokens with a quota per base."""
    fused = retrieval.reciprocal_rank_fusion(retrieval.bound_candidates(_hits(spark, sf), 40), {"vector": 0.5})
    named = written(_rows_of(spark, sf, fused.withColumnRenamed("item", "chunk_id"), "doc_id", "chunk_index", "kb", "content"))  # at most 40 rows a question
    kept = written(retrieval.greedy_distinct(named, "query_id", "rank", "content", "chunk_id").join(named.drop("rank"), ["query_id", "chunk_id"]))
    anchors = kept.filter("rank <= 5").select("query_id", "chunk_id", "doc_id", "chunk_index", "score")
    near = retrieval.expand_neighbours(anchors, chunk_index(spark, sf), 1).select("query_id", "chunk_id", "score")
    pool = kept.select("query_id", "chunk_id", "score").unionByName(near).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    priced = _rows_of(spark, sf, pool, "kb", "content").withColumn("cost", estimate_tokens(F.col("content")))
    return retrieval.select_context(priced, "query_id", "chunk_id", "kb", "score", "cost", 0, 600, 10, 1)


@query(f"""WITH {BM25_SQL}, c AS (SELECT query_id, chunk_id, score, rank, length(content) AS n FROM lexical JOIN chunks USING (chunk_id))
SELECT query_id, max(rank) AS hits, CAST(sum(n) AS BIGINT) AS chars, max(score) AS best, CASE WHEN max(score) >= 30000000 THEN 'answer' ELSE 'insufficient_relevance' END AS decision FROM c GROUP BY 1""", ints=("hits",))
def retrieval_decision(spark: SparkSession, sf: str) -> DataFrame:
    hits = _rows_of(spark, sf, _lexical(spark, sf), "content")
    decision = F.when(F.max("score") >= 30_000_000, "answer").otherwise("insufficient_relevance")
    return hits.groupBy("query_id").agg(F.max("rank").alias("hits"), F.sum(F.char_length("content")).alias("chars"), F.max("score").alias("best"), decision.alias("decision"))
