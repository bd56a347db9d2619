"""Queries over generations, cases, profiles and prompt batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extraction, graph, lifecycle
from tessera.plans.registry import query
from tessera.sources.tables import CHUNKS_SQL, chunks, table


@query("""WITH g AS (SELECT DISTINCT l_suppkey AS kb, l_linenumber AS generation, CASE WHEN l_linenumber = 2 THEN 'BUILDING' WHEN l_linenumber = 1 THEN 'ACTIVE' ELSE 'RETIRED' END AS status FROM lineitem WHERE l_linenumber <= 3),
b AS (SELECT l_suppkey AS kb, l_linenumber AS generation, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 0 OR l_quantity > 3 GROUP BY 1, 2), e AS (SELECT l_suppkey AS kb, l_linenumber AS generation, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT g.*, status = 'BUILDING' AND coalesce(b.n, 0) = coalesce(e.n, 0) AND coalesce(b.n, 0) > 0 AS good FROM g LEFT JOIN b USING (kb, generation) LEFT JOIN e USING (kb, generation))
SELECT kb, generation, CASE WHEN good THEN 'ACTIVE' WHEN status = 'BUILDING' THEN 'FAILED' WHEN status = 'ACTIVE' AND bool_or(good) OVER (PARTITION BY kb) THEN 'RETIRED' ELSE status END AS status FROM c""")
def index_promotion(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("kb"), F.col("l_linenumber").alias("generation"), "l_quantity")
    status = F.when(F.col("generation") == 2, "BUILDING").when(F.col("generation") == 1, "ACTIVE").otherwise("RETIRED")
    generations = lines.filter("generation <= 3").select("kb", "generation").distinct().withColumn("status", status)
    return lifecycle.promotion(generations, lines.filter("kb % 4 <> 0 or l_quantity > 3"), lines, "kb")


@query("""SELECT d.doc_id AS case_id, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS active, CASE WHEN quality = 0 THEN 'needs_review' ELSE 'approved' END AS status, CASE WHEN quality = 0 THEN '' ELSE 'c' || d.doc_id END AS expected,
CASE WHEN quality = 0 THEN 'base,bad_case' ELSE 'base' END AS tags FROM documents d LEFT JOIN labels USING (doc_id)""")
def feedback_sync(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "documents").selectExpr("doc_id as case_id", "1 as active", "'approved' as status", "array(concat('c', doc_id)) as expected", "if(doc_id % 2 = 0, array('base'), array('base', 'bad_case')) as tags")
    votes = table(spark, sf, "labels").selectExpr("doc_id as case_id", "if(quality = 0, -1, 1) as vote")
    out = lifecycle.synced_feedback(cases, votes)
    return out.withColumn("expected", F.array_join("expected", ",")).withColumn("tags", F.array_join("tags", ","))


@query("""WITH c AS (SELECT item_id AS case_id, unnest(generate_series(0, 2)) AS p FROM benchmark) SELECT case_id, string_agg(CASE WHEN (case_id + p) % 3 = 0 THEN 'given' ELSE coalesce(left(sha256(text), 16), '') END, ',' ORDER BY p) AS hashes
FROM c LEFT JOIN documents ON doc_id = (case_id * 31 + p) % 1200 GROUP BY 1""")
def expected_hashes(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "benchmark").selectExpr(
        "item_id as case_id", "transform(sequence(0, 2), p -> (item_id * 31 + p) % 1200) as expected", "transform(sequence(0, 2), p -> if((item_id + p) % 3 = 0, 'given', '')) as hashes"
    )
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("hash"))
    return lifecycle.filled_hashes(cases, known).select("case_id", F.array_join("hashes", ",").alias("hashes"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS hit_count FROM part""")
def mapping_hits(spark: SparkSession, sf: str) -> DataFrame:
    mappings = table(spark, sf, "part").selectExpr("p_partkey", "cast(if(p_size % 2 = 0, p_size, null) as bigint) as hit_count")
    applied = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return lifecycle.hit_counts(mappings, applied, "p_partkey")


@query("""WITH m AS (SELECT user_id, event_type AS intent, props AS text, CASE WHEN event_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS role FROM events), a AS (SELECT * FROM m WHERE role = 'user'),
s AS (SELECT user_id, count(*) AS questions, CAST(sum(length(text)) AS BIGINT) AS chars FROM a GROUP BY 1), i AS (SELECT user_id, intent AS top_intent FROM (SELECT user_id, intent, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, intent) AS r FROM a GROUP BY 1, 2) WHERE r = 1),
v AS (SELECT user_id, count(*) FILTER (WHERE value > 80) AS up, count(*) FILTER (WHERE value < 5) AS down FROM events WHERE value > 80 OR value < 5 GROUP BY 1)
SELECT user_id, questions, chars, top_intent, coalesce(up, 0) AS up, coalesce(down, 0) AS down, CASE WHEN user_id % 4 = 0 THEN user_id + 1 ELSE 1 END AS version FROM s JOIN i USING (user_id) LEFT JOIN v USING (user_id)""")
def user_profiles(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    messages = events.selectExpr("user_id", "event_type as intent", "props as text", "if(event_id % 3 = 0, 'assistant', 'user') as role")
    votes = events.filter("value > 80 or value < 5").selectExpr("user_id", "if(value > 80, 1, -1) as vote")
    old = events.filter("user_id % 4 = 0").select("user_id", F.col("user_id").alias("version")).distinct()
    return lifecycle.profiles(messages, votes, old)


@query("""WITH RECURSIVE """ + CHUNKS_SQL.replace("chunks AS", "every AS", 1) + """, l AS (SELECT doc_id, chunk_index, length(content) AS n FROM every),
w AS (SELECT doc_id, chunk_index, 0 AS batch, 1 AS k, n::BIGINT AS c FROM l WHERE chunk_index = 0 UNION ALL SELECT l.doc_id, l.chunk_index, CASE WHEN k >= 6 OR c + n > 900 THEN batch + 1 ELSE batch END, CASE WHEN k >= 6 OR c + n > 900 THEN 1 ELSE k + 1 END, CASE WHEN k >= 6 OR c + n > 900 THEN n ELSE c + n END
  FROM l JOIN w ON l.doc_id = w.doc_id AND l.chunk_index = w.chunk_index + 1) SELECT doc_id, chunk_index, batch FROM w""")
def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of each document's chunks."""
    wanted = chunks(spark, sf)
    return extraction.prompt_batches(wanted, "doc_id", "chunk_index", "content", 6, 900)


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1),
t AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS r FROM d ORDER BY r LIMIT 260) SELECT src, dst FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""")
def top_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """The edges among the 260 nodes of the highest degree."""
    edges = table(spark, sf, "lineitem").selectExpr("l_suppkey as src", "l_partkey + 10000000 as dst").distinct()
    return graph.induced(edges, graph.degrees(edges).orderBy(F.desc("degree"), "node").limit(260))
