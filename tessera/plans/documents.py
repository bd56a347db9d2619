"""Queries over parsed documents, intents, decisions, clusters and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import answers, bundles, chunking, clustering, decisions, memories
from tessera.plans.registry import query
from tessera.sources import documents
from tessera.sources.tables import table


@query()
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the web pages. A test holds the parser against written pages."""
    return documents.parse_pages(table(spark, sf, "pages"), "page_id", "html").withColumn("outline", F.array_join("outline", " > "))


@query()
def clipboard_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pasted bundles: a heading and the turns, an image after each answer whose marker every third one lacks. A test holds the rules against plain Python."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    mark = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 > 0), F.concat(F.lit("![turn "), "turn", F.lit("](clipboard-image://i"), "turn", F.lit(")"))).otherwise("")
    turn = F.concat_ws("\n\n", F.concat(F.lit("## "), "role"), "text", mark)
    image = F.when(F.col("role") == "assistant", F.struct(F.concat(F.lit("i"), "turn").alias("id"), F.base64(F.encode("text", "UTF-8")).alias("data"), F.lit("image/png").alias("mimeType"), F.concat("turn", F.lit(".png")).alias("filename")))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t"), image.alias("i")))).alias("_l"))  # the turns of one conversation
    content = F.concat(F.lit("# "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n\n"))
    images = F.array_compact(F.transform("_l", lambda x: x["i"]))
    bundle = F.to_json(F.struct(F.lit(1).alias("version"), content.alias("content"), images.alias("images")))
    return bundles.bundle_blocks(whole.select("conv_id", bundle.alias("bundle")), "conv_id", "bundle").withColumn("path", F.array_join("path", " > "))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\s+\S') THEN 'HEADING' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'TABLE' WHEN regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+') THEN 'LIST' WHEN trim(line) = '' THEN 'BLANK' ELSE 'PARAGRAPH' END AS kind FROM l),
s AS (SELECT *, kind IN ('HEADING', 'LIST') OR lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM kind AS starts FROM k) SELECT doc_id, kind, count(*) AS blocks FROM s WHERE starts AND kind <> 'BLANK' GROUP BY 1, 2""")
def outline_kinds(spark: SparkSession, sf: str) -> DataFrame:
    blocks = chunking.outline_blocks(table(spark, sf, "documents"), "doc_id", "text")
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text <> ''),
w AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(0 AS BIGINT) AS k, false AS last FROM d
  UNION ALL SELECT d.doc_id, a, CASE WHEN z < n AND cut > 0 THEN z - 128 + cut ELSE z END, w.k + 1, CASE WHEN z < n AND cut > 0 THEN z - 128 + cut ELSE z END >= n
  FROM w JOIN d USING (doc_id), LATERAL (SELECT CASE WHEN w.k = 0 THEN 0 WHEN w.e - 128 > w.s THEN w.e - 128 ELSE w.e END AS a), LATERAL (SELECT least(a + 512, n) AS z),
  LATERAL (SELECT substr(t, z - 127, 128) AS tail), LATERAL (SELECT CASE WHEN contains(tail, chr(10)) THEN 129 - strpos(reverse(tail), chr(10))
    WHEN regexp_matches(tail, '[。！？]') THEN length(regexp_extract(tail, '(?s)^(.*[。！？])', 1)) ELSE length(regexp_extract(tail, '(?s)^(.*[.!?])(?:\s|$)', 1)) END AS cut)
  WHERE NOT w.last)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, substr(t, s + 1, e - s) AS content FROM w JOIN d USING (doc_id) WHERE k > 0 AND regexp_matches(substr(t, s + 1, e - s), '\S')""")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that end at sentences. A test holds them against brute force."""
    return chunking.sentence_windows(table(spark, sf, "documents"), "doc_id", "text", 512, 128)


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT doc_id, i, length(line) AS n, e, lag(e) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l JOIN e ON vec_id = (doc_id * 31 + i) % (SELECT count(*) FROM embeddings)),
p AS (SELECT doc_id, i, n, coalesce(list_sum(list_transform(list_zip(e, b), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 1) AS s FROM v),
w AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS c, n AS held FROM p WHERE i = 0 UNION ALL SELECT p.doc_id, p.i, CASE WHEN cut THEN w.c + 1 ELSE w.c END, CASE WHEN cut THEN p.n ELSE w.held + 2 + p.n END
  FROM p JOIN w ON p.doc_id = w.doc_id AND p.i = w.i + 1, LATERAL (SELECT w.held >= 300 AND p.s < CAST(0.05 AS DOUBLE) OR w.held + p.n > 450 AS cut))
SELECT doc_id, CAST(c AS INTEGER) AS chunk, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM w JOIN p USING (doc_id, i) GROUP BY 1, 2""")
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as chunks that end where the next line's vector is unlike; a line's vector is that of a number made of document and line."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("i")) % vectors.count())
    out = chunking.semantic_boundaries(lines.join(vectors, "vec_id"), "doc_id", "i", "embedding", "line", 300, 0.05)
    return out.groupBy("doc_id", "chunk").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


@query()
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names that documents mention, at most twelve each."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(fn.entities(F.col("text"))).alias("place", "name"))


@query("""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'tenant_admin' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'member' END AS role FROM customer),
w AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderstatus = 'P' THEN 'PENDING_REVIEW' ELSE 'queued' END AS status, coalesce(role = 'tenant_admin', false) OR o_custkey % 11 = 0 OR l_orderkey IS NOT NULL AS reviewable
FROM orders JOIN u ON o_custkey = c_custkey LEFT JOIN w ON l_orderkey = o_orderkey""")
def upload_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as uploads: whether each waits for a review, and whether its customer may give it."""
    role = F.when(F.col("c_custkey") % 7 == 0, "tenant_admin").when(F.col("c_custkey") % 5 == 0, None).otherwise("member")
    users = table(spark, sf, "customer").select("c_custkey", role.alias("role"))
    grants = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_w", F.lit(True))
    uploads = table(spark, sf, "orders").join(users, F.col("o_custkey") == F.col("c_custkey")).join(grants, "o_orderkey", "left")
    status = decisions.initial_status(F.startswith("o_orderpriority", F.lit("1")) | (F.col("o_orderstatus") == "P"))
    return uploads.select("o_orderkey", status.alias("status"), decisions.may_review(F.col("role"), F.col("o_custkey") % 11 == 0, F.col("_w")).alias("reviewable"))


@query("""WITH m(a, b) AS (VALUES ('O>P', 1)), p AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCESS' END AS s, lead(CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'success' END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders)
SELECT s AS current, t AS target, (s = 'QUEUED' AND t = 'running') OR (s = 'RUNNING' AND t = 'success') AS allowed, count(*) AS n FROM p WHERE t IS NOT NULL GROUP BY 1, 2, 3""")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCESS")
    steps = table(spark, sf, "orders").withColumn("current", s).withColumn("target", F.lower(F.lead("current").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))).filter("target is not null")
    return steps.groupBy("current", "target", decisions.may_pass(F.col("current"), F.col("target")).alias("allowed")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id % 10 AS tenant, CAST(value > 60 AS INTEGER)::DOUBLE AS recall, CAST(event_type = 'error' AS INTEGER)::DOUBLE AS refusal, value * 20 AS p95 FROM events), m AS (SELECT tenant, avg(recall) AS r, avg(refusal) AS f, max(p95) AS p FROM r GROUP BY 1)
SELECT tenant, 'per_channel_top_k' AS param, 'increase' AS direction FROM m WHERE r < 0.6 UNION ALL SELECT tenant, 'rrf_min_score', 'decrease' FROM m WHERE f > 0.30 UNION ALL SELECT tenant, 'max_candidates', 'decrease' FROM m WHERE p > 5000""")
def tuning_hints(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("tenant"), (F.col("value") > 60).cast("double").alias("recall"), (F.col("event_type") == "error").cast("double").alias("refusal"), (F.col("value") * 20).alias("p95_ms")
    )
    return decisions.tuning_hints(runs, ["tenant"])


@query("""WITH d AS (SELECT c_nationkey AS capability, count(*) AS n, avg(CAST(c_acctbal > 3000 AS INTEGER)::DOUBLE) AS b, avg(CAST(c_acctbal > 2500 AS INTEGER)::DOUBLE) AS a, max(c_acctbal) AS p FROM customer GROUP BY 1)
SELECT capability, CASE WHEN n < 55 THEN 'HOLD' WHEN a - b >= 0.05 AND p <= 9950 THEN 'ENABLE' ELSE 'DISABLE' END AS decision FROM d""")
def retrieval_investment(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda x: F.avg((F.col("c_acctbal") > x).cast("double"))
    measured = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("capability")).agg(F.count("*").alias("n"), share(3000).alias("b"), share(2500).alias("a"), F.max("c_acctbal").alias("p"))
    return measured.select("capability", decisions.invest(F.col("n"), F.col("b"), F.col("a"), F.col("p"), 55, 0.05, 9950).alias("decision"))


NODES = (("greet", "the", "the of and"), ("order", "ation", "order status that with"), ("help", "ing", "help in is for"), ("other", "zzz", "nothing here"))


@query(rf"""WITH n(code, name, haystack) AS (VALUES {", ".join(str(n) for n in NODES)}), t AS (SELECT item_id AS query_id, lower(trim(text)) AS q, list_distinct(regexp_extract_all(lower(trim(text)), '[\p{{L}}\p{{N}}_]{{2,}}')) AS w FROM benchmark),
s AS (SELECT query_id, code, CAST(round(least(0.95, CASE WHEN contains(q, name) THEN 0.35 ELSE 0 END + CAST(len(list_filter(w, lambda x: contains(haystack, x))) AS DOUBLE) / greatest(1, len(w)) * 0.65) * 1000000) AS BIGINT) AS score FROM t, n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, code) AS nxt FROM s WHERE score >= 300000)
SELECT query_id, code, score, rank, coalesce(rank = 1 AND score >= 550000 AND score - nxt <= 80000, false) AS ambiguous FROM r WHERE rank <= 5""", ints=("rank",))
def intent_scores(spark: SparkSession, sf: str) -> DataFrame:
    nodes = spark.createDataFrame(list(NODES), "code string, name string, haystack string")
    return decisions.intent_scores(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), nodes)


@query("""WITH s(scope, name) AS (VALUES ('a', 'thand'), ('b', 'ention'), ('c', 'ou'), ('d', 'qqqq')), p AS (SELECT item_id AS query_id, scope, length(name) >= 3 AND contains(lower(text), name) AS hit FROM benchmark, s)
SELECT query_id, scope FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS anyhit FROM p) WHERE hit OR NOT anyhit""")
def scopes_named(spark: SparkSession, sf: str) -> DataFrame:
    scopes = spark.createDataFrame([("a", "thand"), ("b", "ention"), ("c", "ou"), ("d", "qqqq")], "scope string, name string")
    return decisions.scopes_named(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), scopes)


@query("""WITH s AS (SELECT CASE WHEN conv_id % 10 = 0 THEN '' ELSE 'kb' || (conv_id % 7) END AS kb, trim(text) AS sample, conv_id * 1000 + turn AS place FROM conversations WHERE role = 'user'), q AS (SELECT item_id AS query_id, 'kb' || (item_id % 7) AS kb, text FROM benchmark),
f AS (SELECT query_id, sample AS suggestion, min(place) AS place FROM q JOIN s ON (s.kb = q.kb OR s.kb = '') AND sample <> '' AND sample <> trim(text) GROUP BY 1, 2)
SELECT query_id, suggestion, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, suggestion) AS rank FROM f) WHERE rank <= 3""", ints=("rank",))
def recommended_questions(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "conversations").filter("role = 'user'").selectExpr("if(conv_id % 10 = 0, '', concat('kb', conv_id % 7)) as kb", "trim(text) as sample", "conv_id * 1000 + turn as place")
    asked = table(spark, sf, "benchmark").selectExpr("item_id as query_id", "concat('kb', item_id % 7) as kb", "text")
    return decisions.recommended(samples, asked)


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(round(value * 10) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, i, n, v AS level, CAST(0 AS BIGINT) AS gap FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.n, CAST(floor((w.level * 65 + e.v * 35) / 100) AS BIGINT), e.v - w.level FROM e JOIN w ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, level, CASE WHEN gap >= 300 THEN 'up' WHEN gap <= -300 THEN 'down' ELSE 'flat' END AS trend FROM w WHERE i = n""")
def smoothed_levels(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") * 10).cast("long").alias("v"))
    return decisions.smoothed(scores, "user_id", "event_id", "v")


@query()
def query_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters of all vectors within each base. A test holds them against brute force."""
    return clustering.query_clusters(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.9, 2)


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.label, a.vec_id AS item, b.vec_id AS copy_of, CAST(round(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) * 1000000) AS BIGINT) AS s
  FROM n a JOIN n b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 100 = 0)
SELECT label, item, copy_of FROM (SELECT *, row_number() OVER (PARTITION BY label, item ORDER BY s DESC, copy_of) AS r FROM s WHERE s >= 100000) WHERE r = 1""")
def nearest_copies(spark: SparkSession, sf: str) -> DataFrame:
    """For the stated query set, ids divisible by 100, the most similar earlier vector of the same base."""
    vectors = table(spark, sf, "embeddings")
    a = vectors.filter("vec_id % 100 = 0").select("label", F.col("vec_id").alias("item"), F.col("embedding").alias("_a"))
    return clustering.nearest_of(a, vectors, "label", "vec_id", "embedding", 0.1)


_GRAMS = "CASE WHEN length(text) > 1 THEN list_distinct(list_transform(generate_series(1, length(text) - 1), lambda i: substr(text, i, 2))) ELSE [] END"


@query(f"""WITH f AS (SELECT conv_id, text AS fact, {_GRAMS} AS a FROM conversations WHERE role = 'user' AND turn > 0), m AS (SELECT conv_id, text AS memory, {_GRAMS} AS b FROM conversations WHERE role = 'assistant'),
g AS (SELECT f.conv_id, fact, memory, a, b, len(list_intersect(a, b)) AS n FROM f LEFT JOIN m USING (conv_id))
SELECT conv_id, fact, CASE WHEN bool_or(coalesce(contains(memory, fact) OR contains(fact, memory) OR (len(a) > 0 AND len(b) > 0 AND n > CAST(len(a) + len(b) - n AS DOUBLE) * CAST(0.92 AS DOUBLE)), false)) THEN 'NOOP' ELSE 'ADD' END AS action FROM g GROUP BY 1, 2""")
def memory_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole user turns as facts against the answers of their conversation as memories, with the production threshold."""
    said = table(spark, sf, "conversations")
    facts = said.filter("role = 'user' and turn > 0").selectExpr("conv_id", "text as fact")
    return clustering.remembered(facts, said.filter("role = 'assistant'").selectExpr("conv_id", "text as memory"), "conv_id")


@query()
def memory_actions_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Whole histories: each user turn against what the earlier ones of its conversation left. A fold whose state is a list of texts, which a test holds against brute force."""
    said = table(spark, sf, "conversations").filter("role = 'user'")
    return memories.merged(said.select("conv_id", "turn", "text"), "conv_id", "turn", "text")


_TERMS = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({0}, '\[\d+\]', '', 'g'), '[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]{{2,}}'), lambda w: lower(w)))"


@query(rf"""WITH r AS (SELECT conv_id || '-' || turn AS answer_id, conv_id, text || ' [1]' AS answer FROM conversations WHERE role = 'assistant'),
s AS (SELECT answer_id, conv_id, string_split(regexp_replace(regexp_replace(answer, '([。！？.!?\n])', '\1' || chr(1), 'g'), chr(1) || '(\[\d+\])', '\1', 'g'), chr(1)) AS parts FROM r),
c AS (SELECT answer_id, conv_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS sentence_no FROM (SELECT answer_id, conv_id, list_filter(parts, lambda s: len({_TERMS.format("s")}) > 0) AS p FROM s)),
k AS (SELECT answer_id, conv_id, CAST(sentence_no AS INTEGER) AS sentence_no, {_TERMS.format("s")} AS c, list_transform(regexp_extract_all(s, '\[(\d+)\]', 1), lambda n: CAST(n AS INTEGER)) AS marks FROM c),
e AS (SELECT conv_id, CAST(turn // 2 + 1 AS INTEGER) AS ref, {_TERMS.format("text")} AS e FROM conversations WHERE role = 'user'),
j AS (SELECT answer_id, sentence_no, marks, ref, len(c) AS n, len(list_intersect(c, e)) AS m FROM k LEFT JOIN e USING (conv_id)),
v AS (SELECT *, CASE WHEN ref IS NOT NULL AND m >= CASE WHEN n <= 2 THEN 1 ELSE 2 END THEN CAST(m AS DOUBLE) / n ELSE 0 END AS s FROM j),
g AS (SELECT answer_id, sentence_no, any_value(marks) AS marks, coalesce(list_sort(list_distinct(list(ref) FILTER (WHERE s >= 0.15 AND list_contains(marks, ref)))), []) AS good, list(ref ORDER BY s DESC, ref) FILTER (WHERE s >= 0.15) AS best FROM v GROUP BY 1, 2)
SELECT answer_id, sentence_no, CASE WHEN len(good) > 0 THEN array_to_string(good, ',') WHEN best IS NOT NULL THEN CAST(best[1] AS VARCHAR) ELSE '' END AS refs, len(good) = 0 AND best IS NOT NULL AS attached,
  len(good) = 0 AND best IS NULL AS unsupported, CAST(len(list_filter(marks, lambda m: NOT list_contains(good, m))) AS INTEGER) AS invalid FROM g""")
def citation_support(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer's sentences against the user turns of its conversation as sources. A test holds the rules against written cases."""
    said = table(spark, sf, "conversations")
    replies = said.filter("role = 'assistant'").selectExpr("concat(conv_id, '-', turn) as answer_id", "conv_id", "concat(text, ' [1]') as answer")
    sources = replies.select("answer_id", "conv_id").join(said.filter("role = 'user'").select("conv_id", (F.floor(F.col("turn") / 2) + 1).cast("int").alias("ref"), F.col("text").alias("content")), "conv_id")
    return answers.checked_citations(replies, sources).withColumn("refs", F.array_join("refs", ","))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''),
w AS (SELECT doc_id, k, 1 AS r, length(line) AS n FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, CASE WHEN w.n > 0 AND w.n + length(line) > 800 THEN w.r + 1 ELSE w.r END, CASE WHEN w.n > 0 AND w.n + length(line) > 800 THEN length(line) ELSE w.n + length(line) END
  FROM p JOIN w ON p.doc_id = w.doc_id AND p.k = w.k + 1)
SELECT doc_id, CAST(r - 1 AS INTEGER) AS chunk_index, 'PARAGRAPH' AS kind, any_value(source) AS path, string_agg(line, chr(10) || chr(10) ORDER BY k) AS content, '章节: ' || any_value(source) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY k) AS embedding_text
FROM w JOIN p USING (doc_id, k) GROUP BY doc_id, r""")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, each under a heading and with its lines as paragraphs, as chunks of their sections. A test holds the rules against written cases as well."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "concat('# ', source, '\\n\\n', replace(text, '\\n', '\\n\\n')) as text")
    blocks = chunking.outline_blocks(docs, "doc_id", "text")
    return chunking.section_chunks(chunking.outline_paths(blocks, "doc_id"), "doc_id").withColumn("path", F.array_join("path", " > "))


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, parts[i] AS content, length(parts[i]) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
w AS (SELECT doc_id, i, 1 AS r, CASE WHEN n < 200 THEN n ELSE -1 END AS open FROM c WHERE i = 0 UNION ALL SELECT c.doc_id, c.i, CASE WHEN c.n < 200 AND w.open >= 0 THEN w.r ELSE w.r + 1 END,
  CASE WHEN c.n < 200 AND CASE WHEN w.open >= 0 THEN w.open + c.n ELSE c.n END < 200 THEN CASE WHEN w.open >= 0 THEN w.open + c.n ELSE c.n END ELSE -1 END FROM c JOIN w ON c.doc_id = w.doc_id AND c.i = w.i + 1)
SELECT doc_id, CAST(r - 1 AS INTEGER) AS chunk_index, sha256(string_agg(content, chr(10) || chr(10) ORDER BY i)) AS hash FROM w JOIN c USING (doc_id, i) GROUP BY doc_id, r""")
def packed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the documents, short neighbours put together."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"), F.lit("PARAGRAPH").alias("kind"))
    out = chunking.packed_chunks(lines, "doc_id", 200)
    return out.select("doc_id", "chunk_index", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
