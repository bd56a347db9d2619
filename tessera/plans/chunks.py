"""Queries over chunkers that follow blocks, and over the text functions beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import blocks, retrieval
from tessera.plans.registry import query
from tessera.sources.tables import CHUNKS_SQL, chunks, table

_SPREAD = "replace(text, chr(10), chr(10) || chr(10))"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SPREAD} AS t, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM d),
l AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, CAST(s AS BIGINT) AS s,
  CAST(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), s + length(line) + CASE WHEN i < n THEN 1 ELSE 0 END) AS BIGINT) AS e FROM l WHERE regexp_matches(line, '\S')),
w AS (SELECT doc_id, k, 1 AS r, s AS at, e - s AS size, false AS over FROM b WHERE k = 1
  UNION ALL SELECT b.doc_id, b.k, CASE WHEN j THEN w.r ELSE w.r + 1 END, CASE WHEN j THEN w.at ELSE b.s END, CASE WHEN j THEN b.e - w.at ELSE b.e - b.s END, j AND b.e - w.at > 1800
  FROM b JOIN w ON b.doc_id = w.doc_id AND b.k = w.k + 1, LATERAL (SELECT NOT w.over AND (b.e - w.at <= 1800 OR w.size < 600) AS j)),
r AS (SELECT doc_id, r, min(s) AS a, max(e) AS z FROM w JOIN b USING (doc_id, k) GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lead(r) OVER o IS NULL AND z - a < 600 AND z - lag(a) OVER o <= 3600 THEN lag(r) OVER o ELSE r END AS g FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY r)),
x AS (SELECT doc_id, g, min(a) AS a, max(z) AS z FROM m GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS chunk_index, sha256(substr(t, a + 1, z - a)) AS hash FROM x JOIN d USING (doc_id)""")
def structure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the documents as paragraphs, put together by the sizes of the default strategy."""
    docs = table(spark, sf, "documents").filter("text is not null").selectExpr("doc_id", "replace(text, '\\n', '\\n\\n') as text")
    return blocks.structure_chunks(docs, "doc_id", "text").select("doc_id", "chunk_index", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@query("""WITH p AS (SELECT p_brand AS brand, p_name AS name, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
t AS (SELECT brand, i // 20 AS c, 'TABLE' AS kind, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || name || ' | ' || size || ' |', chr(10) ORDER BY i) AS body,
  'headers: name, size' || chr(10) || string_agg('name: ' || name || '; size: ' || size, chr(10) ORDER BY i) AS said, max((n + 19) // 20) AS tables FROM p GROUP BY 1, 2),
l AS (SELECT brand, CASE WHEN n > 30 THEN i // 30 ELSE 0 END AS c, 'LIST' AS kind, string_agg('- ' || name, chr(10) ORDER BY i) AS body, '' AS said, max((n + 19) // 20) AS tables FROM p GROUP BY 1, 2)
SELECT brand, CAST(c + CASE kind WHEN 'LIST' THEN tables ELSE 0 END AS INTEGER) AS chunk_index, kind, '[' || brand || ']' || chr(10) || body AS content, CASE WHEN said = '' THEN '' ELSE '[' || brand || ']' || chr(10) || said END AS embedding_text
FROM (SELECT * FROM t UNION ALL SELECT * FROM l)""")
def block_parts(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand a text with a heading, a table of its parts and a list of their names, as parts of its blocks."""
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("l"))
    table_lines = F.array_join(F.transform("l", lambda p: F.concat(F.lit("| "), p["p_name"], F.lit(" | "), p["p_size"].cast("string"), F.lit(" |"))), "\n")
    items = F.array_join(F.transform("l", lambda p: F.concat(F.lit("- "), p["p_name"])), "\n")
    text = F.concat(F.lit("## "), "brand", F.lit("\n\n| name | size |\n| --- | --- |\n"), table_lines, F.lit("\n"), items)
    return blocks.block_parts(rows.select("brand", text.alias("text")), "brand", "text").drop("path")


@query()
def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut by their blocks and put together again. A test holds the rules against written cases and a plain version."""
    out = blocks.block_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "kind", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@query("""WITH q AS (SELECT item_id AS query_id, trim(regexp_replace(text || ' ;以及 ' || left(text, 20) || CASE WHEN item_id % 2 = 0 THEN '?? a?b' ELSE '' END, '\\s+', ' ', 'g')) AS q FROM benchmark),
s AS (SELECT query_id, q, list_filter(list_transform(regexp_split_to_array(q, '(?:以及|并且|同时|然后|；|;|\\?{2,}|？{2,})'), lambda p: trim(p, ' ,，;；?？')), lambda p: p <> '') AS p FROM q)
SELECT query_id, array_to_string(CASE WHEN len(p) > 1 THEN p[1:4] ELSE [q] END, '|') AS parts FROM s""".replace("\\\\", "\\"))
def decomposed_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").selectExpr("item_id as query_id", "concat(text, ' ;以及 ', substring(text, 1, 20), if(item_id % 2 = 0, '?? a?b', '')) as q")
    return asked.select("query_id", F.array_join(fn.decomposed(F.col("q")), "|").alias("parts"))


@query(r"""WITH n AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '_X' WHEN 1 THEN ' -2' ELSE '' END), '[^\p{L}\p{N}]+', '', 'g') AS plain FROM part)
SELECT p_partkey, plain, length(plain) >= 3 AS links FROM n""")
def normalized_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "_X").when(F.col("p_partkey") % 3 == 1, " -2").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", fn.normalized_name(name).alias("plain"), fn.links_bases(name).alias("links"))


@query("""SELECT r_regionkey, '| key | name |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'even<br>' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) AS body
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""".replace("\\\\", "\\"))
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.col("n_nationkey").cast("string"), F.translate("n_name", "A", "|"), F.lit("even\n"))).otherwise(F.array(F.col("n_nationkey").cast("string"), F.translate("n_name", "A", "|"))).alias("r"))
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows"))
    padded = F.transform("rows", lambda r: F.when(F.size(r) < 3, F.concat(r, F.array(F.lit("")))).otherwise(r))  # so that every region has three columns
    return rows.select("r_regionkey", fn.markdown_table(F.array(F.lit("key"), F.lit("name")), padded).alias("body"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS at FROM events""")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", fn.iso_utc(F.col("ts")).alias("at"))


@query(rf"""WITH {CHUNKS_SQL}, q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS kb, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+.#/-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,6}}'), lambda w: lower(w))) AS t FROM benchmark),
s AS (SELECT query_id, chunk_id, chunk_index, CAST(round((len(list_filter(t, lambda x: contains(lower(content), x))) + least(1.0::DOUBLE, length(content) / 1200.0::DOUBLE)) * 10000) AS BIGINT) AS score FROM q JOIN chunks USING (kb))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id) AS rank FROM s) WHERE rank <= 16""", ints=("rank",))
def fallback_sources(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").selectExpr("item_id as query_id", "text", "concat('src', item_id % 20) as kb")
    return retrieval.fallback_sources(asked, chunks(spark, sf).select("chunk_id", "chunk_index", "kb", "content"))
