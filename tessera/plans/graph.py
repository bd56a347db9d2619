"""Graph queries: nodes are parts, suppliers and words; edges are shared orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import query_terms
from tessera.functions.text import links_bases, normalized_name
from tessera.operators import graph
from tessera.operators.lineage import written
from tessera.plans.registry import query
from tessera.sources.tables import table

EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem)"
BOTH_SQL = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_suppkey as src", "l_partkey + 10000000 as dst").distinct()


@query("""WITH m AS (SELECT l_orderkey AS g, 'p' || (l_partkey % 50) AS name, l_linenumber AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey) AS r FROM lineitem)
SELECT a.name AS src, b.name AS dst, count(DISTINCT a.g) AS n FROM m a JOIN m b ON a.g = b.g AND a.name < b.name WHERE a.r <= 8 AND b.r <= 8 GROUP BY 1, 2""")
def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "lineitem").selectExpr("l_orderkey as g", "concat('p', l_partkey % 50) as name", "l_linenumber * 100000 + l_partkey as place")
    return graph.cooccurrences(mentions, "g", "name", "place")


@query("""WITH a AS (SELECT l_orderkey AS g, 'p' || ((l_partkey + CASE WHEN l_orderkey % 50 = 33 THEN 1 ELSE 0 END) % 50) AS name, l_linenumber * 100000 + l_partkey AS place FROM lineitem WHERE l_orderkey % 50 <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY place) AS r FROM a)
SELECT a.name AS src, b.name AS dst, count(DISTINCT a.g) AS n FROM m a JOIN m b ON a.g = b.g AND a.name < b.name WHERE a.r <= 8 AND b.r <= 8 GROUP BY 1, 2""")
def cooccurrence_update(spark: SparkSession, sf: str) -> DataFrame:
    """Stored co-occurrences after one order in fifty is deleted and one in fifty has other parts: only these orders are looked at again."""
    mentions = table(spark, sf, "lineitem").selectExpr("l_orderkey as g", "l_partkey", "concat('p', l_partkey % 50) as name", "l_linenumber * 100000 + l_partkey as place")
    edges = written(graph.cooccurrences(mentions, "g", "name", "place"))
    later = mentions.filter("g % 50 = 33").withColumn("name", F.concat(F.lit("p"), (F.col("l_partkey") + 1) % 50))
    return graph.updated_cooccurrences(edges, mentions.filter("g % 50 in (0, 33)"), later, "g", "name", "place")


@query("""WITH d AS (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM d)
SELECT node, degree, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM d) > 200 AS truncated FROM r WHERE rank <= 200""")
def first_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 best linked suppliers, and whether there are more."""
    nodes = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count_distinct("l_partkey").alias("degree"))
    return graph.first_nodes(nodes, [F.desc("degree"), F.col("node")], 200)


@query(f"""WITH RECURSIVE {EDGES_SQL}, {BOTH_SQL}, walk AS (SELECT src AS start, src AS node, 0 AS hops FROM (SELECT DISTINCT src FROM edges WHERE src % 100 = 0) UNION SELECT start, dst, hops + 1 FROM walk JOIN both_ways ON node = src WHERE hops < 2)
SELECT start, node, min(hops) AS hops FROM walk WHERE node <> start GROUP BY 1, 2""")
def bfs_expand(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    return graph.within_hops(edges, edges.filter("src % 100 = 0").select(F.col("src").alias("start")).distinct(), 2)


@query(f"""WITH {EDGES_SQL}, {BOTH_SQL}, v AS (SELECT DISTINCT src AS node FROM both_ways WHERE src % 3 <> 0)
SELECT node, EXISTS (SELECT 1 FROM both_ways b WHERE b.src = node AND b.dst NOT IN (SELECT node FROM v)) AS expandable FROM v""")
def expandable_flags(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    visible = graph.undirected(edges).filter("src % 3 <> 0").select(F.col("src").alias("node")).distinct()
    return graph.expandable(edges, visible)


NODES_SQL = "nodes AS (SELECT p_partkey AS id, p_size % 2 AS tenant, p_name AS name, p_brand AS kb, p_type AS kind FROM part)"
DEGREE_SQL = "deg AS (SELECT l_partkey AS id, count(*) AS degree FROM (SELECT DISTINCT l_partkey, l_suppkey + 10000000 AS s FROM lineitem) GROUP BY 1)"


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "part").selectExpr("p_partkey as id", "p_size % 2 as tenant", "p_name as name", "p_brand as kb", "p_type as kind")
    degree = table(spark, sf, "lineitem").selectExpr("l_partkey as id", "l_suppkey").distinct().groupBy("id").agg(F.count("*").alias("degree"))
    return nodes, degree


@query(f"""WITH {NODES_SQL}, {DEGREE_SQL}, m AS (SELECT id, tenant, kb, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS name FROM nodes WHERE length(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 3),
r AS (SELECT tenant, name, kb, id FROM (SELECT n.*, row_number() OVER (PARTITION BY tenant, name, kb ORDER BY coalesce(degree, 0) DESC, n.id) AS k FROM m n LEFT JOIN deg USING (id)) WHERE k = 1)
SELECT a.tenant, a.name, a.kb AS kb_a, b.kb AS kb_b, a.id AS a, b.id AS b FROM r a JOIN r b ON a.tenant = b.tenant AND a.name = b.name AND a.kb < b.kb""")
def cross_kb_bridges(spark: SparkSession, sf: str) -> DataFrame:
    nodes, degree = _parts(spark, sf)
    named = nodes.filter(links_bases(F.col("name"))).withColumn("name", normalized_name(F.col("name")))
    return graph.bridges(named, degree.withColumnRenamed("id", "node"))


@query(f"""WITH {NODES_SQL}, {DEGREE_SQL} SELECT id, kind, rank, total FROM (SELECT n.id, kind, row_number() OVER (PARTITION BY kind ORDER BY coalesce(degree, 0) DESC, name, n.id) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM nodes n LEFT JOIN deg USING (id)) WHERE rank <= 20""", ints=("rank",))
def pertype_topn(spark: SparkSession, sf: str) -> DataFrame:
    nodes, degree = _parts(spark, sf)
    known = nodes.join(degree, "id", "left")
    return graph.top_per_type(known, "kind", [F.desc(F.coalesce("degree", F.lit(0))), F.col("name"), F.col("id")], 20).select("id", "kind", "rank", "total")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, 1 AS weight FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, 2 AS weight FROM lineitem WHERE l_linenumber <= 2)
SELECT relation, weight, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.src = b.src AND a.dst = b.dst AND a.relation = b.relation)) GROUP BY 1, 2""")
def merge_views(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    of = lambda cond, w: lines.filter(cond).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation")).distinct().withColumn("weight", F.lit(w))
    return graph.merged_edges(of("l_linenumber = 1", 1), of("l_linenumber <= 2", 2)).groupBy("relation", "weight").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_partkey AS node, p_brand AS kb, p_type AS kind FROM part), e AS (SELECT DISTINCT p.l_partkey AS src, q.l_partkey AS dst FROM lineitem p JOIN lineitem q ON p.l_orderkey = q.l_orderkey AND p.l_partkey < q.l_partkey)
SELECT least(a.kb || '/' || a.kind, b.kb || '/' || b.kind) AS g1, greatest(a.kb || '/' || a.kind, b.kb || '/' || b.kind) AS g2, count(*) AS edges, bool_or(a.kb <> b.kb) AS "cross" FROM e JOIN g a ON a.node = src JOIN g b ON b.node = dst WHERE (a.kb, a.kind) <> (b.kb, b.kind) GROUP BY 1, 2""")
def overview_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    few = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    edges = few.withColumnRenamed("l_partkey", "src").join(few.withColumnRenamed("l_partkey", "dst"), "l_orderkey").filter("src < dst").select("src", "dst").distinct()
    return graph.overview(edges, table(spark, sf, "part").selectExpr("p_partkey as node", "p_brand as kb", "p_type as kind"))


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS parent, c_mktsegment AS name FROM customer),
w AS (SELECT id, name AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, w.path || ' > ' || n.name, depth + 1 FROM n JOIN w ON n.parent = w.id) SELECT id, path, depth FROM w""")
def intent_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey >= 10 then c_custkey div 10 end as parent", "c_mktsegment as name")
    return graph.paths(nodes)


@query(r"""WITH q AS (SELECT item_id AS query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] AS terms FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.:/-]{1,}'), lambda w: lower(w)) AS l FROM benchmark)),
e AS (SELECT n_name || CASE WHEN n_nationkey % 5 = 0 THEN ' the of' ELSE '' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'thand in ention' ELSE 'none' END AS description, 'c' || (n_nationkey % 8) AS chunk_id FROM nation),
m AS (SELECT query_id, chunk_id, name, CASE WHEN len(list_filter(terms, lambda t: contains(lower(name), t))) > 0 THEN 100 WHEN len(list_filter(terms, lambda t: contains(lower(description), t))) > 0 THEN 72 END AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(name), name, chunk_id) AS r FROM m WHERE score IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY r) AS c FROM r WHERE r <= 10)
SELECT query_id, chunk_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM o WHERE c = 1""", ints=("rank",))
def graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text")).alias("terms"))
    entities = table(spark, sf, "nation").selectExpr("concat(n_name, if(n_nationkey % 5 = 0, ' the of', '')) as name", "if(n_nationkey % 3 = 0, 'thand in ention', 'none') as description", "concat('c', n_nationkey % 8) as chunk_id")
    return graph.mentioned_chunks(asked, entities, 10)


@query()
def recall_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first edges of a walk from the part that each question names, or from the best linked one. A test holds it against brute force."""
    edges = table(spark, sf, "lineitem").selectExpr("concat('s', l_suppkey) as src", "concat('p', l_partkey) as dst").distinct()
    nodes = table(spark, sf, "part").selectExpr("concat('p', p_partkey) as node", "split(p_name, ' ')[0] as name")
    return graph.recall_paths(edges, nodes, table(spark, sf, "benchmark").selectExpr("item_id as query_id", "text"))
