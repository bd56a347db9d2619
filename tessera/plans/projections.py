"""Queries over what follows from a document's change: versions, channels, relations, scopes and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import projections
from tessera.plans.registry import query
from tessera.sources.tables import table


@query("""WITH v AS (SELECT l_partkey AS part, max(l_linenumber) AS v FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) SELECT p_partkey AS part, coalesce(v, 0) + 1 AS next FROM part LEFT JOIN v ON part = p_partkey""", ints=("next",))
def next_versions(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").filter("l_linenumber > 3").selectExpr("l_partkey as part", "l_linenumber as version")
    return projections.next_versions(known, table(spark, sf, "part").selectExpr("p_partkey as part"), "part").withColumn("next", F.col("next").cast("int"))


@query("""SELECT o_orderkey AS doc_id, count(l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 GROUP BY 1""")
def retired_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """How many live chunks (order lines that were not returned) are retired with every third document (order)."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "if(l_returnflag = 'R', 1, 0) as deleted")
    return projections.retired(rows, table(spark, sf, "orders").filter("o_orderkey % 3 = 0").selectExpr("o_orderkey as doc_id"))[1]


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_orderkey || '-' || l_linenumber AS chunk_id, l_linenumber AS k FROM lineitem WHERE l_orderkey % 5 = 0), a AS (SELECT doc_id, count(DISTINCT chunk_id) AS asked FROM d GROUP BY 1),
c(channel) AS (VALUES ('graph'), ('keyword'), ('vector'))
SELECT doc_id, channel, asked, CASE channel WHEN 'graph' THEN 0 ELSE coalesce((SELECT count(*) FROM d WHERE d.doc_id = a.doc_id AND (channel = 'vector' OR k > 1)), 0) END AS removed, CASE channel WHEN 'graph' THEN 'FAILED' ELSE 'DELETED' END AS status, 'RETRY' AS job, 1 AS retry_minutes FROM a, c""", ints=("retry_minutes",))
def channel_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth order's lines deleted from three channels, one of which is down and one lacks first lines."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "concat(l_orderkey, '-', l_linenumber) as chunk_id", "l_linenumber as k")
    channels = {"vector": lines.select("chunk_id"), "keyword": lines.filter("k > 1").select("chunk_id"), "graph": lines.select("chunk_id")}
    return projections.deleted_everywhere(channels, lines.filter("doc_id % 5 = 0").select("doc_id", "chunk_id"), ("graph",))[1]


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_suppkey AS src, l_partkey AS dst, l_linestatus AS type, CASE WHEN l_linenumber = 1 THEN 'deterministic' ELSE 'semantic' END AS origin, l_quantity::DOUBLE AS confidence, l_linenumber AS chunk_id FROM lineitem),
i AS (SELECT doc_id, src, dst, type, confidence + 1 AS confidence, chunk_id FROM s WHERE chunk_id IN (2, 3)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src, dst, type ORDER BY confidence DESC, chunk_id) AS r FROM i WHERE doc_id % 4 = 0) WHERE r = 1),
g AS (SELECT doc_id, src, dst, type, origin, confidence, chunk_id FROM s WHERE NOT (doc_id % 4 = 0 AND origin = 'semantic') UNION ALL SELECT doc_id, src, dst, type, 'semantic', confidence, chunk_id FROM b)
SELECT doc_id, src, dst, type, origin, confidence, chunk_id FROM g""")
def replaced_relations(spark: SparkSession, sf: str) -> DataFrame:
    origin = "if(l_linenumber = 1, 'deterministic', 'semantic') as origin"
    stored = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "l_suppkey as src", "l_partkey as dst", "l_linestatus as type", origin, "cast(l_quantity as double) as confidence", "l_linenumber as chunk_id")
    incoming = stored.filter("chunk_id in (2, 3)").withColumn("confidence", F.col("confidence") + 1).drop("origin")
    return projections.replaced_relations(stored, incoming, table(spark, sf, "orders").filter("o_orderkey % 4 = 0").selectExpr("o_orderkey as doc_id"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS src, l_partkey AS dst FROM lineitem), k AS (SELECT * FROM e WHERE doc_id % 2 = 1), n AS (SELECT src AS name FROM k WHERE src % 7 <> 0 UNION SELECT dst FROM k)
SELECT doc_id, src, dst FROM k WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)""")
def graph_without_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A graph after every other order is deleted; some suppliers are mentioned nowhere else."""
    edges = table(spark, sf, "lineitem").selectExpr("l_orderkey as doc_id", "l_suppkey as src", "l_partkey as dst").distinct()
    mentions = edges.filter("src % 7 <> 0").selectExpr("doc_id", "src as name").unionByName(edges.selectExpr("doc_id", "dst as name"))
    return projections.without_documents(mentions, edges, table(spark, sf, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey as doc_id"))[1]


@query("""SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 6 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 2 END AS enabled FROM part""", ints=("enabled",))
def switched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey as chunk_id", "cast(p_size % 2 as int) as enabled")
    wanted = rows.filter("chunk_id % 3 = 0").withColumn("enabled", F.lit(0)).unionByName(rows.filter("chunk_id % 6 = 0").withColumn("enabled", F.lit(1)))
    return projections.switched(rows, wanted).select("chunk_id", "enabled")


@query("""SELECT o_custkey AS case_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1 AND min(o_orderpriority) = '1-URGENT'""")
def scoped_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers all of whose orders are urgent, as cases bound to one base alone."""
    cases = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_set("o_orderpriority").alias("bases"))
    return projections.cases_in_scope(cases, "1-URGENT").select("case_id")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey % 3 = l_partkey % 3 AND l_linestatus = CASE WHEN l_returnflag = 'A' THEN 'O' ELSE l_linestatus END AS reuse, greatest(1, least(200, l_partkey - 50)) AS graph_limit FROM lineitem""")
def reusable_results(spark: SparkSession, sf: str) -> DataFrame:
    """Whether early results hold (collections: suppliers and parts by remainder; queries: states), and graph limits within their bounds."""
    final = F.when(F.col("l_returnflag") == "A", "O").otherwise(F.col("l_linestatus"))
    reuse = projections.may_reuse(F.col("l_suppkey") % 3, F.col("l_partkey") % 3, F.col("l_linestatus"), final)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reuse.alias("reuse"), projections.graph_limit(F.col("l_partkey") - 50).alias("graph_limit"))


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'P') WHERE place <= 3""", ints=("place",))
def lowest_rated(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's three lowest orders by price among those that have one, in order."""
    rated = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    order = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return rated.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


@query("""WITH n AS (SELECT s_nationkey AS pipeline, s_suppkey % 13 AS node, CASE WHEN s_suppkey % 11 = 0 THEN 'odd' ELSE 'parse' END AS type, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 7) % 15 END AS nxt FROM supplier),
w AS (SELECT DISTINCT pipeline, node AS first, nxt AS here FROM n WHERE nxt IS NOT NULL UNION SELECT w.pipeline, w.first, n.nxt FROM w JOIN n ON n.pipeline = w.pipeline AND n.node = w.here WHERE n.nxt IS NOT NULL)
SELECT pipeline, node, 'duplicate' AS fault FROM n GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT pipeline, node, 'type' FROM n WHERE type = 'odd'
UNION ALL SELECT pipeline, node, 'target' FROM n WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n o WHERE o.pipeline = n.pipeline AND o.node = n.nxt)
UNION ALL SELECT DISTINCT pipeline, w.first, 'cycle' FROM w WHERE w.first = w.here""".replace("WITH n AS", "WITH RECURSIVE n AS", 1))
def pipeline_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation as the nodes of a pipeline, with repeated ones, odd types, targets that aren't there and cycles."""
    nodes = table(spark, sf, "supplier").selectExpr("s_nationkey as pipeline", "s_suppkey % 13 as node", "if(s_suppkey % 11 = 0, 'odd', 'parse') as type", "if(s_suppkey % 4 = 0, null, (s_suppkey * 7) % 15) as next")
    return projections.pipeline_faults(nodes, ("parse",))
