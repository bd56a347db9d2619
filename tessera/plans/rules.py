"""Queries over scalar rules that other queries don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import text as fn
from tessera.operators import access, extraction, lifecycle
from tessera.plans.registry import query
from tessera.sources.tables import table


def _holds(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(lower(q), '{w}') AS INTEGER)" for w in words)


_ASKED = f"""SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN '{rules.CODE_TERMS[0]} ' WHEN 1 THEN '{rules.DOCUMENT_TERMS[0]} {rules.CODE_TERMS[1]} ' WHEN 2 THEN '{rules.DOCUMENT_TERMS[1]}' ELSE '' END || text AS q FROM benchmark"""


@query(f"""WITH n AS (SELECT query_id, {_holds(rules.CODE_TERMS)} AS code, {_holds(rules.DOCUMENT_TERMS)} AS document FROM ({_ASKED}))
SELECT query_id, CASE WHEN code > document THEN 'code_search' WHEN document > 0 THEN 'document_qa' ELSE 'general' END AS kind FROM n""")
def question_kinds(spark: SparkSession, sf: str) -> DataFrame:
    words = rules.CODE_TERMS, rules.DOCUMENT_TERMS
    prefix = F.when(F.col("item_id") % 4 == 0, f"{words[0][0]} ").when(F.col("item_id") % 4 == 1, f"{words[1][0]} {words[0][1]} ").when(F.col("item_id") % 4 == 2, words[1][1]).otherwise("")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), rules.question_kind(F.concat(prefix, "text")).alias("kind"))


@query(f"""SELECT conv_id, turn, regexp_matches(regexp_replace(CASE turn % 3 WHEN 0 THEN '请问 它 的' WHEN 1 THEN '这个参数' ELSE '' END || text, '\\s+', '', 'g'), '{fn.UNRESOLVED}') AS unclear FROM conversations""")
def unclear_questions(spark: SparkSession, sf: str) -> DataFrame:
    prefix = F.when(F.col("turn") % 3 == 0, "请问 它 的").when(F.col("turn") % 3 == 1, "这个参数").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", fn.needs_clarification(F.concat(prefix, "text")).alias("unclear"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN 'a,c' ELSE 'a,b,c' END AS changed FROM lineitem""")
def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that differ between two maps: one goes, one comes, one may keep its value."""
    before, after = F.create_map(F.lit("a"), "l_returnflag", F.lit("b"), "l_linestatus"), F.create_map(F.lit("b"), "l_returnflag", F.lit("c"), "l_linestatus")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.map_keys(rules.map_changes(before, after))), ",").alias("changed"))


@query("""WITH b AS (SELECT p_partkey, p_size % 12 AS k, p_size + 20 AS c, p_partkey % 3 = 0 AS expert, (p_partkey % 10) / 10.0::DOUBLE AS share FROM part), t AS (SELECT *, k + CASE WHEN expert THEN 3 ELSE 0 END AS e FROM b)
SELECT p_partkey, CASE WHEN share > 0.3::DOUBLE THEN greatest(e, least(10, e + 2)) ELSE e END AS top_k, c + CASE WHEN expert THEN 10 ELSE 0 END AS candidates,
  least(greatest(0, p_partkey * 10 - 3000), greatest(least(2000, greatest(0, p_partkey * 10 - 3000)), k * 450)) AS tokens FROM t""", ints=("top_k", "candidates"))
def retrieval_budgets(spark: SparkSession, sf: str) -> DataFrame:
    k, candidates = F.col("p_size") % 12, F.col("p_size") + 20
    most, wide = rules.retrieval_budget(k, candidates, F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 10) / F.lit(10.0))
    tokens = rules.evidence_tokens(F.lit(2000), F.col("p_partkey") * 10, F.lit(3000), k)
    return table(spark, sf, "part").select("p_partkey", most.cast("int").alias("top_k"), wide.cast("int").alias("candidates"), tokens.cast("long").alias("tokens"))


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, trim(CASE l_orderkey % 6 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN l_returnflag WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 3 THEN '+1,234.50%' WHEN 4 THEN 'Yes' ELSE ' ' END) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v = '' THEN 'empty' {" ".join(f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for n, p in extraction.CELL_KINDS)} ELSE 'text' END AS kind FROM c""")
def cell_kinds(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("l_orderkey") % 6
    cell = F.when(at == 0, F.col("l_quantity").cast("long").cast("string")).when(at == 1, F.col("l_returnflag")).when(at == 2, F.date_format("l_shipdate", "yyyy-MM-dd")).when(at == 3, "+1,234.50%").when(at == 4, "Yes").otherwise(" ")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", extraction.cell_kind(cell).alias("kind"))


@query("""SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem h WHERE EXISTS (SELECT 1 FROM lineitem a WHERE a.l_suppkey % 50 = h.l_suppkey % 50 AND a.l_partkey = h.l_partkey AND a.l_returnflag = 'A')""")
def authorized_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits on parts that the user (a supplier's group) was granted."""
    lines = table(spark, sf, "lineitem").selectExpr("l_suppkey % 50 as user_id", "l_partkey as resource_id", "l_orderkey", "l_linenumber", "l_returnflag")
    return access.authorized_hits(lines, lines.filter("l_returnflag = 'A'").select("user_id", "resource_id").distinct()).select("l_orderkey", "l_linenumber").distinct()


@query("""WITH e AS (SELECT o_custkey AS tenant, o_orderpriority AS question, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), a AS (SELECT o_custkey AS tenant, o_orderpriority AS question, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2)
SELECT tenant, question, CASE WHEN e.k % 2 = 0 THEN 's' || e.k ELSE 's' || coalesce(a.k, e.k) END AS sources, coalesce(e.k % 2 = 0, false) AS golden, coalesce(e.k % 2 = 0 AND e.k % 4 = 0, false) AS active FROM e FULL JOIN a USING (tenant, question)""")
def base_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's priorities as questions: cases from every third order, asked again with the others."""
    orders = table(spark, sf, "orders").selectExpr("o_custkey as tenant", "o_orderpriority as question", "o_orderkey as k")
    known = orders.filter("k % 3 = 0").groupBy("tenant", "question").agg(F.max("k").alias("k")).selectExpr("tenant", "question", "concat('s', k) as sources", "k % 2 = 0 as golden", "k % 4 = 0 as active")
    return lifecycle.base_cases(known, orders.filter("k % 3 <> 0").selectExpr("tenant", "question", "k as at", "concat('s', k) as sources"))
