"""Evaluation queries: cases are benchmark items, expected chunks those that hold a question's first words, returned chunks the lexical ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.plans.registry import query
from tessera.sources.tables import table

K = 5
# Rankings made by arithmetic: item i returns documents (i * 7 + rank * 3) % 40, expects documents i .. i + 2 (by id) and i + 5 (by hash).
CASES_SQL = f"""cases AS (SELECT item_id AS case_id, item_id % 6 <> 0 AS answerable, CASE item_id % 4 WHEN 0 THEN 'adversarial' WHEN 1 THEN 'fact' ELSE 'list' END AS category, CASE WHEN length(text) > 200 THEN 'hard' ELSE 'easy' END AS difficulty FROM benchmark),
returned AS (SELECT item_id AS case_id, CAST(r AS INTEGER) AS rank, CAST((item_id * 7 + r * 3) % 40 AS VARCHAR) AS item, 'h' || ((item_id * 7 + r * 3) % 10) AS hash FROM benchmark, (SELECT unnest(generate_series(1, 8)) AS r)),
expected AS (SELECT item_id AS case_id, CAST((item_id + j) % 40 AS VARCHAR) AS item, CASE WHEN j = 3 THEN 'h' || (item_id % 10) ELSE '' END AS hash, CASE j WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS grade FROM benchmark, (SELECT unnest(generate_series(0, 3)) AS j)),
near AS (SELECT * FROM returned WHERE rank <= {K}),
matched AS (SELECT n.case_id, n.rank, e.item, e.grade FROM near n JOIN expected e USING (case_id, item) UNION ALL
  SELECT n.case_id, n.rank, e.item, e.grade FROM near n JOIN expected e ON n.case_id = e.case_id AND e.hash <> '' AND n.hash = e.hash WHERE NOT EXISTS (SELECT 1 FROM expected x WHERE x.case_id = n.case_id AND x.item = n.item)),
firsts AS (SELECT case_id, item, min(rank) AS rank, max(grade) AS grade FROM matched GROUP BY 1, 2),
gained AS (SELECT case_id, count(*) AS hits, min(rank) AS first, CAST(sum(CAST(round(CAST(so_far AS DOUBLE) / rank * 1000000000) AS BIGINT)) AS BIGINT) AS ap, CAST(sum(CAST(round(grade / log2(rank + 1) * 1000000000) AS BIGINT)) AS BIGINT) AS dcg
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS so_far FROM firsts) GROUP BY 1),
ideal AS (SELECT case_id, count(*) AS n_expected, CAST(sum(CAST(round(grade / log2(i + 1) * 1000000000) AS BIGINT)) FILTER (WHERE i <= {K}) AS BIGINT) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, item) AS i FROM expected) GROUP BY 1),
per_case AS (SELECT c.*, coalesce(n_expected, 0) AS n_expected, coalesce(hits, 0) AS hits, CASE WHEN answerable THEN CAST(coalesce(hits, 0) AS DOUBLE) / {K} ELSE 0 END AS precision, CASE WHEN n_expected > 0 THEN CAST(coalesce(hits, 0) AS DOUBLE) / n_expected ELSE 0 END AS recall,
  CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank, coalesce(ap, 0)::DOUBLE / 1000000000 / least(n_expected, {K}) AS average_precision, CASE WHEN idcg > 0 THEN coalesce(dcg, 0)::DOUBLE / idcg ELSE 0 END AS ndcg
  FROM cases c LEFT JOIN ideal USING (case_id) LEFT JOIN gained USING (case_id))"""


def _cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, sf, "benchmark")
    cases = items.selectExpr(
        "item_id as case_id", "item_id % 6 <> 0 as answerable", "case item_id % 4 when 0 then 'adversarial' when 1 then 'fact' else 'list' end as category", "case when char_length(text) > 200 then 'hard' else 'easy' end as difficulty"
    )
    returned = items.selectExpr("item_id as case_id", "explode(sequence(1, 8)) as rank").selectExpr("case_id", "rank", "cast((case_id * 7 + rank * 3) % 40 as string) as item", "concat('h', (case_id * 7 + rank * 3) % 10) as hash")
    expected = items.selectExpr("item_id as case_id", "explode(sequence(0, 3)) as j").selectExpr(
        "case_id", "cast((case_id + j) % 40 as string) as item", "case when j = 3 then concat('h', case_id % 10) else '' end as hash", "cast(case j when 0 then 3 when 1 then 2 else 1 end as double) as grade"
    )
    return cases, returned, expected


@query(f"WITH {CASES_SQL} SELECT case_id, n_expected, hits, precision, recall, hit, reciprocal_rank, average_precision, ndcg FROM per_case")
def case_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.case_metrics(*_cases(spark, sf), K)


def _means(columns: tuple[str, ...]) -> str:
    return ", ".join(f"CAST(floor(sum(CAST(round({c} * 1000000) AS BIGINT)) / count(*)) AS BIGINT) AS {c}" for c in columns)


METRICS = ("precision", "recall", "hit", "reciprocal_rank", "average_precision", "ndcg")


@query(f"WITH {CASES_SQL} SELECT count(*) AS cases, {_means(METRICS)} FROM per_case WHERE answerable")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    cases, returned, expected = _cases(spark, sf)
    return evaluation.case_metrics(cases.filter("answerable"), returned, expected, K).agg(F.count("*").alias("cases"), *[evaluation.micro(m).alias(m) for m in METRICS])


@query(f"""WITH {CASES_SQL} SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS slice, coalesce(category, difficulty, '') AS value, count(*) AS cases, {_means(("recall", "ndcg"))}
FROM per_case GROUP BY GROUPING SETS ((), (category), (difficulty))""")
def slices_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    cases, returned, expected = _cases(spark, sf)
    per_case = evaluation.case_metrics(cases, returned, expected, K).join(cases.select("case_id", "category", "difficulty"), "case_id")
    return evaluation.sliced(per_case, ["category", "difficulty"], ["recall", "ndcg"])


@query(f"""WITH {CASES_SQL}, r AS (SELECT *, case_id % 5 > 1 AS answered FROM cases), c AS (SELECT count(*) FILTER (WHERE NOT answerable AND NOT answered AND category <> 'adversarial') AS t, count(*) FILTER (WHERE answerable AND NOT answered) AS f, count(*) FILTER (WHERE NOT answerable AND category <> 'adversarial') AS a FROM r),
m AS (SELECT CASE WHEN a > 0 THEN t::DOUBLE / a ELSE 0 END AS recall, CASE WHEN t + f > 0 THEN t::DOUBLE / (t + f) ELSE 0 END AS precision FROM c) SELECT recall, precision, CASE WHEN recall + precision > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m""")
def refusal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.refusals(_cases(spark, sf)[0].withColumn("answered", F.col("case_id") % 5 > 1))


def _gate_rows() -> str:
    return ", ".join(f"('{m.format(k=K)}', '{o}', {t}::DOUBLE)" for m, o, t in evaluation.GATES)


@query(f"""WITH {CASES_SQL}, s AS (SELECT count(*)::DOUBLE AS evaluated_cases, CAST(floor(sum(CAST(round(recall * 1000000) AS BIGINT)) / count(*)) AS BIGINT) / 1000000.0::DOUBLE AS recall, CAST(floor(sum(CAST(round(ndcg * 1000000) AS BIGINT)) / count(*)) AS BIGINT) / 1000000.0::DOUBLE AS ndcg FROM per_case),
m AS (SELECT 'evaluated_cases' AS metric, evaluated_cases AS value FROM s UNION ALL SELECT 'recall@{K}', recall FROM s UNION ALL SELECT 'ndcg@{K}', ndcg FROM s UNION ALL SELECT 'recall@{K}_ci95_low', recall / 2 FROM s),
g(metric, operator, threshold) AS (VALUES {_gate_rows()}), j AS (SELECT g.*, coalesce(m.value, 0) AS value, CASE WHEN operator = '>=' THEN coalesce(l.value, m.value, 0) ELSE coalesce(m.value, 0) END AS judged FROM g LEFT JOIN m ON m.metric = g.metric LEFT JOIN m l ON l.metric = g.metric || '_ci95_low')
SELECT *, CASE operator WHEN '>=' THEN judged >= threshold WHEN '<=' THEN judged <= threshold ELSE judged = threshold END AS passed FROM j""")
def gates_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    per_case = evaluation.case_metrics(*_cases(spark, sf), K)
    one = per_case.agg(F.count("*").cast("double").alias("evaluated_cases"), (evaluation.micro("recall") / 1_000_000).alias(f"recall@{K}"), (evaluation.micro("ndcg") / 1_000_000).alias(f"ndcg@{K}"))
    wide = one.withColumn(f"recall@{K}_ci95_low", F.col(f"`recall@{K}`") / 2).withColumn("_k", F.lit(1))
    return evaluation.gates(wide.unpivot("_k", [f"`{c}`" for c in wide.columns if c != "_k"], "metric", "value").drop("_k"), K)


@query("""WITH r AS (SELECT event_type AS kb, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS run, count(*) AS n, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY 1, 2),
u AS (SELECT kb, run, 'n' AS metric, n AS value FROM r UNION ALL SELECT kb, run, 'slow', slow FROM r) SELECT *, value - before AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY kb, metric ORDER BY run) AS before FROM u) WHERE before IS NOT NULL""")
def run_deltas(spark: SparkSession, sf: str) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).alias("run")
    runs = table(spark, sf, "events").groupBy(F.col("event_type").alias("kb"), week).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("slow"))
    return evaluation.deltas(runs, ["kb"], "run", ["n", "slow"]).filter("before is not null")


@query("""WITH c AS (SELECT d.doc_id AS case_id, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 END AS vote, doc_id % 4 <> 0 AS scoped, doc_id % 3 <> 0 AS found FROM documents d LEFT JOIN labels USING (doc_id))
SELECT case_id, CASE WHEN coalesce(vote, 0) <> -1 AND scoped AND found THEN 'approved' ELSE 'needs_review' END AS status, CASE WHEN coalesce(vote, 0) <> -1 AND scoped AND found THEN 1 ELSE 0 END AS active,
CASE WHEN coalesce(vote, 0) <> -1 AND scoped AND found THEN 'c' || case_id ELSE '' END AS expected, 'golden_dataset' || CASE WHEN vote = -1 THEN ',bad_case,needs_review' WHEN NOT scoped THEN ',missing_corpus_scope' WHEN NOT found THEN ',missing_ground_truth' ELSE '' END AS tags FROM c""")
def case_promotion(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    cases = joined.selectExpr(
        "doc_id as case_id", "case quality when 1 then 1 when 0 then -1 end as vote", "if(doc_id % 3 <> 0, array(concat('c', doc_id)), cast(array() as array<string>)) as retrieved",
        "if(doc_id % 4 <> 0, array('kb'), cast(array() as array<string>)) as bases", "array('base_case') as tags",
    )
    out = evaluation.promoted(cases)
    return out.select("case_id", "status", "active", F.array_join("expected", ",").alias("expected"), F.array_join("tags", ",").alias("tags"))
