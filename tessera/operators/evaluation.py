"""Evaluation of retrieval and answers: metrics per case and run, slices, gates, changes between runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Release gates. The metrics of those marked by k carry @k in their names.
GATES = (
    ("evaluated_cases", ">=", 30.0),
    ("recall@{k}", ">=", 0.75),
    ("ndcg@{k}", ">=", 0.70),
    ("mrr@{k}", ">=", 0.70),
    ("refusal_recall", ">=", 0.90),
    ("acl_leakage_count", "==", 0.0),
    ("error_rate", "<=", 0.02),
    ("retrieval_latency_p95_ms", "<=", 3000.0),
    ("stability", ">=", 0.90),
    ("groundedness", ">=", 0.80),
    ("completeness", ">=", 0.70),
    ("answer_relevance", ">=", 0.75),
    ("correctness", ">=", 0.75),
    ("citation_precision", ">=", 0.95),
    ("citation_coverage", ">=", 0.80),
    ("injection_safety", ">=", 1.0),
    ("correctness_reference_coverage", ">=", 0.80),
)


def first_hits(returned: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """case_id, rank, grade of the ranks up to k at which an expected item is met for the first time. returned: case_id, rank, item, hash; expected: case_id, item, hash,
    grade. An item matches by id, else by hash; each counts once. Two equality joins instead of one on either key."""
    near = returned.filter(F.col("rank") <= k)
    by_id = near.join(expected.select("case_id", "item", "grade"), ["case_id", "item"]).select("case_id", "rank", "item", "grade")
    rest = near.join(expected.select("case_id", "item"), ["case_id", "item"], "left_anti").filter(F.coalesce("hash", F.lit("")) != "")
    named = expected.filter(F.coalesce("hash", F.lit("")) != "").groupBy("case_id", "hash").agg(F.max_by("item", "item").alias("item"), F.max_by("grade", "item").alias("grade"))
    by_hash = rest.drop("item").join(named, ["case_id", "hash"]).select("case_id", "rank", "item", "grade")
    return by_id.unionByName(by_hash).groupBy("case_id", "item").agg(F.min("rank").alias("rank"), F.max("grade").alias("grade"))


def case_metrics(cases: DataFrame, returned: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per case (case_id, answerable): n_expected, hits, precision, recall, hit, reciprocal_rank, average_precision, ndcg."""
    hits = first_hits(returned, expected, k).withColumn("_so_far", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")))
    gained = hits.groupBy("case_id").agg(
        F.count("*").alias("hits"),
        F.min("rank").alias("first"),
        F.sum(F.round(F.col("_so_far") / F.col("rank") * 1_000_000_000).cast("long")).alias("ap"),
        F.sum(F.round(F.col("grade") / F.log2(F.col("rank") + 1) * 1_000_000_000).cast("long")).alias("dcg"),
    )
    graded = expected.withColumn("_i", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "item")))
    ideal = graded.groupBy("case_id").agg(
        F.count("*").alias("n_expected"), F.sum(F.when(F.col("_i") <= k, F.round(F.col("grade") / F.log2(F.col("_i") + 1) * 1_000_000_000).cast("long"))).alias("idcg")
    )
    every = cases.join(ideal, "case_id", "left").join(gained, "case_id", "left").fillna(0, ["n_expected", "hits", "ap", "dcg", "idcg"])
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return every.select(
        "case_id",
        "n_expected",
        "hits",
        F.when(F.col("answerable"), F.col("hits").cast("double") / k).otherwise(0.0).alias("precision"),
        share(F.col("hits"), F.col("n_expected")).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        share(F.col("ap") / 1_000_000_000, F.least(F.col("n_expected"), F.lit(k))).alias("average_precision"),
        share(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def micro(name: str) -> Column:
    """The mean of a metric in millionths, from whole millionths, so that the order of the sum doesn't matter."""
    return F.floor(F.sum(F.round(F.col(name) * 1_000_000).cast("long")) / F.count(name)).cast("long")


def sliced(per_case: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means (in millionths) over all cases and over each value of each column of `by`, in one pass of grouping sets; slice and value name the group."""
    sets = [(), *[(c,) for c in by]]
    grouped = per_case.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.grouping_id().alias("_g"), F.count("*").alias("cases"), *[micro(m).alias(m) for m in metrics])
    every = (1 << len(by)) - 1
    slices = [(every - (1 << (len(by) - 1 - i)), c) for i, c in enumerate(by)]
    name, value = F.lit("all"), F.lit("")
    for g, c in slices:
        name, value = F.when(F.col("_g") == g, c).otherwise(name), F.when(F.col("_g") == g, F.col(c)).otherwise(value)
    return grouped.select(name.alias("slice"), value.alias("value"), "cases", *metrics)


def refusals(results: DataFrame) -> DataFrame:
    """Refusal recall, precision and F1 over results (answerable, answered, category); adversarial cases aren't refusal cases."""
    true = F.count_if(~F.col("answerable") & ~F.col("answered") & (F.col("category") != "adversarial"))
    false = F.count_if(F.col("answerable") & ~F.col("answered"))
    asked = F.count_if(~F.col("answerable") & (F.col("category") != "adversarial"))
    counts = results.agg(true.alias("t"), false.alias("f"), asked.alias("a"))
    r = F.when(F.col("a") > 0, F.col("t").cast("double") / F.col("a")).otherwise(0.0)
    p = F.when(F.col("t") + F.col("f") > 0, F.col("t").cast("double") / (F.col("t") + F.col("f"))).otherwise(0.0)
    return counts.select(r.alias("recall"), p.alias("precision"), F.when(r + p > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def gates(metrics: DataFrame, k: int) -> DataFrame:
    """metric, operator, threshold, value, judged, passed: each gate against metrics (metric, value). >= gates judge the lower end of the 95 % interval (metric_ci95_low) where there is one;
    a metric that is missing counts as 0."""
    spec = metrics.sparkSession.createDataFrame([(m.format(k=k), o, t) for m, o, t in GATES], "metric string, operator string, threshold double")
    low = metrics.select(F.regexp_replace("metric", "_ci95_low$", "").alias("metric"), F.col("value").alias("_low")).filter(metrics["metric"].endswith("_ci95_low"))
    joined = spec.join(metrics, "metric", "left").join(low, "metric", "left")
    value = F.coalesce("value", F.lit(0.0))
    judged = F.when(F.col("operator") == ">=", F.coalesce(F.col("_low"), value)).otherwise(value)
    passed = F.when(F.col("operator") == ">=", judged >= F.col("threshold")).when(F.col("operator") == "<=", judged <= F.col("threshold")).otherwise(judged == F.col("threshold"))
    return joined.select("metric", "operator", "threshold", value.alias("value"), judged.alias("judged"), passed.alias("passed"))


def deltas(runs: DataFrame, same: list[str], order: str, metrics: list[str]) -> DataFrame:
    """run, metric, value, before, delta: each run against the one before it with the same settings."""
    long = runs.select(*same, order, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("long"))])).alias("metric", "value"))
    before = F.lag("value").over(Window.partitionBy(*same, "metric").orderBy(order))
    return long.withColumn("before", before).withColumn("delta", F.col("value") - F.col("before"))


def promoted(cases: DataFrame) -> DataFrame:
    """case_id, status, active, expected, tags: cases (case_id, vote, retrieved, bases, tags) made golden, closed where evidence is missing."""
    plain = F.filter("tags", lambda t: t != "base_case")
    bad = F.coalesce(F.col("vote") == -1, F.lit(False))
    scope, found = F.size("bases") > 0, F.size("retrieved") > 0
    ok = ~bad & scope & found
    more = F.when(bad, F.array(F.lit("bad_case"), F.lit("needs_review"))).when(~scope, F.array(F.lit("missing_corpus_scope"))).when(~found, F.array(F.lit("missing_ground_truth"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return cases.select(
        "case_id", F.when(ok, "approved").otherwise("needs_review").alias("status"), ok.cast("int").alias("active"), F.when(ok, F.col("retrieved")).otherwise(none).alias("expected"),
        F.array_distinct(F.concat(plain, F.array(F.lit("golden_dataset")), more)).alias("tags"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
