"""Small decision rules as Column expressions or one-row aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from tessera.operators import folds
from tessera.operators.lineage import met_in_blocks, written

# Which status a document may pass to.
TRANSITIONS = (
    ("UPLOADED", "PENDING_REVIEW"),
    ("UPLOADED", "QUEUED"),
    ("PENDING_REVIEW", "APPROVED"),
    ("PENDING_REVIEW", "REJECTED"),
    ("APPROVED", "QUEUED"),
    ("QUEUED", "RUNNING"),
    ("RUNNING", "SUCCESS"),
    ("RUNNING", "RETRY"),
    ("RUNNING", "DEAD"),
    ("RETRY", "RUNNING"),
    ("RETRY", "DEAD"),
)


def may_pass(current: Column, target: Column) -> Column:
    return F.concat_ws(">", F.upper(current), F.upper(target)).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def may_review(role: Column, owner: Column, can_write: Column) -> Column:
    """Whether someone may approve or reject a document: by role, as owner of its base, or with a grant to write there; unknown counts as no."""
    return F.coalesce(role.isin("admin", "system_admin", "tenant_admin"), F.lit(False)) | F.coalesce(owner, F.lit(False)) | F.coalesce(can_write, F.lit(False))


def initial_status(approval: Column) -> Column:
    """The status of an uploaded document: it waits for a review where those are switched on, else for its turn."""
    return F.when(approval, "PENDING_REVIEW").otherwise("queued")


def tuning_hints(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, param, direction from runs (recall, refusal, p95_ms): more candidates for low recall, a lower threshold for many refusals, fewer candidates for high latency."""
    means = runs.groupBy(*by).agg(F.avg("recall").alias("_r"), F.avg("refusal").alias("_f"), F.max("p95_ms").alias("_p"))
    hint = lambda on, param, direction: F.when(on, F.struct(F.lit(param).alias("param"), F.lit(direction).alias("direction")))
    hints = F.array_compact(F.array(hint(F.col("_r") < 0.6, "per_channel_top_k", "increase"), hint(F.col("_f") > 0.30, "rrf_min_score", "decrease"), hint(F.col("_p") > 5000, "max_candidates", "decrease")))
    return means.select(*by, F.explode(hints).alias("_h")).select(*by, "_h.param", "_h.direction")


def invest(cases: Column, before: Column, after: Column, p95_ms: Column, least_cases: int, least_uplift: float, most_ms: float) -> Column:
    """HOLD without enough cases, ENABLE for a measured uplift within the latency limit, else DISABLE."""
    return F.when(cases < least_cases, "HOLD").when((after - before >= least_uplift) & (p95_ms <= most_ms), "ENABLE").otherwise("DISABLE")


def scopes_named(questions: DataFrame, scopes: DataFrame) -> DataFrame:
    """query_id, scope: scopes (scope, name) whose name, of three characters or more, the question holds; all scopes for a question that holds none. scopes is a short configured list."""
    pairs = met_in_blocks(scopes, questions)
    named = pairs.withColumn("_in", (F.char_length(F.regexp_replace("name", r"[^\p{L}\p{N}]", "")) >= 3) & F.contains(F.lower("text"), F.lower("name")))
    return named.withColumn("_any", F.bool_or("_in").over(Window.partitionBy("query_id"))).filter("_in or not _any").select("query_id", "scope")


def intent_scores(questions: DataFrame, nodes: DataFrame, most: int = 5, least: float = 0.3) -> DataFrame:
    """query_id, code, score, rank, ambiguous: nodes (code, name, haystack; a short configured list) by the share of the question's terms they hold (65 parts) and whether the
    question holds their name (35 parts), cut to 0.95; at most `most` of `least` and over. ambiguous: the best is 0.55 or more and the next within 0.08."""
    pairs = met_in_blocks(nodes, questions.withColumn("_q", F.lower(F.trim("text"))).filter("_q <> ''"))
    terms = F.array_distinct(F.regexp_extract_all("_q", F.lit(r"[\p{L}\p{N}_]{2,}"), 0))
    share = F.size(F.filter(terms, lambda t: F.contains(F.lower("haystack"), t))) / F.greatest(F.lit(1), F.size(terms))
    direct = F.when((F.col("name") != "") & F.contains("_q", F.lower("name")), 0.35).otherwise(0.0)
    scored = pairs.select("query_id", "code", F.round(F.least(F.lit(0.95), direct + share * 0.65) * 1_000_000).cast("long").alias("score")).filter(F.col("score") >= int(least * 1_000_000))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "code")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    close = (F.col("rank") == 1) & (F.col("score") >= 550_000) & (F.col("score") - F.col("_next") <= 80_000)
    return ranked.withColumn("ambiguous", F.coalesce(close, F.lit(False))).filter(F.col("rank") <= most).drop("_next")


def recommended(samples: DataFrame, questions: DataFrame, most: int = 3) -> DataFrame:
    """query_id, suggestion, rank: sample questions (kb, sample, place) of all bases or the question's (query_id, kb, text), other than the question, each once, in order.

    Of each base, and of those for all bases, only the first `most` + 1 different samples can be among them, as one of them at most is the question itself; so questions meet few rows each.
    """
    named = samples.select(F.when(F.col("kb") != "", F.col("kb")).alias("kb"), F.trim("sample").alias("suggestion"), "place").filter("suggestion <> ''")
    first = named.groupBy("kb", "suggestion").agg(F.min("place").alias("place"))
    first = written(first.withColumn("_r", F.row_number().over(Window.partitionBy("kb").orderBy("place", "suggestion"))).filter(F.col("_r") <= most + 1).drop("_r"))
    own = questions.join(first.filter("kb is not null"), "kb").select("query_id", "text", "suggestion", "place")
    every = questions.join(F.broadcast(first.filter("kb is null").drop("kb")), F.lit(True)).select("query_id", "text", "suggestion", "place")  # at most `most` + 1 rows
    fit = own.unionByName(every).filter(F.col("suggestion") != F.trim("text")).groupBy("query_id", "suggestion").agg(F.min("place").alias("place"))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "suggestion"))).filter(F.col("rank") <= most).drop("place")


def smoothed(scores: DataFrame, key: str, order: str, value: str, keep: int = 65) -> DataFrame:
    """key, level (thousandths), trend: values folded in order, each new level keeping `keep` percent of the last; trend: up or down when the last value is 300 thousandths off the level before it."""

    def step(state: tuple, rows: pa.RecordBatch) -> tuple:
        level, gap = state
        for v in rows.column("_v").to_pylist():
            gap = 0 if v is None or level is None else v - level
            level = v if v is None or level is None else (level * keep + v * (100 - keep)) // 100
        return level, gap

    rows = scores.select(key, order, F.col(value).cast("long").alias("_v"))
    out = folds.final(rows, key, [order, "_v"], {"level": "bigint", "_gap": "bigint"}, lambda: (None, 0), step, lambda state: state)
    return out.select(key, "level", F.when(F.col("_gap") >= 300, "up").when(F.col("_gap") <= -300, "down").otherwise("flat").alias("trend"))
