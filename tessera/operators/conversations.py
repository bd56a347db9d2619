"""Conversations: answers to questions, budgets of history, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def following(df: DataFrame, key: str, order: str, asks: str, answers: str, role: str = "role") -> DataFrame:
    """Rows of role `asks` with answer_at, the `order` of the first row of role `answers` at or after them in their key (a forward as-of join).

    One window over the key in order: no join, no comparison of pairs.
    """
    later = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("answer_at", F.first(F.when(F.col(role) == answers, F.col(order)), ignorenulls=True).over(later)).filter(F.col(role) == asks)


def preceding(df: DataFrame, key: str, order: str, of: str, sought: str, role: str = "role") -> DataFrame:
    """Rows of role `of` with question_at, the `order` of the last row of role `sought` at or before them in their key (a backward as-of join)."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("question_at", F.last(F.when(F.col(role) == sought, F.col(order)), ignorenulls=True).over(earlier)).filter(F.col(role) == of)


def within_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """The newest rows of each key whose costs fit the budget; the first that doesn't fit ends it."""
    newest = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(newest)).filter(F.col("spent") <= budget)


def recent_turns(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The last k rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_n") <= k).drop("_n")


def summaries(df: DataFrame, key: str, order: str, role: str, text: str, more_than: int, keep: int, most_each: int, most: int) -> DataFrame:
    """key, summary of the keys with over `more_than` rows: all but the last `keep` as `role: text`, texts cut to most_each characters, the last `most`
    characters of all. A key's rows are gathered in one array; a conversation is bounded by its own length."""
    w = Window.partitionBy(key)
    numbered = df.withColumn("_back", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_n", F.count("*").over(w))
    lines = numbered.filter((F.col("_n") > more_than) & (F.col("_back") > keep)).select(
        key, F.struct(F.col(order).alias("o"), F.concat(F.col(role), F.lit(": "), F.substring(text, 1, most_each)).alias("line")).alias("_x")
    )
    joined = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["line"]), "\n").alias("summary"))
    return joined.withColumn("summary", F.substring("summary", -most, most))
