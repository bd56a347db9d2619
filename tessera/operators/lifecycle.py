"""Life of index generations, evaluation cases and user profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def promotion(generations: DataFrame, built: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """generations (key, generation, status) after their builds were checked: a BUILDING one whose number of built rows (key, generation) is that expected (key, generation), and not
    zero, is ACTIVE and the active one before it RETIRED; otherwise it is FAILED and the active one stays."""
    count = lambda df, name: df.groupBy(key, "generation").agg(F.count("*").alias(name))
    checked = generations.join(count(built, "_b"), [key, "generation"], "left").join(count(expected, "_e"), [key, "generation"], "left")
    good = (F.col("status") == "BUILDING") & (F.coalesce("_b", F.lit(0)) == F.coalesce("_e", F.lit(0))) & (F.coalesce("_b", F.lit(0)) > 0)
    any_good = F.max(good.cast("int")).over(Window.partitionBy(key)) == 1
    status = F.when(good, "ACTIVE").when(F.col("status") == "BUILDING", "FAILED").when((F.col("status") == "ACTIVE") & any_good, "RETIRED").otherwise(F.col("status"))
    return checked.select(key, "generation", status.alias("status"))


def synced_feedback(cases: DataFrame, votes: DataFrame) -> DataFrame:
    """cases (case_id, active, status, expected, tags) with those of a vote of -1 (case_id, vote) closed for review: no expectations, tagged bad_case."""
    bad = F.coalesce(F.col("vote") == -1, F.lit(False))
    none = F.array().cast("array<string>")
    joined = cases.join(votes, "case_id", "left")
    tags = F.when(bad, F.array_union("tags", F.array(F.lit("bad_case")))).otherwise(F.filter("tags", lambda t: t != "bad_case"))
    return joined.select("case_id", F.when(bad, 0).otherwise(F.col("active")).alias("active"), F.when(bad, "needs_review").otherwise(F.col("status")).alias("status"), F.when(bad, none).otherwise(F.col("expected")).alias("expected"), tags.alias("tags"))


def filled_hashes(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, hashes: the hash of each expected chunk (case_id, expected, hashes) by its place, missing ones from chunks (chunk_id, hash); still missing ones are empty."""
    each = cases.select("case_id", F.posexplode_outer("expected").alias("p", "chunk_id"), "hashes")
    known = each.join(chunks.select("chunk_id", F.col("hash").alias("_h")), "chunk_id", "left")
    value = F.coalesce(F.when(F.get("hashes", F.col("p")) != "", F.get("hashes", F.col("p"))), F.col("_h"), F.lit(""))
    listed = known.filter("chunk_id is not null").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", value.alias("h")))), lambda x: x["h"]).alias("hashes"))
    return cases.select("case_id").join(listed, "case_id", "left").select("case_id", F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))


def hit_counts(mappings: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """mappings with hit_count raised by the number of times they were applied; a null count is 0."""
    more = applied.groupBy(key).agg(F.count("*").alias("_n"))
    return mappings.join(more, key, "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def base_cases(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """tenant, question, sources, golden, active: one case for each tenant and question, from existing ones and from newly asked (tenant, question, at, sources). Golden ones keep what they have;
    others get the latest sources, stay inactive and expect nothing."""
    latest = asked.groupBy("tenant", "question").agg(F.max_by("sources", "at").alias("_new"))
    both = existing.join(latest, ["tenant", "question"], "full_outer")
    golden = F.coalesce("golden", F.lit(False))
    return both.select("tenant", "question", F.when(golden, F.col("sources")).otherwise(F.coalesce("_new", "sources")).alias("sources"), golden.alias("golden"), (golden & F.coalesce("active", F.lit(False))).alias("active"))


def profiles(messages: DataFrame, votes: DataFrame, old: DataFrame) -> DataFrame:
    """user_id, questions, chars, top_intent, up, down, version from messages (user_id, role, intent, text), votes (user_id, vote) and the profiles before (user_id, version); users without a question get none."""
    asked = messages.filter("role = 'user'")
    style = asked.groupBy("user_id").agg(F.count("*").alias("questions"), F.sum(F.char_length("text")).alias("chars"))
    intents = asked.groupBy("user_id", "intent").agg(F.count("*").alias("_n")).groupBy("user_id").agg(F.min_by("intent", F.struct(-F.col("_n"), "intent")).alias("top_intent"))
    signals = votes.groupBy("user_id").agg(F.count_if(F.col("vote") == 1).alias("up"), F.count_if(F.col("vote") == -1).alias("down"))
    out = style.join(intents, "user_id").join(signals, "user_id", "left").join(old.select("user_id", "version"), "user_id", "left")
    zero: Column = F.lit(0)
    return out.select("user_id", "questions", "chars", "top_intent", F.coalesce("up", zero).cast("long").alias("up"), F.coalesce("down", zero).cast("long").alias("down"), (F.coalesce("version", zero) + 1).cast("long").alias("version"))
