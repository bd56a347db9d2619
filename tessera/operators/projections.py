"""What follows from a document's change in everything that is derived from it: versions, chunks, index channels and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_versions(versions: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """key, next: one more than the highest version (key, version) of each of the keys, 1 for those without any."""
    highest = versions.groupBy(key).agg(F.max("version").alias("_v"))
    return keys.select(key).distinct().join(highest, key, "left").select(key, (F.coalesce("_v", F.lit(0)) + 1).alias("next"))


def retired(chunks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (doc_id, deleted) with the live ones of docs (doc_id) marked deleted, and how many that are: doc_id, n for each of docs."""
    doomed = docs.select("doc_id").distinct().withColumn("_d", F.lit(True))
    met = chunks.join(doomed, "doc_id", "left")
    marked = met.withColumn("deleted", F.when(F.col("_d"), 1).otherwise(F.col("deleted"))).drop("_d")
    n = met.filter("_d").groupBy("doc_id").agg(F.count_if(F.col("deleted") == 0).alias("n"))
    return marked, doomed.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def deleted_everywhere(channels: dict[str, DataFrame], doomed: DataFrame, failed: tuple[str, ...] = (), retry_minutes: int = 1) -> tuple[dict[str, DataFrame], DataFrame]:
    """The channels (chunk_id and more) without the doomed chunks (doc_id, chunk_id), and doc_id, channel, asked, removed, status, job, retry_minutes for each document and channel.

    Channels that could not be reached keep theirs and are FAILED; a document with a failed channel has a job to RETRY in so many minutes, others are DONE. One anti-join a channel.
    """
    gone = doomed.select("chunk_id").distinct()
    left = {name: rows if name in failed else rows.join(gone, "chunk_id", "left_anti") for name, rows in channels.items()}
    asked = doomed.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("asked"))
    report = None
    for name, rows in sorted(channels.items()):
        held = doomed.distinct().join(rows.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("_n"))
        bad = name in failed
        one = asked.join(held, "doc_id", "left").select(
            "doc_id", F.lit(name).alias("channel"), "asked", (F.lit(0).cast("long") if bad else F.coalesce("_n", F.lit(0))).alias("removed"), F.lit("FAILED" if bad else "DELETED").alias("status")
        )
        report = one if report is None else report.unionByName(one)
    job = F.lit("RETRY" if set(failed) & set(channels) else "DONE")
    wait = F.when(job == "RETRY", F.lit(retry_minutes)).otherwise(F.lit(0))
    return left, report.withColumn("job", job).withColumn("retry_minutes", wait)


def replaced_relations(stored: DataFrame, incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, src, dst, type, origin, confidence, chunk_id: the stored relations of a graph after the semantic ones of docs (doc_id) are replaced by the incoming ones (doc_id, src, dst, type,
    confidence, chunk_id). Relations of other origins, and those of other documents, survive. Of incoming ones with equal ends and type the surest stays (ties: the smaller chunk_id)."""
    columns = ["doc_id", "src", "dst", "type", "origin", "confidence", "chunk_id"]
    stale = docs.select("doc_id").distinct().withColumn("origin", F.lit("semantic"))
    rest = stored.join(stale, ["doc_id", "origin"], "left_anti").select(*columns)
    best = incoming.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "src", "dst", "type").agg(F.min_by(F.struct("confidence", "chunk_id"), F.struct((-F.col("confidence")).alias("c"), "chunk_id")).alias("_b"))
    return rest.unionByName(best.select("doc_id", "src", "dst", "type", F.lit("semantic").alias("origin"), F.col("_b.confidence").alias("confidence"), F.col("_b.chunk_id").alias("chunk_id")))


def switched(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """chunks (chunk_id, enabled) with enabled as wanted (chunk_id, enabled); a chunk wanted twice is enabled if either says so."""
    state = wanted.groupBy("chunk_id").agg(F.max("enabled").alias("_e"))
    return chunks.join(state, "chunk_id", "left").withColumn("enabled", F.coalesce("_e", "enabled")).drop("_e")


def without_documents(mentions: DataFrame, edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions (doc_id, name) and edges (doc_id, src, dst) of a graph without those of docs (doc_id), and without edges to names that nothing mentions any more."""
    kept = mentions.join(docs, "doc_id", "left_anti")
    names = kept.select("name").distinct()
    ends = lambda c: names.withColumnRenamed("name", c)
    return kept, edges.join(docs, "doc_id", "left_anti").join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select(*edges.columns)


def cases_in_scope(cases: DataFrame, base: str | None) -> DataFrame:
    """Cases (bases: array) that are bound to no base, or to `base` alone; all of them without a base, or for *."""
    if not base or base == "*":
        return cases
    bases = F.coalesce("bases", F.array().cast("array<string>"))
    return cases.filter(F.size(F.array_except(bases, F.array(F.lit(base)))) == 0)


def may_reuse(early_collection: Column, collection: Column, early_query: Column, query: Column) -> Column:
    """Whether results that were fetched early still hold: their corpus and query are the final ones."""
    return early_collection.eqNullSafe(collection) & early_query.eqNullSafe(query)


def graph_limit(wanted: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(200), wanted))


def pipeline_faults(nodes: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """pipeline, node, fault of nodes (pipeline, node, type, next): duplicate (a repeated node), type (an unknown one), target (a next node that isn't there), cycle (a node that leads back to
    itself). A repeated node leads to all its next ones. Nodes that nothing leads to, and those that lead nowhere, are taken off round by round, each written; what is left is small, and where it leads is followed by doubling."""
    from tessera.operators.lineage import written

    twice = nodes.groupBy("pipeline", "node").count().filter("count > 1").select("pipeline", "node", F.lit("duplicate").alias("fault"))
    odd = nodes.filter(~F.col("type").isin(*known)).select("pipeline", "node", F.lit("type").alias("fault"))
    there = nodes.select("pipeline", F.col("node").alias("next")).distinct()
    lost = nodes.filter("next is not null").join(there, ["pipeline", "next"], "left_anti").select("pipeline", "node", F.lit("target").alias("fault"))
    edges = written(nodes.filter("next is not null").select("pipeline", F.col("node").alias("a"), F.col("next").alias("b")).distinct())
    n, before = edges.count(), -1
    while n and n != before:
        ends = lambda c, name: edges.select("pipeline", F.col(c).alias(name)).distinct()  # noqa: E731, B023
        edges = written(edges.join(ends("b", "a"), ["pipeline", "a"], "left_semi").join(ends("a", "b"), ["pipeline", "b"], "left_semi"))
        n, before = edges.count(), n
    reach, n, before = edges, n, -1
    while n and n != before:
        further = reach.join(reach.select("pipeline", F.col("a").alias("b"), F.col("b").alias("_c")), ["pipeline", "b"]).select("pipeline", "a", F.col("_c").alias("b"))
        reach = written(reach.select("pipeline", "a", "b").unionByName(further).distinct())
        n, before = reach.count(), n
    cycles = reach.filter("a = b").select("pipeline", F.col("a").alias("node"), F.lit("cycle").alias("fault"))
    return twice.unionByName(odd).unionByName(lost).unionByName(cycles)
