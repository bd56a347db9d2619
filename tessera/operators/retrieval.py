"""Ranking: lexical and vector candidates, fusion, bounding, de-duplication, expansion, budgets. Every ranking has explicit ranks and a total order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trigrams
from tessera.functions.vectors import cosine
from tessera.operators.lineage import if_small, met_by_key, met_in_blocks, written

if TYPE_CHECKING:
    from tessera.sources.lexical import LexicalIndex
    from tessera.sources.vectors import VectorIndex

K1, B = 1.2, 0.75


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def top(df: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark drops the others before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def tokens(text: Column) -> Column:
    """The runs of letters, numbers and _ of a text, in lower case; cut at what stands between them, which is faster than a match for each."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def _saturated(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _scored_blocks(pairs: DataFrame, asked: DataFrame, postings: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """query_id, group, block, place, score: the k best chunks of each query in each block that pairs (query_id, group, block) name (ties: the lower place). asked: query_id, terms (numbers, as in weights).
    A block is one task's work, with arrays of its postings."""
    kind = pairs.schema["query_id"].dataType.simpleString()
    pairs = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # columns of its own, as both sides come from the postings

    def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts, size, out = {}, 1 + max((int(p[-1]) for p in found["places"]), default=0), []
        for term, idf, mean, places, tfs, lengths in zip(*(found[c] for c in ("term", "idf", "mean", "places", "tfs", "lengths"))):
            tf = tfs.astype(np.float64)
            value = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths.astype(np.float64) / mean))
            parts[term] = places, np.floor(value * 1_000_000 + 0.5).astype(np.int64)
        for query, group, block, terms in zip(*(asked[c] for c in ("query_id", "group", "block", "terms"))):
            total, met = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
            for places, value in (parts[t] for t in terms if t in parts):
                total[places] += value
                met[places] = True
            places = np.flatnonzero(met)
            places = places[np.lexsort((places, -total[places]))[:k]]
            out += [(query, group, block, int(p), int(total[p])) for p in places]
        return pd.DataFrame(out, columns=["query_id", "group", "block", "place", "score"])

    blocks = if_small(written(pairs.select("group", "block").distinct()))
    right = postings.join(blocks, ["group", "block"], "left_semi").join(weights, "term").select("block", F.col("number").alias("term"), "idf", "mean", "places", "tfs", "lengths")
    return pairs.join(if_small(asked), "query_id").groupBy("block").cogroup(right.groupBy("block")).applyInPandas(best, f"query_id {kind}, group int, block int, place int, score long")


def bm25(queries: DataFrame, index: LexicalIndex, k: int, seeds: int = 2) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks of a stored index with the highest BM25 score (millionths; ties: chunk_id) for each query (query_id, text); exact.

    Document frequencies and lengths cover the whole index. From the greatest frequency and the smallest length of each term in each block comes a bound of what a chunk there can score. Each query's
    most promising `seeds` blocks are scored first; the k-th score there is a lower bound of the query's k-th, and only blocks that can reach it are scored too. Scores are sums of whole
    millionths, so the order of sums doesn't matter.
    """
    asked = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    terms = written(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    met = index.postings.join(if_small(terms.select("term")), "term", "left_semi")
    corpus = index.chunks.agg(F.count("*").alias("_n"), F.avg("length").alias("mean"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = if_small(written(met.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(corpus), F.lit(True)).join(terms, "term").select("term", "number", idf.alias("idf"), "mean")))
    numbered = written(asked.join(if_small(terms), "term").groupBy("query_id").agg(F.collect_list("number").alias("terms")))
    bound = F.ceil(_saturated(F.col("idf"), F.col("most"), F.col("least"), F.col("mean")) * 1_000_000).cast("long") + 1
    bounds = met.select("group", "block", "term", "most", "least").join(weights, "term").select("group", "block", "term", bound.alias("bound"))
    able = written(if_small(asked).join(bounds, "term").groupBy("query_id", "group", "block").agg(F.sum("bound").alias("bound")))
    ordered = able.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
    first = written(_scored_blocks(written(ordered.filter(F.col("_r") <= seeds).drop("_r", "bound")), numbered, met, weights, k))
    kth = top(first, ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    later = ordered.filter(F.col("_r") > seeds).join(if_small(written(kth)), "query_id", "left").filter(F.col("bound") >= F.coalesce("_least", F.lit(0)))
    hits = first.unionByName(_scored_blocks(written(later.drop("_r", "_least", "bound")), numbered, met, weights, k))
    tied = written(hits.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_r") <= k))
    named = index.chunks.select("group", "block", "place", "chunk_id").join(if_small(tied), ["group", "block", "place"])
    return top(named.select("query_id", "chunk_id", "score"), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2000, bucket: int = 50_000) -> DataFrame:
    """query_id, vec_id, score, rank: the k most similar vectors (vec_id, embedding) for each query (query_id, embedding), by exact cosine in millionths.

    The stated queries go against all rows, by met_in_blocks(). Each task keeps k rows a query before the shuffle.
    """
    pairs = met_in_blocks(queries.withColumnRenamed("embedding", "_q"), vectors, block, bucket)
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("_q"), F.col("embedding")) * 1_000_000).cast("long").alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def cells_in_reach(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """query_id, embedding, group, cell, bound (millionths) for each query and each cell: no vector of the cell has a greater cosine than that, as angles obey the triangle inequality."""
    centres = index.centres
    kind = queries.schema["query_id"].dataType.simpleString()
    radii = written(index.cells.select("group", "cell", "radius"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unit_rows(np.stack(batch["embedding"].to_numpy())) if len(batch) else np.zeros((0, centres.shape[1]))
            cells = batch["cell"].to_numpy()
            angle = np.arccos(np.clip((x * centres[np.maximum(cells, 0)]).sum(axis=1) if len(centres) else np.zeros(len(x)), -1, 1))
            able = np.cos(np.maximum(0.0, angle - batch["radius"].to_numpy() - 1e-7))
            able = np.where((cells < 0) | ~(x != 0).any(axis=1), 0.0, able)
            yield batch[["query_id", "embedding", "group", "cell"]].assign(bound=np.ceil(able * 1_000_000).astype(np.int64) + 1)

    pairs = met_in_blocks(queries.select("query_id", "embedding"), radii)
    return pairs.mapInPandas(bounds, f"query_id {kind}, embedding array<double>, group int, cell int, bound long")


def _scored_cells(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best vectors of each query (query_id, embedding, cell) in each cell (ties: the smaller id). A cell is one task's work; a matrix product finds what may be
    among the k best, which is scored again number by number."""
    kind, of = pairs.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    pairs = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])

    def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(found):
            found = found.sort_values("vec_id", kind="stable")
            v, ids = np.stack(found["embedding"].to_numpy()).astype(np.float64), found["vec_id"].to_numpy()
            q = np.stack(asked["embedding"].to_numpy()).astype(np.float64)
            length = lambda x: np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])
            lq, lv, rough = length(q), length(v), unit_rows(q) @ unit_rows(v).T
            for n, query in enumerate(asked["query_id"]):
                at = np.arange(len(v)) if len(v) <= k else np.flatnonzero(rough[n] >= np.partition(rough[n], -k)[-k] - 3e-6)
                both = lq[n] * lv[at]
                cosine = np.divide(np.add.accumulate(q[n] * v[at], axis=1)[:, -1], both, out=np.zeros(len(at)), where=both > 0) * 1_000_000
                score = (np.sign(cosine) * np.floor(np.abs(cosine) + 0.5)).astype(np.int64)
                order = np.lexsort((at, -score))[:k]
                out += [(query, ids[i], s) for i, s in zip(at[order], score[order].tolist())]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    wanted = if_small(written(pairs.select("group", "cell").distinct()))
    right = vectors.join(wanted, ["group", "cell"], "left_semi").select("cell", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return pairs.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(best, f"query_id {kind}, vec_id {of}, score long")


def nearest_in(queries: DataFrame, index: VectorIndex, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """query_id, vec_id, score, rank: the k vectors of a stored index with the highest cosine (millionths; ties: the smaller id) for each query (query_id, embedding), exactly; and query_id, cells, read: how many
    cells there are and were read for it.

    Each query reads its `probes` most promising cells first; the k-th score there is a lower bound, and only cells that can reach it are read too. Queries have the index's length; those without vector find nothing.
    """
    asked = queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = written(cells_in_reach(asked, index).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))))
    first = written(_scored_cells(cells.filter(F.col("_r") <= probes), index.vectors, k))
    kth = written(top(first, ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least")))
    marked = cells.join(if_small(kth), "query_id", "left").withColumn("_read", (F.col("_r") <= probes) | F.coalesce(F.col("bound") >= F.col("_least"), F.lit(True)))
    later = written(marked.filter(f"_read and _r > {probes}").drop("_least", "_read"))
    hits = top(first.unionByName(_scored_cells(later, index.vectors, k)), ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return hits, marked.groupBy("query_id").agg(F.count("*").alias("cells"), F.count_if("_read").alias("read"))


def reciprocal_rank_fusion(hits: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """query_id, item, score, channels, first_channel, rank: hits (query_id, channel, rank, item) fused by summed weight / (k + rank).

    Negative weights count as 0, missing ones as 1. An item that a channel lists twice counts twice. Ties go to the item seen first, in the order of
    (channel, rank). Scores are in billionths, so that sums don't depend on their order.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(max(0.0, float(w)))).otherwise(weight)
    share = F.round(weight / (k + F.col("rank")) * 1_000_000_000).cast("long")
    fused = hits.withColumn("_s", share).groupBy("query_id", "item").agg(
        F.sum("_s").alias("score"), F.countDistinct("channel").alias("channels"), F.min(F.struct("channel", "rank")).alias("_first")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "item")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "item", "score", "channels", F.col("_first.channel").alias("first_channel"), "rank")


def interleave(hits: DataFrame, by: str, group: str, score: str, position: str) -> DataFrame:
    """hits with turn and place: round-robin over groups, each in falling score, groups in the order of their first position."""
    within = Window.partitionBy(by, group).orderBy(F.desc(score), position)
    marked = hits.withColumn("turn", F.row_number().over(within)).withColumn("_g", F.min(position).over(Window.partitionBy(by, group)))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("turn", "_g", position))).drop("_g")


def bound_candidates(hits: DataFrame, most: int) -> DataFrame:
    """The first `most` hits (query_id, channel, rank) of each query, taking channels in turn."""
    return top(hits, ["query_id"], [F.col("rank"), F.col("channel")], most, "place")


def greedy_distinct(ranked: DataFrame, by: str, rank: str, content: str, item: str, threshold: float = 0.9) -> DataFrame:
    """by, item, rank of the rows kept when each, in rank order, is dropped if the Jaccard similarity of its character 3-grams with any kept one reaches the
    threshold (texts below three characters are alike). Whether a row stays depends on those kept, so each ranking - a bounded list of candidates -
    is folded in the JVM."""
    listed = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("id"), trigrams(F.col(content)).alias("g")))).alias("_l"))

    def alike(a: Column, b: Column) -> Column:
        both = F.size(a) + F.size(b)  # common / (both - common) >= threshold, with the common ones counted once
        return F.when(both == 0, True).otherwise(F.size(F.array_intersect(a, b)) * (1 + threshold) >= both * threshold)

    none = F.filter("_l", lambda x: F.lit(False))
    kept = F.aggregate("_l", none, lambda a, x: F.when(F.exists(a, lambda y: alike(x["g"], y["g"])), a).otherwise(F.array_append(a, x)))
    return listed.select(by, F.explode(kept).alias("_x")).select(by, F.col("_x.id").alias(item), F.col("_x.r").alias(rank))


def expand_neighbours(anchors: DataFrame, index: LexicalIndex, window: int, fade: float = 0.95) -> DataFrame:
    """query_id, chunk_id, score, nearest: indexed chunks within `window` of an anchor (query_id, chunk_id, doc_id, chunk_index, score) that are not anchors themselves, with `fade` times the score
    of the closest anchor (ties: the higher score). The range becomes an equality join, which reads the groups of the asked chunks only."""
    reach = anchors.select(
        "query_id", "doc_id", F.col("chunk_id").alias("nearest"), F.col("chunk_index").alias("_at"), F.col("score").alias("_s"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")
    )
    where = written(index.located(reach.filter("chunk_index >= 0")))
    found = index.chunks_at(where).select("group", "block", "doc_id", "chunk_index", "chunk_id").join(if_small(where), ["group", "block", "doc_id", "chunk_index"])
    met = found.join(anchors.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    best = top(met, ["query_id", "chunk_id"], [F.abs(F.col("chunk_index") - F.col("_at")), F.desc("_s"), F.col("nearest")], 1, "_r")
    return best.select("query_id", "chunk_id", F.floor(F.col("_s") * fade).cast("long").alias("score"), "nearest")


def fallback_sources(queries: DataFrame, chunks: DataFrame, k: int = 16, full: int = 1200) -> DataFrame:
    """query_id, chunk_id, score (ten-thousandths), rank: what is found where no index answers: for each query (query_id, text, kb) the chunks (chunk_id, chunk_index, kb, content) of its base by how
    many of its terms they hold, plus their share of `full` characters up to one; ties: the lower index, then the id. All chunks of the base are looked at; each task keeps k rows a query."""
    from tessera.functions.text import fallback_terms

    lowered = chunks.select("kb", "chunk_id", "chunk_index", F.lower("content").alias("_c"), F.least(F.lit(1.0), F.char_length("content") / full).alias("_s"))  # once a chunk, not once a term of each query
    met = met_by_key(queries.select("query_id", "kb", fallback_terms(F.col("text")).alias("_t")), lowered, "kb")
    held = F.size(F.filter("_t", lambda t: F.contains(F.col("_c"), t)))
    scored = met.select("query_id", "chunk_id", "chunk_index", F.round((held + F.col("_s")) * 10_000).cast("long").alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.col("chunk_index"), F.col("chunk_id")], k).select("query_id", "chunk_id", "score", "rank")


def available(hits: DataFrame, states: DataFrame) -> DataFrame:
    """Hits (chunk_id, hash) whose id is available in states (chunk_id, hash, enabled, deleted), or else whose hash is that of an available row.

    A null `enabled` counts as enabled. Two equality joins; an OR join would compare all pairs.
    """
    free = states.filter((F.col("deleted") == 0) & (F.coalesce("enabled", F.lit(1)) != 0))
    by_id = free.select("chunk_id").distinct().withColumn("_i", F.lit(True))
    by_hash = free.select("hash").distinct().withColumn("_h", F.lit(True))
    return hits.join(by_id, "chunk_id", "left").join(by_hash, "hash", "left").filter(F.coalesce("_i", "_h", F.lit(False))).drop("_i", "_h")


def select_context(hits: DataFrame, by: str, item: str, group: str, score: str, cost: str, least: float, budget: int, most: int, quota: int = 0) -> DataFrame:
    """by, item, score, rank: the best rows that fit. Rows below `least` go; the others are taken in falling score (ties: item), skipping those that would pass the
    budget, until there are `most`. With a quota, groups below it get their best rows left over, each in place of the lowest row of a group above it (groups in
    order); without one to replace, they are added. Acceptance depends on what was accepted, so each bounded candidate list is folded in the JVM."""
    entry = F.struct((-F.col(score)).alias("s"), F.col(item).alias("id"), F.col(cost).cast("long").alias("c"), F.col(group).alias("g"))
    lists = hits.filter(F.col(score) >= least).groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.filter("_l", lambda x: F.lit(False)).alias("out"))

    def take(a: Column, x: Column) -> Column:
        fits = (F.size(a["out"]) < most) & (a["used"] + x["c"] <= budget)
        return F.when(fits, F.struct((a["used"] + x["c"]).alias("used"), F.array_append(a["out"], x).alias("out"))).otherwise(a)

    picked = F.aggregate("_l", start, take, lambda a: a["out"])
    out = lists.withColumn("_out", picked)
    if quota > 0:
        groups = F.array_sort(F.array_distinct(F.transform("_l", lambda x: x["g"])))

        def count(a: Column, g: Column) -> Column:
            return F.size(F.filter(a, lambda x: x["g"] == g))

        def fill(a: Column, g: Column) -> Column:
            """One row of group g in, and the lowest row of a group above the quota out."""
            more = F.filter(F.col("_l"), lambda x: (x["g"] == g) & ~F.exists(a, lambda y: y["id"] == x["id"]))
            victims = F.filter(a, lambda x: F.size(F.filter(a, lambda y: y["g"] == x["g"])) > quota)
            victim = F.array_max(victims)
            swapped = F.array_append(F.when(F.size(victims) > 0, F.filter(a, lambda x: x["id"] != victim["id"])).otherwise(a), F.get(more, F.lit(0)))
            return F.when((count(a, g) < quota) & (F.size(more) > 0), swapped).otherwise(a)

        rounds = F.flatten(F.transform(groups, lambda g: F.array_repeat(g, quota)))
        out = out.withColumn("_out", F.when(F.size(groups) > 1, F.array_sort(F.aggregate(rounds, F.col("_out"), fill))).otherwise(F.col("_out")))
    return out.select(by, F.posexplode("_out").alias("_p", "_x")).select(by, F.col("_x.id").alias(item), (-F.col("_x.s")).alias(score), (F.col("_p") + 1).alias("rank"))


def weighted_fusion(left: DataFrame, right: DataFrame, key: list[str], w_left: int, w_right: int) -> DataFrame:
    """key, score: w_left * left.score + w_right * right.score, a side without the key counting 0."""
    both = left.select(*key, F.col("score").alias("_a")).join(right.select(*key, F.col("score").alias("_b")), key, "full_outer")
    return both.select(*key, (F.coalesce("_a", F.lit(0)) * w_left + F.coalesce("_b", F.lit(0)) * w_right).alias("score"))


def cached_answers(probes: DataFrame, cache: DataFrame, threshold: float, ttl: int) -> DataFrame:
    """probe_id, entry_id, score (millionths): for each probe (probe_id, scope, at, embedding) the most similar entry of its scope (entry_id, scope, at, embedding) that is at
    most ttl old and reaches the threshold; ties: the older entry. A ttl of 0 finds nothing."""
    met = met_by_key(probes.select("probe_id", "scope", F.col("at").alias("_now"), F.col("embedding").alias("_q")), cache, "scope")
    fresh = met.filter((F.lit(ttl) > 0) & (F.col("_now") - F.col("at") <= ttl) & (F.col("_now") >= F.col("at")))
    scored = fresh.select("probe_id", "entry_id", "at", F.round(cosine(F.col("_q"), F.col("embedding")) * 1_000_000).cast("long").alias("score")).filter(F.col("score") >= int(threshold * 1_000_000))
    return top(scored, ["probe_id"], [F.desc("score"), F.col("at"), F.col("entry_id")], 1).select("probe_id", "entry_id", "score")
