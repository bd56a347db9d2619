"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, small_or_not, stored, tabled

#: Fast pseudo-rotations: rounds of random signs and a Hadamard transform.
ROUNDS = 3
#: Rows of vectors or queries that one cell of the search holds at most, on average; larger buckets are split into a grid of cells.
CELL_ROWS = 20_000
#: Cells of small indexes, so that their work is spread. More cells than an index needs cost rows, as each gives k for a query.
LEAST_CELLS = 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; their length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


@cache
def signs(seed: int, table: int, function: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, table, function, size]).choice([-1.0, 1.0], (ROUNDS, size))


def on_sphere(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Unit rows of a power of two of coordinates: each vector over the greatest length, with a coordinate more that fills it up to 1 and zeros behind it. Between a unit query, whose coordinate
    more is 0, and these rows, angles order as inner products with the vectors do."""
    n, d = vectors.shape
    out = np.zeros((n, 1 << int(d).bit_length()))
    out[:, :d] = vectors / longest
    out[:, d] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, :d] ** 2).sum(axis=1)))
    return out


def axis_losses(unit: np.ndarray, table: int, function: int, bits: int, seed: int) -> np.ndarray:
    """For each row, by how much each of 2**bits signed axes is further from the rotated row than the nearest one (0 for that). With fewer bits than the space has, the first axes only."""
    rotated = unit
    for flips in signs(seed, table, function, unit.shape[1]):
        rotated = hadamard(rotated * flips)
    axes = rotated[:, : 1 << (bits - 1)]
    both = np.concatenate([axes, -axes], axis=1)
    return both.max(axis=1, keepdims=True) - both


def buckets(unit: np.ndarray, table: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """The nearest `probes` buckets of each row in a table, best first (fewer, if it has fewer): 2**bits buckets, made of as many hash functions as the bits need."""
    most = int(unit.shape[1]).bit_length()  # 2 * size signed axes
    codes, losses = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
    for function, start in enumerate(range(0, bits, most)):
        here = min(most, bits - start)
        own = axis_losses(unit, table, function, here, seed)
        best = np.argsort(own, axis=1, kind="stable")[:, :probes]
        sums = (losses[:, :, None] + np.take_along_axis(own, best, axis=1)[:, None, :]).reshape(len(unit), -1)
        joined = ((codes << here)[:, :, None] + best[:, None, :]).reshape(len(unit), -1)
        first = np.argsort(sums, axis=1, kind="stable")[:, :probes]
        losses, codes = np.take_along_axis(sums, first, axis=1), np.take_along_axis(joined, first, axis=1)
    return codes


def _coded(rows: DataFrame, tables: int, probes: int, seed: int, of_query: bool) -> DataFrame:
    """rows (v, size, longest, bits, others) once for each table (of a query: and probe), with code (long): length of vector, table and bucket in one number."""

    def hashed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for v, size, longest, bits in batches:
            out: list[list[int]] = [[]] * len(v)
            for (d, m, b), part in pd.DataFrame({"d": size, "m": longest, "b": bits}).groupby(["d", "m", "b"]):
                at = part.index.to_numpy()
                x = np.stack(v.iloc[at].to_numpy()).astype(np.float64)
                unit = on_sphere(x / np.linalg.norm(x, axis=1, keepdims=True), 1.0) if of_query else on_sphere(x, m)
                codes = [((int(d) * tables + t) << 40) + buckets(unit, t, int(b), probes if of_query else 1, seed) for t in range(tables)] if b else [np.full((len(at), 1), -int(d))]
                for i, row in zip(at, np.concatenate(codes, axis=1).tolist()):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return rows.withColumn("code", F.explode(F.pandas_udf(hashed, "array<long>")("v", "size", "longest", "bits"))).drop("longest", "bits")


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """key, vec_id, score: for each query of a cell (key, v, codes) the k nearest ids among the cell's vectors (v, ids, code) of its codes.

    A matrix product in blocks finds what may be among the k nearest; that is scored again number by number from the first to the last, so equal vectors get equal scores."""
    rows = vectors.sort_values("first", kind="stable").reset_index(drop=True)
    asked = queries["codes"].explode().astype("int64")
    asked = asked.groupby(asked).groups  # code: rows of queries
    found = []
    for code, mine in rows.groupby("code"):
        if code not in asked:
            continue
        who = asked[code].to_numpy()
        v = np.stack(mine["v"].to_numpy()).astype(np.float64)
        longest = np.sqrt((v * v).sum(axis=1).max())
        step = max(1, 4_000_000 // len(v))
        for at in range(0, len(who), step):
            part = who[at : at + step]
            q = np.stack(queries["v"].loc[part].to_numpy()).astype(np.float64)
            rough = q @ v.T
            margin = 1e-9 * longest * np.sqrt((q * q).sum(axis=1))
            least = np.partition(rough, -k, axis=1)[:, -k] - margin if len(v) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(rough >= least[:, None])
            exact = np.concatenate([np.add.accumulate(q[i[s : s + 65536]] * v[j[s : s + 65536]], axis=1)[:, -1] for s in range(0, len(i), 65536)])
            order = np.lexsort((j, -exact, i))  # j: by smallest id
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            few = place < k
            found.append(pd.DataFrame({"key": queries["key"].to_numpy()[part[i[few]]], "ids": mine["ids"].to_numpy()[j[few]], "score": exact[few]}))
    if not found:
        return pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype({"key": "int64", "vec_id": "int64", "score": "float64"})
    every = pd.concat(found).explode("ids").rename(columns={"ids": "vec_id"}).astype({"vec_id": "int64"}).drop_duplicates()
    every = every.sort_values(["key", "score", "vec_id"], ascending=[True, False, True])
    return every[every.groupby("key").cumcount() < k][["key", "vec_id", "score"]]


def _searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """key, vec_id, score: at least the k nearest of each query (key, v, size, code) among all vectors (key, v, size, first, ids, code) that share a code with it.

    Codes are dealt to cells of about CELL_ROWS rows. A code with more vectors or queries than that is split on both sides into a grid: every part of its vectors meets every part of its queries.
    """
    spark = index.sparkSession
    sizes = index.groupBy("code").agg(F.count("*").alias("_i")).join(queries.groupBy("code").agg(F.count("*").alias("_q")), "code")
    parts = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int").alias(n)
    grids = small_or_not(stored(sizes.select("code", parts("_i"), parts("_q")).filter("_i > 1 or _q > 1")))
    cells = max(LEAST_CELLS, -(-index.count() // CELL_ROWS))
    part = lambda n: F.pmod(F.xxhash64("v", F.lit("part")), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    cell = F.when(F.col("_i").isNull(), F.pmod(F.xxhash64("code"), F.lit(cells))).otherwise(F.xxhash64("code", "_pi", "_pq")).alias("cell")  # a split code's cells have names of their own
    left = index.join(grids, "code", "left").withColumn("_pi", part(F.col("_i"))).withColumn("_pq", every(F.col("_q"))).select(cell, "v", "first", "ids", "code")
    right = queries.join(grids, "code", "left").withColumn("_pq", part(F.col("_q"))).withColumn("_pi", every(F.col("_i"))).select(cell, "key", "v", "code")
    right = right.groupBy("cell", "key").agg(F.first("v").alias("v"), F.collect_list("code").alias("codes"))  # at most the tables' probes of one query
    met = right.groupBy("cell").cogroup(left.groupBy("cell"))
    with small_batches(spark):
        return tabled(met.applyInPandas(lambda q, v: _best(q, v, k), "key long, vec_id long, score double"))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 20, tables: int = 8, probes: int = 20, bucket_rows: int = 256, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query (query_id, embedding) the k rows of vectors (vec_id, embedding) with the largest inner product that the tables find, nearest first
    (ties: the smaller vec_id); rows with vec_id = query_id are no candidates. All candidates, if there are no more than k.

    Every vector is put on the unit sphere (see on_sphere) and, in each table, into the bucket of the nearest signed axes after a fast pseudo-rotation. There are so many buckets that one
    holds `bucket_rows` or fewer distinct vectors on average, so a query, which looks into its `probes` best buckets of each table, meets about as many rows whatever the size of the index; up to
    bucket_rows vectors are one bucket and the search is exact. Queries that find fewer than k rows, though there are more, are searched again among all vectors, in blocks, exactly.
    Candidates are scored in double precision, from the first number to the last.

    Equal vectors are one: of their rows only the k + 1 with the smallest ids can be among any query's k nearest, so no group of copies is met pair by pair; equal queries are searched once. Rows
    without id, and vectors that are null, empty, zero or hold a null or non-finite number, take no part, neither as queries; vectors of another length than a query's are no candidates for it.
    Equal rows count once; rows with one id and several vectors are candidates each, and a query each. Empty tables give no rows; other columns are ignored.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    able = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    sound = lambda df, name: df.filter(F.col(name).isNotNull() & able).select(F.col(name).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v")).withColumn("hash", F.xxhash64("v"))
    asked, rows = tabled(sound(queries, "query_id").distinct()), tabled(sound(vectors, "vec_id").distinct())
    smallest = Window.partitionBy("hash", "v").orderBy("id")
    firsts = rows.withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= k + 1)
    nodes = tabled(firsts.groupBy("hash", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("first"), F.size("v").alias("size")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(bucket_rows)))).cast("int")
    spaces = stored(nodes.groupBy("size").agg(F.sqrt(F.max(squares)).alias("longest"), bits.alias("bits")))  # a row for each length of vectors
    total = stored(rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("total")))
    one = asked.select("hash", "v").distinct().withColumn("size", F.size("v")).join(small_or_not(spaces), "size")
    searched = tabled(one.withColumn("key", F.monotonically_increasing_id()))  # numbers that hold once they are written
    index = tabled(_coded(nodes.join(small_or_not(spaces), "size"), tables, 1, seed, False))
    found = _lists(_searched(index, _coded(searched, tables, probes, seed, True), k + 1), k + 1)
    lists = tabled(searched.select("key", "hash", "v", "size").join(found, "key", "left"))
    short = tabled(lists.join(small_or_not(total), "size").filter(F.coalesce(F.size("best"), F.lit(0)) < F.least(F.lit(k + 1), F.col("total"))).select("key", "v", "size"))
    if short.limit(1).count():
        whole = lambda df: df.withColumn("code", -F.col("size").cast("long"))
        again = tabled(_lists(_searched(whole(nodes), whole(short), k + 1), k + 1))
        lists = lists.join(again.withColumnRenamed("best", "_all"), "key", "left").withColumn("best", F.coalesce("_all", "best")).drop("_all")
    others = asked.join(lists.select("hash", "v", "best"), ["hash", "v"]).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("_b"))
    return others.select("query_id", F.posexplode("_b").alias("_at", "_x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


def _lists(found: DataFrame, k: int) -> DataFrame:
    """key, best: the k best (vec_id, score) of each query, in order, of what the cells found."""
    first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    few = found.distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    return few.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("best"))
