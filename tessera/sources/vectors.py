"""The stored vector index: vectors in cells around fitted centres, with each cell's radius, so that a search reads the cells that can hold a hit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import if_small, written
from tessera.operators.retrieval import unit_rows
from tessera.sources import grouped, sinks

#: Vectors of a cell on average, cells of a group (the unit that an update writes anew), and the most vectors that centres are fitted on.
CELL_VECTORS, GROUP_CELLS, SAMPLE = 1000, 32, 20_000
#: The cell of vectors without length, which have no angles and the cosine 0 with all.
NO_ANGLE = -1


@dataclass(frozen=True)
class VectorIndex:
    """vectors: group, cell, vec_id, embedding and others; cells: group, cell, n, radius (the greatest angle of one of its vectors to the centre); centres: one row for each cell."""

    folder: str
    dimension: int
    vectors: DataFrame
    cells: DataFrame
    centres: np.ndarray


def fitted(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of unit length by some rounds of spherical k-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    x = unit_rows(sample)
    x = x[(x != 0).any(axis=1)]
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds if len(centres) > 1 else 0):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        moved = unit_rows(sums)
        centres = np.where((moved != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with cell, angle (to its centre) and group."""

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for e in batches:
            if not len(e):
                yield pd.DataFrame({"cell": [], "angle": []}).astype({"cell": "int32", "angle": "float64"})
                continue
            x = unit_rows(np.stack(e.to_numpy()))
            cosines = x @ centres.T if len(centres) else np.zeros((len(x), 1))
            best = cosines.argmax(axis=1)
            some = (x != 0).any(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(x)), best], -1, 1))
            yield pd.DataFrame({"cell": np.where(some, best, NO_ANGLE).astype(np.int32), "angle": np.where(some, angle, 0.0)})

    found = vectors.withColumn("_c", F.pandas_udf(nearest, "cell int, angle double")("embedding"))
    return found.select(*vectors.columns, "_c.cell", "_c.angle").withColumn("group", F.floor(F.col("cell") / GROUP_CELLS).cast("int"))


def _write(assigned: DataFrame, folder: str, version: int) -> list[grouped.Part]:
    parts = grouped.write(assigned, folder, "vectors", version, "cell", "vec_id")
    stored = assigned.sparkSession.read.schema(assigned.schema).parquet(f"{folder}/vectors/version={version}")
    return parts + grouped.write(stored.groupBy("group", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), folder, "cells", version, "cell")


def opened(spark: SparkSession, folder: str) -> VectorIndex:
    """The index that the folder's manifest names. Centres (one row for each cell) come to the driver."""
    parts = grouped.manifest(spark, folder)
    centres = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    read = lambda table, empty: grouped.read(spark, folder, parts, table, empty)
    vectors = read("vectors", "vec_id long, embedding array<float>, cell int, angle double, group int")
    return VectorIndex(folder, parts[0]["size"], vectors, read("cells", "cell int, n long, radius double, group int"), np.array([r["centre"] for r in centres]).reshape(len(centres), parts[0]["size"]))


def built(vectors: DataFrame, folder: str, cell_vectors: int = CELL_VECTORS, sample: int = SAMPLE) -> VectorIndex:
    """Write an index of vectors (vec_id, embedding, others kept), all of one length without nulls (else the job fails); rows without vector or id are left out.

    Centres are fitted on the `sample` vectors with the smallest hashes of their ids, at most; every vector is then put into the cell of its nearest centre."""
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and embedding is not null")
    first = rows.select(F.size("embedding").alias("d")).head()
    dimension = first["d"] if first else 0
    rows = written(sinks.checked_vectors(rows, "embedding", dimension))
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    centres = fitted(np.array([r["embedding"] for r in few]).reshape(len(few), dimension), max(1, -(-rows.count() // cell_vectors))) if few else np.zeros((0, dimension))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    grouped.publish(spark, folder, dimension, 0, _write(_assigned(rows, centres), folder, 0))
    return opened(spark, folder)


def updated(index: VectorIndex, gone: DataFrame, new: DataFrame) -> VectorIndex:
    """The index without the vectors of gone (vec_id) and with those of new (in place of those with their ids), written as the next version: only the groups of cells that change are read and written.
    Centres stay; radii are those of what lies in the cells."""
    spark, folder = index.vectors.sparkSession, index.folder
    parts = grouped.manifest(spark, folder)
    version = max(r["version"] for r in parts) + 1
    leaving = written(gone.select("vec_id").unionByName(new.select("vec_id")).distinct())
    coming = written(_assigned(sinks.checked_vectors(new.filter("vec_id is not null and embedding is not null"), "embedding", index.dimension), index.centres))
    hit = index.vectors.select("group", "vec_id").join(if_small(leaving), "vec_id", "left_semi").select("group").unionByName(coming.select("group"))
    touched = {r["group"] for r in hit.distinct().collect()}
    if not touched:
        return index
    stay = index.vectors.filter(F.col("group").isin(*touched)).join(if_small(leaving), "vec_id", "left_anti")
    kept = [(r["kind"], r["group"], r["version"]) for r in parts if r["group"] not in touched and r["kind"] != "none"]
    grouped.publish(spark, folder, index.dimension, version, kept + _write(written(stay.unionByName(coming, allowMissingColumns=True)), folder, version))
    return opened(spark, folder)
