"""Writers of generations: vectors, manifests and graph projections, and the pointer that makes a generation visible."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class WrongDimension(ValueError):
    """Vectors whose length isn't the table's."""


class IncompleteGeneration(ValueError):
    """A written generation without rows, or with other than the expected number."""


def checked_vectors(vectors: DataFrame, embedding: str, dimension: int) -> DataFrame:
    """The vectors, failing the job that writes them at the first one of another length, or with a null in it."""
    v = F.col(embedding)
    good = F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull()), F.lit(False))
    return vectors.withColumn(embedding, F.when(good, v).otherwise(F.raise_error(F.lit(f"a vector hasn't {dimension} numbers")).cast(vectors.schema[embedding].dataType)))


def write_generation(rows: DataFrame, folder: str, generation: str, by: str = "kb") -> int:
    """Write one generation, partitioned by knowledge base, and return its number of rows as read back. Writing it again replaces it."""
    path = f"{folder}/generation={generation}"
    rows.write.mode("overwrite").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def promote(spark: SparkSession, folder: str, generation: str, expected: int) -> None:
    """Make a generation the visible one, if it holds the expected rows and any at all. Readers follow the pointer of the highest version, a folder of its own that appears whole, so they
    see either the old or the new one. Of two writers that find the same version, the second one's write is refused, as its folder exists."""
    found = spark.read.parquet(f"{folder}/generation={generation}").count()
    if found != expected or not found:
        raise IncompleteGeneration(f"generation {generation} has {found} rows of {expected}")
    newest = _pointer(spark, folder)
    version = newest["version"] + 1 if newest else 1
    spark.createDataFrame([(generation,)], "generation string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/pointer/version={version}")


def _pointer(spark: SparkSession, folder: str) -> Row | None:
    """generation and version of the newest pointer, or None before the first."""
    try:
        pointers = spark.read.schema("generation string, version long").parquet(f"{folder}/pointer")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return pointers.orderBy(F.desc("version")).first()


def visible(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the visible generation."""
    newest = _pointer(spark, folder)
    if newest is None:
        raise IncompleteGeneration(f"{folder} has no visible generation")
    return spark.read.parquet(f"{folder}/generation={newest['generation']}")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows but for the listed keys: what a deletion writes as the next generation."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
