"""Tables whose rows lie in groups, written in versions: a manifest names the version of each group, so an update writes the groups that it changes and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.operators.lineage import short_shuffles
from tessera.sources import sinks

Part = tuple[str, int, int]  # table, group, version


def write(rows: DataFrame, folder: str, table: str, version: int, *order: str, dealt: bool = False) -> list[Part]:
    """Writes rows (group, others) as a version of a table, sorted, a group from few tasks; a part for each group that has rows. dealt: the rows are partitioned by ranges that begin with the group."""
    path = f"{folder}/{table}/version={version}"
    with short_shuffles(rows.sparkSession):
        ranged = rows if dealt else rows.repartitionByRange("group", *order)
        ranged.sortWithinPartitions("group", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("group").parquet(path)
    return [(table, r["group"], version) for r in rows.sparkSession.read.schema(rows.schema).parquet(path).select("group").distinct().collect()]  # a row for each group


def publish(spark: SparkSession, folder: str, size: int, version: int, parts: list[Part]) -> None:
    """Makes the parts the visible ones. `size` is what the groups were made of (blocks, cells), kept for later updates. One writer at a time."""
    rows = spark.createDataFrame([(*p, size) for p in parts] or [("none", -1, version, size)], "kind string, group int, version int, size int").coalesce(1)
    sinks.promote(spark, f"{folder}/manifest", str(version), sinks.write_generation(rows, f"{folder}/manifest", str(version), "kind"))


def manifest(spark: SparkSession, folder: str) -> list[Row]:
    """kind, group, version, size of every visible part."""
    return sinks.visible(spark, f"{folder}/manifest").collect()  # a row for each group and table


def read(spark: SparkSession, folder: str, parts: list[Row], table: str, empty: str) -> DataFrame:
    """The visible rows of a table. Versions are never changed once they are written, so a reader keeps what it has opened while an update goes on."""
    paths = [f"{folder}/{table}/version={r['version']}/group={r['group']}" for r in parts if r["kind"] == table]
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*paths).drop("version") if paths else spark.createDataFrame([], empty)
