"""Generations: written, checked, swapped."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks


def test_generations_swap_whole(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "kb string, chunk_id int")
    assert sinks.write_generation(rows, folder, "g1") == 3
    sinks.promote(spark, folder, "g1", 3)
    sinks.write_generation(sinks.without(rows, spark.createDataFrame([(2,)], "chunk_id int"), "chunk_id"), folder, "g2")
    assert sinks.visible(spark, folder).count() == 3
    with pytest.raises(sinks.IncompleteGeneration):
        sinks.promote(spark, folder, "g2", 3)
    sinks.promote(spark, folder, "g2", 2)
    assert sorted(r["chunk_id"] for r in sinks.visible(spark, folder).collect()) == [1, 3]
    plan = sinks.visible(spark, folder).filter("kb = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kb" in plan


def test_vectors_of_another_length_fail(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "id int, e array<float>")
    assert sinks.checked_vectors(good, "e", 2).count() == 1
    with pytest.raises(Exception, match="2 numbers"):
        sinks.checked_vectors(good.union(spark.createDataFrame([(2, [1.0])], "id int, e array<float>")), "e", 2).collect()
