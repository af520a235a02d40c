"""Join sides are measured in bytes; null keys are spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.plans import lineage


def test_small_sides_are_measured(spark):
    wide = spark.range(200).select("id", F.expr("repeat('x', 1000)").alias("t"), F.expr("array(repeat('y', 500))").alias("a"), F.expr("map('k', 1.0)").alias("m"), F.expr("array(named_struct('k', 'z', 'p', 1.0))").alias("s"))
    assert lineage.is_small(wide, 1_000_000) and not lineage.is_small(wide, 200_000) and not lineage.is_small(spark.range(10_000), 100_000)
    assert lineage.is_small(wide.limit(0)) and lineage.is_small(spark.createDataFrame([(None, None, None)], "a string, b array<string>, c map<string,double>"))


def test_left_lookup_spreads_null_keys(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 2 else f"k{i}") for i in range(50)], "i int, k string")
    side = spark.createDataFrame([(f"k{i}", i) for i in range(0, 30)], "k string, v int")
    want = sorted((i, i if i % 2 == 0 and i < 30 else -1) for i in range(50))
    for small in (True, False):
        monkeypatch.setattr(lineage, "is_small", lambda *_, small=small: small)
        got = lineage.left_lookup(df, side, "k")
        assert sorted(map(tuple, got.select("i", F.coalesce("v", F.lit(-1))).collect())) == want and got.columns.count("k") == 1
