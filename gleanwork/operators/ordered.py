"""Running totals over a whole table in hash order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a key that make its bucket: 4,096 buckets per group.
DIGITS = 3


def hash_key(salt: str, *columns: str) -> Column:
    """A hex string that orders rows by chance, the same in every run and engine: md5 of salt and columns."""
    return F.md5(F.concat_ws("|", F.lit(salt), *(F.col(c).cast("string") for c in columns)))


def unit(key: Column) -> Column:
    """The first 32 bits of a hex key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def running_total(df: DataFrame, key: str, weight: Column, by: list[str] = (), out: str = "before", tie: list[str] = ()) -> DataFrame:
    """``df`` with ``out``: the weight of the rows of its group that come before in the order of the hex ``key``.

    Rows are bucketed by the key's first digits; bucket totals are a few thousand rows per group, and
    only rows of one bucket are ordered together, so a group of any size is spread over many tasks.
    """
    d = df.withColumn("_bucket", F.substring(key, 1, DIGITS)).withColumn("_w", weight)
    sums = d.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_bucket_sum"))
    start = sums.withColumn("_start", F.sum("_bucket_sum").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_bucket_sum")).drop("_bucket_sum")
    same = F.lit(True)
    renamed = start.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_bucket").alias("_k_bucket"), "_start")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = d.join(renamed, same & (F.col("_bucket") == F.col("_k_bucket")))
    inside = F.sum("_w").over(Window.partitionBy(*by, "_bucket").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    return joined.withColumn(out, F.col("_start") + inside).drop("_bucket", "_w", "_start", "_k_bucket", *(f"_k_{c}" for c in by))


def next_in_circle(df: DataFrame, key: str, value: str, by: list[str] = (), out: str = "next") -> DataFrame:
    """``df`` with the ``value`` of the row that follows in key order, the last one followed by the first.

    ``df`` must hold each value once per group. A group of one row is followed by itself.
    """
    d = df.withColumn("_bucket", F.substring(key, 1, DIGITS))
    order = F.struct(F.col(key), F.col(value))
    firsts = d.groupBy(*by, "_bucket").agg(F.min_by(value, order).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    whole = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(w), F.first("_first").over(whole))).drop("_first")
    j = d.join(firsts, [*by, "_bucket"])
    return j.withColumn(out, F.coalesce(F.lead(value).over(Window.partitionBy(*by, "_bucket").orderBy(key, value)), F.col("_after"))).drop("_bucket", "_after")
