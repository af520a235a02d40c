"""Temperatures by grid: every record is scored at every grid point on the fly, sums are what is kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import probs as P


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` log-spaced temperatures, rounded to 6 digits so that engines agree on them."""
    return [round(math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (n - 1)), 6) for i in range(n)]


def grid_nll(df: DataFrame, by: list[str], grid: list[float], gold: Column, probs: Column, floor: float = 1e-12) -> DataFrame:
    """(by..., t, loss, n): mean cross entropy per grid point.

    Every batch of records is scored at all grid points at once, linear in its options, and adds one
    vector of sums per group; only one row per group, grid point and partition is shuffled. Groups are
    few (buckets, kinds, folds).
    """
    g = F.filter(gold, lambda e: e["p"] > 0)
    at = F.transform(g, lambda e: F.coalesce(F.size(probs) - F.array_position(F.reverse(F.transform(probs, lambda x: x["key"])), e["key"]).cast("int"), F.lit(-1)))
    d = F.coalesce(P.log_terms(probs, floor), F.array().cast("array<double>"))
    slim = df.select(*(F.col(c).alias(f"_g{j}") for j, c in enumerate(by)), d.alias("_terms"), F.coalesce(F.transform(g, lambda e: e["p"]), F.array().cast("array<double>")).alias("_mass"), F.coalesce(F.transform(at, lambda i: F.when(i >= F.size(probs), -1).otherwise(i)), F.array().cast("array<int>")).alias("_place"))
    points, low = np.array(grid), -math.log(floor)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            if not len(batch):
                continue
            keys, lists = batch.columns[:-3], batch.columns[-3:]
            types = [c.type for c in keys]
            names = list(zip(*(c.to_pylist() for c in keys))) if keys else [()] * len(batch)
            (k, d), (m, p), (_, i) = map(_flat, lists)
            start = np.concatenate(([0], np.cumsum(k)))[:-1]
            owner = np.repeat(np.arange(len(k)), k)
            row = np.repeat(np.arange(len(m)), m)
            own = np.where(i < 0, 0.0, d[np.minimum(start[row] + np.maximum(i, 0), max(0, len(d) - 1))] if len(d) else 0.0)
            index = {n: j for j, n in enumerate(dict.fromkeys(names))}
            of = np.array([index[n] for n in names])
            part = np.zeros((len(index), len(points) + 1))
            np.add.at(part[:, -1], of, 1.0)
            for j, t in enumerate(points):
                norm = np.log(np.bincount(owner, np.exp(d / t), len(k)).clip(min=1e-300))
                each = p * np.where(i < 0, low, np.minimum(low, norm[row] - own / t))
                np.add.at(part[:, j], of, np.bincount(row, each, len(m)))
            for n, j in index.items():
                sums[n] = sums[n] + part[j] if n in sums else part[j]
        for n, v in sums.items():
            columns = [pa.array([x] * len(points), t) for x, t in zip(n, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(points), pa.array(v[:-1]), pa.array(np.full(len(points), v[-1], np.int64))], [*(f"_g{j}" for j in range(len(by))), "t", "s", "n"])

    given = [f"_g{j} {df.schema[c].dataType.simpleString()}" for j, c in enumerate(by)]
    parts = slim.mapInArrow(score, ", ".join([*given, "t double", "s double", "n bigint"])).select(*(F.col(f"_g{j}").alias(c) for j, c in enumerate(by)), "t", "s", "n")
    return parts.groupBy(*by, "t").agg((F.sum("s") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of lists."""
    return np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def fit(df: DataFrame, by: list[str], grid: list[float], gold: Column, probs: Column, least: int = 50) -> DataFrame:
    """(by..., n, temperature, loss, loss_at_1): best grid point per group, rounded losses, the smaller
    temperature of equals; groups of fewer than ``least`` rows keep 1."""
    g = grid_nll(df, by, sorted({*grid, 1.0}), gold, probs)
    r = F.round("loss", 9)
    best = g.groupBy(*by).agg(F.max("n").alias("n"), F.min_by("t", F.struct(r, F.col("t"))).alias("_t"), F.min(r).alias("_l"), F.max(F.when(F.col("t") == 1.0, r)).alias("loss_at_1"))
    enough = F.col("n") >= least
    return best.select(*by, "n", F.when(enough, F.col("_t")).otherwise(1.0).alias("temperature"), F.when(enough, F.col("_l")).otherwise(F.col("loss_at_1")).alias("loss"), "loss_at_1")


def with_temperature(df: DataFrame, bucket: str, kind: str, by_bucket: DataFrame, by_kind: DataFrame) -> DataFrame:
    """``df`` with ``temperature``: that of its bucket, else of its kind, else 1. The two are tables of a
    few rows, one per bucket and kind."""
    b = by_bucket.select(F.col(bucket), F.col("temperature").alias("_b"))
    k = by_kind.select(F.col(kind), F.col("temperature").alias("_k"))
    return df.join(b, bucket, "left").join(k, kind, "left").withColumn("temperature", F.coalesce("_b", "_k", F.lit(1.0))).drop("_b", "_k")


def decision(pooled_low: Column, pooled_high: Column, domain_low: Column, domain_high: Column) -> Column:
    """Which way two intervals point: gain, harm, mixed or none."""
    return F.when((pooled_low > 0) & (domain_low >= 0), "gain").when((pooled_high < 0) & (domain_high <= 0), "harm").when((pooled_low > 0) | (pooled_high < 0) | (domain_low > 0) | (domain_high < 0), "mixed").otherwise("none")


def out_of_fold(df: DataFrame, fold: str, bucket: str, grid: list[float], gold: Column, probs: Column, least: int = 50) -> DataFrame:
    """``df`` with ``temperature``, the best of its bucket over the rows of the other folds; 1 where those are
    fewer than ``least``. The folds of a row's family must be one: take a hash of the family."""
    folds = [r[0] for r in df.select(fold).distinct().limit(101).collect()]
    if len(folds) > 100:
        raise ValueError("more than 100 folds")
    others = df.withColumn("_other", F.explode(F.array(*(F.lit(f) for f in folds)))).where(F.col("_other") != F.col(fold)) if len(folds) > 1 else df.withColumn("_other", F.lit(None).cast(df.schema[fold].dataType)).limit(0)
    t = fit(others, ["_other", bucket], grid, gold, probs, least).select(F.col("_other").alias(fold), bucket, F.col("temperature").alias("_t"))
    return df.join(t, [fold, bucket], "left").withColumn("temperature", F.coalesce("_t", F.lit(1.0))).drop("_t")
