"""Two evaluations of the same questions: pairing, agreement, and intervals by resampling pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import probs as P

KEY = ["sample_id", "qid"]


def last_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the last in ``order``."""
    o = F.struct(*order)
    return df.groupBy(*key).agg(F.max_by(F.struct(*(c for c in df.columns if c not in key)), o).alias("_x")).select(*key, "_x.*")


def paired(a: DataFrame, b: DataFrame, order: list, key: list[str] = KEY) -> DataFrame:
    """Each row of ``b`` with the last row of ``a`` for its key; columns of ``a`` with suffix ``_a``, of ``b`` with ``_b``."""
    one = last_per_key(a, key, order)
    named = lambda d, s: d.select(*key, *(F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in key))
    return named(one, "a").join(named(b, "b"), key)


def occurrences(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """``df`` with ``occurrence``, the number of its row among those of its key."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def match_bags(a: DataFrame, b: DataFrame, key: list[str], order: list) -> DataFrame:
    """(matched, only_a, only_b): the n-th row of a key with the n-th row of it on the other side."""
    ka, kb = (occurrences(d, key, order).groupBy(*key).agg(F.max("occurrence").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    j = ka.join(kb, key, "full_outer").fillna(0, ["na", "nb"])
    return j.agg(F.coalesce(F.sum(F.least("na", "nb")), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.greatest(F.col("na") - F.col("nb"), F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(F.col("nb") - F.col("na"), F.lit(0))), F.lit(0)).alias("only_b"))


def differences(a: DataFrame, b: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(key..., problem) where the two are not the same bag: repeated, missing on a side, or different."""
    sides = []
    for d, s in ((a, "a"), (b, "b")):
        sides.append(d.groupBy(*key).agg(F.count("*").alias(f"_n{s}"), *(F.first(F.col(c).cast("string") if isinstance(c, str) else c).alias(f"_{c}_{s}") for c in compared)))
    j = sides[0].join(sides[1], key, "full_outer")
    problem = F.when(F.col("_na").isNull(), "missing in a").when(F.col("_nb").isNull(), "missing in b").when((F.col("_na") > 1) | (F.col("_nb") > 1), "repeated")
    for c in compared:
        problem = problem.when(~F.col(f"_{c}_a").eqNullSafe(F.col(f"_{c}_b")), f"{c} differs")
    return j.select(*key, problem.alias("problem")).where("problem is not null")


def head_to_head(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., both, only_a, only_b, neither) of right answers."""
    a, b = F.col("correct_a"), F.col("correct_b")
    return pairs.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def transitions(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., n, changed, wrong_to_right, right_to_wrong) from a to b."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("prediction_a") != F.col("prediction_b")).alias("changed"), F.count_if(~F.col("correct_a") & F.col("correct_b")).alias("wrong_to_right"), F.count_if(F.col("correct_a") & ~F.col("correct_b")).alias("right_to_wrong"))


def gain_change(records: DataFrame, run: str, runs: tuple[str, str], unit: list[str], by: list[str], control: str = "control", wrong: str = "mismatched", right: str = "correct") -> DataFrame:
    """(by..., n, gain_change): how much more the second run gains from the true picture than the first one does.

    Per unit (the columns ``unit``) four means are joined: each run with the true and with a wrong picture;
    units that lack one of the four are left out, n is the number of the others.
    """
    ok = F.col(right).cast("double")
    c = records.groupBy(run, *unit).agg((F.avg(F.when(F.col(control).isNull(), ok)) - F.avg(F.when(F.col(control) == wrong, ok))).alias("gain")).where("gain is not null")
    side = lambda r, s: c.where(F.col(run) == r).select(*unit, F.col("gain").alias(s))
    return side(runs[0], "x").join(side(runs[1], "y"), unit).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("x")).alias("gain_change"))


def order_sensitivity(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., n, flip_rate, mean_change, max_change) between two orders of the same options."""
    change = F.transform("probabilities_a", lambda e: F.abs(e["p"] - P.p_of(F.col("probabilities_b"), e["key"])))
    mean = F.aggregate(change, F.lit(0.0), lambda s, x: s + x) / F.size(change)
    return pairs.where(F.size("probabilities_a") > 0).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("prediction_a") != F.col("prediction_b")).cast("double")).alias("flip_rate"), F.avg(mean).alias("mean_change"), F.max(F.array_max(change)).alias("max_change"))


def blended(gold: Column, teacher: Column, weight: float) -> Column:
    """(1 - w) gold + w teacher over gold's keys."""
    return F.transform(gold, lambda e: F.struct(e["key"].alias("key"), (e["p"] * (1 - weight) + P.p_of(teacher, e["key"]) * weight).alias("p")))


def with_teacher(rows: DataFrame, teacher: DataFrame, key: list[str], order: list, probs: str = "probabilities", out: str = "teacher", missing: str = "refuse") -> DataFrame:
    """``rows`` with the last teacher's distribution of their key in ``out``. A row without one is refused, or with ``missing="keep"`` stays with null."""
    t = last_per_key(teacher, key, order).select(*key, F.col(probs).alias(out))
    j = rows.join(t, key, "left")
    if missing == "refuse":
        lacking = j.where(F.col(out).isNull()).select(*key).limit(20).collect()
        if lacking:
            raise ValueError("rows without a teacher: " + ", ".join("/".join(map(str, r)) for r in lacking))
    return j


def mirrored(original: DataFrame, copy: DataFrame, prefix: str, key: str, extra: list[str]) -> DataFrame:
    """Originals with their mirrored copies, whose key is ``prefix`` and the original's key."""
    c = copy.where(F.col(key).startswith(prefix)).select(F.substring(F.col(key), F.lit(len(prefix) + 1), F.lit(1 << 30)).alias(key), *extra, *(F.col(x).alias(f"{x}_m") for x in copy.columns if x != key and x not in extra))
    return original.join(c, [key, *extra])


def cluster_sums(df: DataFrame, cluster: str, features: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """(by..., cluster, feature sums): all that a resampling over clusters needs."""
    return df.groupBy(*by, cluster).agg(*(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(n) for n, c in features.items()))


def bootstrap_ratio(sums: DataFrame, top: str, bottom: str, cluster: str, by: list[str] = (), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by..., estimate, low, high, n_clusters): sum(top) / sum(bottom) with the 2.5 % and 97.5 % order statistics.

    Poisson resampling: each cluster's weight in replicate r is drawn from a generator keyed by the
    seed and the cluster, so that replicates are the same however rows are partitioned and clusters
    need not be gathered. A partition adds its clusters' weighted sums up to one vector per group; what
    is shuffled is ``resamples`` numbers per group and partition. Undefined replicates are dropped.
    """
    group = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by)) if by else F.lit("")
    slim = sums.select(group.alias("_g"), F.xxhash64(F.coalesce(F.col(cluster).cast("string"), F.lit(""))).alias("_h"), top, bottom)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for g, h, t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), h & (2**64 - 1)])).poisson(1.0, resamples)
                a = kept.setdefault(g, np.zeros((resamples, 2)))
                a[:, 0] += w * t
                a[:, 1] += w * b
        for g, a in kept.items():
            yield pa.RecordBatch.from_pydict({"_g": [g] * resamples, "_r": list(range(resamples)), "_t": a[:, 0], "_b": a[:, 1]})

    parts = slim.mapInArrow(add, "_g string, _r bigint, _t double, _b double")
    values = parts.groupBy("_g", "_r").agg(F.try_divide(F.sum("_t"), F.sum("_b")).alias("v")).where("v is not null")
    lows = values.groupBy("_g").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most ``resamples`` numbers
    at = lambda q: F.get("vs", F.least(F.size("vs") - 1, F.floor(F.size("vs") * q).cast("int")))
    base = sums.withColumn("_g", group).groupBy("_g", *by).agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("estimate"), F.count("*").alias("n_clusters"))
    return base.join(lows, "_g", "left").select(*by, "estimate", at(0.025).alias("low"), at(0.975).alias("high"), "n_clusters")
