"""Metrics of paired evaluations as functions of sums, and intervals of them by resampling clusters.

Each question adds a few numbers; a metric is a function of their sums, so that it can be worked out
for all questions, for a group, and for every replicate alike. An undefined ratio is null and a
replicate with one is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import probs as P

METRICS = ("accuracy", "recall", "fpr", "balanced", "nll")


def features(correct: str, prediction: str, gold_answer: str, gold: str, probabilities: str) -> dict[str, Column]:
    """What one answer adds: right answers and questions; right and all of gold ``true`` and ``false``; cross entropy."""
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    yes, no = F.col(gold_answer) == "true", F.col(gold_answer) == "false"
    return {
        "right": one(F.col(correct)), "all": F.lit(1.0), "tp": one(yes & (F.col(prediction) == "true")), "pos": one(yes),
        "fp": one(no & (F.col(prediction) == "true")), "neg": one(no), "loss": P.nll(F.col(gold), F.col(probabilities)),
    }


def value(metric: str, of) -> Column:
    """The metric from summed features; ``of(name)`` gives the column of a sum."""
    ratio = lambda a, b: F.try_divide(of(a), of(b))
    return {"accuracy": lambda: ratio("right", "all"), "recall": lambda: ratio("tp", "pos"), "fpr": lambda: ratio("fp", "neg"), "balanced": lambda: (ratio("tp", "pos") + 1 - ratio("fp", "neg")) / 2, "nll": lambda: ratio("loss", "all")}[metric]()


def paired_sums(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a_*, b_*): the summed features of both sides of ``pairs`` (columns with suffixes ``_a`` and ``_b``)."""
    names = ("correct", "prediction", "gold_answer", "gold", "probabilities")
    sums = [F.sum(c).alias(f"{s}_{n}") for s in "ab" for n, c in features(*(f"{x}_{s}" for x in names)).items()]
    return pairs.groupBy(*by).agg(*sums)


def metric_table(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, a, b, difference) from summed features, a row per metric."""
    side = lambda s: (lambda n: F.col(f"{s}_{n}"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), value(m, side("a")).alias("a"), value(m, side("b")).alias("b")) for m in METRICS)))
    return sums.select(*by, each.alias("_m")).select(*by, "_m.metric", "_m.a", "_m.b", (F.col("_m.b") - F.col("_m.a")).alias("difference"))


def macro_table(pairs: DataFrame, by: list[str], stratum: str) -> DataFrame:
    """(by..., metric, a, b, difference): the mean over strata (sources) of their accuracies."""
    each = paired_sums(pairs, [*by, stratum]).select(*by, (F.col("a_right") / F.col("a_all")).alias("_a"), (F.col("b_right") / F.col("b_all")).alias("_b"))
    out = each.groupBy(*by).agg(F.avg("_a").alias("a"), F.avg("_b").alias("b"))
    return out.select(*by, F.lit("macro").alias("metric"), "a", "b", (F.col("b") - F.col("a")).alias("difference"))


def replicates(sums: DataFrame, names: list[str], cluster: str, by: list[str] = (), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(by..., replicate, names...): the sums of ``names`` in each replicate.

    One set of weights serves all sums, so that values of one replicate belong together. A cluster's Poisson
    weights come from a generator keyed by the seed and the cluster; groups in ``by`` (strata with them) are resampled
    within themselves. A partition adds its clusters up to one table per group before anything is shuffled.
    """
    slim = sums.select(*(F.col(c).alias(f"_g{j}") for j, c in enumerate(by)), F.xxhash64(F.coalesce(F.col(cluster).cast("string"), F.lit(""))).alias("_h"), *(F.col(n).cast("double").alias(f"_s{j}") for j, n in enumerate(names)))
    width = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.columns[: -1 - width]
            types = [c.type for c in keys]
            groups = list(zip(*(c.to_pylist() for c in keys))) if keys else [()] * len(batch)
            x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-width:]]).astype(float))
            for g, h, row in zip(groups, batch.column(len(keys)).to_pylist(), x):
                w = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), h & (2**64 - 1)])).poisson(1.0, resamples)
                if g not in kept:
                    kept[g] = np.zeros((resamples, width))
                kept[g] += w[:, None] * row
        for g, a in kept.items():
            columns = [pa.array([v] * resamples, t) for v, t in zip(g, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(resamples)), *(pa.array(a[:, j].copy()) for j in range(width))], [*(f"_g{j}" for j in range(len(by))), "_r", *(f"_s{j}" for j in range(width))])

    given = [f"_g{j} {sums.schema[c].dataType.simpleString()}" for j, c in enumerate(by)]
    parts = slim.mapInArrow(add, ", ".join([*given, "_r bigint", *(f"_s{j} double" for j in range(width))]))
    named = parts.select(*(F.col(f"_g{j}").alias(c) for j, c in enumerate(by)), F.col("_r").alias("replicate"), *(F.col(f"_s{j}").alias(n) for j, n in enumerate(names)))
    return named.groupBy(*by, "replicate").agg(*(F.sum(n).alias(n) for n in names))


def bounds(values: DataFrame, of: str, by: list[str], rule: str = "order") -> DataFrame:
    """(by..., low, high, kept) of the replicates' values, nulls dropped.

    Three rules: ``order`` takes entries ``floor(.025 n)`` and ``min(n - 1, floor(.975 n))`` of the sorted values, ``inner``
    the upper one before, ``floor(.975 n) - 1``, ``linear`` interpolates between neighbours. A group has as many values as replicates.
    """
    v = values.where(F.col(of).isNotNull() & ~F.isnan(of)).groupBy(*by).agg(F.sort_array(F.collect_list(of)).alias("_v"), F.count("*").alias("kept"))
    if rule == "linear":
        at = lambda q: F.get("_v", F.floor((F.col("kept") - 1) * q).cast("int")) * (1 - (F.col("kept") - 1) * q + F.floor((F.col("kept") - 1) * q)) + F.get("_v", F.ceil((F.col("kept") - 1) * q).cast("int")) * ((F.col("kept") - 1) * q - F.floor((F.col("kept") - 1) * q))
        return v.select(*by, at(0.025).alias("low"), at(0.975).alias("high"), "kept")
    last = {"order": F.least(F.col("kept") - 1, F.floor(F.col("kept") * 0.975)), "inner": F.greatest(F.lit(0), F.floor(F.col("kept") * 0.975) - 1)}[rule]
    return v.select(*by, F.get("_v", F.floor(F.col("kept") * 0.025).cast("int")).alias("low"), F.get("_v", last.cast("int")).alias("high"), "kept")


def paired_metric(pairs: DataFrame, cluster: str, by: list[str] = (), stratum: str | None = None, resamples: int = 2000, seed: int = 0, rule: str = "order") -> DataFrame:
    """(by..., metric, a, b, difference, low, high, kept): every metric of both sides, and the interval of the difference.

    With ``stratum`` clusters are resampled within the strata and the macro accuracy, the mean over strata, is given too.
    """
    by, strata = list(by), [stratum] if stratum else []
    group = [*by, *strata]
    sums = paired_sums(pairs, [*group, cluster])
    names = [c for c in sums.columns if c.startswith(("a_", "b_"))]
    r = replicates(sums, names, cluster, group, resamples, seed)
    whole = [F.sum(n).alias(n) for n in names]
    drawn = metric_table(r.groupBy(*by, "replicate").agg(*whole), [*by, "replicate"])
    fixed = metric_table(sums.groupBy(*by).agg(*whole), by)
    if stratum:
        share = lambda s: F.avg(F.try_divide(f"{s}_right", f"{s}_all"))
        macro = r.groupBy(*by, "replicate").agg((share("b") - share("a")).alias("difference")).select(*by, "replicate", F.lit("macro").alias("metric"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "difference")
        drawn, fixed = drawn.unionByName(macro), fixed.unionByName(macro_table(pairs, by, stratum))
    return fixed.join(bounds(drawn, "difference", [*by, "metric"], rule), [*by, "metric"], "left")


def difference_in_differences(df: DataFrame, cells: tuple[Column, Column, Column, Column], cluster: str, by: list[str] = (), resamples: int = 2000, seed: int = 0, rule: str = "order") -> DataFrame:
    """(by..., estimate, low, high, kept) of (mean c4 - mean c3) - (mean c2 - mean c1), each over the rows where it is not null."""
    by = list(by)
    parts = [(F.sum(c.cast("double")).alias(f"s{i}"), F.count(c).alias(f"n{i}")) for i, c in enumerate(cells)]
    sums = df.groupBy(*by, cluster).agg(*(x for p in parts for x in p)).fillna(0.0)
    names = [f"{k}{i}" for i in range(4) for k in "sn"]
    did = lambda: (F.try_divide("s3", "n3") - F.try_divide("s2", "n2")) - (F.try_divide("s1", "n1") - F.try_divide("s0", "n0"))
    whole = sums.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names)).select(*by, did().alias("estimate"))
    drawn = replicates(sums, names, cluster, by, resamples, seed).withColumn("v", did())
    low_high = bounds(drawn, "v", by, rule)
    return whole.join(low_high, by, "left") if by else whole.join(low_high)
