"""Expressions over distributions kept as ``array<struct<key, p>>``, whose order means something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, also where ``f`` uses it inside a lambda for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def p_of(dist: Column, key: Column, default: float = 0.0) -> Column:
    """The probability of ``key``; of repeated keys the last one."""
    return F.coalesce(F.try_element_at(F.filter(dist, lambda e: e["key"] == key), F.lit(-1))["p"], F.lit(default))


def argmax_key(dist: Column) -> Column:
    """The key of greatest probability; of equals the first in order; null of an empty distribution."""
    ps = F.transform(dist, lambda e: e["p"])
    return F.when(F.size(dist) > 0, F.get(dist, (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))["key"])


def total(dist: Column) -> Column:
    return F.aggregate(dist, F.lit(0.0), lambda s, e: s + e["p"])


def normalised(dist: Column) -> Column:
    """Probabilities over their sum; null where the sum is not above zero."""
    both = let(F.struct(dist.alias("d"), total(dist).alias("t")), lambda x: F.when(x["t"] > 0, F.transform(x["d"], lambda e: F.struct(e["key"].alias("key"), (e["p"] / x["t"]).alias("p")))))
    return both


def aligned(options: Column, gold: Column) -> Column:
    """The gold's probabilities in the order of the options, over their sum; null where nothing of the gold is offered."""
    raw = F.transform(options, lambda o: p_of(gold, o))
    return let(F.struct(raw.alias("r"), F.aggregate(raw, F.lit(0.0), lambda s, x: s + x).alias("t")), lambda x: F.when(x["t"] > 0, F.transform(x["r"], lambda v: v / x["t"])))


def nll(gold: Column, probs: Column, floor: float = 1e-12) -> Column:
    """Cross entropy against a soft gold: gold terms above zero only, probabilities floored."""
    return F.aggregate(gold, F.lit(0.0), lambda s, g: s - F.when(g["p"] > 0, g["p"] * F.log(F.greatest(p_of(probs, g["key"]), F.lit(floor)))).otherwise(0.0))


def brier(gold: Column, probs: Column) -> Column:
    """Squared differences summed over the gold's keys."""
    return F.aggregate(gold, F.lit(0.0), lambda s, g: s + F.pow(p_of(probs, g["key"]) - g["p"], F.lit(2.0)))


def log_terms(probs: Column, floor: float = 1e-12) -> Column:
    """log p of each entry, floored, less the greatest of them: all that a change of temperature needs."""
    return let(F.transform(probs, lambda e: F.log(F.greatest(e["p"], F.lit(floor)))), lambda z: let(F.struct(z.alias("z"), F.array_max(z).alias("m")), lambda x: F.transform(x["z"], lambda v: v - x["m"])))


def logits(probs: Column, temperature: Column | float = 1.0, floor: float = 1e-12) -> Column:
    """T log p per option as a map: the logits that gave these probabilities at temperature ``T``, up to a constant."""
    return F.transform(probs, lambda e: F.struct(e["key"].alias("key"), (F.log(F.greatest(e["p"], F.lit(floor))) * temperature).alias("z")))


def rescaled(probs: Column, temperature: Column | float, floor: float = 1e-12) -> Column:
    """softmax(log p / T), shifted by the greatest logit."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    e = F.transform(log_terms(probs, floor), lambda d: F.exp(d / t))
    share = let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("s")), lambda x: F.transform(x["e"], lambda v: v / x["s"]))
    return F.zip_with(probs, share, lambda d, x: F.struct(d["key"].alias("key"), x.alias("p")))


def nll_at(probs: Column, gold: Column, temperature: Column | float) -> Column:
    """Cross entropy at a temperature by log-sum-exp, without a floor on the rescaled probabilities; gold names without a probability are left out."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    z = F.transform(logits(probs), lambda e: F.struct(e["key"].alias("key"), (e["z"] / t).alias("z")))
    top = lambda x: F.array_max(F.transform(x, lambda e: e["z"]))
    norm = let(F.struct(z.alias("z"), top(z).alias("m")), lambda x: x["m"] + F.log(F.aggregate(x["z"], F.lit(0.0), lambda a, e: a + F.exp(e["z"] - x["m"]))))
    return let(F.struct(z.alias("z"), norm.alias("n")), lambda x: F.aggregate(F.filter(gold, lambda g: g["p"] > 0), F.lit(0.0), lambda a, g: a + g["p"] * F.coalesce(x["n"] - F.try_element_at(F.filter(x["z"], lambda e: e["key"] == g["key"]), F.lit(-1))["z"], F.lit(0.0))))


def averaged(df: DataFrame, by: list[str], probs: str) -> DataFrame:
    """(by..., n, probabilities): mean probability per option over the rows of a group, renormalised, options by name.

    For answers to one question with its options in several orders: options are matched by name.
    """
    each = df.select(*by, F.explode(probs).alias("_e")).groupBy(*by, F.col("_e.key").alias("_k")).agg(F.sum("_e.p").alias("_s"))
    rows = df.groupBy(*by).agg(F.count("*").alias("n"))
    whole = each.groupBy(*by).agg(F.sum("_s").alias("_t"), F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_l"))  # one entry per option of a question
    share = F.transform("_l", lambda x: F.struct(x["_k"].alias("key"), (x["_s"] / F.col("_t")).alias("p")))
    return rows.join(whole.where("_t > 0").select(*by, share.alias("probabilities")), by)


def smoothed(dist: Column, eps: float) -> Column:
    """(1 - eps) p + eps / k."""
    return F.transform(dist, lambda e: F.struct(e["key"].alias("key"), (e["p"] * (1 - eps) + F.lit(eps) / F.size(dist)).alias("p")))


def softened(dist: Column, eps: float) -> Column:
    """The argmax gets 1 - eps, the others share eps evenly."""
    top = argmax_key(dist)
    return F.transform(dist, lambda e: F.struct(e["key"].alias("key"), F.when(F.size(dist) == 1, F.lit(1.0)).when(e["key"] == top, F.lit(1 - eps)).otherwise(F.lit(eps) / (F.size(dist) - 1)).alias("p")))


def swapped(dist: Column, pairs: dict[str, str]) -> Column:
    """Mirror rewrite: the mass of each key goes to its partner, order kept."""
    other = {**pairs, **{v: k for k, v in pairs.items()}}

    def partner(k: Column) -> Column:
        out = k
        for a, b in other.items():
            out = F.when(k == a, F.lit(b)).otherwise(out)
        return out

    return F.transform(dist, lambda e: F.struct(e["key"].alias("key"), p_of(dist, partner(e["key"])).alias("p")))


def option_bucket(kind: Column, k: Column) -> Column:
    """Calibration bucket by type and number of options."""
    size = F.when(k <= 2, "2").when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+")
    return F.when(kind == "noul", F.lit("noul:2")).otherwise(F.concat(kind, F.lit(":"), size))


def confidence(p: Column, n: Column) -> Column:
    """(n p - 1) / (n - 1): 0 at chance, 1 when sure; null of fewer than two options."""
    return F.try_divide(n * p - 1, n - 1)


def kl(p: Column, q: Column, floor: float = 1e-12) -> Column:
    """KL(p || q) over p's keys."""
    return F.aggregate(p, F.lit(0.0), lambda s, e: s + F.when(e["p"] > 0, e["p"] * (F.log(e["p"]) - F.log(F.greatest(p_of(q, e["key"]), F.lit(floor))))).otherwise(0.0))
