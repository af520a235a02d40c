"""Naive Bayes over word features, and debiasing by its cross-fitted score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.balance import first_by_cell
from gleanwork.operators.metrics import quantiles
from gleanwork.operators.ordered import hash_key
from gleanwork.plans.lineage import cut


def fold(key: str, n: int = 2):
    """A fold by the last hex digit of a hash of ``key``."""
    return F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 64, 1), 16, 10).cast("int"), F.lit(n))


def weights(features: DataFrame, label: str, by: list[str] = (), least: int = 3) -> DataFrame:
    """(by..., f, w): log ratio of the smoothed rates of each feature under true and false labels.

    ``features`` has (by..., label, f), a feature once per row. Features of fewer than ``least`` rows are left out.
    """
    c = features.groupBy(*by, "f").agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q")).where(F.col("p") + F.col("q") >= least)
    whole = c.groupBy(*by).agg(F.sum(F.col("p") + 1).alias("sp"), F.sum(F.col("q") + 1).alias("sq"))
    one = [*by] or ["_one"]
    j = (c if by else c.withColumn("_one", F.lit(1))).join(whole if by else whole.withColumn("_one", F.lit(1)), one)
    return j.select(*by, "f", (F.log((F.col("p") + 1) / F.col("sp")) - F.log((F.col("q") + 1) / F.col("sq"))).alias("w"))


def cross_scores(rows: DataFrame, key: str, label: str, feats: str, folds: int = 2, least: int = 3) -> DataFrame:
    """(key, label, score): each row scored by the weights of the other folds, plus the log odds of their labels."""
    d = rows.select(F.col(key), F.col(label).cast("boolean").alias(label), fold(key, folds).alias("fold"), F.col(feats).alias("_f"))
    long = d.select(key, label, "fold", F.explode("_f").alias("f"))
    fitted = long.select(label, "f", F.explode(F.expr(f"filter(sequence(0, {folds - 1}), x -> x <> fold)")).alias("fold"))
    w = weights(fitted, label, ["fold"], least)
    n = d.select(label, F.explode(F.expr(f"filter(sequence(0, {folds - 1}), x -> x <> fold)")).alias("fold")).groupBy("fold").agg(F.log((F.count_if(F.col(label)) + 1.0) / (F.count_if(~F.col(label)) + 1.0)).alias("prior"))
    s = long.join(w, ["fold", "f"]).groupBy(key).agg(F.sum("w").alias("s"))
    return d.join(F.broadcast(n), "fold").join(s, key, "left").select(key, label, "fold", (F.col("prior") + F.coalesce("s", F.lit(0.0))).alias("score"))


def accuracy(scores: DataFrame, label: str) -> DataFrame:
    return scores.agg(F.avg(((F.col("score") > 0) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def debias(scores: DataFrame, key: str, label: str, bins: int = 20, salt: str = "debias") -> DataFrame:
    """Equally many true and false rows in each of ``bins`` bins of the score, in hash order.

    Bin edges are exact quantiles of the scores, found without a global order, and 0, so that no
    bin holds rows of both guesses. Scores are rounded to nine digits, so that equal texts share a bin
    whatever the order of their sums.
    """
    scores = cut(scores.withColumn("score", F.round("score", 9)))
    edges = [x for x in quantiles(scores, "score", [], [i / bins for i in range(1, bins)], discrete=True).first() or () if x is not None]
    edges = sorted({*edges, 0.0})
    d = scores.withColumn("bin", F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + F.when(F.col("score") > e, 1).otherwise(0)))
    c = d.groupBy("bin").agg(F.least(F.count_if(F.col(label)), F.count_if(~F.col(label))).alias("cap"))
    caps = c.select("bin", F.explode(F.array(F.lit(True), F.lit(False))).alias(label), "cap")
    return first_by_cell(d.withColumn("_h", hash_key(salt, key)), ["bin", label], caps, "_h", [key]).drop("_h")


def answer_prior(df: DataFrame, options: str, answer: str) -> DataFrame:
    """(option, offered, gold, prior): how often an option is the answer where it is offered, (gold + 1) / (offered + 2)."""
    o = df.select(F.col(answer).alias("_a"), F.explode(F.array_distinct(options)).alias("option"))
    return o.groupBy("option").agg(F.count("*").alias("offered"), F.count_if(F.col("option") == F.col("_a")).alias("gold")).withColumn("prior", (F.col("gold") + 1) / (F.col("offered") + 2))


def backoff_accuracy(fit: DataFrame, test: DataFrame, keys: list[str], answer: str, default: str) -> DataFrame:
    """(accuracy, n): answers looked up by the first of ``keys`` that was seen, else the column ``default``."""
    d = test
    for i, k in enumerate(keys):
        c = fit.groupBy(k, answer).agg(F.count("*").alias("n"))
        best = c.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(F.desc("n"), answer))).where("_r = 1").select(k, F.col(answer).alias(f"_a{i}"))
        d = d.join(best, k, "left")
    guess = F.coalesce(*(f"_a{i}" for i in range(len(keys))), default)
    return d.agg(F.avg((guess == F.col(answer)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
