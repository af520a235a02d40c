"""What is wrong with rows: every reason as text, in one array per row, without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import probs as P


def reasons(*checks: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold; a condition of null counts as not holding."""
    return F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in checks)), lambda x: x.isNotNull())


def sample_errors(options: Column, gold: Column, kind: Column, least: int = 2, most: int = 255) -> Column:
    """Reasons why a question can't be used: options, names of the gold, values, their sum."""
    ps = F.transform(gold, lambda g: g["p"])
    bad = lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf"))
    return reasons(
        (kind.isNull(), "no type"), (options.isNull() | (F.size(options) < least), "too few options"), (F.size(options) > most, "too many options"),
        (F.size(F.array_distinct(options)) < F.size(options), "repeated option"), (gold.isNull() | (F.size(gold) == 0), "no gold"),
        (F.exists(gold, lambda g: ~F.array_contains(options, g["key"])), "gold names no option"), (F.exists(ps, bad), "gold value"),
        (~F.exists(ps, bad) & (P.total(gold) <= 0), "gold sums to zero"),
    )


def distribution_errors(options: Column, probs: Column, close: float = 1e-4) -> Column:
    """Reasons why probabilities are no distribution over the options in their order."""
    ps = F.transform(probs, lambda g: g["p"])
    bad = lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    return reasons((~F.transform(probs, lambda g: g["key"]).eqNullSafe(options), "keys"), (F.exists(ps, bad), "value"), (F.abs(P.total(probs) - 1) > close, "sum"))


def refuse(df: DataFrame, errors: str, ident: str, most: int = 20) -> DataFrame:
    """``df`` without ``errors``; raises with at most ``most`` examples if a row has any."""
    bad = df.where(F.size(errors) > 0).select(ident, errors).limit(most).collect()
    if bad:
        raise ValueError("; ".join(f"{r[0]}: {', '.join(r[1])}" for r in bad))
    return df.drop(errors)


def covers_once(side: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., problem) where the side table lacks a row's key, repeats one, or names one that is not there."""
    s = side.groupBy(*key).agg(F.count("*").alias("_s"))
    r = rows.select(*key).distinct().withColumn("_r", F.lit(True))
    j = r.join(s, key, "full_outer")
    problem = F.when(F.col("_s").isNull(), "missing").when(F.col("_r").isNull(), "unknown").when(F.col("_s") > 1, "repeated")
    return j.select(*key, problem.alias("problem")).where("problem is not null")


def full_corners(df: DataFrame, quad: str, corner: list[str], n: int = 4) -> DataFrame:
    """(quad, n_corners) of the quads that do not have exactly ``n`` distinct corners."""
    return df.select(quad, *corner).distinct().groupBy(quad).agg(F.count("*").alias("n_corners")).where(F.col("n_corners") != n)


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unbalanced(df: DataFrame, group: str, answer: str) -> DataFrame:
    """(group, least, most) of groups whose answers are not equally frequent."""
    c = df.groupBy(group, answer).agg(F.count("*").alias("n"))
    return c.groupBy(group).agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least < most")


def manifest(df: DataFrame, by: list[str], ident: str, picture: str) -> DataFrame:
    """(by..., rows, ids, pictures) of each part and, with nulls, of the whole."""
    return df.rollup(*by).agg(F.count("*").alias("rows"), F.count_distinct(ident).alias("ids"), F.count_distinct(picture).alias("pictures"))


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def flat(df: DataFrame, group: str, answer: str, most: float = 2.0) -> DataFrame:
    """(group, top, mean) of groups whose most frequent answer is more than ``most`` times as frequent as the mean of its answers."""
    c = df.groupBy(group, answer).agg(F.count("*").alias("n"))
    return c.groupBy(group).agg(F.max("n").alias("top"), F.avg("n").alias("mean")).where(F.col("top") > F.col("mean") * most)


def split_state(parts: Column) -> Column:
    """(text, image, n_images) of a state given as a list of structs (text, image): its texts joined by lines, its first image."""
    images = F.filter(F.transform(parts, lambda x: x["image"]), lambda x: x.isNotNull())
    texts = F.filter(F.transform(parts, lambda x: x["text"]), lambda x: x.isNotNull())
    return F.struct(F.array_join(texts, "\n").alias("text"), F.get(images, F.lit(0)).alias("image"), F.size(images).alias("n_images"))


def request_errors(state: Column, image: Column, questions: Column) -> Column:
    """Why a request can't be answered: no question, a question of too few options or with one twice, more than one picture or two ways of giving it."""
    s = split_state(state)
    return reasons(
        (questions.isNull() | (F.size(questions) == 0), "no question"), (F.exists(questions, lambda q: F.size(q["options"]) < 2), "too few options"),
        (F.exists(questions, lambda q: F.size(F.array_distinct(q["options"])) < F.size(q["options"])), "repeated option"),
        (s["n_images"] > 1, "several pictures"), ((s["n_images"] > 0) & image.isNotNull(), "picture given twice"),
    )


def weight_errors(df: DataFrame, ident: str, weights: str, questions: str) -> DataFrame:
    """(ident, errors) of rows whose question weights (a map) are negative, not finite, or of a question that is not there."""
    bad = F.exists(F.map_values(weights), lambda w: w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf")))
    other = F.size(F.array_except(F.map_keys(weights), F.col(questions))) > 0
    return df.select(ident, reasons((bad, "weight value"), (other, "weight of no question")).alias("errors")).where("size(errors) > 0")


def same_start(a: DataFrame, b: DataFrame, by: list[str], key: list[str], order: list, probs: str, close: float) -> DataFrame:
    """(by..., n, only_a, only_b, differ, worst): whether two runs begin alike.

    The n-th row of a key is compared with the n-th of it on the other side; ``differ`` counts those with an
    option whose probability is farther apart than ``close``, ``worst`` is the largest distance.
    """
    w = Window.partitionBy(*by, *key).orderBy(*order)
    side = lambda d, s: d.select(*by, *key, F.row_number().over(w).alias("_o"), F.col(probs).alias(f"_{s}"))
    j = side(a, "a").join(side(b, "b"), [*by, *key, "_o"], "full_outer")
    far = F.array_max(F.transform("_a", lambda e: F.abs(e["p"] - P.p_of(F.col("_b"), e["key"]))))
    j = j.withColumn("_far", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.coalesce(far, F.lit(0.0))))
    return j.groupBy(*by).agg(F.count("_far").alias("n"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_far") > close).alias("differ"), F.max("_far").alias("worst"))


def output_errors(records: DataFrame, data: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """(problem, n): everything that is wrong with a run's output against the data it was asked about: keys missing, unknown or repeated,
    fixed columns that differ, probabilities that are none."""
    from gleanwork.operators.compare import differences

    sides = differences(data, records, key, fixed).select("problem")
    own = records.select(F.explode(distribution_errors(F.col("options"), F.col("probabilities"))).alias("problem"))
    return sides.unionByName(own).groupBy("problem").agg(F.count("*").alias("n"))
