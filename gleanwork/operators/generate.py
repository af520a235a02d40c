"""Made tables of panel facts, their twins and questions: all values follow from ids by hashes, so any
part of the table can be made anywhere and is the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a made panel can show.
QUANTITIES = ["voltage", "pressure", "humidity", "distance", "duration", "speed"]


def draw(salt: str, ident: Column, n: int) -> Column:
    """A whole number in 0 .. n - 1 from the salt and an id."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), ident.cast("string"))), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def families(spark: SparkSession, n: int, salt: str = "panel") -> DataFrame:
    """(family, split, quantity, value, twin_value): ``n`` panels and for each a twin that differs in its value."""
    f = F.col("id")
    d = spark.range(n).select(f.alias("family"), draw(f"{salt} split", f, 10).alias("_s"), F.element_at(F.array(*map(F.lit, QUANTITIES)), draw(f"{salt} quantity", f, len(QUANTITIES)) + 1).alias("quantity"), (100 + draw(f"{salt} value", f, 900)).alias("value"), (1 + draw(f"{salt} step", f, 50)).alias("_d"))
    return d.select("family", F.when(F.col("_s") == 0, "tune").when(F.col("_s") == 1, "confirm").otherwise("train").alias("split"), "quantity", "value", (F.col("value") + F.col("_d")).alias("twin_value"))


def questions(fams: DataFrame) -> DataFrame:
    """(family, view, qid, type, instructions, options, answer): fixed questions of both views of each family."""
    view = F.explode(F.array(F.struct(F.lit("scene").alias("view"), F.col("value").alias("shown")), F.struct(F.lit("twin").alias("view"), F.col("twin_value").alias("shown"))))
    d = fams.select("family", "quantity", F.col("value").alias("_v"), F.col("twin_value").alias("_t"), view.alias("_x")).select("*", "_x.view", "_x.shown")
    reading = F.struct(F.lit("value").alias("qid"), F.lit("choice").alias("type"), F.concat(F.lit("What "), F.col("quantity"), F.lit(" does the panel show?")).alias("instructions"), F.transform(F.array("_v", "_t"), lambda x: x.cast("string")).alias("options"), F.col("shown").cast("string").alias("answer"))
    above = F.struct(F.lit("above").alias("qid"), F.lit("noul").alias("type"), F.concat(F.lit("Is the "), F.col("quantity"), F.lit(" above "), F.col("_v").cast("string"), F.lit("?")).alias("instructions"), F.array(F.lit("false"), F.lit("true")).alias("options"), (F.col("shown") > F.col("_v")).cast("string").alias("answer"))
    return d.select("family", "view", F.explode(F.array(reading, above)).alias("q")).select("family", "view", "q.*")


def without_cases(fams: DataFrame, used: DataFrame, case: list[str]) -> DataFrame:
    """Families whose case is not among the used ones, each case once (the least family)."""
    keep = fams.groupBy(*case).agg(F.min("family").alias("family")).select("family")
    return fams.join(keep, "family", "left_semi").join(used.select(*case).distinct(), case, "left_anti")


def per_answer(df: DataFrame, answer: str, picture: str, quota: int, order: list) -> DataFrame:
    """One row per picture, then at most ``quota`` rows of each answer, in ``order``."""
    from gleanwork.operators.balance import cap_per

    return cap_per(cap_per(df, [picture], 1, order), [answer], quota, order)
