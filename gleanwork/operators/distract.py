"""Wrong options and absent things: what stands near an answer in a pool, and what could be in a picture but is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.identity import cooccurrence
from gleanwork.operators.ordered import next_in_circle


def siblings(df: DataFrame, group: str, answer: str, key: Column, out: str = "sibling") -> DataFrame:
    """(group, answer, sibling): for each answer of a group another one of it, the next in hash order, in a circle.

    A group's answers are never gathered: the circle is laid over hash buckets. The only answer of a group has itself.
    """
    d = df.where(F.col(group).isNotNull() & F.col(answer).isNotNull()).select(group, answer).distinct().withColumn("_h", key)
    return next_in_circle(d, "_h", answer, [group], out).drop("_h")


def near_frequency(df: DataFrame, pool: str, answer: str, ratio: float, side: int = 2) -> DataFrame:
    """(pool, answer, others): up to ``side`` answers next above and below in frequency of the same pool whose count is
    within ``ratio`` of the answer's, so that frequency does not tell the right one. Ordered in the pool, not paired with it."""
    c = df.where(F.col(answer).isNotNull()).groupBy(pool, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(pool).orderBy(F.desc("n"), answer)  # a pool's distinct answers
    near = [f(F.struct(F.col(answer).alias("a"), F.col("n").alias("n")), k).over(w) for k in range(1, side + 1) for f in (F.lag, F.lead)]
    ok = F.filter(F.array(*near), lambda x: x.isNotNull() & (x["n"] <= F.col("n") * ratio) & (x["n"] * ratio >= F.col("n")))
    return c.select(pool, answer, "n", F.array_sort(F.transform(ok, lambda x: x["a"])).alias("others"))


def absent(df: DataFrame, picture: str, thing: str, least: int = 1) -> DataFrame:
    """(picture, thing, weight): things that are not in a picture, by how often they occur together with those that are.

    Each of a picture's things brings its partners, so work is bounded by pictures' things times the number of
    classes; a picture is never paired with pictures.
    """
    d = df.where(F.col(picture).isNotNull() & F.col(thing).isNotNull()).select(picture, thing).distinct()
    c = cooccurrence(d, picture, thing, least)
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    there = d.withColumn("_there", F.lit(1))
    brought = d.withColumnRenamed(thing, "a").join(both, "a").groupBy(picture, F.col("b").alias(thing)).agg(F.sum("n").alias("weight"))
    return brought.join(there, [picture, thing], "left_anti")


def likeliest_absent(df: DataFrame, picture: str, thing: str, least: int = 1) -> DataFrame:
    """(picture, adversarial, popular, n_absent): of the absent things the one that occurs most with what is
    there, and the one in most pictures; of equals the least name."""
    a = absent(df, picture, thing, least)
    often = df.where(F.col(picture).isNotNull()).select(picture, thing).distinct().groupBy(thing).agg(F.count("*").alias("_often"))
    top = lambda n: F.min_by(thing, F.struct(-F.col(n), F.col(thing)))
    return a.join(often, thing).groupBy(picture).agg(top("weight").alias("adversarial"), top("_often").alias("popular"), F.count("*").alias("n_absent"))


def top_part(df: DataFrame, picture: str, thing: str, weight: str, part: float) -> DataFrame:
    """The things of each picture in its top ``part`` by weight (rank over how many there are, less one); ties go together."""
    w = Window.partitionBy(picture).orderBy(F.desc(weight))  # a picture's absent classes
    return df.withColumn("_r", F.percent_rank().over(w)).where(F.col("_r") <= part).drop("_r")


def once(df: DataFrame, picture: str, name: str) -> DataFrame:
    """Rows whose name stands once in their picture."""
    n = df.groupBy(picture, name).agg(F.count("*").alias("_n")).where("_n = 1").select(picture, name)
    return df.join(n, [picture, name], "left_semi")


def gap_pairs(df: DataFrame, picture: str, name: str, low: Column, high: Column, gap: float) -> DataFrame:
    """(picture, upper, lower, gap) of things named once in a picture of which one ends at least ``gap`` above the other.

    Only names that stand once are paired, so a picture brings at most the square of its classes.
    """
    d = once(df.select(picture, name, low.cast("double").alias("_lo"), high.cast("double").alias("_hi")).where(F.col(picture).isNotNull() & F.col(name).isNotNull()), picture, name)
    a = d.select(picture, F.col(name).alias("upper"), F.col("_hi").alias("_end"))
    b = d.select(picture, F.col(name).alias("lower"), F.col("_lo").alias("_begin"))
    return a.join(b, picture).where((F.col("upper") != F.col("lower")) & (F.col("_begin") - F.col("_end") >= gap)).select(picture, "upper", "lower", (F.col("_begin") - F.col("_end")).alias("gap"))


def screen_options(gold: Column, screen: Column, generic: Column, n_screen: int, least: int, n: int, salt: Column) -> Column:
    """Gold, up to ``n_screen`` others of the screen in their order, then generic ones in hash order up to ``n`` in all,
    no two alike but for case, then all in hash order; null with fewer than ``least`` from the screen."""
    low = F.lower
    fresh = lambda xs: F.filter(xs, lambda x, i: (F.array_position(F.transform(xs, low), low(x)) == i + 1) & (low(x) != low(gold)))
    own = F.slice(fresh(screen), F.lit(1), F.lit(n_screen))
    rest = F.filter(fresh(generic), lambda g: ~F.array_contains(F.transform(own, low), low(g)))
    mixed = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(F.md5(F.concat_ws("|", salt, x)).alias("h"), x.alias("x")))), lambda s: s["x"])
    return F.when(F.size(own) >= least, mixed(F.concat(F.array(gold), own, F.slice(mixed(rest), F.lit(1), F.greatest(F.lit(0), F.lit(n - 1) - F.size(own))))))


def ranked_numbers(gold: Column, pool: Column, k: int, above: Column) -> Column:
    """``k`` of the pool, ``above`` of them (moved into what is possible) greater than gold, nearest first; null if there are too few."""
    up, down = F.array_sort(F.filter(pool, lambda p: p > gold)), F.reverse(F.array_sort(F.filter(pool, lambda p: p < gold)))
    n = F.least(F.greatest(above, F.lit(k) - F.size(down)), F.least(F.lit(k), F.size(up))).cast("int")
    return F.when(F.size(up) + F.size(down) >= k, F.concat(F.slice(up, F.lit(1), n), F.slice(down, F.lit(1), F.lit(k) - n)))


def swapped_caption(caption: Column, pairs: dict[str, str]) -> Column:
    """The caption with the first of the words that has a partner replaced by it; null if none has."""
    ws = F.split(caption, " ")
    both = {**pairs, **{v: k for k, v in pairs.items()}}

    def partner(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for a, b in both.items():
            out = F.when(w == a, F.lit(b)).otherwise(out)
        return out

    at = F.array_position(F.transform(ws, lambda w: partner(w).isNotNull()), True)
    return F.when(at > 0, F.array_join(F.transform(ws, lambda w, i: F.when(i + 1 == at, partner(w)).otherwise(w)), " "))


def fresh_first(df: DataFrame, used: str, quota: int, key: Column, tie: list[str]) -> DataFrame:
    """``quota`` rows, those not used before first, each kind in hash order."""
    return df.withColumn("_h", key).orderBy(F.col(used).cast("int"), "_h", *tie).limit(quota).drop("_h")


def matched_frequency(df: DataFrame, pool: str, answer: str, ratios: tuple[float, ...] = (2.0, 4.0), side: int = 2) -> DataFrame:
    """(pool, answer, ratio, others): the answers near in frequency by the first of ``ratios`` that gives any; answers for which none does are left out."""
    out = near_frequency(df, pool, answer, ratios[0], side).withColumn("ratio", F.lit(ratios[0]))
    for r in ratios[1:]:
        wider = near_frequency(df, pool, answer, r, side).select(F.col(pool).alias("_p"), F.col(answer).alias("_a"), F.col("others").alias("_o"))
        out = out.join(wider, F.col(pool).eqNullSafe(F.col("_p")) & (F.col(answer) == F.col("_a")), "left")
        none = F.size("others") == 0
        out = out.withColumn("ratio", F.when(none, F.lit(r)).otherwise(F.col("ratio"))).withColumn("others", F.when(none, F.coalesce("_o", "others")).otherwise(F.col("others"))).drop("_p", "_a", "_o")
    return out.where("size(others) > 0").select(pool, answer, "ratio", "others")


def finest_pool(df: DataFrame, fine: str, coarse: str, answer: str, least: int = 8) -> DataFrame:
    """``df`` with ``pool``: the fine pool of a row if it has ``least`` different answers, else the coarse one."""
    n = df.where(F.col(answer).isNotNull()).groupBy(F.col(fine).alias("_f")).agg((F.count_distinct(answer) >= least).alias("_many"))
    return df.join(n, F.col(fine).eqNullSafe(F.col("_f")), "left").withColumn("pool", F.when(F.col("_many"), F.col(fine)).otherwise(F.col(coarse))).drop("_f", "_many")


def negative_captions(df: DataFrame, picture: str, caption: str, pairs: dict[str, str]) -> DataFrame:
    """(picture, caption, negative): captions with one word swapped for its partner that no caption of the same picture says."""
    d = df.where(F.col(picture).isNotNull() & F.col(caption).isNotNull()).select(picture, caption).distinct()
    n = d.withColumn("negative", swapped_caption(F.col(caption), pairs)).where("negative is not null")
    return n.join(d.select(picture, F.col(caption).alias("negative")), [picture, "negative"], "left_anti").select(picture, caption, "negative")


def unambiguous(df: DataFrame, picture: str, phrase: str, thing: str) -> DataFrame:
    """(picture, phrase, thing) of phrases that name one thing of their picture."""
    d = df.where(F.col(picture).isNotNull() & F.col(phrase).isNotNull())
    return d.groupBy(picture, phrase).agg(F.min(thing).alias(thing), F.max(thing).alias("_z")).where(F.col(thing) == F.col("_z")).drop("_z")
