"""Balancing, capping and sampling by ranks inside groups.

Ranks are taken in the order of ``order`` (columns that tell rows apart): the file's own order or a
hash. A group is one window partition; where a group can hold most of the table, use the
``*_spread`` forms or :mod:`gleanwork.operators.ordered`, which bucket it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.ordered import running_total


def _rank(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _joined(df: DataFrame, caps: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that may be null."""
    c = caps.select(*(F.col(x).alias(f"_on_{x}") for x in on), *(x for x in caps.columns if x not in on))
    same = F.lit(True)
    for x in on:
        same &= F.col(x).eqNullSafe(F.col(f"_on_{x}"))
    return df.join(c, same).drop(*(f"_on_{x}" for x in on))


def first_by_cell(df: DataFrame, cell: list[str], cap: DataFrame, key: str, tie: list[str]) -> DataFrame:
    """The first ``cap`` rows of each cell in the order of the hex ``key``; hot cells are bucketed."""
    capped = _joined(df, cap, cell)
    return running_total(capped, key, F.lit(1), cell, "_before", tie).where("_before < cap").drop("_before", "cap")


def equalize(df: DataFrame, group: str, answer: str, key: str, tie: list[str]) -> DataFrame:
    """Per group as many rows of each answer as of its rarest; groups of one answer are dropped."""
    c = df.groupBy(group, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    caps = c.withColumns({"cap": F.min("n").over(w), "_k": F.count("*").over(w)}).where("_k >= 2").select(group, answer, "cap")
    return first_by_cell(df, [group, answer], caps, key, tie)


def flatten_top(df: DataFrame, group: str, answer: str, key: str, tie: list[str], least: int = 5) -> DataFrame:
    """In groups of ``least`` rows or more no answer is kept more often than the second most frequent one;
    a group of one answer keeps one row. Smaller groups stay whole."""
    c = df.groupBy(group, answer).agg(F.count("*").alias("n"))
    top = c.groupBy(group).agg(F.sort_array(F.collect_list("n"), asc=False).alias("_ns"), F.sum("n").alias("_all"))  # one number per distinct answer
    cap = F.when(F.col("_all") < least, F.col("_all")).otherwise(F.coalesce(F.get("_ns", F.lit(1)), F.lit(1)))
    return first_by_cell(df, [group, answer], _joined(c, top.select(group, cap.alias("cap")), [group]).select(group, answer, "cap"), key, tie)


def balance_overall(df: DataFrame, answer: str, key: str, tie: list[str]) -> DataFrame:
    """As many rows of every answer as of the rarest one in the table."""
    c = df.groupBy(answer).agg(F.count("*").alias("n"))
    least = c.agg(F.min("n").alias("m")).first().m or 0
    return first_by_cell(df, [answer], c.select(answer, F.lit(least).alias("cap")), key, tie)


def flatten_answers(df: DataFrame, answer: str, key: str, tie: list[str], factor: float = 2.0) -> DataFrame:
    """No answer more often than ``factor`` times the mean count of answers, at least once."""
    c = df.groupBy(answer).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    cap = max(1, int(factor * (t.n or 0) / max(1, t.k)))
    return first_by_cell(df, [answer], c.select(answer, F.lit(cap).alias("cap")), key, tie)


def drop_surplus(df: DataFrame, group: list[str], answer: str, pair: tuple[str, str], key: str, tie: list[str], only_first: bool = False) -> DataFrame:
    """Equally many rows of the two answers of ``pair`` per group, all other rows untouched.
    ``only_first``: only a surplus of the first answer is dropped."""
    two = F.col(answer).isin(*pair)
    n = df.where(two).groupBy(*group).agg(*(F.count_if(F.col(answer) == a).alias(f"_{i}") for i, a in enumerate(pair)))
    low = F.least("_0", "_1")
    caps = n.select(*group, F.explode(F.array(F.struct(F.lit(pair[0]).alias(answer), low.alias("cap")), F.struct(F.lit(pair[1]).alias(answer), (F.col("_1") if only_first else low).alias("cap")))).alias("_c")).select(*group, f"_c.{answer}", "_c.cap")
    return df.where(~two | F.col(answer).isNull()).unionByName(first_by_cell(df.where(two), [*group, answer], caps, key, tie))


def cap_per(df: DataFrame, by: list[str], cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows per value of ``by``. Groups are ordered whole: meant for keys of few rows."""
    return df.withColumn("_r", _rank(by, order)).where(F.col("_r") <= cap).drop("_r")


def cap_mixed(df: DataFrame, by: str, kind: str, cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows per ``by``, one of each kind before a second of any."""
    d = df.withColumn("_k", _rank([by, kind], order))
    return d.withColumn("_r", _rank([by], ["_k", *order])).where(F.col("_r") <= cap).drop("_k", "_r")


def apportion(quotas: DataFrame, weight: str, total: int, tie: list[str]) -> DataFrame:
    """``quotas`` (a small table) with ``quota``: shares of ``total`` by largest remainder."""
    whole = quotas.agg(F.sum(weight).alias("s")).first().s or 0
    if not whole:
        return quotas.withColumn("quota", F.lit(0).cast("bigint"))
    d = quotas.withColumn("_x", F.col(weight) * F.lit(float(total)) / F.lit(float(whole))).withColumn("_f", F.floor(F.col("_x") + 1e-9))
    left = total - (d.agg(F.sum("_f").alias("s")).first().s or 0)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), *tie))).withColumn("quota", (F.col("_f") + F.when(F.col("_r") <= left, 1).otherwise(0)).cast("bigint")).drop("_x", "_f", "_r")


def water_fill(available: dict[str, int], total: int) -> dict[str, int]:
    """Equal shares of ``total``; what a class can't give is shared by the others, spare units by name."""
    out = dict.fromkeys(available, 0)
    live, left = {k for k, v in available.items() if v > 0}, min(total, sum(available.values()))
    while left and live:
        share = left // len(live)
        if not share:
            for k in sorted(live)[:left]:
                out[k] += 1
            break
        for k in sorted(live):
            take = min(share, available[k] - out[k])
            out[k] += take
            left -= take
        live = {k for k in live if out[k] < available[k]}
    return out


def stratified(df: DataFrame, stratum: str, total: int, key: str, tie: list[str]) -> DataFrame:
    """``total`` rows spread over the strata in proportion to their sizes, in hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    q = apportion(sizes, "n", total, [stratum])
    return first_by_cell(df, [stratum], q.select(stratum, F.least("quota", "n").alias("cap")), key, tie)


def whole_groups(df: DataFrame, group: str, target: int, key: Column) -> DataFrame:
    """Whole groups in hash order while the rows of those before are fewer than ``target``."""
    g = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", key)
    keep = running_total(g, "_h", F.col("_n"), [], "_b", [group]).where(F.col("_b") < target).select(group)
    return _joined(df, keep, [group])


def whole_groups_per(df: DataFrame, outer: str, group: str, share: float, key: Column) -> DataFrame:
    """Per ``outer`` whole groups in hash order while those before hold less than ``share`` of its rows."""
    g = df.groupBy(outer, group).agg(F.count("*").alias("_n"))
    size = g.groupBy(outer).agg(F.sum("_n").alias("_all"))
    g = running_total(g.withColumn("_h", key), "_h", F.col("_n"), [outer], "_b", [group])
    return _joined(df, _joined(g, size, [outer]).where(F.col("_b") < F.col("_all") * share).select(outer, group), [outer, group])


def repeat_to(df: DataFrame, views: int, key: str, ident: str) -> DataFrame:
    """Whole passes over the table until exactly ``views`` rows; copies are named ``#rK``.

    Full passes are exploded; the last one is the first rows in hash order.
    """
    n = df.count()
    if not n or views <= 0:
        return df.limit(0).withColumn("pass", F.lit(0))
    full, rest = divmod(views, n)
    last = running_total(df, key, F.lit(1), [], "_b", [ident])
    times = F.lit(full) + F.when(F.col("_b") < rest, 1).otherwise(0)
    out = last.withColumn("_t", times).where("_t > 0").withColumn("pass", F.explode(F.expr("sequence(0, cast(_t as int) - 1)"))).drop("_b", "_t")
    return out.withColumn(ident, F.when(F.col("pass") > 0, F.concat(F.col(ident).cast("string"), F.lit("#r"), F.col("pass").cast("string"))).otherwise(F.col(ident).cast("string")))


def round_robin(df: DataFrame, pool: str, limit: int, order: list) -> DataFrame:
    """``limit`` rows taken from the pools in turn: first of each, second of each, and so on.
    Only the first ``limit`` rows of a pool can be taken, so that ranks stop there."""
    d = df.withColumn("turn", _rank([pool], order)).where(F.col("turn") <= limit)
    return d.orderBy("turn", pool, *order).limit(limit)


def requests(df: DataFrame, by: list[str], most: int, key: str, tie: list[str]) -> DataFrame:
    """Rows of equal ``by`` packed into requests of at most ``most`` rows in the order of the hex ``key``: columns
    ``request`` and ``place``. Ranks are bucketed, so that the rows without a picture, one group, are many tasks."""
    d = running_total(df, key, F.lit(1), by, "_b", tie)
    return d.withColumns({"request": F.floor(F.col("_b") / most).cast("int"), "place": (F.col("_b") % most).cast("int")}).drop("_b")


def cap_share(df: DataFrame, what: Column, share: float, key: str, tie: list[str]) -> DataFrame:
    """All other rows, and of those for which ``what`` holds the first in hash order that make up at most ``share`` of the result."""
    d = df.withColumn("_what", F.coalesce(what, F.lit(False)))
    rest = d.where("not _what").count()
    first = running_total(d.where("_what"), key, F.lit(1), [], "_b", tie).where(F.col("_b") < int(rest * share / (1 - share))).drop("_b")
    return d.where("not _what").unionByName(first).drop("_what")


def stratified_parts(df: DataFrame, stratum: str, sizes: dict[str, int], other: str, key: str, tie: list[str]) -> DataFrame:
    """``df`` with ``part``: named parts of given sizes over the strata in proportion, by largest remainder, the rest ``other``.
    Inside a stratum the parts follow each other in hash order."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    cuts = n.select(stratum, F.lit(0).cast("bigint").alias("_to"))
    bounds = []
    for name, size in sizes.items():
        q = apportion(n, "n", size, [stratum]).select(stratum, F.col("quota").alias("_q"))
        cuts = _joined(cuts, q, [stratum]).withColumn(f"_to_{len(bounds)}", F.col("_to") + F.col("_q")).withColumn("_to", F.col("_to") + F.col("_q")).drop("_q")
        bounds.append(name)
    d = _joined(running_total(df, key, F.lit(1), [stratum], "_b", tie), cuts, [stratum])
    part = F.lit(other)
    for i, name in reversed(list(enumerate(bounds))):
        part = F.when(F.col("_b") < F.col(f"_to_{i}"), F.lit(name)).otherwise(part)
    return d.withColumn("part", part).select(*df.columns, "part")
