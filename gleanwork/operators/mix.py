"""Unions of sets by rules: first wins, exclusions with reasons, repeats, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.balance import first_by_cell
from gleanwork.operators.validate import repeated


def first_wins(sets: list[tuple[str, DataFrame]], ident: str, order: list) -> DataFrame:
    """Rows of all sets with ``origin``; of rows of one id only the first, by the order of sets and then ``order``."""
    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumns({"origin": F.lit(n), "_p": F.lit(i)}) for i, (n, x) in enumerate(sets)))
    rest = [c for c in d.columns if c != ident]
    one = d.groupBy(ident).agg(F.min_by(F.struct(*rest), F.struct("_p", *order)).alias("_x"))
    return one.select(ident, "_x.*").drop("_p")


def strict_union(sets: list[DataFrame], ident: str) -> DataFrame:
    """The union, refused if an id is in it twice."""
    d = reduce(lambda a, b: a.unionByName(b), sets)
    bad = repeated(d, [ident]).limit(20).collect()
    if bad:
        raise ValueError("ids that are there twice: " + ", ".join(str(r[0]) for r in bad))
    return d


def exclude(df: DataFrame, rules: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``df`` with ``dropped``: the name of the first rule (name, held rows, columns) that a row meets, else null."""
    d = df
    for i, (_, held, on) in enumerate(rules):
        look = held.select(*on).where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))).distinct().withColumn(f"_x{i}", F.lit(True))
        d = d.join(look, on, "left")
    why = reduce(lambda c, x: c.when(F.col(f"_x{x[0]}"), x[1][0]), list(enumerate(rules))[1:], F.when(F.col("_x0"), rules[0][0])) if rules else F.lit(None).cast("string")
    return d.withColumn("dropped", why).select(*df.columns, "dropped")


def repeated_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, with ``copy`` from 0; none at 0 or null."""
    return df.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.expr("sequence(0, cast(_t as int) - 1)"))).drop("_t")


def quota_union(df: DataFrame, source: str, quotas: dict[str, int], key: str, tie: list[str]) -> DataFrame:
    """The first rows in hash order of each source, as many as its quota; sources without one are left out."""
    caps = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{source} string, cap bigint")
    return first_by_cell(df.where(F.col(source).isin(*quotas)), [source], caps, key, tie)


def short_quotas(df: DataFrame, source: str, quotas: dict[str, int]) -> DataFrame:
    """(source, quota, n) of the quotas that can't be met."""
    q = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{source} string, quota bigint")
    n = df.groupBy(source).agg(F.count("*").alias("n"))
    return q.join(n, source, "left").fillna(0, ["n"]).where("n < quota")


def lineage(start: str, parents: dict[str, str | None]) -> list[str]:
    """The chain of a run and the runs it was started from; a circle ends where it closes."""
    out: list[str] = []
    at: str | None = start
    while at is not None and at not in out:
        out.append(at)
        at = parents.get(at)
    return out


def verdict(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: whether each rule holds for all rows, and ``accepted`` if all do."""
    d = rows.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in rules.items()))
    return d.withColumn("accepted", reduce(lambda a, b: a & b, (F.col(n) for n in rules)))
