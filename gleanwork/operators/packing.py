"""Packing: units into batches, requests into calls, groups up to a limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.ordered import running_total

#: Batches hold at most so many items; sizes beyond it can not be planned by counts.
MOST = 100_000


def first_fit_plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """First fit decreasing by counts: rows (size, from, to, first batch, units per batch).

    Units of one size are alike, so the packing follows from how many there are of each. Neighbouring batches with
    equal room are one run; a size goes through the runs in order, filling each as far as it fits, and
    opens new batches for its rest. The plan has as many rows as sizes and runs, not as units.
    """
    runs: list[list[int]] = []  # first batch, how many, room left in each
    plan, opened = [], 0
    for size in sorted(counts, reverse=True):
        if not 0 < size <= most:
            raise ValueError(f"a unit of {size} items does not fit into a batch of {most}")
        left, at, after = counts[size], 0, []
        for first, many, room in runs:
            per = room // size
            if not left or not per:
                after.append([first, many, room])
                continue
            full = min(many, left // per)
            if full:
                plan.append((size, at, at + full * per, first, per))
                at, left = at + full * per, left - full * per
                after.append([first, full, room - per * size])
            if full < many:
                if left:
                    plan.append((size, at, at + left, first + full, per))
                    after.append([first + full, 1, room - left * size])
                    at, left, full = at + left, 0, full + 1
                if full < many:
                    after.append([first + full, many - full, room])
        if left:
            per = most // size
            plan.append((size, at, at + left, opened, per))
            full, rest = divmod(left, per)
            if full:
                after.append([opened, full, most - per * size])
            if rest:
                after.append([opened + full, 1, most - rest * size])
            opened += full + bool(rest)
        runs = after
    return plan


def batches(df: DataFrame, unit: str, size: str, mode: str, most: int, key: str) -> DataFrame:
    """``df`` (a row per unit) with ``batch``: whole units packed by first fit, decreasing, into batches of at most
    ``most`` items; each ``mode`` for itself, with batch numbers from 0.

    Only how many units of each size and mode there are reaches the driver (at most ``most`` rows per mode);
    which unit goes where follows from its rank among those of its size in the order of the hex ``key``.
    A unit of no items or of null size is in no batch; a unit larger than a batch is refused.
    """
    if most > MOST:
        raise ValueError(f"batches of more than {MOST} items")
    live = df.where(F.col(size) > 0)
    counts: dict = {}
    for r in live.groupBy(F.col(mode).alias("m"), F.col(size).cast("int").alias("s")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.m, {})[r.s] = r.n
    rows = [(m, *row) for m, c in counts.items() for row in first_fit_plan(c, most)]
    plan = df.sparkSession.createDataFrame(rows, f"_m {df.schema[mode].dataType.simpleString()}, _s int, _from bigint, _to bigint, _first bigint, _per bigint")
    ranked = running_total(live, key, F.lit(1), [mode, size], "_r", [unit])
    met = F.col(mode).eqNullSafe(F.col("_m")) & (F.col(size) == F.col("_s")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    out = ranked.join(plan, met)
    return out.withColumn("batch", F.col("_first") + F.floor((F.col("_r") - F.col("_from")) / F.col("_per"))).select(*df.columns, "batch")


def calls(df: DataFrame, shard: str, order: list[str], size: str, most: int) -> DataFrame:
    """``df`` with ``call``: neighbours in ``order`` go into one call while it holds at most ``most``; a larger row is a call of its own.

    A sweep over each ``shard`` (take a hash of a picture: as many shards as the work should be parts of);
    calls are numbered from 0 in it. A null size counts as nothing.
    """
    names = df.columns

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, call, held = object(), 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch.column(names.index(shard)).to_pylist(), batch.column(names.index(size)).to_pylist()):
                n = n or 0
                if k != now:
                    now, call, held = k, 0, 0
                elif held + n > most:
                    call, held = call + 1, 0
                held += n
                out.append(call)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "call"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(shard).sortWithinPartitions(shard, *order).mapInArrow(sweep, f"{given}, call bigint")


def first_that_fit(df: DataFrame, group: str, limit: int, key) -> DataFrame:
    """Rows of whole groups in hash order, each taken if it still fits under ``limit`` and skipped if not.

    Groups are counted first. A round takes the groups up to the first that does not fit; what lies
    behind and is larger than the room left is gone for good, so rounds are few. Rows without group are left out.
    """
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", key)
    g, room, taken = g.where(F.col("_n") <= limit), limit, None
    while True:
        run = running_total(g.where(F.col("_n") <= room), "_h", F.col("_n"), [], "_b", [group])
        fits = run.where(F.col("_b") + F.col("_n") <= room)
        first_bad = run.where(F.col("_b") + F.col("_n") > room).agg(F.min(F.struct("_h", group)).alias("x"), F.count("*").alias("n")).first()
        some = fits if not first_bad.n else fits.where(F.struct("_h", group) < F.struct(F.lit(first_bad.x[0]), F.lit(first_bad.x[1])))
        taken = some.select(group) if taken is None else taken.unionByName(some.select(group))
        if not first_bad.n:
            return df.join(taken, group, "left_semi")
        room -= some.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        g = g.where(F.struct("_h", group) > F.struct(F.lit(first_bad.x[0]), F.lit(first_bad.x[1])))


def capped_groups(df: DataFrame, group: str, episode: str, cap: int, per_group: int, group_key, episode_key) -> DataFrame:
    """Groups in hash order while the rows kept of those before are below ``cap``; of each group whole
    episodes in hash order while the rows of those before are below ``per_group``."""
    e = df.groupBy(group, episode).agg(F.count("*").alias("_n")).withColumn("_h", episode_key)
    kept = running_total(e, "_h", F.col("_n"), [group], "_b", [episode]).where(F.col("_b") < per_group)
    g = kept.groupBy(group).agg(F.sum("_n").alias("_all")).withColumn("_g", group_key)
    live = running_total(g, "_g", F.col("_all"), [], "_gb", [group]).where(F.col("_gb") < cap).select(group)
    return df.join(kept.join(live, group, "left_semi").select(group, episode), [group, episode], "left_semi")
