"""A sample that follows wanted shares of categories, with minimums and a report of what fell short.

Categories are the cells of a two-way table (type by collection). Fractional quotas are made integer
by controlled rounding: a maximum flow gives each cell its floor or ceiling while each row sum and
column sum keeps its floor or ceiling too. Each cell then gives exactly its quota, by random keys.

Defined results: lines of one id count once, whatever they say; a row without id counts nowhere; a row
without type or source is in no category; types in no known spelling are in no category of the
targets; an empty table gives an empty sample and a report of zeros.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.pictures import clean_source, collection_of
from gleanwork.operators.ordered import hash_key, running_total
from gleanwork.plans.lineage import cut, small_side

# Spellings of the three types.
_TYPES = {
    "noul": ("noul", "yesno", "yesorno", "boolean", "bool", "binary"),
    "choice": ("choice", "multichoice", "multiplechoice", "mc", "singlechoice"),
    "score": ("score", "rating", "rate"),
}
#: The targets are a table of parameters; one of more cells than this is refused.
MAX_CELLS = 10_000
BUCKETS = 65_536


def clean_type(c: str | Column) -> Column:
    """``noul``, ``choice`` or ``score``; another spelling as its bare letters; null if none."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(c), "[^a-z]", "")
    out = F.when(s != "", s)
    for name, spellings in _TYPES.items():
        out = F.when(s.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def controlled_rounding(table: list[list[float]]) -> list[list[int]]:
    """Integers next to the cells whose row sums, column sums and total are next to those of ``table``.

    Such a table always exists. It is a feasible flow source -> rows -> columns -> sink whose edges
    carry between floor and ceiling; lower bounds are paid first, and augmenting paths fill the rest.
    """
    # Sums of rounded cells are rounded alike, so that float noise never turns a whole number into an interval.
    table = [[round(x, 6) for x in row] for row in table]
    low, high = (lambda x: math.floor(round(x, 6))), (lambda x: math.ceil(round(x, 6)))
    rows, cols = len(table), len(table[0]) if table else 0
    if not rows or not cols:
        return [[] for _ in table]
    source, sink, start, end = rows + cols, rows + cols + 1, rows + cols + 2, rows + cols + 3
    room: list[dict[int, int]] = [{} for _ in range(rows + cols + 4)]
    owed = [0] * (rows + cols + 4)

    def edge(a: int, b: int, least: int, most: int) -> None:
        room[a][b] = room[a].get(b, 0) + most - least
        room[b].setdefault(a, 0)
        owed[b] += least
        owed[a] -= least

    whole = sum(map(sum, table))
    for i, row in enumerate(table):
        edge(source, i, low(sum(row)), high(sum(row)))
        for j, x in enumerate(row):
            edge(i, rows + j, low(x), high(x))
    for j in range(cols):
        x = sum(row[j] for row in table)
        edge(rows + j, sink, low(x), high(x))
    edge(sink, source, low(whole), high(whole))
    for v, x in enumerate(owed):
        if x > 0:
            edge(start, v, 0, x)
        elif x < 0:
            edge(v, end, 0, -x)
    owed_now = sum(x for x in owed[: rows + cols + 2] if x > 0)
    if _max_flow(room, start, end) != owed_now:
        raise ArithmeticError("no controlled rounding was found")
    return [[low(x) + (high(x) - low(x) - room[i][rows + j]) for j, x in enumerate(row)] for i, row in enumerate(table)]


def _max_flow(room: list[dict[int, int]], start: int, end: int) -> int:
    """Shortest augmenting paths; ``room`` is left as the residual graph."""
    total = 0
    while True:
        came = {start: start}
        queue = deque([start])
        while queue and end not in came:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        if end not in came:
            return total
        path = [end]
        while path[-1] != start:
            path.append(came[path[-1]])
        path.reverse()
        step = min(room[a][b] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            room[a][b] -= step
            room[b][a] = room[b].get(a, 0) + step
        total += step


def fractional_quotas(share: list[float], least: list[float], have: list[int], size: float) -> list[float]:
    """Quotas that sum to ``size`` if the cells hold so much: shares of it, at least ``least``, at most
    ``have``; what cells fall short of is taken by the others in proportion to their shares."""
    floor = [min(a, h) for a, h in zip(least, have)]
    if sum(have) <= size:
        return list(map(float, have))
    quota = lambda f: [min(h, max(a, s * f)) for s, a, h in zip(share, floor, have)]
    if sum(floor) >= size:
        return [x * size / sum(floor) for x in floor]
    lo, hi = 0.0, max([size, *(h / s for s, h in zip(share, have) if s > 0)]) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(quota(mid)) < size else (lo, mid)
    return list(map(float, quota(hi)))


def smallest_keys(df: DataFrame, cell: list[str], key: Column, quota: DataFrame, weight: Column | None = None, tie: list[str] = ()) -> DataFrame:
    """Of each cell the rows of smallest ``key`` (a double in [0, 1)) until ``quota`` is reached.

    ``quota`` holds the cell columns (never null) and ``quota``, for any number of cells; cells without one give nothing.
    Without ``weight`` exactly so many rows are taken, with it (above 0) rows while the weight before them
    plus half their own is below the quota. Keys are counted in 65,536 buckets per cell; rows of the
    buckets before the one in which the quota is reached stay where they are, only that one bucket is
    shuffled and ordered. So a hot cell is never gathered, and what moves is a sliver of it.
    """
    w = F.lit(1) if weight is None else weight
    keyed = df.withColumn("_key", key).withColumn("_w", w).withColumn("_bucket", F.floor(F.col("_key") * BUCKETS).cast("int"))
    order = Window.partitionBy(*cell).orderBy("_bucket")
    sums = keyed.groupBy(*cell, "_bucket").agg(F.sum("_w").alias("_sum")).withColumn("_upto", F.sum("_sum").over(order))
    past = F.col("_upto") > F.col("quota")
    edges = sums.join(quota.select(*cell, "quota"), cell).groupBy(*cell, "quota").agg(F.min(F.when(past, F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_before")))).alias("_e"))
    edges = edges.select(*cell, "quota", F.coalesce("_e._bucket", F.lit(BUCKETS)).alias("_edge"), F.col("_e._before").alias("_before"))
    live = keyed.join(small_side(cut(edges)), cell).where("_bucket <= _edge")
    run = F.col("_before") + F.sum("_w").over(Window.partitionBy(*cell).orderBy("_key", *tie).rowsBetween(Window.unboundedPreceding, 0))
    limit = run <= F.col("quota") if weight is None else run - F.col("_w") / 2 < F.col("quota")
    rest = live.where("_bucket = _edge").withColumn("_take", limit).where("_take").drop("_take")
    return live.where("_bucket < _edge").unionByName(rest).drop("_key", "_w", "_bucket", "_before", "quota", "_edge")


def unit_hash(*columns: str | Column) -> Column:
    """A double in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _lines(train: DataFrame) -> DataFrame:
    """(id, type, collection, loaded_at, rec_no) of the lines that have an id; nulls where a line is in no category."""
    s, t = collection_of(clean_source("source")), clean_type("type")
    row = train.select("id", "rec_no", "loaded_at", s.alias("collection"), t.alias("type")).where("id is not null")
    has = F.col("type").isNotNull() & F.col("collection").isNotNull()
    return row.withColumns({"type": F.when(has, F.col("type")), "collection": F.when(has, F.col("collection"))})


def _cell_name(t: Column, c: Column) -> Column:
    return F.concat(t, F.lit("\t"), c)


def id_groups(train: DataFrame, names: list[str]) -> DataFrame:
    """(cells, n): how many ids have lines in exactly these of the categories ``names`` (a sorted list, empty where in none).

    An id's lines are made distinct before the shuffle, so an id that is delivered over and over is
    one row per task; ids are grouped by what they can stand for, and only groups go on.
    """
    cell = _cell_name(F.col("type"), F.col("collection"))
    cell = F.when(cell.isin(names), cell)
    per_id = _lines(train).groupBy("id").agg(F.sort_array(F.collect_set(cell)).alias("cells"))  # at most one entry per category
    return per_id.groupBy("cells").agg(F.count("*").alias("n"))


class Supply:
    """Groups of ids and the categories that they can stand for, and how they fill asked numbers by maximum flow."""

    def __init__(self, groups: list[tuple[tuple[str, ...], int]]):
        self.groups = [(tuple(c), n) for c, n in groups if c]
        self.total = sum(n for _, n in groups)

    def have(self, cell: str) -> int:
        return sum(n for cells, n in self.groups if cell in cells)

    def fill(self, asked: dict[str, int]) -> dict[tuple[int, str], int]:
        """(number of the group, category) -> ids, as many as the groups can give to the asked numbers."""
        names = sorted(asked)
        at = {c: len(self.groups) + i for i, c in enumerate(names)}
        start, end = len(self.groups) + len(names), len(self.groups) + len(names) + 1
        room: list[dict[int, int]] = [{} for _ in range(end + 1)]

        def edge(a: int, b: int, most: int) -> None:
            room[a][b], room[b][a] = most, 0

        for c, v in at.items():
            edge(v, end, asked[c])
        for i, (cells, n) in enumerate(self.groups):
            edge(start, i, n)
            for c in cells:
                if c in at:
                    edge(i, at[c], n)
        _max_flow(room, start, end)
        return {(i, c): room[at[c]][i] for i, (cells, _) in enumerate(self.groups) for c in cells if c in at and room[at[c]].get(i)}

    def reached(self, asked: dict[str, int]) -> dict[str, int]:
        out = dict.fromkeys(asked, 0)
        for (_, c), n in self.fill(asked).items():
            out[c] += n
        return out


def _supply(train: DataFrame, names: list[str]) -> Supply:
    found = id_groups(train, names).limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} different sets of categories per id")
    return Supply([(tuple(r.cells), r.n) for r in found])


def _planned(train: DataFrame, targets: DataFrame, part: float) -> tuple[list[dict], Supply, dict[tuple[int, str], int]]:
    """The rows of the plan, the supply, and which groups of ids fill which category.

    Quotas are rounded by flow over the two margins, then filled by flow from the groups of ids. Where
    ids that could stand for several categories leave one below its quota, its number is set to what
    it can reach and the rest is shared out anew, so that the sample keeps its size while ids are left.
    """
    cells = targets.select("type", "collection", "share", "min_rows").where("type is not null and collection is not null").limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError("too many target categories")
    cells.sort(key=lambda r: (r.type, r.collection))
    name = lambda r: f"{r.type}\t{r.collection}"
    supply = _supply(train, sorted({name(r) for r in cells}))
    size = supply.total * part
    have = [supply.have(name(r)) for r in cells]
    wanted = [max(float(r.min_rows or 0), (r.share or 0.0) * size) for r in cells]
    # Short by the flow itself: served before all others, a category still stops below what is wanted.
    alone = [supply.reached({name(r): math.ceil(w)})[name(r)] for r, w in zip(cells, wanted)]
    kinds, sets = sorted({r.type for r in cells}), sorted({r.collection for r in cells})
    most = list(have)
    while True:
        quotas = fractional_quotas([r.share or 0.0 for r in cells], [float(r.min_rows or 0) for r in cells], most, float(round(size)))
        grid = [[0.0] * len(sets) for _ in kinds]
        for r, q in zip(cells, quotas):
            grid[kinds.index(r.type)][sets.index(r.collection)] += q
        whole = controlled_rounding(grid)
        quota = {name(r): min(m, whole[kinds.index(r.type)][sets.index(r.collection)]) for r, m in zip(cells, most)}
        flow = supply.fill(quota)
        got = dict.fromkeys(quota, 0)
        for (_, c), n in flow.items():
            got[c] += n
        lacking = [i for i, r in enumerate(cells) if got[name(r)] < quota[name(r)]]
        if not lacking:
            break
        for i in lacking:
            most[i] = got[name(cells[i])]
    rows = [
        {"type": r.type, "collection": r.collection, "share": r.share, "min_rows": r.min_rows, "available": h, "wanted": w, "quota": quota[name(r)], "short": a < w}
        for r, h, w, a in zip(cells, have, wanted, alone)
    ]
    return rows, supply, flow


def quota_plan(train: DataFrame, targets: DataFrame, part: float = 0.25) -> DataFrame:
    """(type, collection, share, min_rows, available, wanted, quota, short) for each target category.

    ``available`` are the distinct ids with a line in the category, ``wanted`` is the larger of ``min_rows``
    and ``share`` times the sample's size (``part`` of all distinct ids); ``short`` says that the flow from
    the ids stops below it even if the category is served first. Worked out on the driver from the
    targets (at most 10,000 cells, more are refused) and the groups of ids that stand for the same categories (likewise).
    """
    rows, _, _ = _planned(train, targets, part)
    return train.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "type string, collection string, share double, min_rows int, available bigint, wanted double, quota bigint, short boolean")


def quota_sample(train: DataFrame, targets: DataFrame, part: float = 0.25, salt: str = "sample") -> DataFrame:
    """(id, rec_no, type, collection): exactly the planned quota of each category, by random keys of the ids.

    An id with lines in several categories stands for the one that the flow gives it to, with its latest
    line there. Groups of one category, nearly all, are cut by their smallest keys; in the others each
    category takes its stretch of the ranks in key order.
    """
    spark = train.sparkSession
    _, supply, flow = _planned(train, targets, part)
    stretches, at = [], {}
    for (i, c), n in sorted(flow.items()):
        begin = at.get(i, 0)
        at[i] = begin + n
        stretches.append(("\n".join(supply.groups[i][0]), *c.split("\t"), begin, begin + n))
    plan = spark.createDataFrame(stretches, "cells string, type string, collection string, begin bigint, quota bigint")
    last = F.max(F.struct("loaded_at", "rec_no")).alias("line")
    wanted = sorted({c for cells, _ in supply.groups for c in cells})
    per_line = _lines(train).where(_cell_name(F.col("type"), F.col("collection")).isin(wanted)).groupBy("id", "type", "collection").agg(last)
    per_id = per_line.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(_cell_name(F.col("type"), F.col("collection")).alias("cell"), F.col("line.rec_no").alias("rec_no")))).alias("lines"))
    per_id = cut(per_id.select("id", F.array_join("lines.cell", "\n").alias("cells"), "lines"))
    u = unit_hash(F.lit(salt), "id")
    one = smallest_keys(per_id.where("size(lines) = 1"), ["cells"], u, plan.where("not contains(cells, '\n')").select("cells", "quota"), tie=["id"])
    one = one.select("id", F.col("lines")[0]["rec_no"].alias("rec_no"), F.substring_index("cells", "\t", 1).alias("type"), F.substring_index("cells", "\t", -1).alias("collection"))
    if all(len(supply.groups[i][0]) == 1 for i, _ in flow):
        return one
    several = running_total(per_id.where("size(lines) > 1").withColumn("_key", hash_key(salt, "id")), "_key", F.lit(1), ["cells"], "_before", ["id"])
    several = several.join(plan, "cells").where("_before >= begin and _before < quota")
    line = F.filter("lines", lambda x: x["cell"] == _cell_name(F.col("type"), F.col("collection")))[0]["rec_no"]
    return one.unionByName(several.select("id", line.alias("rec_no"), "type", "collection"))


def quota_report(train: DataFrame, targets: DataFrame, part: float = 0.25) -> DataFrame:
    """The plan with how many records the sample has of each category and the share that is."""
    plan = quota_plan(train, targets, part)
    got = quota_sample(train, targets, part).groupBy("type", "collection").agg(F.count("*").alias("reached"))
    out = plan.join(got, ["type", "collection"], "left").fillna(0, ["reached"])
    return out.withColumn("reached_share", F.try_divide(F.col("reached").cast("double"), F.sum("reached").over(Window.partitionBy(F.lit(1)))))  # as many rows as targets
