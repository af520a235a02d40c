"""Packing by counts against packing one by one; greedy groups; calls; intervals of metrics."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import intervals, packing
from gleanwork.operators.ordered import hash_key


def first_fit(sizes, most):
    rooms = []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= s), None)
        if i is None:
            rooms.append(most)
            i = len(rooms) - 1
        rooms[i] -= s
    return sorted(rooms)


def test_first_fit_by_counts():
    rng = random.Random(4)
    for _ in range(300):
        most = rng.randint(1, 30)
        sizes = [rng.randint(1, most) for _ in range(rng.randint(0, 80))]
        rooms, given = defaultdict(lambda: most), Counter()
        for size, a, z, first, per in packing.first_fit_plan(Counter(sizes), most):
            assert a == given[size]
            for k in range(a, z):
                rooms[first + (k - a) // per] -= size
            given[size] = z
        assert given == Counter(sizes) and sorted(rooms.values()) == first_fit(sizes, most)
    with pytest.raises(ValueError):
        packing.first_fit_plan({9: 1}, 8)


def test_batches(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 2, 3, 5, 8, None, 0]), rng.choice(["text", "picture", None]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "unit int, size int, mode string, batch_like string").withColumn("h", hash_key("b", "unit"))
    got = packing.batches(df, "unit", "size", "mode", 8, "h").collect()
    assert sorted(r.unit for r in got) == sorted(i for i, s, *_ in rows if s)
    for m in ("text", "picture", None):
        held = Counter()
        for r in got:
            if r.mode == m:
                held[r.batch] += r.size
        assert max(held.values()) <= 8 and sorted(8 - x for x in held.values()) == first_fit([s for _, s, k, _ in rows if s and k == m], 8) and set(held) == set(range(len(held)))
    assert packing.batches(df.limit(0), "unit", "size", "mode", 8, "h").isEmpty()


def test_calls(spark):
    df = spark.createDataFrame([(s, i, n) for s in (0, 1, None) for i, n in enumerate([3, 3, 3, 9, 1, None, 7])], "shard int, i int, n int")
    got = {(r.shard, r.i): r.call for r in packing.calls(df, "shard", ["i"], "n", 8).collect()}
    assert all([got[s, i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 3] for s in (0, 1, None))


def test_groups_that_fit(spark):
    rng = random.Random(2)
    for limit in (0, 7, 40, 1000):
        sizes = {f"g{i}": rng.randint(1, 15) for i in range(25)}
        df = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)] + [(None, 1)], "g string, k int")
        order = sorted((r.h, r.g) for r in df.where("g is not null").select("g", hash_key("f", "g").alias("h")).distinct().collect())
        want, room = set(), limit
        for _, g in order:
            if sizes[g] <= room:
                want.add(g)
                room -= sizes[g]
        got = packing.first_that_fit(df, "g", limit, hash_key("f", "g"))
        assert {r.g for r in got.collect()} == want and got.count() == limit - room


def test_capped_groups(spark):
    df = spark.createDataFrame([(f"g{i % 6}", f"e{i % 30}", i) for i in range(240)], "g string, e string, i int")
    got = packing.capped_groups(df, "g", "e", 50, 20, hash_key("g", "g"), hash_key("e", "e")).collect()
    per, eps = Counter(r.g for r in got), Counter((r.g, r.e) for r in got)
    assert set(per.values()) == {24} and set(eps.values()) == {8} and len(per) == 3


DIST = "array<struct<key:string,p:double>>"


def pair_rows(spark, rows):
    both = [(f"q{i}", c, s, g, "true" if a == (g == "true") else "false", a, "true" if b == (g == "true") else "false", b) for i, (c, s, g, a, b) in enumerate(rows)]
    d = spark.createDataFrame(both, "q string, picture string, source string, g string, pa string, ca boolean, pb string, cb boolean")
    dist = lambda c: F.array(F.struct(F.lit("false").alias("key"), (c == "false").cast("double").alias("p")), F.struct(F.lit("true").alias("key"), (c == "true").cast("double").alias("p")))
    cols = {}
    for s, p, c in (("a", "pa", "ca"), ("b", "pb", "cb")):
        cols |= {f"correct_{s}": F.col(c), f"prediction_{s}": F.col(p), f"gold_answer_{s}": F.col("g"), f"gold_{s}": dist(F.col("g")), f"probabilities_{s}": F.transform(dist(F.col(p)), lambda e: F.struct(e["key"].alias("key"), (e["p"] * 0.8 + 0.1).alias("p")))}
    return d.withColumns(cols)


def test_paired_metrics(spark):
    # Three positives and a negative: balanced accuracy (1/3 + 0) / 2 for a, 1 for b.
    p = pair_rows(spark, [("i1", "s", "true", True, True), ("i1", "s", "true", False, True), ("i2", "s", "true", False, True), ("i3", "s", "false", False, True)])
    got = {r.metric: r for r in intervals.paired_metric(p, "picture", resamples=200).collect()}
    assert got["balanced"].a == pytest.approx(1 / 6) and got["balanced"].b == 1 and got["recall"].a == pytest.approx(1 / 3) and got["fpr"].a == 1 and got["fpr"].b == 0
    # Macro weighs sources alike: 3 rows of one, 1 of another.
    p = pair_rows(spark, [("i1", "big", "true", True, False), ("i2", "big", "true", True, False), ("i3", "big", "true", True, False), ("i4", "small", "true", False, True)])
    got = {r.metric: r for r in intervals.paired_metric(p, "picture", stratum="source", resamples=200).collect()}
    assert got["macro"].difference == 0 and got["accuracy"].difference == -0.5 and got["fpr"].a is None and got["fpr"].low is None


def test_intervals_cover(spark):
    rng = random.Random(6)
    rows = [(f"i{k}", "s", "true", rng.random() < 0.5, rng.random() < 0.7) for k in range(100) for _ in range(3)]
    for rule in ("order", "inner", "linear"):
        r = next(x for x in intervals.paired_metric(pair_rows(spark, rows), "picture", resamples=400, rule=rule).collect() if x.metric == "accuracy")
        assert r.low < r.difference < r.high and 0.05 < r.high - r.low < 0.4 and r.kept == 400
    d = pair_rows(spark, rows)
    same = F.col("correct_a")
    x = intervals.difference_in_differences(d, (same, F.col("correct_b"), same, F.col("correct_b")), "picture", resamples=200).first()
    assert x.estimate == 0 == x.low == x.high
