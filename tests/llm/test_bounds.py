"""Bounds that must not change results: many cells, either way of the component search, ids of several categories, phrases and short words."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.llm import mixing, overlap, quota, skeleton, splits

DAY = datetime(2025, 1, 1)
ALIAS = "alias_id string, image_id string, added_at timestamp"


def test_every_cell_is_served(spark):
    n = 12_000
    d = spark.range(n * 2).select("id", (F.col("id") % n).alias("c")).withColumn("k", quota.unit_hash("id"))
    q = spark.range(n).select(F.col("id").alias("c"), F.lit(1.0).alias("quota"))
    got = quota.smallest_keys(d, ["c"], F.col("k"), q, tie=["id"])
    assert got.agg(F.count("*"), F.count_distinct("c")).first() == (n, n)


def test_labels_and_splits_do_not_depend_on_the_way_of_the_search(spark):
    rows = [(i, f"i{i}", f"harbor/b{(i * 7919) % 400}", f"harbor:{(i * 104729) % 900}") for i in range(1500)]
    df = spark.createDataFrame(rows, "rec_no bigint, id string, source string, image_id string")
    al, targets = spark.createDataFrame([], ALIAS), spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    one, other = (sorted(map(tuple, splits.record_splits(df, al, targets, seed_edges=e).collect())) for e in (200_000, 0))
    assert one == other and len(one) == len(rows)
    got = splits.components(spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "z")], "a string, b string")).collect()
    assert {r.v: r.label for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "z": "x"}


def test_a_hub_is_kept_in_parts(spark, monkeypatch):
    links = spark.createDataFrame([("hub", f"v{i:03}") for i in range(60)] + [("v000", "w"), ("p", "q")], "a string, b string")
    spread = splits._spread
    monkeypatch.setattr(splits, "_spread", lambda e: spread(e, 10))
    got = {r.v: r.label for r in splits.components(links).collect()}
    assert len(got) == 64 and {got[v] for v in got if v not in "pq"} == {"hub"} and got["q"] == "p"


def test_split_cuts_follow_the_shares():
    wanted = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    totals = {9: {17: 600}, 5: {5: 40, 900: 33}, 0: {b: 1 for b in range(0, 4000, 4)}}
    cuts = splits._cuts(totals, wanted)
    got = Counter()
    for size, t in totals.items():
        for b, n in t.items():
            got[wanted[sum(c <= b for c in cuts[size])][0]] += n
    assert sum(got.values()) == 1673 and all(abs(got[s] / 1673 - x) < 0.01 for s, x in wanted)


def test_ids_of_several_categories_fill_the_sample(spark):
    line = lambda i, kind, source: (i, f"i{i}", source, kind, DAY)
    rows = [line(i, "noul", "tern/b1") for i in range(400)] + [line(i, "choice", "tern/b1") for i in range(200)]
    df = spark.createDataFrame([(r[0] + 1000 * k, *r[1:]) for k, r in enumerate(rows)], "rec_no bigint, id string, source string, type string, loaded_at timestamp")
    targets = spark.createDataFrame([("noul", "tern", 0.81, 1), ("choice", "tern", 0.19, 1)], "type string, collection string, share double, min_rows int")
    got = quota.quota_sample(df, targets, part=1.0).collect()
    assert Counter(r.type for r in got) == {"noul": 324, "choice": 76} and len({r.id for r in got}) == 400
    want = {r[0] + 1000 * k: (r[1], r[3]) for k, r in enumerate(rows)}
    assert all(want[r.rec_no] == (r.id, r.type) for r in got)
    targets = spark.createDataFrame([("noul", "tern", 0.1, 1), ("choice", "tern", 0.9, 1)], "type string, collection string, share double, min_rows int")
    report = {r.type: r for r in quota.quota_report(df, targets, part=1.0).collect()}
    assert report["choice"].short and report["choice"].reached == 200 and report["noul"].reached == 200 and not report["noul"].short


def test_mixture_of_twenty_thousand_sources(spark):
    n = 20_000
    tokens = spark.range(n * 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("source"), F.lit(1).alias("max_repeats"), F.lit("en").alias("lang"), F.lit("none").alias("topic"), F.lit(10).cast("bigint").alias("tokens"))
    weights = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(1.0 / n).alias("weight"), F.lit(1).alias("max_repeats"))
    assert mixing.mixture(tokens, weights).agg(F.count_distinct("source")).first()[0] == n


def overlap_of(spark, train, held, **more):
    row = "rec_no bigint, source string, image_id string, instructions string"
    side = lambda texts, at: spark.createDataFrame([(at + i, "tern/b1", f"tern:{p}", t) for i, (p, t) in enumerate(texts)], row)
    return {(r.train_no, r.held_no - 100_000) for r in overlap.overlaps(side(train, 0), side(held, 100_000), spark.createDataFrame([], ALIAS), **more).collect()}


def test_phrases_are_learnt(spark):
    things = [a + b for a in ("lamp", "kettle", "window", "statue", "bicycle", "drum") for b in ("", "post", "stand", "case", "works")]
    asks = [f"Is there a {x} in the picture?" for x in things] + [f"What color is the {x}?" for x in things] + [f"How many {x} handles are shown?" for x in things]
    where = [f"Is there a {x} in the picture on the table?" for x in things] + [f"What color is the {x} on the table?" for x in things] + [f"What stands on the table near the {x}?" for x in things] + [f"How many {x} handles are shown on the table?" for x in things]
    tails = ["Respond using a single word", "Choose from the options below", "Explain briefly"]
    train = [(i, q) for i, q in enumerate(asks + where)]
    held = [(i, f"{q} {tails[i % 3]}.") for i, q in enumerate(asks)] + [(len(asks) + i, f"Take a look: {q}") for i, q in enumerate(where)] + [(i, q.replace("?", " on the table?")) for i, q in enumerate(asks)]
    got = overlap_of(spark, train, held, leads=(), tails=())
    assert got == {(i, i) for i in range(len(train))}


def test_slips_in_short_words(spark):
    base = [(i, "Is the cat on the mat?") for i in range(300)] + [(i, f"Is the dog near box {i % 9}?") for i in range(300)]
    held = [(1, "Is teh cat on the mat?"), (2, "Is the cta on the mat?"), (3, "si the cat on the mat?"), (4, "Is the cat on the matt?"), (5, "Is the cat no the mat?"), (6, "Is the dog near box 71?"), (7, "Is the cow on the mat?"), (8, "Is the cst on the mat?")]
    got = overlap_of(spark, base, held)
    assert {(i, i - 1) for i in (1, 2, 3, 4, 5, 8)} == got


def test_lists_are_cut(spark):
    left = spark.createDataFrame([("p", "w", f"a{i}") for i in range(50)] + [("q", "w", "a1")], "picture string, word string, a string")
    right = spark.createDataFrame([("p", "w", f"b{i}") for i in range(3)] + [("q", "w", "b9")], "picture string, word string, b string")
    got = [tuple(r) for r in overlap._paired_lists(left, right, 7).collect()]
    assert len(got) == 151 == len(set(got))


def test_public_confusables(spark):
    of = skeleton.Skeleton(skeleton.prototypes(spark))
    for a, b in (("ꓐꓔꓳ", "BTO"), ("ⲔⲞ", "KO"), ("ꮯ", "c"), ("⍺", "a"), ("ιυ", "iu"), ("о", "o"), ("ø", "o̸")):
        assert of(a) == of(b), (a, b)
    for a, b in (("I", "l"), ("O", "0"), ("1", "l"), ("m", "rn"), ("æ", "ae"), ("ı", "i"), ("‘", "'"), ("−", "-"), ("👩‍🔬", "👩🔬"), ("🏴\U000e0067\U000e007f", "🏴"), ("²", "2"), ("é", "e")):
        assert of(a) != of(b), (a, b)
    assert all(of(c) == c for c in map(chr, range(0x21, 0x7F)))


def test_many_copies_and_one_variant_are_linear(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "расе").otherwise("pace").alias("text"))
    got = skeleton.lookalike_pairs(df)
    assert got.agg(F.count("*"), F.count_if((F.col("doc_a") == 7) | (F.col("doc_b") == 7))).first() == (59_999, 59_999)
