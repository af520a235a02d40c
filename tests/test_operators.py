"""Operators on small rows worked out by hand."""

from __future__ import annotations

import gzip
import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwork.functions import geometry as G
from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import balance, bayes, calibrate, compare, identity, metrics, mix, ordered, scorer, validate
from gleanwork.sources import files

DIST = "array<struct<key:string,p:double>>"


def one(spark, value, *exprs):
    return tuple(spark.range(1).select(*(e for e in exprs)).first()) if value is None else tuple(spark.createDataFrame([(value,)], "v string").select(*exprs).first())


def test_scores(spark):
    d = spark.createDataFrame([([("x", 0.7), ("y", 0.3)], [("x", 0.6), ("y", 0.4)]), ([("x", 1.0)], []), ([], [])], f"g {DIST}, p {DIST}")
    got = d.select(P.nll(F.col("g"), F.col("p")), P.brier(F.col("g"), F.col("p")), P.argmax_key(F.col("p"))).collect()
    assert got[0][0] == pytest.approx(-(0.7 * math.log(0.6) + 0.3 * math.log(0.4))) and got[0][1] == pytest.approx(0.02) and got[0][2] == "x"
    assert got[1][0] == pytest.approx(-math.log(1e-12)) and got[1][2] is None and got[2][0] == 0


def test_first_of_equals_wins(spark):
    d = spark.createDataFrame([([("false", 0.5), ("true", 0.5)],)], f"probabilities {DIST}")
    assert scorer.answered(d).select("prediction", "p_prediction", "confidence").first() == ("false", 0.5, 0.0)


def test_rescaled_and_smoothed(spark):
    d = spark.createDataFrame([([("a", 0.8), ("b", 0.2)],)], f"p {DIST}")
    r = d.select(P.rescaled(F.col("p"), 2.0).alias("r"), P.smoothed(F.col("p"), 0.1).alias("s"), P.softened(F.col("p"), 0.1).alias("t"), P.swapped(F.col("p"), {"a": "b"}).alias("m")).first()
    assert r.r[0].p == pytest.approx(math.sqrt(0.8) / (math.sqrt(0.8) + math.sqrt(0.2)))
    assert [x.p for x in r.s] == pytest.approx([0.77, 0.23]) and [x.p for x in r.t] == pytest.approx([0.9, 0.1]) and [x.p for x in r.m] == pytest.approx([0.2, 0.8])


def test_text(spark):
    d = spark.createDataFrame([("How many  lamps? ", "1,200.50%", "The cat is on the mat.")], "q string, n string, s string")
    r = d.select(X.norm(F.col("q")), X.canonical_answer(F.col("n")), X.statement_to_question(F.col("s")), X.question_kind(F.col("q")), X.singular(F.lit("glasses and berries")), X.thousands(F.lit("1234567.5")), X.short_answer(F.lit("Answer: 2.")), X.template(F.lit('say "x" 12.5 times'))).first()
    assert tuple(r) == ("how many lamps", "1200.5%", "Is the cat on the mat?", "count", "glass and berrie", "1,234,567.5", "2", "say _ # times")
    r = d.select(X.words(F.lit("Isn't it 3?")), X.cyclic_orders(F.array(F.lit("a"), F.lit("b"))), X.placed(F.lit("g"), F.array(F.lit("a"), F.lit("b")), F.lit(4)), X.count_options(F.lit(0), around=2), X.lettered_options(F.lit("A: red; B: blue;")), X.clash(F.lit("two dogs"), F.lit("Dog"))).first()
    assert tuple(r) == (["is", "n't", "it", "3"], [["a", "b"], ["b", "a"]], ["a", "g", "b"], ["0", "1", "2"], ["red", "blue"], True)


def test_geometry(spark):
    a, b = G.box(*map(F.lit, (0, 0, 10, 10))), G.box(*map(F.lit, (5, 0, 10, 10)))
    r = spark.range(1).select(G.iou(a, b), G.crossing(a, b), G.relation(a, b, 2), G.box_grid(a, F.lit(20.0), F.lit(20.0), 2), F.size(G.views(F.lit(800.0), F.lit(400.0), 6, 0.1)), G.pixel_box(G.box(*map(F.lit, (0.99, 0.0, 0.0, 0.5))), F.lit(100), F.lit(10))).first()
    assert r[0] == pytest.approx(1 / 3) and r[1] and r[2] == "left" and r[3] == [1.0, 0.0, 0.0, 0.0] and r[4] == 6 and tuple(r[5]) == (99, 0, 1, 5)
    els = F.array(F.struct(F.lit("big").alias("label"), G.box(*map(F.lit, (0, 0, 100, 100))).alias("box")), F.struct(F.lit("small").alias("label"), G.box(*map(F.lit, (10, 10, 5, 5))).alias("box")))
    assert spark.range(1).select(G.tapped(els, F.lit(12), F.lit(12)), G.tapped(els, F.lit(50), F.lit(50)), G.tapped(els, F.lit(500), F.lit(5))).first() == ("small", "big", None)


def test_balance(spark):
    rows = [(i, g, a) for i, (g, a) in enumerate([("dog", "t")] * 5 + [("dog", "f")] * 2 + [("cat", "t")] * 3 + [("sky", "blue")] * 8 + [("sky", "gray")] * 3 + [(None, "x"), (None, "y")])]
    d = spark.createDataFrame(rows, "id int, g string, a string").withColumn("h", ordered.hash_key("x", "id"))
    count = lambda x: {(r.g, r.a): r["count"] for r in x.groupBy("g", "a").count().collect()}
    assert count(balance.equalize(d, "g", "a", "h", ["id"])) == {("dog", "t"): 2, ("dog", "f"): 2, ("sky", "blue"): 3, ("sky", "gray"): 3, (None, "x"): 1, (None, "y"): 1}
    top = count(balance.flatten_top(d, "g", "a", "h", ["id"]))
    assert top[("sky", "blue")] == 3 and top[("cat", "t")] == 3 and top[("dog", "t")] == 2
    assert balance.equalize(d.limit(0), "g", "a", "h", ["id"]).isEmpty() and balance.stratified(d.limit(0), "g", 5, "h", ["id"]).isEmpty()
    assert sorted(r.id for r in balance.repeat_to(d, 50, "h", "id").collect()) == sorted(r.id for r in balance.repeat_to(d.repartition(7), 50, "h", "id").collect())
    assert balance.repeat_to(d, 50, "h", "id").select("id").distinct().count() == 50
    assert balance.water_fill({"a": 1, "b": 10, "c": 10, "d": 0}, 8) == {"a": 1, "b": 4, "c": 3, "d": 0}


def test_running_totals_are_those_of_one_window(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, rng.choice([None, "a", "b"]), rng.randint(0, 9)) for i in range(3000)], "i int, g string, w int").withColumn("h", F.md5(F.col("i").cast("string")))
    got = {r.i: r.before for r in ordered.running_total(d, "h", F.col("w"), ["g"]).collect()}
    seen, want = {}, {}
    for r in sorted(d.collect(), key=lambda r: r.h):
        want[r.i] = seen.get(r.g, 0)
        seen[r.g] = want[r.i] + r.w
    assert got == want
    ring = {r.i: r.next for r in ordered.next_in_circle(d.select("i", "h"), "h", "i").collect()}
    order = [r.i for r in sorted(d.collect(), key=lambda r: r.h)]
    assert ring == dict(zip(order, order[1:] + order[:1]))


def test_hamming_join_finds_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    bits = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base] + base[:3]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    d = spark.createDataFrame(list(enumerate(signed)), "i int, h bigint")
    got = {(r.a, r.b): r.distance for r in identity.hamming_pairs(d.withColumnRenamed("i", "a"), d.withColumnRenamed("i", "b"), "a", "b", "h", 3).collect()}
    assert got == {(i, j): (x ^ y).bit_count() for i, x in enumerate(bits) for j, y in enumerate(bits) if (x ^ y).bit_count() <= 3}
    assert identity.hamming_pairs(d.limit(0).withColumnRenamed("i", "a"), d.withColumnRenamed("i", "b"), "a", "b", "h", 3).isEmpty()


def test_intervals(spark):
    p = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 5)], "k int, t int")
    i = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 400, "b"), (1, 9, 3, "backwards")], "k int, s int, e int, n string")
    assert sorted((r.t, r.n) for r in identity.covering(p, i, "k", "t", "s", "e", 7).collect()) == [(5, "a"), (10, "a"), (10, "b"), (11, "b")]
    m = spark.createDataFrame([("f", 0, 10), ("f", 12, 20), ("f", 2, 3), ("f", 100, 110)], "k string, s int, e int")
    assert sorted(map(tuple, identity.merged_ranges(m, "k", "s", "e", 5).collect())) == [("f", 0, 20, 3), ("f", 100, 110, 1)]


def test_pairs_and_bags(spark):
    s = "sample_id string, qid string, correct boolean, prediction string, t int"
    a = spark.createDataFrame([("1", "q", True, "x", 1), ("1", "q", False, "y", 2), ("2", "q", True, "x", 1)], s)
    b = spark.createDataFrame([("1", "q", True, "x", 1), ("1", "q", True, "x", 2), ("3", "q", True, "x", 1)], s)
    p = compare.paired(a, b, ["t"])
    assert tuple(compare.head_to_head(p).first()) == (0, 0, 2, 0)
    assert tuple(compare.match_bags(a, b, compare.KEY, ["t"]).first()) == (2, 1, 1)
    assert {(r.sample_id, r.problem) for r in compare.differences(a, b, compare.KEY, ["prediction"]).collect()} == {("1", "repeated"), ("2", "missing in b"), ("3", "missing in a")}


def test_bootstrap(spark):
    rows = [(f"p{i // 5}", 1.0 if (i // 5) % 2 else 0.0, 1) for i in range(250)]
    d = spark.createDataFrame(rows, "pic string, d double, n int")
    s = compare.cluster_sums(d, "pic", {"d": F.col("d"), "n": F.col("n")})
    r = compare.bootstrap_ratio(s, "d", "n", "pic", resamples=500, seed=3).first()
    again = compare.bootstrap_ratio(s.repartition(7), "d", "n", "pic", resamples=500, seed=3).first()
    assert r.estimate == 0.5 and r.n_clusters == 50 and 0.3 < r.low < 0.45 < 0.55 < r.high < 0.7
    assert (r.low, r.high) == pytest.approx((again.low, again.high))


def test_temperature_is_found(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(3000):
        z = rng.normal(size=3) * 2
        p = np.exp(z) / np.exp(z).sum()
        over = np.exp(z * 2) / np.exp(z * 2).sum()  # too sure by a factor of two
        g = rng.choice(3, p=p)
        rows.append(([(str(k), float(k == g)) for k in range(3)], [(str(k), float(over[k])) for k in range(3)], "choice:3-5"))
    d = spark.createDataFrame([*rows, *[(r[0], r[1], "choice:2") for r in rows[:45]]], f"g {DIST}, p {DIST}, bucket string")
    t = {r.bucket: r for r in calibrate.fit(d, ["bucket"], calibrate.log_grid(0.3, 8, 100), F.col("g"), F.col("p")).collect()}
    assert 1.8 < t["choice:3-5"].temperature < 2.2 and t["choice:3-5"].loss < t["choice:3-5"].loss_at_1
    assert t["choice:2"].temperature == 1.0


def test_debias_takes_the_cue_away(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        yes = rng.random() < 0.5
        cue = "always" if (rng.random() < 0.9) == yes else "never"
        rows.append((i, yes, f"the {rng.choice(['cat', 'dog', 'cow'])} is {cue} {rng.choice(['here', 'there'])}"))
    d = spark.createDataFrame(rows, "i int, yes boolean, t string").withColumn("f", X.features(F.col("t")))
    s = bayes.cross_scores(d, "i", "yes", "f").cache()
    assert bayes.accuracy(s, "yes").first().accuracy > 0.85
    kept = bayes.debias(s, "i", "yes")
    assert abs(bayes.accuracy(kept, "yes").first().accuracy - 0.5) < 0.06
    assert {r["count"] for r in kept.groupBy("yes").count().collect()}.__len__() == 1


def test_majorities_and_leave_one_out(spark):
    d = spark.createDataFrame([("k", "a")] * 3 + [("k", "b")] * 2 + [("m", "b")], "w string, a string")
    assert {r.w: r.best for r in metrics.majority(d, "w", "a").collect()} == {"k": "a", "m": "b"}
    r = metrics.loo_prior(d, "w", "a").first()
    assert (r.n, r.seen) == (6, 5) and r.accuracy == pytest.approx((3 * 0.5 + 2 * 0.0) / 5)


def test_validation(spark):
    rows = [(["red", "green"], [("red", 0.0), ("green", 1.0)], "choice"), (["red", "red"], [("blue", 0.0)], None), (["red", "green"], [("red", -1.0)], "choice"), (["a", "b"], [("a", float("nan"))], "choice"), (None, None, "choice")]
    d = spark.createDataFrame(rows, f"o array<string>, g {DIST}, t string").withColumn("e", validate.sample_errors(F.col("o"), F.col("g"), F.col("t")))
    assert [r.e for r in d.collect()] == [[], ["no type", "repeated option", "gold names no option", "gold sums to zero"], ["gold value"], ["gold value"], ["too few options", "no gold"]]
    with pytest.raises(ValueError, match="no type"):
        validate.refuse(d.withColumn("i", F.lit(1)), "e", "i")
    q = spark.createDataFrame([("x", v, o) for v in (1, 2) for o in (1, 2)] + [("y", 1, 1)] * 4, "q string, v int, o int")
    assert [tuple(r) for r in validate.full_corners(q, "q", ["v", "o"]).collect()] == [("y", 1)]


def test_mixing(spark):
    a, b = (spark.createDataFrame(r, "id string, n int") for r in ([("x", 1), ("x", 2), ("y", 3)], [("y", 9), ("z", 4)]))
    assert sorted((r.id, r.n, r.origin) for r in mix.first_wins([("a", a), ("b", b)], "id", ["n"]).collect()) == [("x", 1, "a"), ("y", 3, "a"), ("z", 4, "b")]
    with pytest.raises(ValueError, match="twice"):
        mix.strict_union([a, b], "id")
    assert mix.lineage("c", {"c": "b", "b": "a", "a": "c"}) == ["c", "b", "a"]
    assert mix.repeated_rows(a, F.col("n")).count() == 6


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl.gz"
    p.write_bytes(gzip.compress(b'{"id": "1", "gold": [{"key": "b", "p": 1}, {"key": "a", "p": 0}]}\n\n{"id": "2"}\n'))
    d = files.read_jsonl(spark, str(p), files.SAMPLE)
    assert [(r.id, [g.key for g in r.gold or []]) for r in d.orderBy("id").collect()] == [("1", ["b", "a"]), ("2", [])]
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.SAMPLE).collect()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for i in range(5):
            f.writestr(f"d/{i}.txt", f"member {i}" * 50)
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    spark.dataSource.register(files.ZipMembers)
    m = spark.read.format("zip_members").option("path", str(tmp_path / "a.zip")).option("pattern", "*.txt").option("perPartition", "2").load()
    assert {r.name: bytes(r.content).decode() for r in m.collect()} == {f"d/{i}.txt": f"member {i}" * 50 for i in range(5)}
    html = spark.createDataFrame([(1, "<div id=a>Hi <b>you</b><nav><a id=m>Menu</a></nav></div><p id=c>"), (2, None)], "k int, h string")
    assert [(r.node_id, r.tag, r.label, r.in_menu) for r in files.html_elements(html, "k", "h").orderBy("pos").collect()] == [("a", "div", "Hi you", False), ("m", "a", "Menu", True), ("c", "p", "", False)]
    (tmp_path / "l.csv").write_text("v,names\n1,\"['a', 'b']\"\n2,[]\n")
    assert [r.names for r in files.read_list_csv(spark, str(tmp_path / "l.csv"), "v int, names string", ["names"]).orderBy("v").collect()] == [["a", "b"], []]


def test_scorer_and_pictures(spark):
    def load():
        def model(rows):
            if any(r["x"] is None for r in rows):
                raise ValueError("no x")
            return [[float(r["x"]), 0.0] for r in rows]

        return model

    d = spark.createDataFrame([(1, 2), (2, None), (3, 2)], "k int, x int")
    got = {r.k: (r.logits, r.error) for r in scorer.asked(d, "k", ["x"], load).collect()}
    assert got == {1: ([2.0, 0.0], None), 2: (None, "no x"), 3: ([2.0, 0.0], None)}
    assert {r.k: r.logits for r in scorer.asked_once(d, "k", ["x"], load).collect()} == {1: [2.0, 0.0], 2: None, 3: [2.0, 0.0]}
    rng = np.random.default_rng(1)
    a = (rng.random((40, 60)) * 255).astype(np.uint8)
    noisy = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    pics = spark.createDataFrame([(0, bytearray(a.tobytes()), 60, 40), (1, bytearray(noisy.tobytes()), 60, 40), (2, bytearray(b"x"), 60, 40), (3, bytearray(a[:, ::-1].tobytes()), 60, 40)], "i int, p binary, w int, h int")
    h = {r.i: r.h for r in pics.select("i", scorer.pixel_hashes("p", "w", "h").alias("h")).collect()}
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert bits(h[0].dhash, h[1].dhash) <= 4 and bits(h[0].phash, h[1].phash) <= 4 and h[2] is None and h[3].dhash == h[0].mirror_dhash and h[0].pixel_sha != h[1].pixel_sha


def test_plans(tmp_path):
    from gleanwork.plans.pipeline import Step, from_config, ordered, run

    steps = from_config({"steps": {"b": {"kind": "fit", "needs": ["a"], "rate": 1}, "a": {"kind": "read"}}}, {"fit": {"rate"}, "read": set()})
    assert [s.name for s in steps] == ["a", "b"]
    did = []
    act = lambda s, at: did.append(s.name) or {"n": 1}
    assert run(steps, tmp_path, act) == {"a": "ran", "b": "ran"} and run(steps, tmp_path, act) == {"a": "kept", "b": "kept"}
    assert run(steps, tmp_path, act, start="b") == {"a": "kept", "b": "ran"} and did == ["a", "b", "b"]
    for bad in ([Step("a", ("b",)), Step("b", ("a",))], [Step("a", ("x",))], [Step("a"), Step("a")]):
        with pytest.raises(ValueError):
            ordered(bad)


def test_streams_are_their_batch_twins(spark, tmp_path):
    from gleanwork.streaming import streams

    rows = [(i, f"2024-01-0{1 + i % 5} 00:{i % 60:02d}:00", "ab"[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, t string, k string").withColumn("t", F.to_timestamp("t"))
    d.union(d).repartition(6).write.parquet(str(tmp_path / "in"))
    s = streams.follow_files(spark, str(tmp_path / "in"))
    assert streams.drained(streams.once(s, ["i"], "t", "30 days")).count() == 200
    w = streams.windowed(d, "t", "1 day", "1 day", ["k"], F.count("*").alias("n"))
    assert sum(r.n for r in w.collect()) == 200 and w.count() == 10
    assert streams.windowed(s, "t", "1 day", "1 day", ["k"], F.count("*").alias("n")).isStreaming
    assert sum(r.n for r in streams.sessions(d, "t", "2 hours", "1 day", ["k"]).collect()) == 200


def test_made_tables(spark):
    from gleanwork.operators import generate

    f = generate.families(spark, 500)
    assert f.where("value = twin_value").isEmpty() and {r.split for r in f.select("split").distinct().collect()} == {"tune", "confirm", "train"}
    q = generate.questions(f)
    assert q.count() == 2000 and q.where("not array_contains(options, answer)").isEmpty()
    assert generate.without_cases(f, f.where("split = 'tune'"), ["quantity", "value"]).where("split = 'tune'").isEmpty()
