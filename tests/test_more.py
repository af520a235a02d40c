"""Text, geometry, sources and validation on cases worked out by hand or by brute force."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import geometry as G
from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import calibrate, distract, identity, metrics, validate
from gleanwork.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_turns(spark):
    cases = {
        "Is it red?\nAnswer yes or no.": "Is it red?", "What shape? Your response must be concise.": "What shape?", "Answer briefly": "Answer briefly", "One.\nTwo?\nBe short": "One. Two?", "What is this?  ": "What is this?", "Which? The left one": "Which? The left one",
    }
    for t, want in cases.items():
        assert one(spark, X.question_text(F.lit(t))).c0 == want
    r = one(spark, *(X.turn(F.lit("How many?"), F.lit(a)) for a in ("Answer: 2.", "Yes.", "a red cup", "a very long answer", "")))
    assert [x and (x["class"], x.answer) for x in r] == [("number", "2"), ("yesno", "yes"), ("word", "a red cup"), None, None]
    user = "Question: Which one?\nChoices:\nA. cat\nB. dog\nAnswer with the letter."
    r = one(spark, X.choice_turn(F.lit(user), F.lit("Answer: B")), X.choice_turn(F.lit(user), F.lit("C")), X.choice_turn(F.lit("no choices"), F.lit("A")), X.literal_choice(F.lit("['a b', \"it's\"]"), F.lit("(B)")))
    assert (r.c0.question, r.c0.options, r.c0.answer) == ("Which one?", ["cat", "dog"], "dog") and r.c1 is None and r.c2 is None and (r.c3.options, r.c3["index"]) == (["a b", "it's"], 1)


def test_statements_and_answers(spark):
    r = one(spark, *(X.statement_to_question(F.lit(t)) for t in ("The box contains a cat.", "The man has a hat", "The rug touches the wall.", "A cup is full", "Nothing here")))
    assert list(r) == ["Does the box contain a cat?", "Does the man have a hat?", "Does the rug touch the wall?", "Is a cup full?", None]
    r = one(spark, *(X.canonical_answer(F.lit(t)) for t in ("grey", "Grey cat", "1,200.50%", "+007", "-0.0", ".50", "5.", "a  B", "1 000")))
    assert list(r) == ["gray", "grey cat", "1200.5%", "7", "0", ".5", "5", "a b", "1 000"]
    r = one(spark, *(X.clash(F.lit(a), F.lit(b)) for a, b in (("boxes", "box"), ("red cup", "cup"), ("cap", "cup"), ("glass", "glasses"))))
    assert list(r) == [True, True, False, True]


def test_numbers(spark):
    r = one(spark, *(X.near_numbers(F.lit(t)) for t in ("5", "1,000", "12.50%", "0", "cat", "-3")))
    assert list(r) == [["6", "4", "7", "3", "8"], ["500", "1,500", "2,000", "750", "1,250"], ["6.25%", "18.75%", "25.00%", "9.38%", "15.63%"], ["1", "2", "3"], [], ["-2", "-4", "-1", "-5", "0"]]
    spans = one(spark, X.number_spans(F.lit("7 cats, 7 dogs and 1,200.5 mice 7"))).c0
    assert [tuple(s) for s in spans] == [(0, 1, "7"), (8, 9, "7"), (19, 26, "1,200.5"), (32, 33, "7")]
    r = one(spark, X.number_labels(F.lit("-12.5"), 8), X.read_number(X.number_labels(F.lit("-12.5"), 8)), X.number_labels(F.lit("12345678"), 8), X.read_number(F.array(F.lit(1), F.lit(10), F.lit(14))), X.leading_number(F.lit("1,250 km")), X.leading_number(F.lit("km 3")))
    assert r.c1 == "-12.5" and r.c0[-1] == -1 and len(r.c0) == 8 and r.c2 is None and r.c3 is None and r.c4 == 1250 and r.c5 is None
    r = one(spark, X.product_of_square(F.lit("12"), F.lit("1,000.0")), X.product_of_square(F.lit("1.5"), F.lit("2")), X.table_text(F.lit("s"), "H", F.array(F.struct(F.lit("A").alias("object"), F.lit("m").alias("quantity"), F.lit("2").alias("value")))))
    assert r.c0 == "12,000,000" and r.c1 is None and r.c2 == "s\nH\nA: m = 2"


def test_patches_and_regions(spark):
    view = G.box(F.lit(100), F.lit(50), F.lit(200), F.lit(100))
    ps = one(spark, G.patches(view, F.lit(400.0), F.lit(300.0), 64, 4)).c0
    assert len(ps) == 16 and ps[0].cx == pytest.approx(125 / 400) and ps[0].cy == pytest.approx((50 + (8 - 16) / 0.32) / 300) and ps[5].w == pytest.approx(50 / 400)
    for b in ((110.0, 60.0, 30.0, 30.0), (90.0, 40.0, 400.0, 20.0), (0.0, 0.0, 10.0, 10.0), (149.0, 99.0, 2.0, 2.0)):
        r = one(spark, G.region(G.box(*map(F.lit, b)), view, F.lit(400.0), F.lit(300.0), 64, 4)).c0
        want = []
        for i, p in enumerate(ps):
            cx, cy, w, h = p.cx * 400, p.cy * 300, p.w * 400, p.h * 300
            ix = min(cx + w / 2, 300, b[0] + b[2]) - max(cx - w / 2, 100, b[0])
            iy = min(cy + h / 2, 150, b[1] + b[3]) - max(cy - h / 2, 50, b[1])
            if ix > 1e-9 and iy > 1e-9:
                want.append((i, (cx - b[0]) / b[2], (cy - b[1]) / b[3]))
        assert [x.patch for x in r] == [w[0] for w in want] and all(x.x == pytest.approx(w[1]) and x.y == pytest.approx(w[2]) for x, w in zip(r, want))
        assert not r or (min(x.row for x in r), min(x.col for x in r)) == (0, 0)
    g = one(spark, G.boxes_grid(F.array(G.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), G.box(F.lit(1), F.lit(1), F.lit(1), F.lit(3))), F.lit(2.0), F.lit(2.0), 2), G.boxes_grid(F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"), F.lit(2.0), F.lit(2.0), 2))
    assert sum(g.c0) == pytest.approx(1) and g.c0[0] == pytest.approx(0.25) and g.c0[3] == pytest.approx(0.75) and list(g.c1) == [0.25] * 4


def test_taps(spark):
    el = lambda label, x, y, w, h, nav=False: F.struct(F.lit(label).alias("label"), F.lit(nav).alias("nav"), G.box(*map(F.lit, (x, y, w, h))).alias("box"))
    screen = F.array(el("Open", 0, 0, 10, 10), el("Open", 50, 50, 10, 10), el("Save", 20, 0, 10, 10), el("Home", 40, 0, 5, 5, True), el("A", 70, 0, 20, 20), el("B", 75, 5, 5, 5), el("..", 0, 30, 5, 5))
    got = one(spark, *(G.tap(screen, F.lit(x), F.lit(y), 3.0) for x, y in ((5.0, 5.0), (25.0, 5.0), (32.0, 5.0), (42.0, 2.0), (76.0, 6.0), (200.0, 200.0), (2.0, 32.0))))
    assert [(x.label, x.reason) for x in got] == [(None, "label twice"), ("Save", None), ("Save", None), (None, "navigation bar"), (None, "ambiguous"), (None, "no element"), (None, "unreadable")]


def test_options(spark):
    names = lambda *xs: F.array(*map(F.lit, xs))
    r = one(spark, distract.screen_options(F.lit("OK"), names("ok", "Save", "save", "Open"), names("Back", "open", "Home", "Menu"), 3, 2, 5, F.lit("q")), distract.screen_options(F.lit("OK"), names("ok"), names("Back"), 3, 1, 5, F.lit("q")))
    assert sorted(r.c0)[:1] and {"OK", "Save", "Open"} < set(r.c0) and len(r.c0) == 5 and len({x.lower() for x in r.c0}) == 5 and r.c1 is None
    pool = F.array(*map(F.lit, (1.0, 2.0, 3.0, 8.0, 9.0)))
    r = one(spark, *(distract.ranked_numbers(F.lit(5.0), pool, 3, F.lit(k)) for k in (0, 1, 3)), distract.ranked_numbers(F.lit(5.0), pool, 6, F.lit(1)), distract.swapped_caption(F.lit("a black cup left of it"), {"left": "right", "black": "white"}), distract.swapped_caption(F.lit("a cup"), {"left": "right"}))
    assert list(r) == [[3.0, 2.0, 1.0], [8.0, 3.0, 2.0], [8.0, 9.0, 3.0], None, "a white cup left of it", None]


def test_joint_and_nearest(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(12)]
    hs = [(i, b ^ sum(1 << rng.randrange(63) for _ in range(k % 4)), rng.getrandbits(62) if k % 3 else base[0]) for i, (k, b) in enumerate((k, b) for b in base for k in range(4))]
    d = spark.createDataFrame(hs, "i int, h bigint, p bigint")
    far = lambda a, b: bin(a ^ b).count("1")
    got = {tuple(r) for r in identity.joint_hits(d.withColumnRenamed("i", "a"), d.withColumnRenamed("i", "b"), "a", "b", "h", "p", 3, 30).collect()}
    assert got == {(a, b, far(x, y), far(p, q)) for a, x, p in hs for b, y, q in hs if far(x, y) <= 3 and far(p, q) <= 30}
    got = {r.a: (r.distance, r.b) for r in identity.nearest(d.select(F.col("i").alias("a"), "h"), d.select(F.col("i").alias("b"), "h"), "a", "b", "h", 4).collect()}
    for a, x, _ in hs:
        best = min(((far(x, y), b) for b, y, _ in hs if b != a and far(x, y) <= 4), default=(None, None))
        assert got[a] == best


def test_binned_joins_equal_whole_windows(spark):
    rng = random.Random(5)
    ev = [(i, rng.choice(["u", "v", None]), rng.randint(0, 400), float(i)) for i in range(300)]
    d = spark.createDataFrame(ev, "i int, u string, t int, v double")
    right = d.where("i % 3 = 0").groupBy("u", "t").agg(F.max("v").alias("v"))
    left = d.where("i % 3 = 1").select("i", "u", "t")
    assert rows(identity.nearest_before(left, right, ["u"], "t", "v")) == rows(identity.nearest_before(left, right, ["u"], "t", "v", F.floor(F.col("t") / 30)))
    r = d.select("u", F.col("t").alias("a"), (F.col("t") + F.col("i") % 7).alias("b"))
    want = rows(identity.merged_ranges(r, "u", "a", "b", 1, 10, 10_000))
    assert want == rows(identity.merged_ranges(r, "u", "a", "b", 1, 10, 7)) and len(want) > 20


def test_out_of_fold(spark):
    dist = "array<struct<key:string,p:double>>"
    rng = random.Random(1)
    data = [([("a", float(k := rng.random() < 0.5)), ("b", float(not k))], [("a", 0.9), ("b", 0.1)], f"f{i % 2}", "x") for i in range(200)]
    d = spark.createDataFrame(data, f"g {dist}, p {dist}, fold string, bucket string")
    got = calibrate.out_of_fold(d, "fold", "bucket", [1.0, 2.0, 8.0], F.col("g"), F.col("p"))
    assert got.count() == 200 and {r[0] for r in got.select("temperature").distinct().collect()} == {8.0}
    assert {r[0] for r in calibrate.out_of_fold(d, "fold", "bucket", [8.0], F.col("g"), F.col("p"), least=101).select("temperature").distinct().collect()} == {1.0}
    many = [(f"k{j}", 1 / 255) for j in range(255)]
    assert calibrate.fit(spark.createDataFrame([(many, many, "b"), ([], [], None), (None, None, "n")], f"g {dist}, p {dist}, bucket string"), ["bucket"], [0.5, 1.0], F.col("g"), F.col("p"), 1).count() == 3


def test_quantiles(spark):
    rng = random.Random(3)
    vs = [(rng.choice("ab"), rng.choice([None, float("nan"), 0.0, -rng.random(), rng.random() * 10 ** rng.randint(0, 6), 7.0])) for _ in range(2000)]
    d = spark.createDataFrame(vs, "g string, v double")
    got = {r.g: r for r in metrics.quantiles(d, "v", ["g"], [0.1, 0.5, 0.95]).collect()}
    for g in "ab":
        x = sorted(v for k, v in vs if k == g and v is not None and v == v)
        for i, q in enumerate((0.1, 0.5, 0.95)):
            at = (len(x) - 1) * q
            assert got[g][f"q{i}"] == pytest.approx(x[int(at)] + (x[min(len(x) - 1, int(at) + 1)] - x[int(at)]) * (at - int(at)))


def test_averaged_orders(spark):
    dist = "array<struct<key:string,p:double>>"
    d = spark.createDataFrame([("s", [("a", 0.6), ("b", 0.4)]), ("s", [("b", 0.2), ("a", 0.8)]), ("t", []), (None, [("a", 1.0)])], f"s string, p {dist}")
    got = {r.s: (r.n, [(e.key, round(e.p, 6)) for e in r.probabilities]) for r in P.averaged(d, ["s"], "p").collect()}
    assert got == {"s": (2, [("a", 0.7), ("b", 0.3)])}


def test_requests_and_weights(spark):
    part = lambda t, i: F.struct(F.lit(t).cast("string").alias("text"), F.lit(i).cast("string").alias("image"))
    ask = lambda *o: F.struct(F.array(*map(F.lit, o)).alias("options"))
    r = one(spark, validate.split_state(F.array(part("a", None), part(None, "p"), part("b", "q"))), validate.request_errors(F.array(part(None, "p"), part(None, "q")), F.lit("z"), F.array(ask("a", "a"))), validate.request_errors(F.array(part("a", None)), F.lit("z"), F.array(ask("a", "b"))))
    assert tuple(r.c0) == ("a\nb", "p", 2) and r.c1 == ["repeated option", "several pictures", "picture given twice"] and r.c2 == []
    d = spark.createDataFrame([(1, {"q": 1.0}, ["q"]), (2, {"q": -1.0}, ["q"]), (3, {"x": float("nan")}, ["q"])], "i int, w map<string,double>, q array<string>")
    assert rows(validate.weight_errors(d, "i", "w", "q")) == [(2, ["weight value"]), (3, ["weight value", "weight of no question"])]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": \n{"id": "2"}\n')
    assert [tuple(r) for r in files.bad_lines(spark, f"{tmp_path}/a.jsonl", "id string").collect()] == [("a.jsonl", 3, '{"id": ')]
    (tmp_path / "t.csv").write_text('Year, "Sales, net"\n2001, "1,5"\n\n2002,\n')
    assert rows(files.cells(spark, f"{tmp_path}/t.csv")) == [("t.csv", 0, 0, "Year"), ("t.csv", 0, 1, "Sales, net"), ("t.csv", 1, 0, "2001"), ("t.csv", 1, 1, "1,5"), ("t.csv", 3, 0, "2002"), ("t.csv", 3, 1, "")]
    (tmp_path / "i.json").write_text(json.dumps({"images": [{"id": 1, "width": 4, "height": 3}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [0, 1, 2, 3], "area": 6, "iscrowd": 0}, {"image_id": 1, "category_id": 7, "bbox": [0, 0, 1, 1], "area": 1, "iscrowd": 1}], "categories": [{"id": 7, "name": "cat"}]}))
    images, boxes = files.instances(spark, f"{tmp_path}/i.json")
    assert rows(images) == [(1, 4, 3)] and rows(boxes) == [(1, "cat", 0.0, 1.0, 2.0, 3.0, 6.0)]
    (tmp_path / "s.csv").write_text("v,start,what\nx,5,b\nx,1,a\ny,2,c\n")
    got = files.segments(spark, f"{tmp_path}/s.csv", "v string, start int, what string", "v", "start").collect()
    assert {r.v: [tuple(s) for s in r.segments] for r in got} == {"x": [(1, "a"), (5, "b")], "y": [(2, "c")]}
    q, a = spark.createDataFrame([(1, "Q")], "question_id int, question string"), spark.createDataFrame([(1, "yes"), (2, "no")], "question_id int, answer string")
    assert rows(files.answered_questions(q, a)) == [(1, "Q", "yes")] and rows(files.only_ids(a, q, "question_id", ["answer"])) == [("yes",)]
    a.write.parquet(f"{tmp_path}/deep/x-1.parquet")
    assert files.matching(spark, f"{tmp_path}/deep", "*.parquet").count() == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"m{i}.txt", f"text {i}" * 50)
    spark.dataSource.register(files.ZipMembers)
    got = spark.read.format("zip_members").option("path", f"file://{tmp_path}/z.zip").option("perPartition", 2).load()
    assert {r.name: bytes(r.content).decode() for r in got.collect()} == {f"m{i}.txt": f"text {i}" * 50 for i in range(5)}


def test_teacher_is_required(spark):
    from gleanwork.operators import compare

    dist = "array<struct<key:string,p:double>>"
    a = spark.createDataFrame([("s", "q", [("x", 1.0)]), ("t", "q", [("x", 1.0)])], f"sample_id string, qid string, gold {dist}")
    t = spark.createDataFrame([("s", "q", [("x", 0.5)], 1), ("s", "q", [("x", 0.25)], 2)], f"sample_id string, qid string, probabilities {dist}, at int")
    with pytest.raises(ValueError, match="t/q"):
        compare.with_teacher(a, t, ["sample_id", "qid"], ["at"])
    kept = {r.sample_id: r.teacher and r.teacher[0].p for r in compare.with_teacher(a, t, ["sample_id", "qid"], ["at"], missing="keep").collect()}
    assert kept == {"s": 0.25, "t": None}


def test_picture_kernels(spark):
    import numpy as np

    from gleanwork.operators import scorer

    a = np.arange(12 * 6, dtype=float).reshape(6, 12)
    box = scorer.letterboxed(a, 4, 9.0)
    assert box.shape == (4, 4) and (box[0] == 9).all() and (box[3] == 9).all() and box[1:3].mean() == pytest.approx(a.mean())
    assert box[1, 0] == pytest.approx(a[:3, :3].mean()) and scorer.letterboxed(np.dstack([a, a * 2]), 4)[1, 0, 1] == pytest.approx(2 * a[:3, :3].mean())
    v = scorer.view_pixels(a, [(0, 0, 12, 6), (6, 0, 6, 6)], 4)
    assert v.shape == (2, 4, 4) and v[1].mean() == pytest.approx(a[:, 6:].mean())
    rng = np.random.default_rng(1)
    p = rng.integers(0, 255, (20, 30)).astype(np.uint8)
    d = spark.createDataFrame([(bytearray(p.tobytes()), 30, 20), (bytearray(np.ascontiguousarray(p[:, ::-1]).tobytes()), 30, 20), (None, 3, 3), (bytearray(b"x"), 3, 3)], "p binary, w int, h int")
    x, y, *none = [r[0] for r in d.select(scorer.pixel_hashes("p", "w", "h")).collect()]
    assert (x.dhash, x.phash, x.mirror_dhash, x.mirror_phash) == (y.mirror_dhash, y.mirror_phash, y.dhash, y.phash) and x.pixel_sha != y.pixel_sha and none == [None, None]


def test_stages_and_kept_tables(spark, tmp_path):
    from gleanwork.plans import pipeline

    config = {"steps": {"a": {"train": ["x", "y"], "eval": "z"}, "b": {"calibration": "z"}, "c": {}}}
    assert rows(pipeline.stage_files(spark, config)) == [("x", "train", "a"), ("y", "train", "a"), ("z", "calibration", "b"), ("z", "eval", "a")]
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    def get(text):
        (tmp_path / "held.txt").write_text(text)
        return pipeline.kept_table(spark, f"{tmp_path}/kept", files.file_hashes(spark, f"{tmp_path}/held.txt"), make).count()

    assert [get("one"), get("one"), get("two"), get("one")] == [1, 1, 2, 1] and len(made) == 2
