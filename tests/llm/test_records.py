"""Pictures, overlaps, splits, samples and mixtures against brute force on small tables."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanwork.llm import mixing, overlap, quota, splits
from gleanwork.operators import pictures

ALIAS = "alias_id string, image_id string, added_at timestamp"
TRAIN = "rec_no bigint, id string, source string, image_id string, type string, instructions string, loaded_at timestamp, picture string, label string"
DAY = datetime(2025, 1, 1)


def train(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], DAY, "clash", "clash") for r in rows], TRAIN)


def aliases(spark, rows=()):
    return spark.createDataFrame([(a, b, t if isinstance(t, datetime) else DAY) for a, b, *t_ in rows for t in (t_[0] if t_ else None,)], ALIAS)


def test_picture_names(spark):
    same = ["tern:42", "TERN:0042", " tern : 42", "tern/42", "tern/images/00042.jpg", "data/tern/images/42.png", "tern:42:flip", "Tern_42", "tern-42", "42", "00042", "arc:7", "ARC:007 ", "legacy:3", "s3://x/tern/images/42.webp"]
    none = [None, "", " ", "-", "n/a", "unknown", "none", "legacy:4", "loop:1"]
    al = aliases(spark, [("arc:7", "tern:42"), ("arc:7", "tern:42"), ("legacy:3", "arc:7"), ("legacy:4", None), ("loop:1", "loop:2"), ("loop:2", "loop:1"), ("arc:9", "tern:1", datetime(2024, 1, 1)), ("arc:9", "tern:2", datetime(2025, 6, 1))])
    df = spark.createDataFrame([(s, "Tern_b3") for s in same] + [(s, "tern/b3") for s in none] + [("42", "kiln/b1"), ("42", None), ("arc:9", None), ("arc:77", None)], "image_id string, source string")
    got = {(r.image_id, r.source): r.picture for r in pictures.with_picture(df, al).collect()}
    assert {got[s, "tern/b3"] for s in same} == {"tern:42"} and {got[s, "tern/b3"] for s in none} == {None}
    assert got["42", "kiln/b1"] == "kiln:42" and got["42", None] is None and got["arc:9", None] == "tern:2" and got["arc:77", None] == "arc:77"
    assert pictures.alias_ends(aliases(spark)).isEmpty()


def test_long_alias_chain(spark):
    al = aliases(spark, [(f"old:{i}", f"old:{i + 1}") for i in range(1, 70)] + [("old:70", "tern:5")])
    assert {r.end for r in pictures.alias_ends(al).collect()} == {"tern:5"}


ASK = {
    "Is there a red lantern in the image?": ["is there a red lantern in this picture", "Q) IS THERE A RED LANTERN IN THE PHOTO?", "Please answer: Is there a red lantren in the image? Answer yes or no.", "Is thеre​ a rеd lantern in the image?!  (yes/no)", "Is there a red laantern in the iamge?"],
    "Is the lantern above the kettle?": ["Looking at the picture, is the lantern above the kettle", "Is the lanern above the kettl?"],
    "Is the kettle above the lantern?": [],
    "Is the lantern below the kettle?": [],
    "Is there a blue lantern in the image?": [],
    "Is there a lantern in the image?": [],
    "Is there a lamp in the image?": [],
}


def asked(rng):
    """Rows of both sides with which question they ask; every clean wording is frequent enough to be settled."""
    t, v, truth = [], [], {}
    slips = ("lantren", "laantern", "lanern")
    clean = [(w, k) for k, (q, more) in enumerate(ASK.items()) for w in [q, *more] if not any(x in w for x in slips)]
    forms = [(w, k) for k, (q, more) in enumerate(ASK.items()) for w in [q, *more]]
    for p in range(120):
        for _ in range(3):
            w, k = rng.choice(forms if p < 12 else clean)
            t.append((len(t), f"t{len(t)}", "tern/b1", f"tern:{p}", None, w))
            truth[t[-1][0]] = (p, k)
        w, k = rng.choice(forms if p < 12 else clean)
        v.append((10_000 + len(v), f"v{len(v)}", "tern/v1", f"{p:05d}", None, w))
        truth[v[-1][0]] = (p, k)
    return t, v, truth


def test_overlaps(spark):
    t, v, truth = asked(random.Random(8))
    t += [(9000, "x", "tern/b1", None, None, "Is there a lamp in the image?"), (9001, "x", "tern/b1", "tern:1", None, None), (9002, "x", "tern/b1", "tern:1", None, "?!"), (9003, "x", "tern/b1", "-", None, "Is there a lamp in the image?"), (9004, "x", "tern/b1", "tern:1", None, "word " * 3000)]
    v += [(19000, "x", None, "unknown", None, "Is there a lamp in the image?"), (19001, "x", None, "1", None, "Is there a lamp in the image?")]
    want = {(a[0], b[0]) for a in t for b in v if a[0] in truth and b[0] in truth and truth[a[0]] == truth[b[0]]}
    tr, va = train(spark, t), train(spark, v).withColumn("split", F.lit("val"))
    got = list(map(tuple, overlap.overlap_pairs(tr, va, aliases(spark)).collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    counts = {r.source: r for r in overlap.overlap_counts(tr, va, aliases(spark)).collect()}
    assert counts["tern/v1"].n_pairs == len(want) and counts["tern/v1"].n_held == len({b for _, b in want}) and counts["tern/v1"].n_train == len({a for a, _ in want}) and counts[None].n_pairs == 0
    assert overlap.overlap_pairs(tr.limit(0), va, aliases(spark)).isEmpty() and overlap.overlap_pairs(tr, va.limit(0), aliases(spark)).isEmpty()


def test_pruning_loses_nothing(spark):
    """Every pair of vectors above the threshold shares a head word."""
    rng = random.Random(4)
    cores = sorted({" ".join(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randint(1, 7))) for _ in range(150)})
    df = spark.createDataFrame([(c, rng.randint(1, 5)) for c in cores], "core string, n bigint")
    vec = {r.core: (r.vector, set(r.heads)) for r in overlap.core_vectors(df, 0.5).collect()}
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for v, _ in vec.values())
    near = 0
    for a, b in itertools.combinations(cores, 2):
        if sum(x * vec[b][0].get(w, 0.0) for w, x in vec[a][0].items()) >= 0.5:
            near += 1
            assert vec[a][1] & vec[b][1]
    assert near > 100 and any(len(h) < len(v) for v, h in vec.values())


def test_slips():
    for a, b in (("kettle", "ketle"), ("kettle", "kketle"), ("kettle", "kettel"), ("kettle", "kettlle"), ("kettle", "kattle"), ("ab", "ba")):
        assert overlap.one_slip(a, b) == (a != "kettle" or b != "kketle") and overlap.one_slip(b, a) == overlap.one_slip(a, b)
    assert not overlap.one_slip("kettle", "kettle") and not overlap.one_slip("abcd", "badc")


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for x in list(up):
        out[top(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_components(spark, bound):
    rng = random.Random(6)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(90)] + [("hub", f"h{i}") for i in range(200)] + [(f"r{rng.randint(0, 150)}", f"r{rng.randint(0, 150)}") for _ in range(90)] + [("x", "x"), ("x", None), ("c5", "c4")] * 2
    df = spark.createDataFrame(pairs, "a string, b string")
    got = defaultdict(set)
    for r in splits.components(df, bound).collect():
        got[r.label].add(r.v)
    assert {frozenset(v) for v in got.values()} == union_find([(a, b) for a, b in pairs if b is not None and a != b])
    assert splits.components(df.limit(0), bound).isEmpty()


def source_rows(rng):
    rows = [(i, f"i{i}", f"tern/b{i % 40}", f"tern:{1000 + i}", None, None) for i in range(4000)]
    rows += [(5000 + i, f"h{i}", "quill/b1", f"quill:{i % 300}", None, None) for i in range(2500)]
    rows += [(8000 + i, f"j{i}", f"kiln/b{i}", f"quill:{i}", None, None) for i in range(30)]
    rows += [(9000 + i, f"k{i}", f"slate/b{rng.randint(0, 30)}", f"slate:{rng.randint(0, 60)}", None, None) for i in range(60)]
    rows += [(9500, "n", None, "quill:3", None, None), (9501, "n2", None, "ember:1", None, None), (9502, "n3", None, "ember:1", None, None), (9503, "n4", None, None, None, None), (9504, None, None, None, None, None), (9505, "m", "marrow/b1", "-", None, None), (9506, "m2", "marrow/b2", "-", None, None)]
    return rows


def test_splits(spark):
    rows = source_rows(random.Random(2))
    df, al = train(spark, rows), aliases(spark)
    ties = [("s" + r[2], "p" + r[3]) for r in rows if r[2] and r[3] and r[3] != "-"]
    want = set()
    for c in union_find(ties):
        want |= set(itertools.combinations(sorted(x[1:] for x in c if x[0] == "s"), 2))
    for block in (5, 1000):
        got = list(map(tuple, splits.tied_sources(df, al, block).collect()))
        assert len(got) == len(set(got)) and set(got) == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, share double")
    out = {r.rec_no: r.split for r in splits.record_splits(df, al, targets).collect()}
    assert set(out) == {r[0] for r in rows}
    for c in union_find(ties):
        assert len({out[r[0]] for r in rows if r[2] and "s" + r[2] in c}) == 1
    assert out[9500] == out[5000] and out[9501] == out[9502]
    share = Counter(out.values())
    assert all(abs(share[s] / len(rows) - x) < 0.03 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert splits.record_splits(df.limit(0), al, targets).isEmpty() and splits.tied_sources(df.limit(0), al).isEmpty()


def test_controlled_rounding():
    rng = random.Random(3)
    for _ in range(200):
        t = [[rng.choice([0.0, rng.random() * 5, float(rng.randint(0, 3))]) for _ in range(rng.randint(1, 6))]]
        t += [[rng.random() * 5 for _ in t[0]] for _ in range(rng.randint(0, 5))]
        got = quota.controlled_rounding(t)
        near = lambda x, n: math.floor(x + 1e-5) <= n <= math.ceil(x - 1e-5) or abs(x - n) < 1e-5
        assert all(near(x, n) for a, b in zip(t, got) for x, n in zip(a, b))
        assert all(near(sum(a), sum(b)) for a, b in zip(t, got)) and all(near(sum(a), sum(b)) for a, b in zip(zip(*t), zip(*got)))
        assert near(sum(map(sum, t)), sum(map(sum, got)))
    assert quota.controlled_rounding([]) == []


def test_sample(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        kind, spelled = rng.choice([("noul", ["noul", " Noul", "yes/no", "yes-no"]), ("choice", ["choice", "multiple choice", "multi_choice "])])
        source = rng.choice(["tern", "kiln"] * 5 + ["ember"])
        rows.append((i, f"i{i}", f"{source}/b{i % 5}", None, rng.choice(spelled), None))
        if i % 7 == 0:
            rows.append((10_000 + i, f"i{i}", f"{source.upper()}_b1", None, rng.choice([*spelled, None]), None))
    rows += [(20_000, "q", None, None, "noul", None), (20_001, "q2", "tern/b1", None, None, None), (20_002, None, "tern/b1", None, "noul", None), (20_003, "q3", "tern/b1", None, "score", None)]
    df = train(spark, rows)
    targets = spark.createDataFrame([("noul", "tern", 0.3, 4), ("choice", "tern", 0.2, 4), ("noul", "kiln", 0.2, 4), ("choice", "kiln", 0.05, 4), ("noul", "ember", 0.25, 4), ("choice", "ember", 0.001, 20), ("noul", "nowhere", 0.0, 3), ("score", "tern", 0.0, 2)], "type string, collection string, share double, min_rows int")
    plan = {(r.type, r.collection): r for r in quota.quota_plan(df, targets).collect()}
    have = Counter()
    for i in {r[1] for r in rows if r[1]}:
        mine = [r for r in rows if r[1] == i and r[2] and r[4]]
        if mine:
            letters = "".join(c for c in mine[0][4].lower() if c.isalpha())
            have["noul" if letters in ("noul", "yesno") else "score" if letters == "score" else "choice", mine[0][2].lower()[:4].rstrip("/_")] += 1
    total = len({r[1] for r in rows if r[1]})
    for (k, c), r in plan.items():
        assert r.available == have[k, c[:4]] and r.wanted == pytest.approx(max(r.min_rows, r.share * total / 4)) and r.short == (r.available < r.wanted)
    assert {k for k, r in plan.items() if r.short} == {("noul", "ember"), ("noul", "nowhere"), ("score", "tern")}
    assert sum(r.quota for r in plan.values()) == round(total / 4) and plan["choice", "ember"].quota == 20
    got = quota.quota_sample(df, targets).collect()
    assert Counter((r.type, r.collection) for r in got) == {k: r.quota for k, r in plan.items() if r.quota} and len({r.id for r in got}) == len(got)
    again = quota.quota_sample(df.repartition(5), targets).collect()
    assert {r.id for r in again} == {r.id for r in got}
    assert quota.quota_sample(df.limit(0), targets).isEmpty() and {r.reached for r in quota.quota_report(df.limit(0), targets).collect()} == {0}


def test_smallest_keys_are_exact(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, rng.choice("aab"), rng.randint(1, 50)) for i in range(3000)], "i int, g string, w int").withColumn("k", quota.unit_hash("i")).cache()
    q = spark.createDataFrame([("a", 777.0), ("b", 10.0)], "g string, quota double")
    got = {r.i for r in quota.smallest_keys(d, ["g"], F.col("k"), q, tie=["i"]).collect()}
    rows = sorted(d.collect(), key=lambda r: r.k)
    assert got == {r.i for g, n in (("a", 777), ("b", 10)) for r in [x for x in rows if x.g == g][:n]}
    got = {r.i for r in quota.smallest_keys(d, ["g"], F.col("k"), q, F.col("w"), ["i"]).collect()}
    want, used = set(), Counter()
    for r in rows:
        if used[r.g] + r.w / 2 < (777 if r.g == "a" else 10):
            want.add(r.i)
        used[r.g] += r.w
    assert got == want


def test_mixture(spark, tokenizers):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        s = rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None, "other"])
        rows.append((i, rng.choice([None, "", "word " * rng.randint(1, 60)]) if i % 10 == 0 else "some text " * rng.randint(1, 40), rng.choice(["en", "EN", "en-XX", "de", None, "und"]), s, rng.choice(["tern:1", None, "kiln:2"]), "clash"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, image_id string, tokens string")
    weights = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.28, 2), ("none", 0.02, 5)], "source string, weight double, max_repeats int")
    t = {r.doc_id: r.tokens for r in mixing.token_table(docs, weights).collect()}
    of = {s: sum(t[r[0]] for r in rows if r[3] == s) for s in ("big", "mid", "small")}
    total = sum(of.values())
    short = {s for s, w, m in (("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.28, 2), ("none", 0.02, 5)) if of.get(s, 0) * m < w * total}
    assert {r.source for r in mixing.short_sources(docs, weights).collect()} == short == {"small", "none"}
    mix = mixing.mix_corpus(docs, weights).collect()
    limit = {"big": 1, "mid": 3, "small": 2}
    assert len({r.doc_id for r in mix}) == len(mix) and all(1 <= r.repeats <= limit[r.source] and r.tokens == t[r.doc_id] > 0 for r in mix)
    report = {r.value: r for r in mixing.mix_report(docs, weights).collect() if r.margin == "source"}
    assert report["none"].reached_tokens == 0 and report["small"].reached_tokens == 2 * of["small"]
    for s in ("big", "mid"):
        assert abs(report[s].reached_tokens - report[s].target_tokens) < 0.02 * report[s].target_tokens
    assert abs(sum(r.reached_tokens for r in report.values()) - total) < 0.02 * total
    assert mixing.mix_corpus(docs.limit(0), weights).isEmpty() and {r.source for r in mixing.short_sources(docs.limit(0), weights).collect()} == set()


def test_rake_meets_margins():
    cells = [(s, g, p, 100.0 + 10 * i + 7 * j + 3 * k) for i, s in enumerate("ab") for j, g in enumerate("xy") for k, p in enumerate("mn")]
    whole = sum(c[3] for c in cells)
    use = mixing.rake(cells, {"a": whole * 0.7, "b": whole * 0.3}, {"a": 10.0, "b": 10.0})
    for k in range(3):
        got, own = Counter(), Counter()
        for c, u in zip(cells, use):
            got[c[k]] += c[3] * u
            own[c[k]] += c[3]
        want = {"a": whole * 0.7, "b": whole * 0.3} if k == 0 else own
        assert all(got[x] == pytest.approx(want[x], rel=1e-3) for x in got)
