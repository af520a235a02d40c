"""Nested records against a plain recursive reading of the same JSON."""

from __future__ import annotations

import json
import random
from collections import Counter

from gleanwork.operators import nested

SCHEMA = "rec_no bigint, questions string, criteria string, type string, instructions string"


def plain(rec_no, questions, criteria):
    """Options of all questions, read by recursion."""
    out = []

    def ask(parent, qid, q):
        c = q.get("criteria")
        c = [] if c is None else list(c.items()) if isinstance(c, dict) else [(o["key"], o) if isinstance(o, dict) else (str(o), None) for o in c]
        if not c:
            out.append((rec_no, parent, qid, ""))
        for name, o in c:
            out.append((rec_no, parent, qid, name))
            if isinstance(o, dict):
                many(qid, o.get("then"))
        many(qid, q.get("followups"))

    def many(parent, v):
        for qid, q in [] if v is None else v.items() if isinstance(v, dict) else [(x["qid"], x) for x in v]:
            ask(parent, qid, q)

    if questions is None:
        ask("", "q", {"criteria": criteria})
    else:
        many("", questions.get("items", questions) if isinstance(questions, dict) else questions)
    return out


def random_question(rng, depth):
    q = {"type": "choice", "instructions": "Which?"}
    names = rng.sample(["a", "b", "7", "7.50", "x y"], rng.randint(0, 3))
    opts = {}
    for n in names:
        o = rng.choice([None, "text", {"desc": None}, {"regions": [{"box": [1, 2, 3, 4], "note": "n"}]}])
        if depth and rng.random() < 0.4:
            o = {"then": {"t": random_question(rng, depth - 1)}}
        opts[n] = o
    q["criteria"] = rng.choice([opts, [{"key": k, **(v if isinstance(v, dict) else {})} for k, v in opts.items()], list(opts), None])
    if isinstance(q["criteria"], list) and all(isinstance(x, str) for x in q["criteria"]) and any(isinstance(v, dict) and "then" in v for v in opts.values()):
        q["criteria"] = opts
    if depth and rng.random() < 0.5:
        inner = {f"f{i}": random_question(rng, depth - 1) for i in range(rng.randint(1, 2))}
        q["followups"] = inner if rng.random() < 0.5 else [{**v, "qid": k} for k, v in inner.items()]
    if rng.random() < 0.3:
        q["votes"] = [{"annotator": "a1", "value": "yes", "spans": [{"from": 0, "to": 3}]}]
    return q


def test_random_trees(spark):
    rng = random.Random(5)
    table, want = [], Counter()
    for i in range(300):
        qs = {f"q{k}": random_question(rng, 3) for k in range(rng.randint(1, 3))}
        shape = rng.randint(0, 3)
        value = [qs, [{**v, "qid": k} for k, v in qs.items()], {"version": 2, "items": qs}, {"version": 3, "items": [{**v, "qid": k} for k, v in qs.items()], "meta": {"notes": []}}][shape]
        text = json.dumps(value)
        for _ in range(rng.randint(0, 2)):
            text = json.dumps(text) if rng.random() < 0.3 else text
        table.append((i, text, "ignored", None, None))
        want.update(plain(i, value, None))
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert Counter(map(tuple, nested.question_options(df).collect())) == want
    nodes = nested.node_table(df).cache()
    for outer, inner, col in (("question", "option", "question_pre"), ("question", "question", "question_pre"), ("option", "region", "option_pre"), ("vote", "span", "vote_pre")):
        joined = set(map(tuple, nested.inside(nodes, outer, inner).collect()))
        walked = set(map(tuple, nodes.where(f"kind = '{inner}' and {col} is not null").select("rec_no", col, "pre").collect()))
        assert joined == walked and joined
    assert nodes.where("not pre < post").isEmpty()


def test_written_forms(spark):
    table = [
        (1, None, '{"true": null, "false": {"then": [{"qid": "n", "type": "noul"}]}}', "noul", "Is it?"),
        (2, None, None, None, None),
        (3, '{"q": {"type": "choice", "criteria": [134, 1.50, "1e2", true, null]}}', None, None, None),
        (4, '{"q": {"type": "choice"', '["a"]', "choice", "cut off"),
        (5, '[{"qid": "a", "criteria": {"x": null, "x": "again"}}, {"qid": "a", "criteria": []}]', None, None, None),
        (6, "", '["a"]', None, None),
        (7, "null", '["a"]', None, None),
        (8, "NaN", '["a"]', None, None),
        (9, None, "{broken", None, None),
    ]
    got = Counter(map(tuple, nested.question_options(spark.createDataFrame(table, SCHEMA)).collect()))
    assert got == Counter([
        (1, "", "q", "true"), (1, "", "q", "false"), (1, "q", "n", ""), (2, "", "q", ""), (3, "", "q", "134"), (3, "", "q", "1.50"), (3, "", "q", "1e2"), (3, "", "q", "true"), (3, "", "q", "null"),
        (5, "", "a", "x"), (5, "", "a", "x"), (5, "", "a", ""), (7, "", "q", "a"),
    ])


def test_tables_hang_together(spark):
    q = {"q": {"type": "noul", "instructions": ["Is it?"], "weight": 2.5, "criteria": {"true": {"desc": "d", "regions": [{"box": [1, 2, 3, 4], "note": None}]}}, "votes": [{"annotator": "a7", "value": "no", "spans": [{"from": 1, "to": 9}]}]}}
    t = nested.flat_tables(spark.createDataFrame([(1, json.dumps(q), None, None, None), (2, "broken", None, None, None)], SCHEMA))
    assert sorted(map(tuple, t["records"].collect())) == [(1, 1, 1, 1, 1, 1, 3), (2, 0, 0, 0, 0, 0, 0)]
    question = t["questions"].first()
    assert (question.qid, question.type, question.instructions, question.weight, question.n_options, question.parent_pre) == ("q", "noul", "Is it?", 2.5, 1, None)
    option = t["options"].first()
    assert (option.opt, option.description, option.question_pre) == ("true", "d", question.pre)
    region = t["regions"].first()
    assert (region.x, region.h, region.note, region.option_pre) == (1.0, 4.0, None, option.pre)
    vote = t["votes"].first()
    assert (vote.annotator, vote.value, vote.question_pre) == ("a7", "no", question.pre)
    assert (t["spans"].first().from_char, t["spans"].first().vote_pre) == (1.0, vote.pre)


def test_empty_deep_long_and_extra(spark):
    assert nested.question_options(spark.createDataFrame([], SCHEMA)).isEmpty()
    deep = '{"type": "noul"}'
    for i in range(200):
        deep = '{"type": "noul", "followups": {"d%d": %s}}' % (i, deep)
    wide = json.dumps({"q": {"criteria": {f"o{i}": None for i in range(60_000)}}})
    too_deep = "[" * 200_000 + "]" * 200_000
    df = spark.createDataFrame([(1, '{"q": %s}' % deep, None, None, None, "k"), (2, wide, None, None, None, "k"), (3, too_deep, None, None, None, "k"), (None, '{"q": {"type": "noul"}}', None, None, None, "k")], SCHEMA + ", kind string")
    got = dict(nested.question_options(df).groupBy("rec_no").count().collect())
    assert got == {1: 201, 2: 60_000, None: 1}


def rewrapped(rng, value, depth=0):
    """The same questions, packed as text, put into envelopes or listed, at any level."""
    if isinstance(value, dict) and depth == 0 and all(isinstance(v, dict) for v in value.values()) and rng.random() < 0.3:
        value = [{**v, "qid": k} for k, v in value.items()]
    for _ in range(rng.choice([0, 0, 1, 2])):
        value = rng.choice([lambda v: json.dumps(v), lambda v: {rng.choice(["data", "body", "items", "payload"]): v, "version": 4}, lambda v: [v] if not isinstance(v, str) else v])(value)
    return value


def deep_rewrapped(rng, q):
    q = dict(q)
    for name in ("followups", "then"):
        if isinstance(q.get(name), (dict, list)):
            inner = q[name] if isinstance(q[name], list) else {k: deep_rewrapped(rng, v) for k, v in q[name].items()}
            q[name] = rewrapped(rng, inner)
    if isinstance(q.get("criteria"), dict):
        q["criteria"] = {k: deep_rewrapped(rng, v) if isinstance(v, dict) else v for k, v in q["criteria"].items()}
        if rng.random() < 0.3:
            q["criteria"] = json.dumps(q["criteria"])
    elif isinstance(q.get("criteria"), list) and q["criteria"] and rng.random() < 0.5:
        q["criteria"] = [q["criteria"][:1], q["criteria"][1:]]
    return json.dumps(q) if rng.random() < 0.2 and "qid" not in q else q


def test_wrapping_and_packing_make_no_difference(spark):
    rng = random.Random(17)
    table, want = [], Counter()
    for i in range(400):
        qs = {f"q{k}": random_question(rng, 3) for k in range(rng.randint(1, 3))}
        want.update(plain(i, qs, None))
        table.append((i, json.dumps(rewrapped(rng, {k: deep_rewrapped(rng, v) for k, v in qs.items()})), None, None, None))
    got = Counter(map(tuple, nested.question_options(spark.createDataFrame(table, SCHEMA)).collect()))
    assert got == want


def test_any_depth(spark):
    n = 20_000
    chain = '{"type": "noul", "followups": {"f": ' * n + '{"type": "noul", "criteria": ["end"]}' + "}}" * n
    envelope = '{"data": ' * n + '{"q1": {"type": "noul"}}' + "}" * n
    lists = "[" * n + '{"qid": "q2", "type": "noul"}' + "]" * n
    odd = '{"q": {"type": "noul", "criteria": [1.50, "\\u00e9", true, null, {"key": "k"}], "votes": ' + "[" * n + "]" * n + "}}"
    df = spark.createDataFrame([(1, '{"q": %s}' % chain, None, None, None), (2, envelope, None, None, None), (3, lists, None, None, None), (4, lists + "]", None, None, None), (5, odd, None, None, None)], SCHEMA)
    got = nested.question_options(df).collect()
    assert Counter(r.rec_no for r in got) == {1: n + 1, 2: 1, 3: 1, 5: 5}
    assert {tuple(r) for r in got if r.rec_no > 1} == {(2, "", "q1", ""), (3, "", "q2", ""), *((5, "", "q", o) for o in ("1.50", "é", "true", "null", "k"))}


def test_deep_parser_agrees():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randint(0, 7 if depth else 4)
        return [None, True, rng.randint(-9, 9), 1.25, "a\"\n é"][kind] if kind < 5 else [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind < 6 else {f"k{i % 2}": value(depth - 1) for i in range(rng.randint(0, 3))}

    for _ in range(500):
        text = json.dumps(value(4), indent=rng.choice([None, 1]))
        assert nested._deep(text) == nested._DECODER.decode(text)
        cut = text[: rng.randint(0, len(text))] + rng.choice(["", "}", "]", ",", "x"])
        try:
            want = nested._DECODER.decode(cut)
        except ValueError:
            want = nested.BROKEN
        assert nested._deep(cut) == want or nested._deep(cut) is want
