"""Nothing that has a goal or a partner is lost by the methods of the training-corpus operators."""

from __future__ import annotations

from collections import Counter

import pytest

from gleanwork.llm import mixing, overlap
from test_records import aliases, train


@pytest.mark.parametrize("english", [0, 30])
def test_single_language_source_beside_a_capped_one(english):
    cells = [("A", "de", "x", 900.0), ("B", "de", "x", 300.0), ("B", "en", "x", float(english)), ("C", "en", "x", 8800.0 - english)]
    goal, most = {"A": 2700.0, "B": 200.0, "C": 7100.0}, {"A": 3.0, "B": 2.0, "C": 1.0}
    use = mixing.rake(cells, goal, most)
    got = Counter()
    for c, u in zip(cells, use):
        got[c[0]] += c[3] * u
        assert u <= most[c[0]] * (1 + 1e-9) and (u > 0 or not c[3])
    assert got == pytest.approx(goal)


def test_its_documents_are_in_the_mixture(spark):
    docs = [(i, s, m, lang, "x", 10) for i, (s, m, lang) in enumerate([("A", 3, "de")] * 90 + [("B", 2, "de")] * 30 + [("C", 1, "en")] * 880)]
    tokens = spark.createDataFrame(docs, "doc_id bigint, source string, max_repeats int, lang string, topic string, tokens bigint")
    weights = spark.createDataFrame([("A", 0.3, 3), ("B", 0.02, 2), ("C", 0.68, 1)], "source string, weight double, max_repeats int")
    goal = {r.source: r.target_tokens for r in mixing.source_plan(tokens, weights).collect()}
    got = Counter()
    for r in mixing.mixture(tokens, weights).collect():
        got[r.source] += r.tokens * r.repeats
    assert got["A"] == 2700 and all(abs(got[s] - goal[s]) <= 10 for s in goal)


def test_short_sources_come_from_the_raked_cells(spark, tokenizers, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "some text", "en", None), (2, "b", "some text " * 40, "de", None)], "doc_id bigint, source string, text string, lang string, image_id string")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    seen, rake = [], mixing.rake
    monkeypatch.setattr(mixing, "rake", lambda cells, *a, **k: seen.append(cells) or rake(cells, *a, **k))
    assert [r.source for r in mixing.short_sources(docs, weights).collect()] == ["a"]
    assert [{c[0] for c in cells} for cells in seen] == [{"a", "b"}]


def test_slip_of_a_rare_word_is_an_overlap(spark):
    ask = "Is there a {} in the image?"
    t = [(i, f"t{i}", "tern/b1", f"tern:{i}", None, ask.format("lamp" if i < 200 else "zebra")) for i in range(205)]
    v = [(9000 + i, f"v{i}", "tern/v1", f"tern:{p}", None, ask.format(w)) for i, (p, w) in enumerate([(0, "table"), (200, "zebraa"), (201, "zbera"), (202, "lamp"), (203, "zzebra"), (3, "zebrra")])]
    got = overlap.overlap_pairs(train(spark, t), train(spark, v), aliases(spark)).collect()
    assert sorted(map(tuple, got)) == [(200, 9001), (201, 9002), (203, 9004)]
