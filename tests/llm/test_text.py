"""Encoding and look-alike texts: round trips, another library, brute force."""

from __future__ import annotations

import random
import unicodedata
from collections import defaultdict

import pytest

from gleanwork.llm import encode, skeleton

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def encoder(tokenizers):
    return encode.Encoder(encode.sentencepiece_model(encode.read_ranks()))


ODD = ["", " ", "\n\n  x", "<|endoftext|> <|x|>", "naïve ① ½ ２０", "👩‍🔬🧺", "a" * 20_000, "ab " * 5_000, "\x00\x01\x7f", "­​", "日本語 текст ελληνικά", "don't I'LL we'd", "\t\t x  \r\n", "▁ Ġ", " " * 3000, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢"]


def test_round_trip_and_other_library(encoder, tokenizers):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(encode.read_ranks())}
    other = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD[:6] + ODD[7:] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    ids = encoder.encode(texts)
    assert ids == [other.encode_ordinary(t) for t in texts]
    assert [encoder.decode(i) for i in ids] == texts
    assert encoder.decode(encoder.encode(ODD)[6]) == ODD[6]


def test_memory_is_bounded(tokenizers):
    e = encode.Encoder(encode.sentencepiece_model(encode.read_ranks()), remember=1000)
    texts = [f"word{i} and {i * 7}" for i in range(200)] + ["z" * 5000]
    for t in texts:
        assert e.decode(e.encode([t])[0]) == t and e.held < 1000 + 70 * len(t)
    assert len(e.known) < 40


def test_column(spark, encoder):
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate([*ODD, None])] + [(None, "a", None)], DOCS + ", ids array<int>").repartition(3)
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert got == dict(zip([*range(len(ODD) + 1), None], encoder.encode([*ODD, None, "a"]))) and got[0] == [] and got[len(ODD)] == []
    assert encode.encode_corpus(df.limit(0)).isEmpty()
    n = df.select("doc_id", encode.token_count(spark, "text").alias("n")).collect()
    assert {r.doc_id: r.n for r in n} == {k: len(v) for k, v in got.items()}


SAME = [
    ("Fig. 12; off", "Ｆｉｇ． １２; oﬀ"), ("pace", "расе"), ("résumé", "résumé"), ("cat sat", "c​at s­at"), ("ệ", "ệ"), ("K Å Ω", "K Å Ω"),
    ("HOME", "ΗΟΜΕ"), ("HOME", "НОМЕ"), ("大山", "⼤⼭"), ("한국", unicodedata.normalize("NFD", "한국")), ("ｶﾞ", "ガ"), ("a b", "a　b"), ("x", "﻿x‎"), ("line\nnext", "line\r\nnext"), ("used", "սѕеԁ"),
    ("fine", "𝐟𝐢𝐧𝐞"), ("q̣́", "q̣́"), ("a-b", "a‑b"), ("µ", "μ"),
]
OTHER = [("m2", "m²"), ("1", "①"), ("1", "¹"), ("a", "A"), ("resume", "résumé"), ("é", "è"), ("a.", "a,"), ("10", "11"), ("a b", "ab"), ("I", "l"), ("l", "1"), ("O", "0"), ("1/2", "½x"), ("a\nb", "a b"), ("rn", "m"), ("don't", "don’t"), ("a-b", "a–b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_to_the_eye(a, b):
    assert skeleton.skeleton(a) == skeleton.skeleton(b)
    assert skeleton.skeleton(skeleton.skeleton(b)) == skeleton.skeleton(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_to_the_eye(a, b):
    assert skeleton.skeleton(a) != skeleton.skeleton(b)


def brute(texts):
    g = defaultdict(list)
    for i, t in texts:
        if t is not None and i is not None and skeleton.skeleton(t):
            g[skeleton.skeleton(t)].append((i, t))
    return {(min(i, j), max(i, j)) for v in g.values() for k, (i, t) in enumerate(v) for j, u in v[k + 1 :] if t != u}


def test_pairs(spark):
    rng = random.Random(1)
    forms = ["pace", "расе", "ｐａｃｅ", "p​ace", "pace "]
    rows = [(i, rng.choice(forms)) for i in range(60)] + [(100 + k, t) for k, p in enumerate(SAME + OTHER) for t in p[:1]] + [(200 + k, p[1]) for k, p in enumerate(SAME + OTHER)]
    rows += [(300, None), (301, ""), (302, "  "), (303, "​﻿"), (304, "x" * 100_000), (305, "ｘ" * 100_000), (None, "pace"), (306, "lone")]
    df = spark.createDataFrame([(*r, "look", 1) for r in rows], DOCS + ", look string, n int")
    want = brute(rows)
    for block in (2, 7, 2000):
        got = list(map(tuple, skeleton.lookalike_pairs(df, block=block).collect()))
        assert len(got) == len(set(got)) and set(got) == want
    assert len(skeleton.lookalike_pairs(df.union(df), block=5).collect()) == len(want)
    text = {r.doc_id: r.text for r in skeleton.consistent_text(df).collect()}
    assert text[300] is None and text[301] == text[302] == text[303] == "" and text[304] == text[305]
    classes = {r.doc_id: (r.class_id, r.n_forms) for r in skeleton.lookalike_classes(df).collect()}
    assert set(classes) == {i for i, t in rows if t is not None and skeleton.skeleton(t)} and classes[304] == classes[305] and classes[306][1] == 1
    assert skeleton.lookalike_pairs(df.limit(0)).isEmpty() and skeleton.lookalike_classes(df.limit(0)).isEmpty()
