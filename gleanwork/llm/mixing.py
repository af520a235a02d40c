"""A mixture of sources with wanted shares of its tokens.

Token weights of the cells (source, language, topic) are raked by iterative proportional fitting to
the wanted tokens per source and to the corpus's own shares of languages and topics; a cell's weight
over its tokens is how often its documents are wanted on average, never above ``max_repeats``. Each
document is then used the whole part of that often, and once more by random keys with the fractional
part as its chance, stopped per source where the source's tokens are reached.

Defined results: rows that share an id are one document whose uses add up; documents of other sources, of null source and without tokens are left out; a source
without documents reaches 0; what sources fall short of is given by the others in proportion to their
weights, so that the size is reached if the documents hold so much.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.encode import token_count
from gleanwork.operators.pictures import collection_of, picture_name
from gleanwork.llm.quota import fractional_quotas, smallest_keys, unit_hash
from gleanwork.plans.lineage import cut, small_side

#: Cells reach the driver as one row each; sources, languages and topics beyond so many cells are refused.
MAX_CELLS = 100_000
#: The steps of language and topic leave a cell at least this part of its source's mean use.
LEAST_USE = 0.01
LANGUAGE = r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$"


def token_table(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, max_repeats, lang, topic, tokens) of the documents whose source is weighted.

    ``lang`` is the bare lower-case code or ``und``; the topic is the collection of the document's
    picture or ``none``.
    """
    w = cut(weights.select("source", "max_repeats").where("source is not null"))
    d = documents.select("doc_id", "source", "text", "lang", "image_id").join(small_side(w), "source")
    lang = F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), LANGUAGE, 1))
    topic = F.coalesce(collection_of(F.regexp_replace(picture_name("image_id"), ":", "/")), F.lit("none"))
    return d.select("doc_id", "source", "max_repeats", F.when(lang == "", "und").otherwise(lang).alias("lang"), topic.alias("topic"), token_count(documents.sparkSession, "text", path).alias("tokens"))


def _cells(tokens: DataFrame) -> list:
    found = tokens.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")).where("t > 0").limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError("too many cells of source, language and topic")
    return sorted(found)


def source_plan(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, tokens, wanted_tokens, target_tokens, short) for each weighted source."""
    rows = weights.select("source", "weight", "max_repeats").where("source is not null").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("too many weighted sources")
    rows.sort(key=lambda r: r.source)
    have = dict(tokens.groupBy("source").agg(F.sum("tokens")).collect())  # at most as many as weighted sources
    total = sum(have.values())
    most = [(have.get(r.source) or 0) * (r.max_repeats or 0) for r in rows]
    goal = fractional_quotas([r.weight or 0.0 for r in rows], [0.0] * len(rows), most, float(total))
    out = [(r.source, r.weight, r.max_repeats, have.get(r.source) or 0, (r.weight or 0.0) * total, float(g), m < (r.weight or 0.0) * total) for r, m, g in zip(rows, most, goal)]
    return tokens.sparkSession.createDataFrame(out, "source string, weight double, max_repeats int, tokens bigint, wanted_tokens double, target_tokens double, short boolean")


def _scaled(use: list[float], size: list[float], cap: list[float], wanted: float) -> list[float]:
    """``use`` times the one factor with which, each cut off at its cap, it holds ``wanted``, or all that caps allow."""
    out = list(use)
    by = sorted((i for i in range(len(use)) if size[i] * use[i] > 0), key=lambda i: cap[i] / use[i])
    rest = [0.0]
    for i in reversed(by):
        rest.append(rest[-1] + size[i] * use[i])
    left = wanted
    for n, i in enumerate(by):
        factor = max(0.0, left) / rest[len(by) - n]
        if use[i] * factor < cap[i]:
            for m in by[n:]:
                out[m] = min(cap[m], use[m] * factor)
            break
        out[i] = cap[i]
        left -= size[i] * cap[i]
    return out


def rake(cells: list[tuple[str, str, str, float]], goal: dict[str, float], most: dict[str, float], rounds: int = 200, close: float = 1e-6) -> list[float]:
    """How often each cell (source, language, topic, tokens) is wanted.

    Proportional fitting over the three margins in turn, sources last, so that each of them holds its
    goal or all that its cap allows; a cell never goes beyond its source's cap. The margins of language
    and topic are the corpus's shares of the size. Where sources at their caps hold more of a language or
    topic than that, its cells in other sources become rare there but never less than ``LEAST_USE`` of
    their source's mean before the source's own step, so that no document is left without a chance.
    """
    size, cap = [c[3] for c in cells], [max(0.0, most[c[0]]) for c in cells]
    use = [min(1.0, m) for m in cap]
    whole, total = sum(size), sum(goal.values())
    if not whole:
        return use
    margins: list[tuple[list[list[int]], list[float]]] = []
    for k in (1, 2, 0):
        members: dict[str, list[int]] = {}
        for i, c in enumerate(cells):
            members.setdefault(c[k], []).append(i)
        margins.append((list(members.values()), [goal.get(x, 0.0) if k == 0 else sum(size[i] for i in m) * total / whole for x, m in members.items()]))
    have: dict[str, float] = {}
    for c in cells:
        have[c[0]] = have.get(c[0], 0.0) + c[3]
    least = [min(m, LEAST_USE * goal.get(c[0], 0.0) / have[c[0]]) if c[3] else 0.0 for c, m in zip(cells, cap)]
    moved = 0.0
    for _ in range(rounds):
        before = list(use)
        for k, (groups, wanted) in zip((1, 2, 0), margins):
            for group, want in zip(groups, wanted):
                new = _scaled([use[i] for i in group], [size[i] for i in group], [cap[i] for i in group], want)
                for i, u in zip(group, new):
                    use[i] = u if k == 0 else max(u, least[i])
        moved = max((abs(a - b) for a, b in zip(before, use)), default=0.0)
        if moved < close:
            break
    if moved >= close:
        # Margins that caps make contradict each other have no fixed point; the sources' own step came last and holds.
        warnings.warn(f"raking still moved by {moved:.2g} uses after {rounds} rounds", stacklevel=2)
    return use


def raked(tokens: DataFrame, weights: DataFrame) -> tuple[list, list, list[float]]:
    """The rows of the source plan, the cells, and how often each cell is wanted; ``tokens`` is a materialised token table."""
    plan, cells = source_plan(tokens, weights).collect(), _cells(tokens)
    return plan, cells, rake([tuple(c) for c in cells], {r.source: r.target_tokens for r in plan}, {r.source: float(r.max_repeats or 0) for r in plan})


def mixture(tokens: DataFrame, weights: DataFrame, salt: str = "mixture") -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the mixture and how often each is in it.

    ``tokens`` is a materialised token table. The chance of one more use is made exact per source by
    order sampling: keys are uniform over the chance, and those below the point where the source's
    tokens are reached are taken; a hot source is never gathered in a task.
    """
    return _drawn(tokens, *raked(tokens, weights), salt).groupBy("doc_id", "source", "tokens").agg(F.sum("repeats").cast("int").alias("repeats"))


def _drawn(tokens: DataFrame, plan: list, cells: list, use: list[float], salt: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, repeats) of the sure and the drawn uses."""
    spark = tokens.sparkSession
    goal = {r.source: r.target_tokens for r in plan}
    rates = spark.createDataFrame([(c.source, c.lang, c.topic, u) for c, u in zip(cells, use)], "source string, lang string, topic string, rate double")
    d = tokens.where("tokens > 0").join(small_side(rates), ["source", "lang", "topic"])
    d = d.withColumn("sure", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("chance", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    sure: dict[str, float] = dict.fromkeys(goal, 0.0)
    for c, u in zip(cells, use):
        sure[c.source] += math.floor(u + 1e-9) * c.t
    quota = spark.createDataFrame([(s, max(0.0, g - sure[s])) for s, g in goal.items()], "source string, quota double")
    u = unit_hash(F.lit(salt), "doc_id")
    # u / (u + chance * (1 - u)) grows with u / chance and stays below 1; of chance 1 the key is u.
    key = u / (u + F.col("chance") * (1 - u) + 1e-300)
    keep = ["doc_id", "source", "lang", "topic", "tokens"]
    maybe = d.where("chance > 1e-9 and sure < max_repeats").select(*keep, "chance")
    more = smallest_keys(maybe, ["source"], F.least(key, F.lit(1 - 1e-12)), quota, F.col("tokens"), ["doc_id"]).select(*keep, F.lit(1).alias("repeats"))
    return d.where("sure > 0").select(*keep, F.col("sure").alias("repeats")).unionByName(more)


def mix_corpus(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    return mixture(cut(token_table(documents, weights, path)), weights)


def mix_report(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """(margin, value, weight, max_repeats, tokens, wanted_tokens, target_tokens, raked_tokens, reached_tokens, reached_share, n_docs, most_repeats, short).

    A row per weighted source (``margin`` source), language and topic. ``wanted_tokens`` are the weight of
    all tokens; ``target_tokens`` what the margin is fitted to; ``raked_tokens`` what fitting ended at, whose distance
    from the target tells how far the caps of repeats let it come; ``reached_tokens`` what the drawn
    documents have.
    """
    spark = documents.sparkSession
    tokens = cut(token_table(documents, weights, path))
    plan, cells, use = raked(tokens, weights)
    total, goal = sum(c.t for c in cells), sum(r.target_tokens for r in plan)
    rows = {("source", r.source): [r.weight, r.max_repeats, r.tokens, r.wanted_tokens, r.target_tokens, 0.0, r.short] for r in plan}
    for c, u in zip(cells, use):
        rows["source", c.source][5] += c.t * u
        for margin, value in (("language", c.lang), ("topic", c.topic)):
            row = rows.setdefault((margin, value), [None, None, 0, 0.0, 0.0, 0.0, None])
            row[2] += c.t
            row[3] += float(c.t)
            row[4] += c.t / total * goal
            row[5] += c.t * u
    planned = spark.createDataFrame([(*k, *v) for k, v in sorted(rows.items())], "margin string, value string, weight double, max_repeats int, tokens bigint, wanted_tokens double, target_tokens double, raked_tokens double, short boolean")
    sides = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(c).alias("value")) for m, c in (("source", "source"), ("language", "lang"), ("topic", "topic")))))
    used = _drawn(tokens, plan, cells, use, "mixture").groupBy("doc_id", "source", "lang", "topic", "tokens").agg(F.sum("repeats").alias("repeats"))
    got = used.select(sides.alias("m"), "tokens", "repeats").groupBy("m").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    out = planned.join(got.select("m.margin", "m.value", "reached_tokens", "n_docs", "most_repeats"), ["margin", "value"], "left").fillna(0, ["reached_tokens", "n_docs", "most_repeats"])
    share = F.try_divide(F.col("reached_tokens").cast("double"), F.sum("reached_tokens").over(Window.partitionBy("margin")))  # as many rows as values of the margins
    return out.withColumn("reached_share", share)


def short_sources(documents: DataFrame, weights: DataFrame, path: str | None = None) -> DataFrame:
    """(source) of those whose raked tokens stop at ``max_repeats`` times their tokens, below their weight of all tokens."""
    plan, cells, use = raked(cut(token_table(documents, weights, path)), weights)
    reached: dict[str, float] = {}
    for c, u in zip(cells, use):
        reached[c.source] = reached.get(c.source, 0.0) + c.t * u
    at_cap = lambda r: reached.get(r.source, 0.0) >= r.tokens * (r.max_repeats or 0) * (1 - 1e-9)
    return documents.sparkSession.createDataFrame([(r.source,) for r in plan if r.short and at_cap(r)], "source string")
