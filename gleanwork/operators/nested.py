"""Deeply nested question records to flat tables, linked by interval labels.

Every record is one tree: record, questions, options, votes, regions, spans; questions may stand
under questions (``followups``) and under options (``then``), to any depth. A depth-first walk gives
each node a pre-order and a post-order number from one clock, so that ``a`` holds ``d`` exactly when
``a.pre < d.pre`` and ``d.post < a.post``. Nodes of all kinds leave one walk as one table; the tables
per kind are selections of it, and a node's enclosing question, option or vote is the innermost
interval of that kind that contains its own.

Defined results: text that is not JSON gives no nodes; a null ``questions`` (also JSON's null) is the one
question ``q`` with the options of ``criteria``; names repeated in one object are all kept; numbers
keep their spelling; JSON that is itself packed as text, as a whole or in any wrapping, is unpacked as
often as needed; a name of an option is never unpacked. Any depth is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.plans.lineage import settle

RECORD, QUESTION, OPTION, REGION, VOTE, SPAN = "record", "question", "option", "region", "vote", "span"


class Obj(list):
    """A JSON object as its list of (name, value), in order and with repeats."""

    def get(self, name: str, default=None):
        for k, v in self:
            if k == name:
                return v
        return default


def _refuse(x: str):
    raise ValueError(f"not JSON: {x}")


class _Num(str):
    """A number by its spelling."""


_DECODER = json.JSONDecoder(object_pairs_hook=Obj, parse_int=_Num, parse_float=_Num, parse_constant=_refuse)
BROKEN = object()


def parse(text: str | None):
    """The value of JSON text, unpacked while it is text itself; ``BROKEN`` if it is none."""
    value = text
    while isinstance(value, str) and not isinstance(value, _Num):
        try:
            value = _DECODER.decode(value)
        except RecursionError:
            value = _deep(value)
        except ValueError:
            return BROKEN
    return value


def _deep(text: str):
    """The same value for JSON of any depth: containers are kept on a list of their own, scalars are left to the decoder."""
    space = re.compile(r"[ \t\n\r]*").match
    open_: list[tuple[list, bool]] = []
    at, value, name = space(text, 0).end(), BROKEN, None
    names: list[str | None] = []
    try:
        while True:
            c = text[at]
            if c in "[{":
                held = Obj() if c == "{" else []
                at = space(text, at + 1).end()
                if text[at] != ("}" if c == "{" else "]"):
                    open_.append((held, c == "{"))
                    names.append(name)
                    if c == "{":
                        name, at = _member(text, at, space)
                    continue
                value, at = held, at + 1
            else:
                value, at = _DECODER.raw_decode(text, at)
            # A value is whole: it goes into what holds it, which may be whole with it.
            while True:
                at = space(text, at).end()
                if not open_:
                    return value if at == len(text) else BROKEN
                held, is_object = open_[-1]
                held.append((name, value) if is_object else value)
                c = text[at]
                if c == ",":
                    at = space(text, at + 1).end()
                    if is_object:
                        name, at = _member(text, at, space)
                    break
                if c != ("}" if is_object else "]"):
                    return BROKEN
                open_.pop()
                value, name, at = held, names.pop(), at + 1
    except (ValueError, IndexError):
        return BROKEN


def _member(text: str, at: int, space) -> tuple[str, int]:
    """The name that stands at ``at`` and where its value begins."""
    if text[at] != '"':
        raise ValueError("a name is missing")
    name, at = _DECODER.raw_decode(text, at)
    at = space(text, at).end()
    if text[at] != ":":
        raise ValueError("a colon is missing")
    return name, space(text, at + 1).end()


def _text(value) -> str | None:
    """A scalar as written; objects and lists give their first text."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, str):
            return str(value).encode("utf-8", "replace").decode()
        if isinstance(value, list):
            left.extend(reversed([v for _, v in value] if isinstance(value, Obj) else value))
    return None


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


#: What only a question has; an object with none of it is a wrapping, or a question of which nothing is known.
_FIELDS = frozenset(("type", "instructions", "criteria", "votes", "followups"))


def _is_question(value) -> bool:
    return isinstance(value, Obj) and any(k in _FIELDS for k, _ in value)


def _unpacked(value):
    """Packed text as what it holds, if that is an object or a list."""
    if isinstance(value, str) and not isinstance(value, _Num) and value.lstrip()[:1] in ("{", "[", '"'):
        inner = parse(value)
        return inner if isinstance(inner, list) else value
    return value


def _holds_question(value) -> bool:
    left = [value]
    while left:
        value = _unpacked(left.pop())
        if _is_question(value):
            return True
        if isinstance(value, list):
            left.extend(v for _, v in value) if isinstance(value, Obj) else left.extend(value)
    return False


def _questions(value, under: str = "q") -> list[tuple[str, Obj]]:
    """(qid, question) of any wrapping, in order: lists, objects by qid, envelopes of any name and depth,
    one bare question, and each of them packed as text."""
    out: list[tuple[str, Obj]] = []
    left: list[tuple[str | None, object, bool]] = [(None, value, True)]
    while left:
        name, value, holds = left.pop()
        value = _unpacked(value)
        if isinstance(value, Obj):
            if _is_question(value) and not any(_is_question(v) for k, v in value if k in ("type", "instructions")):
                out.append((_text(value.get("qid", under)) if name is None else name, value))
                continue
            if not holds and not _holds_question(value):
                out.append((name, value))
                continue
            named = next((v for w in ("items", "questions") if (v := value.get(w)) is not None and not _is_question(_unpacked(v))), None)
            if named is not None:
                left.append((None, named, True))
                continue
            inner = [(k, x) for k, v in value if isinstance(x := _unpacked(v), list)]
            if not any(_is_question(x) for _, x in inner):
                # No question by its name here: an envelope, unless nothing below is one either.
                if len(inner) > 1 or not isinstance(inner[0][1] if inner else None, Obj):
                    inner = [(k, x) for k, x in inner if _holds_question(x)] or [(k, x) for k, x in inner if isinstance(x, Obj)]
                left.extend((k, x, len(inner) == 1 and bool(x)) for k, x in reversed(inner))
            else:
                left.extend((k, x, False) for k, x in reversed(inner) if isinstance(x, Obj) or _holds_question(x))
        elif isinstance(value, list):
            for v in reversed(value):
                v = _unpacked(v)
                if isinstance(v, Obj):
                    left.append((_text(v.get("qid", under)), v, False) if not _is_question(v) else (None, v, False))
                elif isinstance(v, list):
                    left.append((None, v, True))
    return out


def _options(value) -> list[tuple[str, object]]:
    """(name, what is said of it) of criteria as an object by name or as a list of names, objects, pairs of both, or lists of such."""
    if isinstance(value, str) and not isinstance(value, _Num):
        value = parse(value)
    if isinstance(value, Obj):
        return list(value)
    out: list[tuple[str, object]] = []
    left = list(reversed(value)) if isinstance(value, list) else []
    while left:
        v = left.pop()
        if isinstance(v, Obj):
            out.append((_text(v.get("key")) or "", v))
        elif isinstance(v, list) and len(v) == 2 and isinstance(v[1], Obj) and not isinstance(v[0], list):
            out.append(("null" if v[0] is None else _text(v[0]), v[1]))
        elif isinstance(v, list):
            left.extend(reversed(v))
        else:
            out.append(("null" if v is None else _text(v), None))
    return out


def _listed(value) -> list:
    value = _unpacked(value)
    return value if isinstance(value, list) else []


def _children(kind: str, body, leaves: bool) -> Iterator[tuple[str, str, object]]:
    """(kind, name, body) of what hangs on a node; ``leaves``: with votes, regions and spans."""
    if not isinstance(body, Obj):
        return
    if kind == QUESTION:
        for k, v in _options(body.get("criteria")):
            yield OPTION, k, v
        for v in _listed(body.get("votes")) if leaves else ():
            yield VOTE, _text(v.get("annotator")) if isinstance(v, Obj) else _text(v), v
        for k, v in _questions(body.get("followups")):
            yield QUESTION, k, v
    elif kind == OPTION:
        for v in _listed(body.get("regions")) if leaves else ():
            yield REGION, None, v
        for k, v in _questions(body.get("then")):
            yield QUESTION, k, v
    elif kind == VOTE:
        for v in _listed(body.get("spans")):
            yield SPAN, None, v


def _details(kind: str, body) -> tuple[str | None, str | None, list[float | None] | None]:
    """(label, body text, numbers) of a node."""
    if kind == QUESTION:
        return _text(body.get("type")), _text(body.get("instructions")), [_number(body.get("weight"))]
    if kind == OPTION:
        return None, _text(body.get("desc") if isinstance(body, Obj) else body), None
    if not isinstance(body, Obj):
        return None, None, None
    if kind == VOTE:
        return _text(body.get("value")), None, None
    if kind == REGION:
        return None, _text(body.get("note")), [_number(x) for x in _listed(body.get("box"))]
    return None, None, [_number(body.get("from")), _number(body.get("to"))]


def label(roots: Iterable[tuple[str, object]], leaves: bool = True) -> list[list]:
    """Nodes of one record in pre-order as [kind, name, body, pre, post, depth]; the walk keeps its own stack."""
    nodes: list[list] = [[RECORD, None, None, 0, 0, 0]]
    clock = 1
    stack = [(nodes[0], iter([(QUESTION, k, v) for k, v in roots]))]
    while stack:
        node, rest = stack[-1]
        for kind, name, body in rest:
            body = _unpacked(body)
            child = [kind, name, body, clock, 0, len(stack)]
            nodes.append(child)
            clock += 1
            if isinstance(body, Obj):
                stack.append((child, _children(kind, body, leaves)))
                break
            child[4] = clock
            clock += 1
        else:
            node[4] = clock
            clock += 1
            stack.pop()
    return nodes


def containers(pre: list[int], post: list[int]) -> list[int]:
    """For nodes in pre-order the index of the innermost node whose interval contains theirs, or -1:
    one sweep that keeps the open intervals on a stack."""
    out, open_ = [], []
    for i, a in enumerate(pre):
        while open_ and post[open_[-1]] < a:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def _holders(inner: list[int], kinds: list[str], wanted: str) -> list[int]:
    """The innermost container of kind ``wanted``, by way of the innermost container of any kind."""
    out: list[int] = []
    for i in inner:
        out.append(i if i < 0 or kinds[i] == wanted else out[i])
    return out


_SCHEMA = "kind string, name string, pre int, post int, depth int, question_pre int, qid string, parent_qid string, option_pre int, vote_pre int, n_options int, label string, body string, nums array<double>"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_ARROW = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]


def _record_rows(questions: str | None, criteria: str | None, kind: str | None, instructions: str | None, details: bool) -> Iterator[tuple]:
    if questions is None or (value := parse(questions)) is None:
        listed = parse(criteria)
        if listed is BROKEN:
            return
        roots = [("q", Obj([("type", kind), ("instructions", instructions), ("criteria", listed)]))]
    elif value is BROKEN:
        return
    else:
        roots = _questions(value)
    nodes = label(roots, details)
    kinds, pre, post = [x[0] for x in nodes], [x[3] for x in nodes], [x[4] for x in nodes]
    inner = containers(pre, post)
    in_question, in_option = _holders(inner, kinds, QUESTION), _holders(inner, kinds, OPTION)
    in_vote = _holders(inner, kinds, VOTE) if details else [-1] * len(nodes)
    options = [0] * len(nodes)
    for i, k in enumerate(kinds):
        if k == OPTION:
            options[in_question[i]] += 1
    at = lambda i: None if i < 0 else pre[i]
    for i, (k, name, body, a, z, depth) in enumerate(nodes):
        q = in_question[i]
        # A question's own name and the one it stands under; anything else has those of its question.
        own = i if k == QUESTION else q
        above = in_question[own] if own >= 0 else -1
        qid = None if own < 0 else nodes[own][1]
        parent = None if own < 0 else "" if above < 0 else nodes[above][1]
        yield (k, name, a, z, depth, at(q), qid, parent, at(in_option[i]), at(in_vote[i]), options[i] if k == QUESTION else None, *(_details(k, body) if details and k != RECORD else (None, None, None)))


def node_table(df: DataFrame, key: str = "rec_no", questions: str = "questions", criteria: str = "criteria", kind: str = "type", instructions: str = "instructions", details: bool = True) -> DataFrame:
    """One row per node of every record: key, kind, name, interval, and the intervals that hold it.

    A scan and one Arrow stage without a shuffle: a record is one row, so all that can contain a node
    is at hand where the node is. ``details=False`` leaves label, body and nums null
    and votes, regions and spans out. Columns that
    only stand in for a missing ``questions`` are sent to Python only for such rows.
    """
    if key in _NAMES:
        raise ValueError(f"a key named {key} clashes with a column of the node table")
    none = F.col(questions).isNull() | (F.trim(F.col(questions).cast("string")) == "null")
    only = lambda c: F.when(none, F.col(c))
    picked = df.select(F.col(key).alias("key"), F.col(questions).cast("string"), only(criteria).cast("string"), only(kind).cast("string"), only(instructions).cast("string"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rows = batch.column(0), [], []
            for at, parts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for row in _record_rows(*parts, details):
                    ids.append(at)
                    rows.append(row)
                if len(rows) > 50_000:
                    yield _batch(keys, ids, rows)
                    ids, rows = [], []
            if rows:
                yield _batch(keys, ids, rows)

    def _batch(keys: pa.Array, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(ids, pa.int32())), *columns], ["key", *_NAMES])

    out = picked.mapInArrow(walk, f"key {picked.schema['key'].dataType.simpleString()}, {_SCHEMA}")
    return out.withColumnRenamed("key", key)


def inside(nodes: DataFrame, outer: str, inner: str, key: str = "rec_no") -> DataFrame:
    """The containment join over interval labels: (key, outer_pre, inner_pre) with the innermost
    ``outer`` node of each ``inner`` node, for node tables that were written and read again.

    Sort and sweep: the nodes of a record are sorted by ``pre`` and read once, with the ``outer`` intervals
    that are still open on a stack, so the work is linear in the nodes. Nodes without key are left out; a key stands for one record.
    """
    kind = nodes.schema[key].dataType.simpleString()
    both = nodes.where(F.col(key).isNotNull() & F.col("kind").isin(outer, inner)).select(F.col(key).alias("key"), "pre", "post", (F.col("kind") == outer).alias("o"), (F.col("kind") == inner).alias("i"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            at, held = [], []
            for n, (k, pre, post, is_outer, is_inner) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if k != now:
                    now, open_ = k, []
                while open_ and open_[-1][1] < pre:
                    open_.pop()
                if is_inner and open_:
                    at.append(n)
                    held.append(open_[-1][0])
                if is_outer:
                    open_.append((pre, post))
            some = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array(held, pa.int32()), batch.column(1).take(some)], ["key", "outer_pre", "inner_pre"])

    swept = both.repartition("key").sortWithinPartitions("key", "pre").mapInArrow(sweep, f"key {kind}, outer_pre int, inner_pre int")
    return swept.withColumnRenamed("key", key)


def question_options(df: DataFrame, key: str = "rec_no", **columns: str) -> DataFrame:
    """(key, parent_qid, qid, opt): a row for each option of each question, one with ``''`` where none is listed."""
    n = node_table(df, key, details=False, **columns)
    n = n.where((F.col("kind") == OPTION) | ((F.col("kind") == QUESTION) & (F.col("n_options") == 0)))
    return n.select(key, "parent_qid", "qid", F.when(F.col("kind") == OPTION, F.col("name")).otherwise("").alias("opt"))


def flat_tables(df: DataFrame, key: str = "rec_no", only: str | None = None, **columns: str) -> dict[str, DataFrame]:
    """The related tables; each row carries its own interval and the ``pre`` of its parents.

    ``records`` has every row of ``df`` with how many nodes of each kind its tree holds (0 for broken text).
    The node table is written once to the shared folder and all tables are selections of it; with
    ``only`` that one table is made, straight from the walk.
    """
    n = node_table(df, key, **columns)
    if only is None:
        n = settle(n)
    of = lambda k: n.where(F.col("kind") == k)
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in (QUESTION, OPTION, VOTE, REGION, SPAN)]
    tables = {
        "records": lambda: df.select(key).join(n.groupBy(key).agg(*counts, F.max("depth").alias("depth")), key, "left").fillna(0),
        "questions": lambda: of(QUESTION).select(key, "pre", "post", "depth", F.col("question_pre").alias("parent_pre"), "option_pre", "parent_qid", "qid", F.col("label").alias("type"), F.col("body").alias("instructions"), F.get("nums", F.lit(0)).alias("weight"), "n_options"),
        "options": lambda: of(OPTION).select(key, "pre", "post", "question_pre", "qid", F.col("name").alias("opt"), F.col("body").alias("description")),
        "regions": lambda: of(REGION).select(key, "pre", "option_pre", "qid", F.get("nums", F.lit(0)).alias("x"), F.get("nums", F.lit(1)).alias("y"), F.get("nums", F.lit(2)).alias("w"), F.get("nums", F.lit(3)).alias("h"), F.col("body").alias("note")),
        "votes": lambda: of(VOTE).select(key, "pre", "question_pre", "qid", F.col("name").alias("annotator"), F.col("label").alias("value")),
        "spans": lambda: of(SPAN).select(key, "pre", "vote_pre", "qid", F.get("nums", F.lit(0)).alias("from_char"), F.get("nums", F.lit(1)).alias("to_char")),
    }
    return {k: make() for k, make in tables.items() if only in (None, k)}
