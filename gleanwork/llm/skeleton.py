"""Look-alike text: one consistent form per text, and groups of texts that are equal to the eye.

The form is a confusables skeleton: decompose, replace each character by its prototype, decompose
again. Prototypes come from Unicode's public confusables data, see :func:`prototypes`. Case, accents,
raised and circled digits, real punctuation and joined pictures stay as they are.

Defined results: a null text has a null skeleton; a text that shows nothing (blank, only invisible
characters) has the skeleton ``''`` and belongs to no group; runs of blanks keep their length, each
kind of blank becomes a space, CRLF becomes LF, blanks at the ends are dropped.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.plans.lineage import cut

# Characters of other alphabets and blocks drawn like the one on the left.
_LOOKALIKES = {
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іⅰ", "j": "јϳյ", "l": "ӏ",
    "n": "ոռ", "o": "оοօᴏଠ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "սᴜ", "v": "ѵνᴠ", "w": "ԝᴡա", "x": "х",
    "y": "уү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ",
    "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ",
    "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "ΖᏃ",
    "!": "ǃ", ",": "‚", "-": "‐˗", ".": "․", "/": "∕⁄", ":": "∶׃ː", "*": "∗", "'": "＇", "|": "ǀ∣",
}
_PROTOTYPE = {c: k for k, cs in _LOOKALIKES.items() for c in cs}
#: Compatibility forms that a reader tells apart from what they stand for.
_VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
#: Characters without a glyph that are not in the category of format characters.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
_BLANK = {0x2800, 0x0085, 0x2028, 0x2029}
#: A dotless i lacks what an accent is to a reader.
_APART = "\u0131"


#: The table once it was read; it is the same for the whole program.
_PUBLIC: dict[str, str] = {}


def prototypes(spark: SparkSession) -> dict[str, str]:
    """Character -> prototype by the public confusables data of Unicode, less what a reader tells apart.

    The data comes from the Unicode library that Spark itself runs on: one call gives the prototypes of
    all letters, numbers and signs. It takes ``I``, ``l``, ``1`` and ``|``, or ``O`` and ``0``, for one;
    here a character goes to the one of its own case or number. Left out are characters that stand for several letters
    (``m`` as ``rn``), compatibility forms (which are decomposed before), punctuation, and letters of one
    case whose prototype has the other.
    """
    if _PUBLIC:
        return dict(_PUBLIC)
    kind = unicodedata.category
    all_of = [c for c in map(chr, range(0x21, 0x110000)) if kind(c)[0] in "LNS"]
    found = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(all_of)).split("\n")
    if len(found) != len(all_of):
        raise ValueError("the confusables data can not be read")
    ascii_of: dict[str, list[str]] = {}
    for c, p in zip(all_of, found):
        if c.isascii():
            ascii_of.setdefault(p, []).append(c)
    out = {}
    for c, p in zip(all_of, found):
        if c.isascii() or c in _APART or kind(c)[0] == "S" and kind(p[:1] or " ")[0] != "L" or unicodedata.decomposition(c) or p == c:
            continue
        base = p.rstrip("".join(x for x in p if unicodedata.combining(x)))
        own = ascii_of.get(base, [base] if len(base) == 1 else [])
        cased = [x for x in own if not ({"Lu", "Ll"} == {kind(c), kind(x)} or kind(c) == "Nd" and x.isdigit() and int(x) != unicodedata.digit(c, -1) or kind(x)[0] in "PS" or x.isdigit() != (kind(c)[0] == "N") and len(own) > 1)]
        pick = next((x for x in cased if kind(x) == kind(c)), cased[0] if cased else None)
        if pick is not None and pick != c:
            out[c] = pick + p[len(base) :]
    _PUBLIC.update(out | _PROTOTYPE)
    return dict(_PUBLIC)


class _Table(dict):
    """Code point -> its replacement, worked out when first met."""

    def __init__(self, prototype: dict[str, str]):
        self.prototype = prototype

    def __missing__(self, o: int) -> str:
        self[o] = out = self._of(chr(o))
        return out

    def _of(self, c: str) -> str:
        o, kind = ord(c), unicodedata.category(c)
        if c in "\n ":
            return c
        if kind in ("Zs", "Zl", "Zp") or c == "\t" or o in _BLANK:
            return "\n" if o in (0x85, 0x2028, 0x2029) else " "
        if kind in ("Cf", "Cc", "Cs") or o in _INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
            return ""
        form = unicodedata.decomposition(c)
        if form and not form.startswith(_VISIBLE_FORMS):
            parts = form.split()
            return "".join(self[int(x, 16)] for x in parts[parts[0].startswith("<") :])
        p = self.prototype.get(c, c)
        return p if p == c or p.isascii() else "".join(x if x == c else self[ord(x)] for x in p)


#: Runs of accents; those are sorted, as their order can not be seen.
_MARKS = re.compile("[" + "".join(map(chr, filter(lambda o: unicodedata.combining(chr(o)), range(0x300, 0x1E950)))) + "]{2,}")
#: What a text of plain characters does not have.
_RUNS = re.compile(r"[^\x20-\x7e\n]+")
#: A joiner between two pictures makes one picture of them, and tags after a flag another flag.
_JOINED = regex.compile(r"((?<=[\p{Extended_Pictographic}\uFE0F\U0001F3FB-\U0001F3FF])\u200d(?=\p{Extended_Pictographic})|(?<=\U0001F3F4)[\U000E0020-\U000E007E]+\U000E007F)")


class Skeleton:
    """The consistent form of texts by one table of prototypes; runs of odd characters are remembered."""

    def __init__(self, prototype: dict[str, str] = _PROTOTYPE, remember: int = 100_000):
        self.table, self.runs, self.remember = _Table(prototype), {}, remember

    def _run(self, run: str) -> str:
        out = unicodedata.normalize("NFD", unicodedata.normalize("NFD", run).translate(self.table))
        return _MARKS.sub(lambda m: "".join(sorted(m[0])), out)

    def _known(self, m: re.Match) -> str:
        run = m[0]
        out = self.runs.get(run)
        if out is None:
            out = "".join(x if i % 2 else self._run(x) for i, x in enumerate(_JOINED.split(run))) if "\u200d" in run or "\U000e007f" in run else self._run(run)
            if len(run) < 100:
                if len(self.runs) > self.remember:
                    self.runs.clear()
                self.runs[run] = out
        return out

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        return _RUNS.sub(self._known, text).strip(" \n")


#: The form by the fixed values alone, for use without a session.
skeleton = Skeleton()
_SKELETONS: dict[int, Skeleton] = {}


def shared_skeleton(spark: SparkSession):
    """A function that gives, inside a worker, the skeleton by the whole table (some thousand characters, fixed by Unicode)."""
    shared = spark.sparkContext.broadcast(prototypes(spark))

    def get() -> Skeleton:
        if id(shared.value) not in _SKELETONS:
            _SKELETONS[id(shared.value)] = Skeleton(shared.value)
        return _SKELETONS[id(shared.value)]

    return get


def skeleton_of(spark: SparkSession, text: Column) -> Column:
    """The consistent form as a column. Texts of ASCII alone need no table and stay in the JVM; only the others go to Python."""
    get = shared_skeleton(spark)

    @F.arrow_udf(T.StringType())
    def form(texts: pa.Array) -> pa.Array:
        of = get()
        return pa.array([of(x) for x in texts.to_pylist()], pa.string())

    plain = F.length(text) == F.octet_length(text)
    gone = "".join(map(chr, (*range(9), 11, 12, *range(14, 32), 127)))
    jvm = F.btrim(F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\t" + gone, " "), F.lit(" \n"))
    return F.when(plain, jvm).otherwise(form(F.when(~plain, text)))


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, look, form): hashes of the skeleton and of the text itself; shows-nothing texts left out."""
    return (
        df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
        .where(F.col("t").isNotNull())
        .select("doc", skeleton_of(df.sparkSession, F.col("t")).alias("s"), F.unhex(F.md5("t")).alias("form"))
        .where(F.col("s") != "")
        .select("doc", F.unhex(F.md5("s")).alias("look"), "form")
    )


def consistent_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and the consistent form of its text."""
    return df.select(id_col, skeleton_of(df.sparkSession, F.col(text_col)).alias(text_col))


def lookalike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row that shows something: ``class_id`` (hash of the skeleton), how many rows and
    how many different strings its class holds. A hot class is only ever counted, never gathered."""
    c = _classes(df, id_col, text_col)
    size = c.groupBy("look", "form").agg(F.count("*").alias("n")).groupBy("look").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_forms"))
    return c.join(size, "look").select(F.col("doc").alias(id_col), F.lower(F.hex("look")).alias("class_id"), "n_docs", "n_forms")


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 2000) -> DataFrame:
    """Pairs of rows (smaller id first) whose texts are different strings with one skeleton.

    The different strings of a class are paired first, each pair of strings then gives the rows of one
    against the rows of the other: every combination that is made is a result, however many copies a
    string has. Strings of a class and rows of a string are cut into blocks of about ``block`` by hash
    and paired block against block, so that no task holds a whole class. Rows without an id pair with
    none; a row that is there twice counts once.
    """
    c = cut(_classes(df.where(F.col(id_col).isNotNull()), id_col, text_col).distinct())
    forms = c.groupBy("look", "form").agg(F.count("*").alias("n"))
    many = forms.groupBy("look").agg(F.count("*").alias("forms")).where("forms > 1")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    live = cut(forms.join(many, "look").select("look", "form", blocks("n").alias("k"), blocks("forms").alias("nb")).withColumn("b", F.expr("cast(pmod(xxhash64(form), nb) as int)")))
    # Cell (x, y) with x <= y holds the pairs of block x with block y; a string goes to the nb cells of its block.
    left = live.select("look", F.col("form").alias("fa"), F.col("k").alias("ka"), F.col("b").alias("x"), F.explode(F.expr("sequence(b, nb - 1)")).alias("y"))
    right = live.select("look", F.col("form").alias("fb"), F.col("k").alias("kb"), F.col("b").alias("y"), F.explode(F.expr("sequence(0, b)")).alias("x"))
    two = left.join(right, ["look", "x", "y"]).where("x < y or fa < fb")
    two = two.withColumn("ba", F.explode(F.expr("sequence(0, ka - 1)"))).withColumn("bb", F.explode(F.expr("sequence(0, kb - 1)"))).select("fa", "ba", "fb", "bb")
    docs = c.join(live.select("form", "k"), "form").select("form", "doc", F.expr("cast(pmod(xxhash64(doc), k) as int)").alias("b"))
    side = lambda s: docs.select(F.col("form").alias(f"f{s}"), F.col("b").alias(f"b{s}"), F.col("doc").alias(f"d{s}"))
    pairs = two.join(side("a"), ["fa", "ba"]).join(side("b"), ["fb", "bb"])
    return pairs.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))
