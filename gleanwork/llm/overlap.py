"""Records of evaluation splits that also occur in the training split, unchanged or nearly so.

A case is a pair of a train and an evaluation row on the same picture whose instructions ask the same
question. The search is a weighted cosine join of the wordings, blocked by picture:

1. Wordings are folded (look-alikes, case, punctuation, spacing) and cut into words. Slips of typing
   are led back to the word of the corpus they stand for, found by one-deletion neighbourhoods of the
   word table; words for the picture become one word; phrases around the question are cut off. What
   remains is the core of a wording.
2. A core is a vector of its words, weighted by rarity and of length one. Its words are ordered by
   rarity; the inverted lists (picture, word) hold a core only under the words before which the rest
   could still reach the threshold: the rest's norm, and its sum against the greatest weight that any
   vector has for a word, bound what the rest can add. Two cores above the threshold share such a word.
3. Candidates get their exact dot product. Those above the threshold are tested word by word for
   asking the same question, and expanded to rows.

Defined results: rows without number or picture, with null instructions or with none left after folding match
nothing; every stored line counts; an instruction that is all phrase (``Answer briefly.``) keeps it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.operators.pictures import clean_source, with_picture
from gleanwork.llm.skeleton import Skeleton, shared_skeleton, skeleton
from gleanwork.plans.lineage import cut, small_side

#: Cosine from which two cores are compared word by word.
THRESHOLD = 0.5
#: A word is a slip of another one that is at least so many times as frequent; more so for short words.
SLIP_RATIO, SHORT_RATIO = 20, 100
#: Words of fewer letters than this are short; of words of fewer than three letters the only slips are swaps.
SHORT = 5
SLIP_LENGTH = 3
#: Parts of an inverted list are paired on their own where it has more cores than this.
LIST = 2000
#: A phrase is learnt if so many wordings and this part of all have it, half of them are wordings without it too,
#: those begin in three ways or more, and one of its words hardly stands anywhere else.
PHRASE_LEAST, PHRASE_SHARE, PHRASE_WORDS, PHRASE_ATTESTED, PHRASE_OPENINGS, PHRASE_OWN = 20, 0.0005, 8, 0.5, 3, 0.9
#: A word of fewer (picture, wording) pairs than this can be a slip of a word no more frequent.
SETTLED = 3

# Words for the picture, and phrases that only say how to answer or where to look.
_PICTURE_WORDS = "image|picture|photo|photograph|pic|snapshot"
_LEADS = (
    "question", "q", "please", "please answer", "answer", "answer this", "please answer this", "now tell me", "tell me", "now",
    "looking at (?:the |this )?picture", "look at (?:the |this )?picture(?: and (?:answer|tell me))?", "based on (?:the |this )?picture",
    "from (?:the |this )?picture", "given (?:the |this )?picture", "judging by (?:the |this )?picture", "according to (?:the |this )?picture",
    "consider (?:the |this )?picture", "here is (?:a |the )?question", "quick question", "can you tell me", "could you tell me", "(?:in|on) (?:the|this) picture",
)
_TAILS = (
    "yes no", "yes or no", "true or false", "please", "thanks", "thank you",
    "(?:please )?(?:answer|reply|respond|say)(?: only)?(?: with)?(?: only)?(?: just)? (?:yes or no|true or false|yes no|briefly|shortly|concisely|in one word|(?:a )?single word|one word|one of (?:the|these) options?|one option|an option|the option|the letter|a number|one number)(?: only)?",
    "(?:please )?(?:pick|choose|select|give|take|mark)(?: only)? (?:the best|the right|the correct|one|an|exactly one|a single|the most likely)(?: of the| of these)? ?(?:answers?|options?|choices?)?",
    "be brief", "keep it short", "one word only", "look closely", "look carefully",
)
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
#: Deletions of one letter; the words of one key are compared.
_CUTS = "transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1, length(word))))"
#: Slips are looked for in words of letters: another number is another thing.
_SPELLED = r"length(word) > 1 and not word rlike '\\p{N}'"


def fold(text: str | None, form: Skeleton = skeleton) -> str | None:
    """The words of a wording in one spelling, parted by single spaces; null if there are none."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", form(text))
    return " ".join(_WORDS(text.lower())) or None


def folded(spark: SparkSession, text: Column) -> Column:
    """:func:`fold` as a column; ASCII stays in the JVM."""
    get = shared_skeleton(spark)

    @F.arrow_udf(T.StringType())
    def odd(texts: pa.Array) -> pa.Array:
        form = get()
        return pa.array([fold(x, form) for x in texts.to_pylist()], pa.string())

    plain = F.length(text) == F.octet_length(text)
    jvm = F.nullif(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))
    return F.when(plain, jvm).otherwise(odd(F.when(~plain, text)))


def one_slip(a: str, b: str) -> bool:
    """Whether one letter left out, put in, changed or swapped with its neighbour leads from ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def word_table(wordings: DataFrame) -> DataFrame:
    """(word, n, means): every word, in how many (picture, wording) pairs it stands, and the word it
    stands for: itself, the word it is a slip of, or its singular where both numbers are in use.

    ``wordings`` has (text, n). Counts are over all wordings. Slips are found without pairing words
    freely: a word and its one-letter deletions are keys, and words that share a key are compared; the
    likeliest partner wins, by its count and the kind of slip, of equals the greater.
    """
    words = wordings.select(F.explode(F.array_distinct(F.split("text", " "))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words)
    keys = words.where(_SPELLED).select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), F.expr(_CUTS)))).alias("key"))

    @F.arrow_udf(T.DoubleType())
    def slip(a: pa.Array, b: pa.Array) -> pa.Array:
        # A certain wrong letter is one of 25; the other slips of a letter are one of their kind.
        return pa.array([0.0 if not one_slip(x, y) else 0.04 if len(x) == len(y) and sorted(x) != sorted(y) else 1.0 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    rare = keys.select("key", F.col("word").alias("rare"), F.col("n").alias("rare_n"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    swap = (F.length("rare") == F.length("word")) & (letters("rare") == letters("word"))
    ratio = F.when(F.least(F.length("word"), F.length("rare") + 1) < SHORT, SHORT_RATIO).otherwise(SLIP_RATIO)
    # Short words in use have too many neighbours: theirs are slips only if hardly met, or by a swap.
    likely = (F.length("word") > SLIP_LENGTH) | swap | ((F.length("word") == SLIP_LENGTH) & (F.col("rare_n") < SETTLED))
    near = rare.join(keys, "key").where((F.col("n") >= ratio * F.col("rare_n")) & likely).select("rare", "word", "n").distinct()
    near = near.withColumn("likely", slip("rare", "word") * F.col("n")).where("likely > 0").groupBy("rare").agg(F.max_by("word", F.struct("likely", "word")).alias("means"))
    stands = cut(words.join(near, words.word == near.rare, "left").select("word", "n", F.coalesce("means", "word").alias("means")))
    # Plurals: lamps -> lamp where both are in use, also for what is a slip of lamps.
    own = stands.where((F.col("word") == F.col("means")) & (F.col("n") >= SETTLED)).select(F.col("word").alias("base"))
    plural = words.where(f"length(word) > 3 and word like '%s' and n >= {SETTLED}").select(F.col("word").alias("base")).select(
        F.col("base").alias("means"), F.explode(F.expr("array(substring(base, 1, length(base) - 1), if(base like '%es', substring(base, 1, length(base) - 2), null), if(base like '%ies', concat(substring(base, 1, length(base) - 3), 'y'), null))")).alias("base")
    )
    single = plural.join(own, "base").groupBy("means").agg(F.min("base").alias("base"))
    return cut(stands.join(single, "means", "left").select("word", "n", F.coalesce("base", "means").alias("means")))


def with_picture_word(words: Column) -> Column:
    """Corrected words with one word for the picture."""
    return F.regexp_replace(F.regexp_replace(words, rf"\b({_PICTURE_WORDS})s?\b", "picture"), r"\bthis picture\b", "the picture")


def core_of(words: Column, leads: Iterable[str], tails: Iterable[str]) -> Column:
    """The question itself: ``leads`` and ``tails`` (patterns over words) taken off, however many follow each other."""
    of = lambda ps: "|".join(sorted(ps, key=len, reverse=True))
    if tails := of(tails):
        words = F.regexp_replace(words, rf"(?<=\S)(?: (?:{tails}))+$", "")
    if leads := of(leads):
        words = F.regexp_replace(words, rf"^(?:(?:{leads}) )+(?=\S)", "")
    return words


def learnt_phrases(wordings: DataFrame) -> tuple[list[str], list[str]]:
    """(leads, tails) that the corpus itself shows to say nothing of the question; ``wordings`` has distinct ``s``.

    A phrase at an end counts if most wordings that have it are wordings without it as well, of several
    kinds of question, and if a word of it belongs to such phrases: ``on the table`` may stand after many
    questions, but tables are asked about too. Counted over all wordings; at most 1 / ``PHRASE_SHARE``
    phrases of each length can pass, and only those reach the driver.
    """
    w = wordings.where("s is not null").select("s", F.split("s", " ").alias("ws"))
    ends = F.expr(f"""explode(flatten(transform(sequence(1, least({PHRASE_WORDS}, size(ws) - 1)), i -> array(
        struct('lead' as end, slice(ws, 1, i) as phrase, slice(ws, i + 1, size(ws)) as rest), struct('tail' as end, slice(ws, size(ws) - i + 1, i) as phrase, slice(ws, 1, size(ws) - i) as rest)))))""")
    cuts = w.where("size(ws) > 1").select(ends.alias("e")).select("e.end", F.array_join("e.phrase", " ").alias("phrase"), F.xxhash64(F.array_join("e.rest", " ")).alias("h"), F.get("e.rest", F.lit(0)).alias("opening"))
    least = max(PHRASE_LEAST, int(PHRASE_SHARE * w.count()))
    often = cut(cuts.groupBy("end", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    there = w.select(F.xxhash64("s").alias("h")).distinct()
    # Only numbers are shuffled: of the phrase, of what is left without it, and of its first word.
    alone = cuts.join(small_side(often), ["end", "phrase"]).select("id", "h", F.xxhash64("opening").alias("opening")).join(there, "h", "left_semi")
    kept = alone.groupBy("id", "opening").agg(F.count("*").alias("k")).groupBy("id").agg(F.sum("k").alias("k"), F.count("*").alias("openings"))
    found = often.join(kept, "id").where((F.col("k") >= F.col("n") * PHRASE_ATTESTED) & (F.col("openings") >= PHRASE_OPENINGS)).select("end", "phrase").collect()
    sides = [[r.phrase for r in found if r.end == e] for e in ("lead", "tail")]
    mine = sorted({x for side in sides for p in side for x in p.split(" ")})
    if not mine:
        return [], []
    # Of each word of such phrases: how many wordings have it, and how many still do without the phrases.
    rest = F.split(core_of(F.col("s"), *sides), " ")
    own = w.select(F.explode(F.array_intersect("ws", F.array(*map(F.lit, mine)))).alias("word"), rest.alias("rest")).groupBy("word").agg(F.avg(F.array_contains("rest", F.col("word")).cast("double")).alias("elsewhere"))
    bound = {r.word for r in own.where(F.col("elsewhere") <= 1 - PHRASE_OWN).collect()}  # some of ``mine``
    leads, tails = ([p for p in side if bound.intersection(p.split(" "))] for side in sides)
    return leads, tails


def core_table(wordings: DataFrame, leads: Iterable[str] = _LEADS, tails: Iterable[str] = _TAILS) -> DataFrame:
    """(text, core): for each folded wording the question that is left of its corrected words.

    ``leads`` and ``tails`` are patterns to start from; phrases learnt from the wordings join them.
    """
    table = small_side(word_table(wordings).select("word", "means"))
    at = wordings.select("text", F.posexplode(F.split("text", " ")).alias("i", "word"))
    found = at.join(table, "word", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("i", "means"))).alias("w"))
    corrected = cut(found.select("text", with_picture_word(F.array_join(F.col("w.means"), " ")).alias("s")))
    more = learnt_phrases(corrected.select("s").distinct())
    core = core_of(F.col("s"), [*leads, *more[0]], [*tails, *more[1]])
    return corrected.select("text", F.when(core != "", core).otherwise(F.col("s")).alias("core"))


def core_vectors(cores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(core, vector, heads): unit vectors of words and the words a core is listed under.

    ``cores`` has (core, n), n being how many (picture, core) pairs there are. Weights are
    ``ln(1 + N / n_word)``; a word met fewer than three times, which may be a slip that could not be
    led back, weighs as little as the most common one and so never keeps two wordings apart.
    """
    whole = cores.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    words = cores.select("core", "n", F.explode(F.split("core", " ")).alias("word"))
    tf = words.groupBy("core", "word").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = tf.groupBy("word").agg(F.sum("n").alias("df"))
    idf = df.select("word", F.when(F.col("df") < SETTLED, F.log1p(F.lit(1.0))).otherwise(F.log1p(F.lit(float(whole)) / F.col("df"))).alias("idf"))
    idf = small_side(cut(idf))
    weighted = tf.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("core")))
    unit = cut(weighted.select("core", "word", "idf", (F.col("w") / norm).alias("w")))
    most = small_side(cut(unit.groupBy("word").agg(F.max("w").alias("most"))))
    v = unit.join(most, "word").groupBy("core").agg(F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("order"), "word", "w", "most"))).alias("v"))
    # What the words from position i on can add: the lesser of their norm and their sum against the greatest weights.
    rest = lambda f: F.reverse(F.aggregate(F.reverse("v"), F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + f(x)))))
    size = F.when(F.size("v") > 0, F.size("v"))
    v = v.where(size > 0).withColumn("norm2", rest(lambda x: x.w * x.w)).withColumn("sum", rest(lambda x: x.w * x.most))
    heads = F.filter(F.arrays_zip("v", "norm2", "sum"), lambda z: F.least(F.sqrt(z["norm2"]), z["sum"]) >= threshold - 1e-9)
    return v.select("core", F.map_from_entries(F.transform("v", lambda x: F.struct(x.word, x.w))).alias("vector"), F.transform(heads, lambda z: z["v"]["word"]).alias("heads"))


def dot(a: str, b: str) -> Column:
    """The exact dot product of two word vectors."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e.value * F.coalesce(F.try_element_at(F.col(b), e.key), F.lit(0.0)))


_NUMBER = regex.compile(r"\p{N}").search


@F.arrow_udf(T.BooleanType())
def _same_question(a: pa.Array, b: pa.Array, common: pa.Array) -> pa.Array:
    """Word by word: equal, or at most two places a slip apart where not both words are settled ones."""
    out = []
    for x, y, settled in zip(a.to_pylist(), b.to_pylist(), common.to_pylist(), strict=True):
        p, q, known = x.split(" "), y.split(" "), set(settled or ())
        differ = [(s, t) for s, t in zip(p, q) if s != t]
        out.append(len(p) == len(q) and len(differ) <= 2 and all((max(len(s), len(t)) >= SLIP_LENGTH or sorted(s) == sorted(t)) and not _NUMBER(s + t) and one_slip(s, t) and not (s in known and t in known) for s, t in differ))
    return pa.array(out, pa.bool_())


def slip_candidates(classes: DataFrame, words: DataFrame) -> DataFrame:
    """(picture, a, b): the cores of both sides on a picture that hold words a slip apart, not both settled.

    A slip of a rare word that could not be led back leaves that word's weight on one side only, and the
    cosine falls below any useful threshold; what the word test can accept is therefore listed by words
    too. Slips are found in the word table, by one-letter deletions; ``words`` has (word, n).
    """
    keys = words.where(_SPELLED).select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), F.expr(_CUTS)))).alias("key"))
    new = keys.where(F.col("n") < SETTLED).select("key", F.col("word").alias("new"))

    @F.arrow_udf(T.BooleanType())
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one_slip(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    pairs = new.join(keys, "key").where((F.col("new") != F.col("word")) & ((F.greatest(F.length("new"), F.length("word")) >= SLIP_LENGTH) | (F.reverse("new") == F.col("word")))).select("new", "word").distinct()
    pairs = cut(pairs.where(near("new", "word")))
    # Only the words of such pairs are listed.
    used = small_side(pairs.select("new").union(pairs.select("word")).distinct().withColumnRenamed("new", "word"))
    listed = cut(classes.select("picture", "core", "in_train", "in_held", F.size(F.split("core", " ")).alias("length"), F.explode(F.array_distinct(F.split("core", " "))).alias("word")).join(used, "word", "left_semi"))
    news = listed.withColumnRenamed("word", "new").join(small_side(pairs), "new").select("picture", "length", "word", F.col("core").alias("x"), F.col("in_train").alias("x_train"), F.col("in_held").alias("x_held"))
    both = news.join(listed.withColumnRenamed("core", "y"), ["picture", "length", "word"]).where("x <> y")
    one = both.where("x_train and in_held").select("picture", F.col("x").alias("a"), F.col("y").alias("b"))
    return cut(one.unionByName(both.where("x_held and in_train").select("picture", F.col("y").alias("a"), F.col("x").alias("b"))).distinct())


def _paired_lists(left: DataFrame, right: DataFrame, most: int = LIST) -> DataFrame:
    """(picture, a, b) of the inverted lists of both sides; a list of more than ``most`` cores is cut into
    parts by hash on the left and repeated for them on the right, so that a hot list is many tasks."""
    long = left.groupBy("picture", "word").agg(F.count("*").alias("n")).where(F.col("n") > most).select("picture", "word", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    long = cut(long)
    on = ["picture", "word"]
    if not long.isEmpty():
        long = small_side(long)
        left = left.join(long, on, "left").withColumn("part", F.coalesce(F.expr("cast(pmod(xxhash64(a), parts) as int)"), F.lit(0))).drop("parts")
        right = right.join(long, on, "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
        on = [*on, "part"]
    return left.join(right, on).select("picture", "a", "b")


def overlaps(train: DataFrame, held: DataFrame, alias: DataFrame, threshold: float = THRESHOLD, leads: Iterable[str] = _LEADS, tails: Iterable[str] = _TAILS) -> DataFrame:
    """(train_no, held_no, similarity): all cases between the rows of ``train`` and of ``held``.

    Equal cores have similarity 1, the dot product of a unit vector with itself. The threshold costs no case:
    two other cores that the word test accepts differ in a word that is hardly met, and such pairs are candidates by
    their words too (:func:`slip_candidates`).
    """
    want = ("rec_no", "source", "image_id", "instructions")
    both = train.select(*want, F.lit(True).alias("train")).unionByName(held.select(*want, F.lit(False).alias("train")))
    rows = with_picture(both, alias).select("rec_no", "train", "picture", folded(train.sparkSession, F.col("instructions")).alias("text"))
    # Wordings are shuffled by a hash of 128 bits; their text moves once per wording and task.
    rows = cut(rows.where("rec_no is not null and picture is not null and text is not null").withColumn("key", F.unhex(F.md5("text"))))
    both_in = lambda: (F.max("in_train").alias("in_train"), F.max("in_held").alias("in_held"))
    sides = rows.select("picture", "key", F.col("train").alias("in_train"), (~F.col("train")).alias("in_held"))
    asked = cut(sides.groupBy("picture", "key").agg(*both_in()))
    per = asked.groupBy("key").agg(F.count("*").alias("n"))
    wordings = cut(rows.groupBy("key").agg(F.first("text").alias("text")).join(per, "key"))
    table = small_side(cut(core_table(wordings, leads, tails).select(F.unhex(F.md5("text")).alias("key"), "core")))
    # A core on a picture is one class, however many rows ask it; counts are over all, only pictures of both sides go on.
    classes = cut(asked.join(table, "key").groupBy("picture", "core").agg(*both_in()))
    cores = cut(classes.groupBy("core").agg(F.count("*").alias("n")))
    shared = asked.groupBy("picture").agg(*both_in()).where("in_train and in_held").select("picture")
    shared = small_side(cut(shared))
    classes = cut(classes.join(shared, "picture", "left_semi"))
    rows = cut(rows.drop("text").join(shared, "picture", "left_semi").join(table, "key").select("rec_no", "train", "picture", "core"))
    vectors = cut(core_vectors(cores, threshold))
    heads = small_side(vectors.select("core", "heads"))
    listed = classes.join(heads, "core").select("picture", "core", "in_train", "in_held", F.explode("heads").alias("word"))
    left = listed.where("in_train").select("picture", "word", F.col("core").alias("a"))
    right = listed.where("in_held").select("picture", "word", F.col("core").alias("b"))
    words = cut(cores.select("n", F.explode(F.array_distinct(F.split("core", " "))).alias("word")).groupBy("word").agg(F.sum("n").alias("n")))
    slips = slip_candidates(classes, words)
    candidates = cut(_paired_lists(left, right).unionByName(slips).distinct())
    # Similarity depends on the two cores only: each pair of them is worked out once.
    pairs = candidates.where("a <> b").select("a", "b").distinct()
    sided = small_side(vectors.select(F.col("core").alias("a"), F.col("vector").alias("va")))
    by_b = vectors.select(F.col("core").alias("b"), F.col("vector").alias("vb"))
    scored = pairs.join(sided, "a").join(by_b, "b").withColumn("similarity", dot("va", "vb"))
    scored = scored.join(small_side(slips.select("a", "b").distinct().withColumn("slip", F.lit(True))), ["a", "b"], "left").where((F.col("similarity") >= threshold) | F.col("slip"))
    apart = F.array_union(F.array_except(F.split("a", " "), F.split("b", " ")), F.array_except(F.split("b", " "), F.split("a", " ")))
    scored = cut(scored.select("a", "b", "similarity", apart.alias("apart")).where("size(apart) between 1 and 4"))
    settled = words.where(F.col("n") >= SETTLED).select("word")
    known = scored.select("a", "b", F.explode("apart").alias("word")).join(settled, "word", "left_semi").groupBy("a", "b").agg(F.collect_set("word").alias("known"))
    same = cut(scored.join(known, ["a", "b"], "left").where(_same_question("a", "b", "known")).select("a", "b", "similarity"))
    found = candidates.where("a = b").withColumn("similarity", F.lit(1.0)).unionByName(candidates.where("a <> b").join(small_side(same), ["a", "b"]).select("picture", "a", "b", "similarity"))
    of = lambda side, c, no: rows.where(side).select("picture", F.col("core").alias(c), F.col("rec_no").alias(no))
    return found.join(of("not train", "b", "held_no"), ["picture", "b"]).join(of("train", "a", "train_no"), ["picture", "a"]).select("train_no", "held_no", "similarity")


def overlap_pairs(train: DataFrame, held: DataFrame, alias: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rec_a, rec_b), the smaller number first."""
    p = overlaps(train, held, alias, threshold)
    return p.select(F.least("train_no", "held_no").alias("rec_a"), F.greatest("train_no", "held_no").alias("rec_b"))


def overlap_counts(train: DataFrame, held: DataFrame, alias: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(split, source, n_pairs, n_held, n_train, n_rows) per split and clean source of the evaluation rows;
    every split and source is there, with zeros where nothing overlaps."""
    p = overlaps(train, held, alias, threshold).select("train_no", "held_no")
    side = held.select(F.col("rec_no").alias("held_no"), "split", clean_source("source").alias("source"))
    everything = side.groupBy("split", "source").agg(F.count("*").alias("n_rows"))
    hit = p.join(side, "held_no")
    got = hit.groupBy("split", "source", "held_no").agg(F.count("*").alias("n")).groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_held"))
    trained = hit.groupBy("split", "source", "train_no").agg(F.lit(1).alias("x")).groupBy("split", "source").agg(F.count("*").alias("n_train"))
    on = lambda d: (F.col("e.split").eqNullSafe(d["split"])) & (F.col("e.source").eqNullSafe(d["source"]))
    out = everything.alias("e").join(got, on(got), "left").select("e.*", "n_pairs", "n_held").alias("e").join(trained, on(trained), "left")
    return out.select("e.split", "e.source", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("n_held", F.lit(0)).alias("n_held"), F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_rows")
