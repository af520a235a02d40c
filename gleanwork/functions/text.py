"""Text expressions of question data. All of them are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, colour words, number words, and how a line begins that only says how to answer.
STOP = ["a", "an", "the", "of", "in", "on", "at", "to", "is", "are", "and", "or", "it", "this", "that", "there", "with", "for"]
COLOURS = ["black", "white", "red", "green", "blue", "yellow", "orange", "brown", "pink", "purple", "gray", "grey", "silver"]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
ANSWER_LINES = ["answer", "provide", "give", "be ", "quick", "short", "keep", "offer", "ensure", "respond", "your answer", "your response", "please", "only", "just", "the answer", "a short", "concise", "brief", "write", "reply", "use ", "make", "state"]


def norm(t: Column) -> Column:
    """Lower case, single spaces, no question mark at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"\s+", " "), r"[ ?]+$", ""))


def words(t: Column) -> Column:
    """Lower-case words and numbers, ``n't`` split off."""
    return F.regexp_extract_all(F.replace(F.lower(t), F.lit("n't"), F.lit(" n't")), F.lit(r"(n't|[a-z0-9]+)"), F.lit(1))


def content_words(t: Column) -> Column:
    return F.array_except(words(t), F.array(*map(F.lit, STOP)))


def ngrams(ws: Column, n: int) -> Column:
    """Runs of ``n`` words; none of fewer words."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def features(t: Column) -> Column:
    """Words, pairs of words and a length bucket, each once."""
    ws = words(t)
    return F.array_union(F.array_union(ws, ngrams(ws, 2)), F.array(F.concat(F.lit("len:"), F.least(F.lit(8), F.floor(F.size(ws) / 2)).cast("string"))))


def singular_word(w: Column) -> Column:
    """``-es`` off after ch, sh, ss and x, else ``-s`` off words of more than three letters that do not end in ss."""
    return F.when(w.rlike("(ch|sh|ss|x)es$"), F.left(w, F.length(w) - 2)).when(w.rlike("[^s]s$") & (F.length(w) > 3), F.left(w, F.length(w) - 1)).otherwise(w)


def singular(t: Column) -> Column:
    """Each word in the singular, by rule."""
    return F.array_join(F.transform(F.split(t, " "), singular_word), " ")


def holds_word(a: Column, b: Column) -> Column:
    """Whether ``b`` stands in ``a`` as whole words."""
    return F.instr(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" "))) > 0


def related(a: Column, b: Column) -> Column:
    return (a == b) | holds_word(a, b) | holds_word(b, a)


def clash(a: Column, b: Column) -> Column:
    """Whether two answers can't both be offered: related as written, or in the singular equal or one within the other as words."""
    x, y = norm(a), norm(b)
    return related(x, y) | related(singular(x), singular(y))


def template(t: Column) -> Column:
    """Quoted parts as ``_``, numbers as ``#``."""
    return F.regexp_replace(F.regexp_replace(t, r"\"[^\"]*\"", "_"), r"[0-9]+(\.[0-9]+)?", "#")


def question_kind(t: Column) -> Column:
    """Kind of a question by its opening words."""
    s = norm(t)
    return F.when(s.rlike("^how many "), "count").when(s.rlike("^what colou?r "), "color").when(s.rlike("^(is|are|does|do|was|were|can|has|have) "), "yesno").when(s.rlike("^which "), "which").when(s.rlike("^what "), "what").otherwise("other")


def wording_prefix(t: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(norm(t), " "), 1, n), " ")


def parse_number(t: Column) -> Column:
    """A number without thousands marks, percent and currency; null if it is none."""
    return F.regexp_replace(F.trim(t), r"[,%$€£ ]", "").try_cast("double")


def canonical_answer(t: Column) -> Column:
    """Numbers without needless zeros, signs and thousands marks, ``%`` kept; the rest lower case with single blanks;
    the one word grey is gray."""
    s = F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))
    bare = F.regexp_replace(F.trim(F.regexp_replace(s, "%$", "")), ",", "")
    number = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    number = F.regexp_replace(F.regexp_replace(number, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    number = F.regexp_replace(number, "^-0$", "0")
    return F.when(bare.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.concat(number, F.when(s.endswith("%"), "%").otherwise(""))).when(s == "grey", "gray").otherwise(s)


def answer_class(question: Column, answer: Column) -> Column:
    """The pool that distractors of an answer come from."""
    a = F.lower(F.trim(answer))
    return (
        F.when(a.isin("yes", "no", "true", "false"), "yesno").when(a.isin(*COLOURS), "color").when(a.rlike("^(19|20)[0-9]{2}$"), "year")
        .when(a.isin(*NUMBER_WORDS) | canonical_answer(a).rlike(r"^-?[0-9]+(\.[0-9]+)?%?$"), "number")
        .otherwise(F.concat(F.lit("text:"), wording_prefix(question, 4)))
    )


def label_format(t: Column) -> Column:
    """(decimals, prefix, suffix) of a written number."""
    return F.struct(F.length(F.regexp_extract(t, r"\.([0-9]+)", 1)).alias("decimals"), F.regexp_extract(t, r"^([^0-9.-]*)", 1).alias("prefix"), F.regexp_extract(t, r"([^0-9.,]*)$", 1).alias("suffix"))


def thousands(t: Column) -> Column:
    """Separators in the integer part of a written number."""
    whole, rest = F.regexp_extract(t, r"^(-?[0-9]+)", 1), F.regexp_extract(t, r"^-?[0-9]+(.*)$", 1)
    return F.when(whole == "", t).otherwise(F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+$)", ","), rest))


def short_answer(t: Column) -> Column:
    """``Answer: 2.`` -> ``2``."""
    return F.regexp_replace(F.regexp_replace(F.trim(t), r"(?i)^(the )?answer( is)?[: ]+", ""), r"[. ]+$", "")


def question_text(t: Column) -> Column:
    """A question without what says in what form to answer: lines at the end, and what follows its mark on its own line."""
    says = lambda x: F.lower(x).rlike("^(" + "|".join(ANSWER_LINES) + ")")
    lines = F.filter(F.transform(F.split(t, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.transform(lines, lambda x, i: F.when((i == 0) | x.endswith("?") | ~says(x), i + 1).otherwise(F.lit(0)))
    text = F.array_join(F.slice(lines, F.lit(1), F.greatest(F.coalesce(F.array_max(kept), F.lit(0)), F.lit(0))), " ")
    tail = F.trim(F.regexp_extract(text, r"^.*\?([^?]*)$", 1))
    return F.when((tail != "") & says(tail), F.regexp_extract(text, r"^(.*\?)[^?]*$", 1)).otherwise(text)


def turn(question: Column, answer: Column) -> Column:
    """(class, question, answer) of a turn: yesno, number, word (up to three words), or null."""
    a = short_answer(answer)
    low = F.lower(a)
    kind = F.when(low.isin("yes", "no"), "yesno").when(a.rlike("^[0-9]+$"), "number").when((a != "") & (F.size(F.split(F.trim(a), r"\s+")) <= 3), "word")
    return F.when(kind.isNotNull(), F.struct(kind.alias("class"), question_text(question).alias("question"), F.when(kind == "yesno", low).otherwise(a).alias("answer")))


def choice_turn(user: Column, assistant: Column) -> Column:
    """(question, options, answer) of ``question / Choices: / A. x / B. y`` and an answer by letter; null unless two
    options or more, all different, and the letter names one."""
    inner = r"(?s)^\s*(?:Question:\s*)?(.*?)\nChoices:\n(.*?)(?:\nAnswer with.*)?$"
    listed = F.regexp_extract(F.trim(user), inner, 2)
    names = F.regexp_extract_all(listed, F.lit(r"(?m)^([A-J])\.\s*(.+)$"), F.lit(1))
    texts = F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^([A-J])\.\s*(.+)$"), F.lit(2)), lambda x: F.trim(x))
    at = F.array_position(names, F.upper(F.left(short_answer(assistant), F.lit(1)))).cast("int")
    good = (F.size(texts) >= 2) & (F.size(F.array_distinct(texts)) == F.size(texts)) & (at > 0)
    return F.when(good, F.struct(F.trim(F.regexp_extract(F.trim(user), inner, 1)).alias("question"), texts.alias("options"), F.get(texts, at - 1).alias("answer")))


def literal_choice(choices: Column, letter: Column) -> Column:
    """(options, index) of a list written out, ``['a', 'b']``, and a letter in brackets or bare."""
    options = F.transform(F.regexp_extract_all(choices, F.lit(r"'((?:[^'\\\\]|\\\\.)*)'|\"((?:[^\"\\\\]|\\\\.)*)\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.struct(options.alias("options"), (F.ascii(F.upper(F.regexp_extract(letter, "([A-Za-z])", 1))) - 65).alias("index"))


def lettered_options(t: Column) -> Column:
    """Options of ``A: red; B: blue`` or lines ``A. red``, in order."""
    return F.transform(F.regexp_extract_all(t, F.lit(r"(?:^|[;\n]|\s)\(?[A-Z][:.)]\s*([^;\n]+)"), F.lit(1)), lambda x: F.trim(x))


def statement_to_question(t: Column) -> Column:
    """``The cat is on the mat.`` -> ``Is the cat on the mat?``, ``The box contains a cat`` -> ``Does the box contain a cat?``; else null."""
    s = F.regexp_replace(F.trim(t), r"[. ]+$", "")
    part = lambda p, i: F.regexp_extract(s, rf"(?i)^(.+?) ({p}) (.+)$", i)
    low = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    be, do = "is|are|was|were", "contains|has|consists of|touches"
    verb = part(do, 2)
    bare = F.when(F.lower(verb) == "has", "have").when(F.lower(verb) == "consists of", "consist of").when(F.lower(verb) == "touches", "touch").otherwise("contain")
    return F.when(part(be, 1) != "", F.concat(F.initcap(part(be, 2)), F.lit(" "), low(part(be, 1)), F.lit(" "), part(be, 3), F.lit("?"))).when(part(do, 1) != "", F.concat(F.lit("Does "), low(part(do, 1)), F.lit(" "), bare, F.lit(" "), part(do, 3), F.lit("?")))


def whole_number(t: Column) -> Column:
    """A count in any spelling, digits or a word up to ten, as a number; null if it is none."""
    low = F.lower(F.trim(t))
    return F.coalesce(F.regexp_replace(low, ",", "").try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), low), F.lit(0)).cast("int") - 1)


def is_count_question(kind: Column, question: Column, options: Column) -> Column:
    """A choice among counts only, asked by ``how many`` or said to be one."""
    return (F.size(options) > 0) & F.forall(options, lambda o: whole_number(o).isNotNull()) & (F.lower(question).contains("how many") | (kind == "count"))


def wide_counts(gold: Column, top: int = 10) -> Column:
    """The gold's mass over the counts 0 to ``top``, spellings of one number summed; null if any mass is on another answer."""
    number = F.transform(gold, lambda e: F.struct(whole_number(e["key"]).alias("n"), e["p"].alias("p")))
    beyond = F.exists(number, lambda e: (e["p"] > 0) & ((e["n"] > top) | e["n"].isNull() | (e["n"] < 0)))
    mass = lambda k: F.aggregate(F.filter(number, lambda e: e["n"] == k), F.lit(0.0), lambda s, e: s + e["p"])
    return F.when(~beyond, F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.struct(k.cast("string").alias("key"), mass(k).alias("p"))))


def near_numbers(t: Column) -> Column:
    """Numbers near a written one in its own format: steps of one or two around small whole numbers, parts and
    multiples of others; never of another sign than a number of zero or more. Empty for what is no number."""
    core = F.regexp_replace(F.regexp_replace(F.trim(t), "%$", ""), ",", "")
    g, decimals = core.try_cast("double"), F.length(F.regexp_extract(core, r"\.([0-9]+)$", 1))
    steps = F.transform(F.array(*map(F.lit, (1.0, -1.0, 2.0, -2.0, 3.0))), lambda d: g + d)
    parts = F.transform(F.array(*map(F.lit, (0.5, 1.5, 2.0, 0.75, 1.25))), lambda m: g * m)
    near = F.when((decimals == 0) & (F.abs(g) < 30), steps).otherwise(parts)
    near = F.filter(near, lambda v: ~((v < 0) & (g >= 0)))
    shown = F.transform(near, lambda v: _fixed(v, decimals))
    text = F.transform(shown, lambda v: F.concat(F.when(t.contains(","), thousands(v)).otherwise(v), F.when(t.endswith("%"), "%").otherwise("")))
    return F.when(g.isNotNull() & ~F.isnan(g), F.array_distinct(F.filter(text, lambda v: v != F.trim(t)))).otherwise(F.array().cast("array<string>"))


def _fixed(v: Column, decimals: Column) -> Column:
    """A written number with so many decimals, rounded half up."""
    r = v.cast("decimal(24,6)")
    out = F.when(decimals == 0, F.round(r, 0).cast("decimal(24,0)").cast("string"))
    for n in range(1, 6):
        out = out.when(decimals == n, F.round(r, n).cast(f"decimal(24,{n})").cast("string"))
    return out.otherwise(r.cast("string"))


def number_spans(t: Column) -> Column:
    """(start, stop, text) of each number in a text, positions from 0. For captions: the list is built up number by number."""
    found = F.regexp_extract_all(t, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))
    begin = lambda s, x: F.call_function("locate", x, t, s["at"] + 1) - 1
    step = lambda s, x: F.struct((begin(s, x) + F.length(x)).alias("at"), F.concat(s["out"], F.array(F.struct(begin(s, x).alias("start"), (begin(s, x) + F.length(x)).alias("stop"), x.alias("text")))).alias("out"))
    empty = F.array().cast("array<struct<start:int,stop:int,text:string>>")
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def leading_number(t: Column) -> Column:
    """The number that an option begins with; null if it begins with none."""
    return F.regexp_replace(F.regexp_extract(F.trim(t), r"^([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def number_labels(t: Column, slots: int, alphabet: str = "0123456789.-,%") -> Column:
    """Places of a number's characters in ``alphabet``, then the end mark (the alphabet's length), filled up with -1; null if
    a character is not in it or the text is longer than the slots leave room for."""
    ids = F.transform(F.split(t, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(alphabet), c) - 1)
    good = (t != "") & (F.length(t) < slots) & ~F.exists(ids, lambda i: i < 0)
    return F.when(good, F.slice(F.concat(ids, F.array(F.lit(len(alphabet))), F.array_repeat(F.lit(-1), slots)), F.lit(1), F.lit(slots)))


def read_number(ids: Column, alphabet: str = "0123456789.-,%") -> Column:
    """The number that character places spell up to the end mark; null if it is none or no end mark is there."""
    end = F.array_position(ids, len(alphabet)).cast("int")
    text = F.array_join(F.transform(F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0))), lambda i: F.substring(F.lit(alphabet), i + 1, F.lit(1))), "")
    return F.when((end > 0) & text.rlike(r"^-?[0-9][0-9,]*(\.[0-9]+)?%?$"), text)


def routed(t: Column, routes: dict[str, list[list[str]]]) -> Column:
    """The first route one of whose sets of words all stand in the normalised question; null if none does."""
    s, out = norm(t), F.lit(None).cast("string")
    for name, sets in reversed(routes.items()):
        hit = F.lit(False)
        for w in sets:
            met = F.lit(True)
            for x in w:
                met &= s.contains(x)
            hit |= met
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def table_text(state: Column, header: str, rows: Column) -> Column:
    """The text, a header, and a line ``object: quantity = value`` per row (structs of object, quantity, value)."""
    lines = F.array_join(F.transform(rows, lambda r: F.format_string("%s: %s = %s", r["object"], r["quantity"], r["value"])), "\n")
    return F.concat(F.when(F.coalesce(state, F.lit("")) != "", F.concat(state, F.lit("\n"))).otherwise(""), F.lit(header + "\n"), lines)


def product_of_square(m: Column, v: Column) -> Column:
    """m * v * v as an exact whole number with thousands marks, from two written numbers; null unless both are whole numbers."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), ",", ""), r"\.0*$", "")
    whole = lambda x: F.when(bare(x).rlike("^-?[0-9]{1,9}$"), bare(x)).cast("decimal(9,0)")
    return thousands((whole(m) * whole(v) * whole(v)).cast("decimal(38,0)").cast("string"))


def count_options(n: Column, low: int = 0, high: int = 10, around: int = 1) -> Column:
    """Whole numbers around ``n`` as text, kept within the bounds."""
    return F.transform(F.sequence(F.greatest(n - around, F.lit(low)), F.least(n + around, F.lit(high))), lambda x: x.cast("string"))


def count_run(n: Column, length: Column, u: Column, top: int = 10) -> Column:
    """``length`` neighbouring counts from 0 to ``top`` as text with ``n`` among them, its place given by ``u`` in [0, 1);
    null where ``n`` is beyond the counts."""
    low = F.greatest(F.lit(0), n - length + 1)
    high = F.least(n, F.lit(top) - length + 1)
    start = (low + F.floor(u * (high - low + 1))).cast("int")
    return F.when((n >= 0) & (n <= top), F.transform(F.sequence(start, start + length - 1), lambda x: x.cast("string")))


def count_bucket(n: Column) -> Column:
    """The stratum of a count."""
    return F.when(n <= 1, n.cast("string")).when(n <= 3, "2-3").when(n <= 6, "4-6").when(n.isNotNull(), "7+")


def placed(gold: Column, others: Column, slot: Column) -> Column:
    """``gold`` put among the distractors at ``slot`` modulo the number of places."""
    at = (F.pmod(slot, F.size(others) + 1) + 1).cast("int")
    return F.concat(F.slice(others, F.lit(1), at - 1), F.array(gold), F.slice(others, at, F.greatest(F.size(others) - at + 1, F.lit(0))))


def cyclic_orders(options: Column) -> Column:
    """All rotations of a list."""
    n = F.size(options)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(options, k + 1, n), F.slice(options, F.lit(1), k)))).otherwise(F.array().cast("array<array<string>>"))


def clean_options(options: Column) -> Column:
    """Trimmed, not empty, each once ignoring case, in order."""
    kept = F.filter(F.transform(options, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def word_budget(t: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` blank-separated words."""
    return F.array_join(F.slice(F.split(F.trim(t), r"\s+"), 1, n), " ")
