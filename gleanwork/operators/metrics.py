"""Numbers over evaluation records: every one a query over the table of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import probs as P
from gleanwork.functions import text as X

GROUPS = ("all", "source", "kind", "axis", "options")


def scored(records: DataFrame) -> DataFrame:
    """Records with ``is_right``, ``nll`` (soft gold, floored at 1e-12) and ``brier`` (gold keys only)."""
    return records.withColumns({
        "is_right": F.col("prediction") == F.col("gold_answer"),
        "nll": P.nll(F.col("gold"), F.col("probabilities")),
        "brier": P.brier(F.col("gold"), F.col("probabilities")),
    })


def confidence_bin(p: Column, bins: int) -> Column:
    """Equal bins over [0, 1], the last one with 1 in it."""
    return F.least(F.floor(p * bins), F.lit(bins - 1))


def _mean(c: Column) -> Column:
    return F.avg(c.cast("double"))


def binned_error(df: DataFrame, by: list[str], conf: Column, right: Column, bins: int = 15) -> DataFrame:
    """(by..., ece): gaps between confidence and accuracy per bin, weighted by the bins' shares."""
    b = df.groupBy(*by, confidence_bin(conf, bins).alias("_bin")).agg(F.count("*").alias("_n"), _mean(conf).alias("_c"), _mean(right).alias("_a"))
    return b.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def summary(records: DataFrame, by: list[str] = ("run_id",), bins: int = 15) -> DataFrame:
    """(by..., field, value, n, images, accuracy, nll, brier, ece) over all records and by source, kind,
    axis and number of options; an empty field counts as ``-``.

    Each record goes to its five groups in one pass. Sums, bins and distinct pictures are combined on
    the map side; groups are few, so what is shuffled does not grow with the records.
    """
    r = scored(records)
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("-")).otherwise(c)
    pairs = {"all": F.lit("all"), "source": filled(F.col("source")), "kind": filled(F.col("kind")), "axis": filled(F.col("axis")), "options": F.size("options").cast("string")}
    g = r.withColumn("_g", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in pairs.items())))).select(*by, "_g.field", "_g.value", "image_id", "is_right", "nll", "brier", "p_prediction")
    keys = [*by, "field", "value"]
    right = F.col("is_right").cast("double")
    sums = [F.count("*").alias("_n"), F.sum(right).alias("_r"), F.sum("nll").alias("_l"), F.sum("brier").alias("_b"), F.sum("p_prediction").alias("_p")]
    per_bin = g.groupBy(*keys, confidence_bin(F.col("p_prediction"), bins).alias("_bin")).agg(*sums)
    out = per_bin.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum("_r") / F.sum("_n")).alias("accuracy"), (F.sum("_l") / F.sum("_n")).alias("nll"), (F.sum("_b") / F.sum("_n")).alias("brier"),
        (F.sum(F.abs(F.col("_p") - F.col("_r"))) / F.sum("_n")).alias("ece"),
    )
    images = g.select(*keys, "image_id").distinct().groupBy(*keys).agg(F.count("image_id").alias("images"))
    return out.join(images, keys).select(*keys, "n", "images", "accuracy", "nll", "brier", "ece")


def reliability(records: DataFrame, by: list[str] = ("run_id",), bins: int = 10) -> DataFrame:
    """Per confidence bin that holds records: how many, mean confidence, accuracy."""
    r = scored(records)
    b = confidence_bin(F.col("p_prediction"), bins).cast("int").alias("bin")
    return r.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg("p_prediction").alias("confidence"), _mean(F.col("is_right")).alias("accuracy"))


def thresholds(records: DataFrame, at: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9), by: list[str] = ("run_id",)) -> DataFrame:
    """Share answered and accuracy of those when only answers of confidence >= t are given; null accuracy of none."""
    r = scored(records).withColumn("threshold", F.explode(F.array(*map(F.lit, at))))
    over = F.col("p_prediction") >= F.col("threshold")
    return r.groupBy(*by, "threshold").agg(_mean(over).alias("coverage"), _mean(F.when(over, F.col("is_right").cast("double"))).alias("accuracy"))


def confusion(records: DataFrame, by: list[str]) -> DataFrame:
    """Yes/no metrics, ``true`` being positive; an undefined ratio is 0."""
    yes, gold = F.col("prediction") == "true", F.col("gold_answer") == "true"
    no, miss = F.col("prediction") == "false", F.col("gold_answer") == "false"
    c = records.groupBy(*by).agg(F.count_if(yes & gold).alias("tp"), F.count_if(yes & miss).alias("fp"), F.count_if(no & gold).alias("fn"), F.count_if(no & miss).alias("tn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "yes_ratio": ratio(tp + fp, F.col("n"))})
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def quantiles(df: DataFrame, value: str, by: list[str], at: list[float], digits: int = 3, discrete: bool = False) -> DataFrame:
    """(by..., q0, q1, ...): exact interpolated quantiles of the values that are there, without a buffer of all values;
    ``discrete``: the least value that at least that part of them does not exceed.

    Values are counted in buckets of ``digits`` significant digits, the buckets that hold the wanted ranks
    are found in the running counts, and only the values of those buckets (at most 9 x 10^(digits - 1) buckets
    per power of ten, so about one value in hundreds) are counted one by one.
    """
    v = F.col(value).cast("double")
    there = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.col("_v")))))
    there = there.withColumn("_b", F.when(F.col("_v") == 0, 0.0).otherwise(F.floor(F.col("_v") * scale) / scale))
    counts = there.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    if discrete:
        ranks = [(F.greatest(F.ceil(F.col("_all") * F.lit(q)), F.lit(1)) - 1).cast("bigint") for q in at]
    else:
        ranks = [f((F.col("_all") - 1) * F.lit(q)).cast("bigint") for q in at for f in (F.floor, F.ceil)]
    # The wanted ranks are worked out once per bucket, as a list.
    counts = counts.withColumn("_ranks", F.array(*ranks))
    holds = lambda r, n: (F.col("_before") <= r) & (r < F.col("_before") + F.col(n))
    hot = counts.where(F.exists("_ranks", lambda r: holds(r, "_n")))
    met = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))
    each = there.alias("t").join(hot.alias("h"), met("t", "h") & (F.col("t._b") == F.col("h._b"))).groupBy(*(F.col(f"t.{c}").alias(c) for c in by), F.col("t._b").alias("_b"), F.col("t._v").alias("_v"), F.col("h._before").alias("_start"), F.col("h._all").alias("_all"), F.col("h._ranks").alias("_ranks")).agg(F.count("*").alias("_k"))
    each = each.withColumn("_before", F.col("_start") + F.sum("_k").over(Window.partitionBy(*by, "_b").orderBy("_v")) - F.col("_k"))
    ends = each.groupBy(*by).agg(*(F.max(F.when(holds(F.get("_ranks", F.lit(i)), "_k"), F.col("_v"))).alias(f"_{i}") for i in range(len(ranks))), F.max("_all").alias("_all"))
    if discrete:
        return ends.select(*by, *(F.col(f"_{i}").alias(f"q{i}") for i in range(len(at))))
    part = lambda q: (F.col("_all") - 1) * F.lit(q) - F.floor((F.col("_all") - 1) * F.lit(q))
    return ends.select(*by, *((F.col(f"_{2 * i}") + (F.col(f"_{2 * i + 1}") - F.col(f"_{2 * i}")) * part(q)).alias(f"q{i}") for i, q in enumerate(at)))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, 95th percentile (interpolated), mean and rate per second of the values that are there."""
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean_ms"), F.try_divide(F.count("*") * F.lit(1000.0), F.sum(v)).alias("per_second"))
    q = quantiles(df, value, by, [0.5, 0.95])
    met = reduce(lambda x, y: x & y, (F.col(f"b.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by), F.lit(True))
    return base.alias("b").join(q.alias("q"), met).select(*(F.col(f"b.{c}").alias(c) for c in by), "n", F.col("q0").alias("p50"), F.col("q1").alias("p95"), "mean_ms", "per_second")


def value_spread(df: DataFrame, value: str, by: list[str], below: list[float]) -> DataFrame:
    """(by..., n, p10, p50, p90, below_...): exact quantiles and the shares of values below each bound."""
    shares = [F.avg((F.col(value) < x).cast("double")).alias(f"below_{x:g}") for x in below]
    base = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *shares)
    q = quantiles(df, value, by, [0.1, 0.5, 0.9])
    met = reduce(lambda x, y: x & y, (F.col(f"b.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by), F.lit(True))
    return base.alias("b").join(q.alias("q"), met).select(*(F.col(f"b.{c}").alias(c) for c in by), "n", F.col("q0").alias("p10"), F.col("q1").alias("p50"), F.col("q2").alias("p90"), *(f"below_{x:g}" for x in below))


def macro(df: DataFrame, by: list[str], inner: str, value: Column) -> DataFrame:
    """Mean over the groups of ``inner`` of their means, next to the plain mean."""
    g = df.groupBy(*by, inner).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return g.groupBy(*by).agg(F.avg("_m").alias("macro"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("micro"), F.count("*").alias("n_groups"))


def folded_field(df: DataFrame, field: str, least: int, other: str = "(other)") -> DataFrame:
    """``df`` with ``folded``: the field's value, or ``other`` where it has fewer than ``least`` rows."""
    n = df.groupBy(F.col(field).alias("_v")).agg((F.count("*") >= least).alias("_often"))
    name = F.when(F.col("_often"), F.coalesce(F.col(field), F.lit("-"))).otherwise(other)
    return df.join(n, F.col(field).eqNullSafe(F.col("_v")), "left").withColumn("folded", name).drop("_v", "_often")


def majority(df: DataFrame, field: str, answer: str) -> DataFrame:
    """(field, best, n): the most frequent answer of each group; of equals the least."""
    c = df.groupBy(field, answer).agg(F.count("*").alias("n"))
    return c.groupBy(field).agg(F.min_by(answer, F.struct(-F.col("n"), F.col(answer))).alias("best"), F.sum("n").alias("n"))


def majority_accuracy(fit: DataFrame, test: DataFrame, field: str, answer: str, chance: Column | None = None) -> DataFrame:
    """(accuracy, n) of answering each group's majority of ``fit``; a group not seen gets ``chance`` or,
    without it, the overall majority."""
    m = majority(fit, field, answer).select(F.col(field).alias("_f"), "best")
    overall = fit.groupBy(answer).agg(F.count("*").alias("n")).agg(F.min_by(answer, F.struct(-F.col("n"), F.col(answer))).alias("w")).first().w
    j = test.join(m, test[field].eqNullSafe(m["_f"]), "left")
    right = (F.coalesce("best", F.lit(overall)) == F.col(answer)).cast("double")
    if chance is not None:
        right = F.when(F.col("best").isNull(), chance).otherwise(right)
    return j.agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


def option_rates(df: DataFrame, options: str, answer: str, by: list[str]) -> DataFrame:
    """How often the first, last, longest and shortest option is the answer (of equals the first), and chance."""
    o = F.col(options)
    lengths = F.transform(o, lambda x: F.length(x))
    at = lambda pick: F.get(o, (F.array_position(lengths, pick(lengths)) - 1).cast("int"))
    hit = lambda c: _mean((c == F.col(answer)).cast("double"))
    return df.where(F.size(o) > 0).groupBy(*by).agg(
        F.count("*").alias("n"), hit(F.get(o, F.lit(0))).alias("first"), hit(F.element_at(o, -1)).alias("last"), hit(at(F.array_max)).alias("longest"), hit(at(F.array_min)).alias("shortest"), F.avg(1.0 / F.size(o)).alias("chance")
    )


def position_histogram(df: DataFrame, options: str, answer: str, by: list[str]) -> DataFrame:
    """(by..., n_options, position, n): where the answer stands among the options, from 0; -1 if nowhere."""
    return df.groupBy(*by, F.size(options).alias("n_options"), (F.array_position(options, F.col(answer)) - 1).cast("int").alias("position")).agg(F.count("*").alias("n"))


def loo_prior(df: DataFrame, wording: str, answer: str) -> DataFrame:
    """(wording accuracy leaving each row's own answer out): (n, seen, accuracy).

    A row is right if its answer stays the most frequent of its wording without it; ties share credit.
    Only counts per (wording, answer) are needed, so rows are not joined with rows.
    """
    c = df.groupBy(wording, answer).agg(F.count("*").alias("c"))
    w = Window.partitionBy(wording)
    top, second = F.max("c").over(w), F.sort_array(F.collect_list("c").over(w), asc=False)
    d = c.withColumns({"_top": top, "_counts": second, "_n": F.sum("c").over(w)})
    own = F.col("c") - 1
    rest = F.when(F.col("c") == F.col("_top"), F.coalesce(F.get("_counts", F.lit(1)), F.lit(0))).otherwise(F.col("_top"))
    ties = F.size(F.filter("_counts", lambda x: x == own)) + F.when(F.col("c") == own, F.lit(-1)).otherwise(F.lit(0))
    credit = F.when(F.col("_n") < 2, None).when(own > rest, 1.0).when((own == rest) & (own > 0), 1.0 / (1 + ties)).otherwise(0.0)
    return d.withColumn("_k", credit).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_n") > 1, F.col("c")).otherwise(0)).alias("seen"), F.try_divide(F.sum(F.col("_k") * F.col("c")), F.sum(F.when(F.col("_n") > 1, F.col("c")))).alias("accuracy"))


def several_answers(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, n, n_answers) of keys with more than one distinct answer."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(answer).alias("n_answers")).where("n_answers > 1")


def loo_option_prior(df: DataFrame, ident: str, wording: str, options: str, answer: str) -> DataFrame:
    """(n, accuracy): of the options offered the one that is most often right for the wording in the other rows, of equals the first.

    Rows meet only the counts of their wording's answers, not other rows.
    """
    c = df.groupBy(F.col(wording).alias("_w"), F.col(answer).alias("_o")).agg(F.count("*").alias("_c"))
    o = df.select(ident, F.col(wording).alias("_w"), F.col(answer).alias("_a"), F.posexplode(options).alias("_i", "_o"))
    o = o.join(c, ["_w", "_o"], "left").withColumn("_c", F.coalesce("_c", F.lit(0)) - (F.col("_o") == F.col("_a")).cast("int"))
    pick = o.groupBy(ident).agg(F.min_by(F.struct("_o", "_a"), F.struct(-F.col("_c"), F.col("_i"))).alias("x"))
    return pick.agg(F.count("*").alias("n"), _mean(F.col("x._o") == F.col("x._a")).alias("accuracy"))


def wording_choice(fit: DataFrame, test: DataFrame, ident: str, wording: str, options: str, answer: str, by: list[str] = ()) -> DataFrame:
    """(by..., n, accuracy, chance, seen): the option most often right for the wording in ``fit``, of equals the one most often right
    anywhere, and of those left an even share of the credit; ``seen`` is the share of rows whose wording was there."""
    by = list(by)
    per = fit.groupBy(F.col(wording).alias("_w"), F.col(answer).alias("_o")).agg(F.count("*").alias("_c"))
    anywhere = per.groupBy("_o").agg(F.sum("_c").alias("_all"))
    there = per.select("_w").distinct().withColumn("_seen", F.lit(1.0))
    o = test.select(ident, *by, F.col(wording).alias("_w"), F.col(answer).alias("_a"), F.explode(F.array_distinct(options)).alias("_o"))
    o = o.join(per, ["_w", "_o"], "left").join(anywhere, "_o", "left").join(there, "_w", "left").fillna(0, ["_c", "_all"])
    w = Window.partitionBy(ident)  # a question's own options
    o = o.withColumn("_best", F.max(F.struct("_c", "_all")).over(w) == F.struct("_c", "_all"))
    each = o.groupBy(ident, *by).agg(F.try_divide(F.count_if(F.col("_best") & (F.col("_o") == F.col("_a"))), F.count_if("_best")).alias("_k"), (1.0 / F.count("*")).alias("_ch"), F.coalesce(F.max("_seen"), F.lit(0.0)).alias("_s"))
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_k").alias("accuracy"), F.avg("_ch").alias("chance"), F.avg("_s").alias("seen"))


def overlap_choice(df: DataFrame, text: Column, options: Column, answer: Column, by: list[str] = ()) -> DataFrame:
    """(by..., n, accuracy): the option that shares most words with the text; of equals the first."""
    share = F.transform(options, lambda o: F.size(F.array_intersect(X.words(text), X.words(o))))
    pick = F.get(options, (F.array_position(share, F.array_max(share)) - 1).cast("int"))
    return df.where(F.size(options) > 0).groupBy(*by).agg(F.count("*").alias("n"), _mean(pick == answer).alias("accuracy"))


def option_rules(df: DataFrame, values: Column, gold: Column) -> DataFrame:
    """(n, smallest, lower_median, most_common, chance): how often a rule over the numbers offered alone is right.
    Rows of which an option or the gold is no number are left out."""
    d = df.select(F.array_sort(values).alias("_v"), gold.alias("_g")).where((F.size("_v") > 0) & F.col("_g").isNotNull() & ~F.exists("_v", lambda x: x.isNull()))
    often = d.groupBy("_g").agg(F.count("*").alias("n")).agg(F.min_by("_g", F.struct(-F.col("n"), F.col("_g"))).alias("_often"))
    at = lambda i: F.get("_v", i)
    return d.join(often).agg(
        F.count("*").alias("n"), _mean(at(F.lit(0)) == F.col("_g")).alias("smallest"), _mean(at(F.floor((F.size("_v") - 1) / 2).cast("int")) == F.col("_g")).alias("lower_median"),
        _mean(F.array_contains("_v", F.col("_often")) & (F.col("_often") == F.col("_g"))).alias("most_common"), F.avg(1.0 / F.size("_v")).alias("chance"),
    )


def blind(records: DataFrame, options: str, gold: str, probabilities: str, threshold: float) -> DataFrame:
    """Rows of more than two options whose certain gold is given at least ``threshold`` although the picture is a wrong one."""
    best = P.argmax_key(F.col(gold))
    return records.where((F.size(options) > 2) & (P.p_of(F.col(gold), best) >= 1.0) & (P.p_of(F.col(probabilities), best) >= threshold))


def rate_at_least(df: DataFrame, by: str, hit: Column, rate: float, least: int) -> DataFrame:
    """(by, n, rate) of the groups of at least ``least`` rows in which ``hit`` is that frequent."""
    return df.groupBy(by).agg(F.count("*").alias("n"), _mean(hit).alias("rate")).where((F.col("n") >= least) & (F.col("rate") >= rate))
