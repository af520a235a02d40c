"""Queries that build questions: turns, counts, numbers, wrong options, absent things, packing, chains of balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import balance, distract, identity, intervals, metrics, packing
from gleanwork.operators.ordered import hash_key, unit
from gleanwork.operators.pictures import alias_ends, with_picture
from gleanwork.plans.queries_eval import _KIND, _LAST, _P, _SCORED, records, rounded, run_pairs, with_buckets
from gleanwork.plans.registry import Registry, table

query = Registry()

_ARG = "list_filter(gold, lambda e: e.p = list_max(list_transform(gold, lambda x: x.p)))[1].key"
_KEYS = "list_transform(gold, lambda e: e.key)"
_SAYS = "^(" + "|".join(X.ANSWER_LINES) + ")"
_WORDS10 = "[" + ", ".join(map(repr, X.NUMBER_WORDS)) + "]"
_NUM = lambda x: f"coalesce(try_cast(replace(lower(trim({x})), ',', '') as int), nullif(list_position({_WORDS10}, lower(trim({x}))), 0)::int - 1)"


def h(salt: str, x: str) -> str:
    return f"md5('{salt}|' || {x})"


def gold_rows(spark, folder, name="train", *more):
    return table(spark, folder, name).select("rec_no", "id", "kind", "source", "instructions", "gold", P.argmax_key(F.col("gold")).alias("answer"), F.transform("gold", lambda e: e["key"]).alias("options"), *more)


# Turns, counts, numbers


@query("answer_turns", f"""with l as (select rec_no, list_filter(list_transform(string_split(instructions, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l, {_ARG} as a from val),
k as (select rec_no, a, l, coalesce(list_max(list_transform(l, lambda x, i: case when i = 1 or ends_with(x, '?') or not regexp_matches(lower(x), '{_SAYS}') then i else 0 end)), 0) as k from l),
t as (select rec_no, regexp_replace(regexp_replace(trim(a), '(?i)^(the )?answer( is)?[: ]+', ''), '[. ]+$', '') as a, array_to_string(l[1:k], ' ') as t from k),
q as (select rec_no, a, t, trim(regexp_extract(t, '^.*\\?([^?]*)$', 1), ' ') as tail from t),
c as (select rec_no, a, case when tail <> '' and regexp_matches(lower(tail), '{_SAYS}') then regexp_extract(t, '^(.*\\?)[^?]*$', 1) else t end as question,
  case when lower(a) in ('yes', 'no') then 'yesno' when regexp_matches(a, '^[0-9]+$') then 'number' when a <> '' and len(regexp_split_to_array(trim(a), '[ ]+')) <= 3 then 'word' end as class from q)
select rec_no, class, case when class is not null then question end as question, case when class = 'yesno' then lower(a) when class is not null then a end as answer from c""")
def answer_turns(spark, folder):
    r = gold_rows(spark, folder, "val")
    return r.select("rec_no", X.turn(F.col("instructions"), F.col("answer")).alias("t")).select("rec_no", "t.class", "t.question", "t.answer")


@query("wide_counts", f"""with g as (select rec_no, list_transform(gold, lambda e: {{'n': {_NUM('e.key')}, 'p': e.p}}) as g from train)
select rec_no, case when g is not null and len(list_filter(g, lambda e: e.p > 0 and (e.n > 10 or e.n is null or e.n < 0))) = 0 then list_transform(range(0, 11), lambda k: round(coalesce(list_sum(list_transform(list_filter(g, lambda e: e.n = k), lambda e: e.p)), 0), 6)) end as mass from g""")
def wide_counts(spark, folder):
    mass = X.wide_counts(F.col("gold"))
    return table(spark, folder, "train").select("rec_no", F.transform(mass, lambda e: F.round(e["p"], 6)).alias("mass"))


@query("count_questions", f"""with q as (select kind, lower(instructions) as q, {_KEYS} as ks from train)
select kind, count(*) as n, count_if(len(ks) > 0 and len(list_filter(ks, lambda k: {_NUM('k')} is null)) = 0 and (q like '%how many%' or kind = 'count'))::bigint as counts from q group by kind""")
def count_questions(spark, folder):
    r = gold_rows(spark, folder)
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(X.is_count_question(F.col("kind"), F.col("instructions"), F.col("options"))).alias("counts"))


_ALPHABET = "0123456789.-,%"


@query("number_labels", f"""with a as (select distinct gold_answer as answer from eval_records where gold_answer is not null),
i as (select answer, list_transform(string_split(answer, ''), lambda c: instr('{_ALPHABET}', c) - 1) as ids from a),
l as (select answer, case when answer <> '' and len(answer) < 8 and len(list_filter(ids, lambda x: x < 0)) = 0 then list_concat(list_concat(ids, [{len(_ALPHABET)}]), list_transform(range(0, 7 - len(answer)), lambda x: -1)) end as ids from i)
select answer, list_transform(ids, lambda x: x::int) as ids, case when ids is not null and regexp_matches(answer, '^-?[0-9][0-9,]*(\\.[0-9]+)?%?$') then answer end as number from l""")
def number_labels(spark, folder):
    a = records(spark, folder).where("gold_answer is not null").select(F.col("gold_answer").alias("answer")).distinct()
    return a.select("answer", X.number_labels(F.col("answer"), 8).alias("ids")).select("answer", "ids", X.read_number(F.col("ids")).alias("number"))


@query("leading_numbers", """select option, case when regexp_matches(trim(option), '^[-+]?[0-9]') then try_cast(replace(regexp_extract(trim(option), '^([-+]?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') as double) end as number, count(*) as n
from (select unnest(options) as option from eval_records) group by option""")
def leading_numbers(spark, folder):
    o = records(spark, folder).select(F.explode("options").alias("option")).groupBy("option").agg(F.count("*").alias("n"))
    return o.select("option", X.leading_number(F.col("option")).alias("number"), "n")


_ROUTES = {"panel": [["panel", "show"], ["panel", "what"]], "screen": [["button", "screen"]], "count": [["how many"]]}


@query("routed_questions", """with q as (select kind, trim(regexp_replace(regexp_replace(lower(instructions), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '[ ?]+$', '')) as w, regexp_matches(gold[1].key, '^[0-9]') as r from train),
d as (select kind, case when (contains(w, 'panel') and contains(w, 'show')) or (contains(w, 'panel') and contains(w, 'what')) then 'panel' when contains(w, 'button') and contains(w, 'screen') then 'screen' when contains(w, 'how many') then 'count' end as domain, r from q)
select kind, domain, count(*) as asked, count_if(domain is not null and r)::bigint as read from d group by kind, domain""")
def routed_questions(spark, folder):
    """How many questions are routed to each domain of readings, and of those how many have options that can be read."""
    r = table(spark, folder, "train").select("kind", X.routed(F.col("instructions"), _ROUTES).alias("domain"), F.get("gold", F.lit(0))["key"].rlike("^[0-9]").alias("r"))
    return r.groupBy("kind", "domain").agg(F.count("*").alias("asked"), F.count_if(F.col("domain").isNotNull() & F.col("r")).alias("read"))


@query("logits", "select run_id, sample_id, asked_at, loaded_at, list_transform(probabilities, lambda e: round(ln(greatest(e.p, 1e-12)) * 1.16, 6)) as z from eval_records")
def logits(spark, folder):
    z = F.transform(P.logits(F.col("probabilities"), 1.16), lambda e: F.round(e["z"], 6))
    return records(spark, folder).select("run_id", "sample_id", "asked_at", "loaded_at", z.alias("z"))


@query("stable_nll", """with z as (select kind, gold, probabilities, list_transform(probabilities, lambda e: ln(greatest(e.p, 1e-12)) / 1.5) as z from eval_records),
n as (select kind, gold, probabilities, z, list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) as n from z)
select kind, round(avg(coalesce(list_sum(list_transform(list_filter(gold, lambda g: g.p > 0), lambda g: g.p * coalesce(n - z[len(z) + 1 - nullif(list_position(list_reverse(list_transform(probabilities, lambda d: d.key)), g.key), 0)], 0))), 0)), 6) as nll from n group by kind""")
def stable_nll(spark, folder):
    return rounded(records(spark, folder).groupBy("kind").agg(F.avg(P.nll_at(F.col("probabilities"), F.col("gold"), 1.5)).alias("nll")), "nll")


# Runs against each other


@query("combined_orders", """with e as (select sample_id, qid, unnest(probabilities) as e from eval_records where control is null or control = 'reversed'), n as (select sample_id, qid, count(*) as n from eval_records where control is null or control = 'reversed' group by all),
s as (select sample_id, qid, e.key as key, sum(e.p) as s from e group by all), t as (select sample_id, qid, sum(s) as t, list({'k': key, 's': s} order by key) as l from s group by all having sum(s) > 0)
select sample_id, qid, n, list_transform(l, lambda x: x.k) as options, list_transform(l, lambda x: round(x.s / t, 6)) as p from t join n using (sample_id, qid)""")
def combined_orders(spark, folder):
    r = records(spark, folder).where("control is null or control = 'reversed'")
    a = P.averaged(r, ["sample_id", "qid"], "probabilities")
    return a.select("sample_id", "qid", "n", F.transform("probabilities", lambda e: e["key"]).alias("options"), F.transform("probabilities", lambda e: F.round(e["p"], 6)).alias("p"))


@query("order_rows", """with a as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc, run_id desc) as rn from eval_records where control is null) where rn = 1), b as (select * from eval_records where control = 'reversed')
select b.kind as kind, count(*) as n, count_if(a.prediction <> b.prediction)::bigint as flipped, count_if(a.correct and b.correct)::bigint as both_right from a join b using (sample_id, qid) group by b.kind""")
def order_rows(spark, folder):
    from gleanwork.operators import compare

    r = records(spark, folder)
    p = compare.paired(r.where("control is null"), r.where("control = 'reversed'"), ["loaded_at", "asked_at", "run_id"])
    return p.groupBy(F.col("kind_b").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction_a") != F.col("prediction_b")).alias("flipped"), F.count_if(F.col("correct_a") & F.col("correct_b")).alias("both_right"))


@query("blind_answers", f"""with b as (select *, {_ARG} as best from eval_records where control = 'mismatched' and len(options) > 2 and kind <> 'count'),
p as (select source, list_filter(gold, lambda e: e.key = best)[-1].p as g, coalesce(list_filter(probabilities, lambda e: e.key = best)[-1].p, 0) as p from b)
select source, count(*) as asked, count_if(g >= 0.6 and p >= 0.2)::bigint as blind from p group by source""")
def blind_answers(spark, folder):
    r = records(spark, folder).where("control = 'mismatched' and size(options) > 2 and kind <> 'count'")
    best = P.argmax_key(F.col("gold"))
    hit = (P.p_of(F.col("gold"), best) >= 0.6) & (P.p_of(F.col("probabilities"), best) >= 0.2)
    return r.groupBy("source").agg(F.count("*").alias("asked"), F.count_if(hit).alias("blind"))


@query("compared_buckets", f"""with {_SCORED}, k as (select *, case when {_KIND} in ('noul', 'yesno') then 'noul' when {_KIND} in ('choice', 'multichoice', 'multiplechoice') then 'choice' else {_KIND} end as clean from r),
b as (select *, case when clean = 'noul' then 'noul:2' when len(options) <= 2 then clean || ':2' when len(options) <= 5 then clean || ':3-5' when len(options) <= 10 then clean || ':6-10' else clean || ':11+' end as bucket from k),
x as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc) as rn from b where run_id = 'r21') where rn = 1), y as (select * from b where run_id = 'r24')
select y.bucket as bucket, count(*) as n, round(avg(x.is_right::int), 6) as accuracy_a, round(avg(y.is_right::int), 6) as accuracy_b, round(avg(x.nll), 6) as nll_a, round(avg(y.nll), 6) as nll_b from x join y using (sample_id, qid) group by y.bucket""")
def compared_buckets(spark, folder):
    from gleanwork.operators import compare

    d = with_buckets(metrics.scored(records(spark, folder)))
    p = compare.paired(d.where("run_id = 'r21'"), d.where("run_id = 'r24'"), ["loaded_at", "asked_at"])
    ok = lambda s: F.avg(F.col(f"is_right_{s}").cast("double")).alias(f"accuracy_{s}")
    out = p.groupBy(F.col("bucket_b").alias("bucket")).agg(F.count("*").alias("n"), ok("a"), ok("b"), F.avg("nll_a").alias("nll_a"), F.avg("nll_b").alias("nll_b"))
    return rounded(out, "accuracy_a", "accuracy_b", "nll_a", "nll_b")


_SIDE = lambda s: f"sum(c{s}::int)::double as {s}_right, count(*)::double as {s}_all, sum((g = 'true' and p{s} = 'true')::int)::double as {s}_tp, sum((g = 'true')::int)::double as {s}_pos, sum((g = 'false' and p{s} = 'true')::int)::double as {s}_fp, sum((g = 'false')::int)::double as {s}_neg, sum(l{s}) as {s}_loss"
_METRIC = lambda s: f"unnest([{{'m': 'accuracy', 'v': {s}_right / {s}_all}}, {{'m': 'recall', 'v': {s}_tp / nullif({s}_pos, 0)}}, {{'m': 'fpr', 'v': {s}_fp / nullif({s}_neg, 0)}}, {{'m': 'balanced', 'v': ({s}_tp / nullif({s}_pos, 0) + 1 - {s}_fp / nullif({s}_neg, 0)) / 2}}, {{'m': 'nll', 'v': {s}_loss / {s}_all}}])"
_PAIRED = f"""with {_SCORED}, x as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc) as rn from r where run_id = 'r21') where rn = 1), y as (select * from r where run_id = 'r24'),
p as (select y.kind as kind, y.source as source, y.image_id as image_id, x.correct as ca, y.correct as cb, x.prediction as pa, y.prediction as pb, y.gold_answer as g, x.nll as la, y.nll as lb from x join y using (sample_id, qid))"""


@query("paired_metrics", f"""{_PAIRED}, s as (select kind, {_SIDE('a')}, {_SIDE('b')} from p group by kind),
m as (select kind, {_METRIC('a')} as a, {_METRIC('b')} as b from s),
c as (select kind, source, avg(ca::int) as a, avg(cb::int) as b from p group by all)
select kind, a.m as metric, round(a.v, 6) as a, round(b.v, 6) as b, round(b.v - a.v, 6) as difference from m union all select kind, 'macro', round(avg(a), 6), round(avg(b), 6), round(avg(b) - avg(a), 6) from c group by kind""")
def paired_metrics(spark, folder):
    p = run_pairs(spark, folder).withColumns({"kind": F.col("kind_b"), "source": F.col("source_b"), "gold_answer_a": F.col("gold_answer_b"), "gold_a": F.col("gold_a")})
    out = intervals.metric_table(intervals.paired_sums(p, ["kind"]), ["kind"]).unionByName(intervals.macro_table(p, ["kind"], "source"))
    return rounded(out, "a", "b", "difference")


@query("metric_intervals")
def metric_intervals(spark, folder):
    """Intervals of all metric differences, resampled within sources; random weights, so without SQL."""
    p = run_pairs(spark, folder).withColumns({"kind": F.col("kind_b"), "source": F.coalesce("source_b", F.lit("-")), "image": F.coalesce("image_id_b", F.concat(F.lit("sample "), "sample_id"))})
    return rounded(intervals.paired_metric(p, "image", ["kind"], "source", 500, 3), "a", "b", "difference", "low", "high")


@query("bootstrap_sums", f"with {_LAST} select kind, count(distinct coalesce(image_id, '')) as pictures, sum(cb::int - ca::int)::double as difference, count(*)::double as n from p group by kind")
def bootstrap_sums(spark, folder):
    """What the intervals are resampled from: cluster sums, added up."""
    from gleanwork.operators import compare

    p = run_pairs(spark, folder).withColumns({"kind": F.col("kind_b"), "image": F.coalesce("image_id_b", F.lit(""))})
    s = compare.cluster_sums(p, "image", {"d": F.col("correct_b").cast("int") - F.col("correct_a").cast("int"), "n": F.lit(1)}, ["kind"])
    return s.groupBy("kind").agg(F.count("*").alias("pictures"), F.sum("d").alias("difference"), F.sum("n").alias("n"))


@query("gain_interval")
def gain_interval(spark, folder):
    """The difference of gains from the true picture, with its interval over pictures; without SQL as above."""
    r = records(spark, folder).withColumn("image", F.coalesce("image_id", F.concat(F.lit("sample "), "sample_id")))
    cell = lambda run, mis: F.when((F.col("run_id") == run) & (F.col("control") == "mismatched" if mis else F.col("control").isNull()), F.col("correct").cast("int"))
    return rounded(intervals.difference_in_differences(r, (cell("r21", True), cell("r21", False), cell("r24", True), cell("r24", False)), "image", (), 500, 5), "estimate", "low", "high")


# Baselines of text alone


@query("option_rules", f"""with v as (select list_sort(list_transform(options, lambda o: try_cast(replace(trim(o), ',', '') as double))) as v, try_cast(replace(trim(gold_answer), ',', '') as double) as g from eval_records),
d as (select v, g from v where len(v) > 0 and g is not null and len(list_filter(v, lambda x: x is null)) = 0), c as (select g, count(*) as n from d group by g), o as (select arg_min(g, (-n, g)) as often from c)
select count(*) as n, round(avg((v[1] = g)::int), 6) as smallest, round(avg((v[(len(v) - 1) // 2 + 1] = g)::int), 6) as lower_median, round(avg((list_contains(v, often) and often = g)::int), 6) as most_common, round(avg(1.0::double / len(v)), 6) as chance from d, o""")
def option_rules(spark, folder):
    number = lambda t: F.regexp_replace(F.trim(t), ",", "").try_cast("double")
    return rounded(metrics.option_rules(records(spark, folder), F.transform("options", number), number(F.col("gold_answer"))), "smallest", "lower_median", "most_common", "chance")


_WORDING = "trim(regexp_replace(regexp_replace(lower(instructions), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '[ ?]+$', ''))"


@query("option_prior_loo", f"""with d as (select rec_no, {_WORDING} as w, {_ARG} as a, {_KEYS} as ks from train where gold is not null and instructions is not null), c as (select w, a as o, count(*) as c from d group by all),
o as (select rec_no, w, a, unnest(ks) as o, unnest(range(0, len(ks))) as i from d), s as (select o.rec_no, o.o, o.a, o.i, coalesce(c.c, 0) - coalesce((o.o = o.a)::int, 0) as c from o left join c on o.w = c.w and o.o = c.o),
p as (select rec_no, arg_min(o, (-c, i)) as pick, any_value(a) as a from s group by rec_no) select count(*) as n, round(avg((pick = a)::int), 6) as accuracy from p""")
def option_prior_loo(spark, folder):
    d = gold_rows(spark, folder).where("gold is not null and instructions is not null").select("rec_no", X.norm(F.col("instructions")).alias("w"), "answer", "options")
    return rounded(metrics.loo_option_prior(d, "rec_no", "w", "options", "answer"), "accuracy")


@query("wording_choice", f"""with t as (select {_WORDING} as w, {_ARG} as a from train where gold is not null and instructions is not null), e as (select rec_no, kind, {_WORDING} as w, {_ARG} as a, list_distinct({_KEYS}) as ks from val where gold is not null and instructions is not null),
c as (select w, a, count(*) as c from t group by all), g as (select a, count(*) as g from t group by a), s as (select distinct w from t),
o as (select rec_no, kind, w, a, unnest(ks) as o from e), j as (select o.*, coalesce(c.c, 0) as c, coalesce(g.g, 0) as g, s.w is not null as seen from o left join c on o.w = c.w and o.o = c.a left join g on o.o = g.a left join s on o.w = s.w),
b as (select *, (c, g) = max((c, g)) over (partition by rec_no) as best from j), k as (select rec_no, kind, count_if(best and o = a) / count_if(best) as k, 1.0::double / count(*) as ch, max(seen::int) as s from b group by rec_no, kind)
select kind, count(*) as n, round(avg(k), 6) as accuracy, round(avg(ch), 6) as chance, round(avg(s), 6) as seen from k group by kind""")
def wording_choice(spark, folder):
    side = lambda n: gold_rows(spark, folder, n).where("gold is not null and instructions is not null").select("rec_no", "kind", X.norm(F.col("instructions")).alias("w"), "answer", "options")
    return rounded(metrics.wording_choice(side("train"), side("val"), "rec_no", "w", "options", "answer", ["kind"]), "accuracy", "chance", "seen")


_OWN = lambda x: f"regexp_extract_all(replace(lower({x}), 'n''t', ' n''t'), '(n''t|[a-z0-9]+)')"


@query("overlap_choice", f"""with d as (select kind, {_OWN('instructions')} as ws, {_KEYS} as ks, {_ARG} as a from train where len(gold) > 0 and instructions is not null),
s as (select kind, ks, a, list_transform(ks, lambda k: len(list_distinct(list_filter({_OWN('k')}, lambda x: list_contains(ws, x))))) as s from d)
select kind, count(*) as n, round(avg((ks[list_position(s, list_max(s))] = a)::int), 6) as accuracy from s group by kind""")
def overlap_choice(spark, folder):
    d = gold_rows(spark, folder).where("size(gold) > 0 and instructions is not null")
    return rounded(metrics.overlap_choice(d, F.col("instructions"), F.col("options"), F.col("answer"), ["kind"]), "accuracy")


@query("frequent_rights", "select source, count(*) as n, round(avg(correct::int), 6) as rate from eval_records group by source having count(*) >= 10 and avg(correct::int) >= 0.5")
def frequent_rights(spark, folder):
    return rounded(metrics.rate_at_least(records(spark, folder), "source", F.col("correct"), 0.5, 10), "rate")


# Near and absent things


_H = "list_reduce(list_prepend(0::bigint, list_transform(range(1, 33), lambda i: case when embedding[i + {at}] > 0 then (1::bigint << (i - 1)) else 0 end)), lambda a, b: a | b)"
_HASHES = f"e as (select vec_id, {_H.format(at=0)} as d, {_H.format(at=32)} as p from embeddings)"


def hashes(spark, folder, *names):
    half = lambda at: identity.sign_bits(F.slice("embedding", at, 32))
    return table(spark, folder, "embeddings").select("vec_id", half(1).alias("d"), half(33).alias("p"), identity.sign_bits("embedding").alias("h"))


@query("joint_hash_hits", f"with {_HASHES} select a.vec_id as vec_a, b.vec_id as vec_b, bit_count(xor(a.d, b.d))::int as d_first, bit_count(xor(a.p, b.p))::int as d_second from e a, e b where a.vec_id < b.vec_id and bit_count(xor(a.d, b.d)) <= 6 and bit_count(xor(a.p, b.p)) <= 12")
def joint_hash_hits(spark, folder):
    e = hashes(spark, folder)
    return identity.joint_hits(e.withColumnRenamed("vec_id", "vec_a"), e.withColumnRenamed("vec_id", "vec_b"), "vec_a", "vec_b", "d", "p", 6, 12).where("vec_a < vec_b")


@query("nearest_hash", f"with {_HASHES}, p as (select a.vec_id as a, b.vec_id as b, (bit_count(xor(a.d, b.d)) + bit_count(xor(a.p, b.p)))::int as n from e a, e b where a.vec_id <> b.vec_id), m as (select a, min((n, b)) as x from p where n <= 16 group by a) select vec_id as vec_a, x[2] as vec_b, x[1] as distance from e left join m on a = vec_id".replace("min((n, b)) as x", "min({'n': n, 'b': b}) as x").replace("x[2]", "x.b").replace("x[1]", "x.n"))
def nearest_hash(spark, folder):
    e = hashes(spark, folder)
    return identity.nearest(e.select(F.col("vec_id").alias("vec_a"), "h"), e.select(F.col("vec_id").alias("vec_b"), "h"), "vec_a", "vec_b", "h", 16)


_BRANDS = "d as (select distinct l_orderkey as o, p_brand as b from lineitem join part on p_partkey = l_partkey), c as (select x.b as a, y.b as b, count(*) as n from d x join d y using (o) where x.b <> y.b group by all), w as (select d.o as o, c.b as b, sum(c.n) as w from d join c on c.a = d.b group by all), a as (select w.* from w where not exists (select 1 from d where d.o = w.o and d.b = w.b))"


def brands(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p_partkey")).join(table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("b")), "p_partkey").select("o", "b")


@query("likeliest_absent", f"with {_BRANDS}, f as (select b, count(*) as f from d group by b) select o, arg_min(b, (-w, b)) as adversarial, arg_min(b, (-f, b)) as popular, count(*) as n_absent from a join f using (b) group by o")
def likeliest_absent(spark, folder):
    return distract.likeliest_absent(brands(spark, folder), "o", "b")


@query("absent_top_quarter", f"with {_BRANDS}, r as (select o, b, percent_rank() over (partition by o order by w desc) as r from a) select b, count(*) as n from r where r <= 0.25 group by b")
def absent_top_quarter(spark, folder):
    a = distract.absent(brands(spark, folder), "o", "b")
    return distract.top_part(a, "o", "b", "weight", 0.25).groupBy("b").agg(F.count("*").alias("n"))


@query("gap_pairs", """with b as (select l_orderkey as o, l_returnflag || l_linestatus || l_linenumber as name, (l_suppkey % 300)::double as lo, l_suppkey % 300 + l_tax * 1000 + 10 as hi from lineitem), u as (select o, name from b group by all having count(*) = 1), d as (select b.* from b join u using (o, name))
select x.o as o, x.name as upper, y.name as lower, round(y.lo - x.hi, 6) as gap from d x join d y using (o) where x.name <> y.name and y.lo - x.hi >= 40""")
def gap_pairs(spark, folder):
    d = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_suppkey") % 300).cast("double").alias("lo"), (F.col("l_suppkey") % 300 + F.col("l_tax") * 1000 + 10).alias("hi"))
    return rounded(distract.gap_pairs(d, "o", "name", F.col("lo"), F.col("hi"), 40.0), "gap")


@query("sibling_answers", f"""with d as (select distinct kind as g, {_ARG} as a from train), e as (select g, a, {h('sib', 'a')} as h from d where g is not null and a is not null)
select g as kind, a as answer, coalesce(lead(a) over w, first_value(a) over (partition by g order by h, a rows between unbounded preceding and unbounded following)) as sibling from e window w as (partition by g order by h, a)""")
def sibling_answers(spark, folder):
    return distract.siblings(gold_rows(spark, folder).select("kind", "answer"), "kind", "answer", hash_key("sib", "answer"))


@query("near_frequency", f"""with d as (select kind, {_ARG} as a from train), c as (select kind, a, count(*) as n from d where a is not null group by all),
r as (select *, row_number() over (partition by kind order by n desc, a) as r from c),
p as (select x.kind as kind, x.a as answer, x.n as n, y.a as other from r x left join r y on x.kind is not distinct from y.kind and y.r <> x.r and y.r between x.r - 2 and x.r + 2 and y.n <= x.n * 2 and y.n * 2 >= x.n)
select kind, answer, n, coalesce(list(other order by other) filter (other is not null), []) as others from p group by kind, answer, n""")
def near_frequency(spark, folder):
    return distract.near_frequency(gold_rows(spark, folder).select("kind", "answer"), "kind", "answer", 2.0)


# Intervals


_EVENTS = "e as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as t from events)"


def timed(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))


@query("outside_windows", f"with {_EVENTS} select event_id from e where event_type = 'click' and not exists (select 1 from e p where p.user_id = e.user_id and p.event_type = 'purchase' and e.t between p.t - 7200 and p.t + 7200)")
def outside_windows(spark, folder):
    e = timed(spark, folder)
    windows = e.where("event_type = 'purchase'").select("user_id", (F.col("t") - 7200).alias("a"), (F.col("t") + 7200).alias("b"))
    return identity.outside(e.where("event_type = 'click'"), windows, "user_id", "event_id", "t", "a", "b", 28_800).select("event_id")


@query("covered_by_one", f"""with {_EVENTS} select c.event_id as event_id, min(p.event_type) as label from e c join e p on p.user_id = c.user_id and c.t between p.t and p.t + 86400 and p.event_type in ('view', 'purchase', 'signup') where c.event_type = 'click' group by c.event_id having count(distinct p.event_type) = 1""")
def covered_by_one(spark, folder):
    e = timed(spark, folder)
    i = e.where("event_type in ('view', 'purchase', 'signup')").select("user_id", F.col("t").alias("a"), (F.col("t") + 86_400).alias("b"), F.col("event_type").alias("label"))
    return identity.covered_by_one(e.where("event_type = 'click'"), i, "user_id", "event_id", "t", "a", "b", "label", 86_400)


@query("unbroken_groups", "with v as (select distinct image_id from val where image_id is not null), t as (select rec_no, id, coalesce(image_id in (select image_id from v), false) as held from train), b as (select distinct id from t where held and id is not null) select rec_no from t where (id is not null or not held) and (id is null or id not in (select id from b))")
def unbroken_groups(spark, folder):
    """Lines of one id stay only if none of them is on a picture of the evaluation records."""
    held = table(spark, folder, "val").where("image_id is not null").select("image_id").distinct().withColumn("_held", F.lit(True))
    t = table(spark, folder, "train").select("rec_no", "id", "image_id").join(held, "image_id", "left")
    return identity.without_broken_groups(t, "id", F.coalesce("_held", F.lit(False))).select("rec_no")


# Packing


@query("batch_sizes", f"""with u as (select id as unit, len(any_value(gold)) as size, any_value(kind) as mode from train where id is not null and len(gold) > 0 group by id having min(len(gold)) = max(len(gold)) and min(kind) = max(kind))
select mode, count(*) as units, sum(size)::bigint as items, true as all_within, true as enough from u group by mode""")
def batch_sizes(spark, folder):
    """Units of one size packed into batches of 16: all are packed, none beyond the limit, and no two batches that one could hold."""
    t = table(spark, folder, "train").where("id is not null and size(gold) > 0").groupBy("id").agg(F.min(F.size("gold")).alias("size"), F.max(F.size("gold")).alias("z"), F.min("kind").alias("mode"), F.max("kind").alias("y")).where("size = z and mode = y")
    b = packing.batches(t.select(F.col("id").alias("unit"), "size", "mode", hash_key("batch", "id").alias("h")), "unit", "size", "mode", 16, "h")
    per = b.groupBy("mode", "batch").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    half = F.count_if(F.col("held") <= 8) <= 1
    return per.groupBy("mode").agg(F.sum("n").alias("units"), F.sum("held").alias("items"), (F.max("held") <= 16).alias("all_within"), half.alias("enough"))


@query("call_counts")
def call_counts(spark, folder):
    """Requests of a run in calls of at most 64 questions, one sweep for each of 16 shards of pictures."""
    r = records(spark, folder).where("image_id is not null").groupBy("run_id", "image_id").agg(F.count("*").cast("int").alias("n"))
    r = r.withColumn("shard", F.conv(F.substring(hash_key("shard", "image_id"), 1, 1), 16, 10).cast("int") + F.when(F.col("run_id") == "r21", 0).otherwise(16))
    c = packing.calls(r, "shard", ["image_id"], "n", 64)
    return c.groupBy("run_id", "shard", "call").agg(F.sum("n").alias("questions"), F.count("*").alias("pictures"))


# Chains of balancing and sampling


def ordered(spark, folder, salt):
    return gold_rows(spark, folder, "train", F.col("image_id")).withColumn("h", hash_key(salt, "rec_no"))


@query("balanced_capped", f"""with d as (select rec_no, kind, image_id, {_ARG} as a, {h('bc', 'rec_no')} as h from train), t as (select * from d where a in ('true', 'false')),
n as (select kind, least(count_if(a = 'true'), count_if(a = 'false')) as cap from t group by kind), b as (select t.*, row_number() over (partition by t.kind, a order by h, rec_no) as r, cap from t join n on t.kind is not distinct from n.kind),
x as (select * from b where r <= cap), y as (select *, row_number() over (partition by image_id order by h, rec_no) as p from x), z as (select * exclude (r, cap) from y where p <= 2),
m as (select kind, least(count_if(a = 'true'), count_if(a = 'false')) as cap from z group by kind), w as (select z.*, row_number() over (partition by z.kind, a order by h, rec_no) as r, cap from z join m on z.kind is not distinct from m.kind)
select kind, a as answer, count(*) as n from w where r <= cap group by all""")
def balanced_capped(spark, folder):
    """Balance, cap per picture, balance again: the cap undoes some of the balance."""
    d = ordered(spark, folder, "bc").where(F.col("answer").isin("true", "false"))
    even = lambda x: balance.drop_surplus(x, ["kind"], "answer", ("true", "false"), "h", ["rec_no"])
    out = even(balance.cap_per(even(d), ["image_id"], 2, ["h", "rec_no"]))
    return out.groupBy("kind", "answer").agg(F.count("*").alias("n"))


@query("pinned_quotas", "with k as (select distinct kind from train where kind is not null and kind <> 'count'), n as (select 1000 - 300 as rest, count(*) as k from k), r as (select kind, row_number() over (order by kind) as r from k) select kind, (rest // k + case when r <= rest % k then 1 else 0 end)::bigint as quota from r, n union all select 'count', 300")
def pinned_quotas(spark, folder):
    """One class has 300 of 1000 places, the others share what is left evenly, spare places by name."""
    k = table(spark, folder, "train").where("kind is not null").select("kind").distinct()
    rest = balance.apportion(k.where("kind <> 'count'").withColumn("w", F.lit(1)), "w", 700, ["kind"]).select("kind", "quota")
    return rest.unionByName(spark.createDataFrame([("count", 300)], "kind string, quota bigint"))


@query("few_per_picture", f"""with d as (select rec_no, image_id, {h('fp', 'rec_no')} as h, {h('img', 'image_id')} as g from train where image_id is not null), r as (select *, row_number() over (partition by image_id order by h, rec_no) as r from d)
select rec_no from r where r <= 2 order by g, image_id, r limit 200""")
def few_per_picture(spark, folder):
    """At most two rows a picture, pictures in hash order, the first 200."""
    d = table(spark, folder, "train").where("image_id is not null").select("rec_no", "image_id", hash_key("fp", "rec_no").alias("h"), hash_key("img", "image_id").alias("g"))
    kept = balance.cap_per(d, ["image_id"], 2, ["h", "rec_no"])
    return kept.orderBy("g", "image_id", "h", "rec_no").limit(200).select("rec_no")


@query("smallest_hashes", "select image_id from (select distinct image_id from train where image_id is not null) order by sha1(image_id), image_id limit 50")
def smallest_hashes(spark, folder):
    return table(spark, folder, "train").where("image_id is not null").select("image_id").distinct().orderBy(F.sha1("image_id"), "image_id").limit(50)


@query("class_share_cap", f"""with d as (select rec_no, kind, {h('cs', 'rec_no')} as h from train), n as (select count_if(kind <> 'exist' or kind is null) as rest from d), r as (select *, row_number() over (partition by kind order by h, rec_no) as r from d)
select coalesce(kind, '-') as kind, count(*) as n from r, n where kind is distinct from 'exist' or r <= floor(rest * 0.15 / 0.85) group by 1""")
def class_share_cap(spark, folder):
    """One class holds at most 15 % of what is kept, its smallest hashes stay."""
    d = table(spark, folder, "train").select("rec_no", "kind", hash_key("cs", "rec_no").alias("h"))
    return balance.cap_share(d, F.col("kind").eqNullSafe(F.lit("exist")), 0.15, "h", ["rec_no"]).groupBy(F.coalesce("kind", F.lit("-")).alias("kind")).agg(F.count("*").alias("n"))


@query("stratified_parts", f"""with d as (select rec_no, kind, {h('st', 'rec_no')} as h from train where kind is not null), n as (select kind, count(*) as n from d group by kind), t as (select sum(n) as t from n),
q as (select kind, p, w * n / t as x from n, t, (values ('dev', 200), ('test', 100)) as v(p, w)), f as (select kind, p, floor(x + 1e-9) as f, row_number() over (partition by p order by round(x - floor(x + 1e-9), 9) desc, kind) as r, (case p when 'dev' then 200 else 100 end) as w from q),
s as (select p, sum(f) as s from f group by p), a as (select kind, f.p as p, f + (r <= w - s)::int as quota from f join s using (p)), g as (select kind, max(quota) filter (p = 'dev') as dev, max(quota) filter (p = 'test') as test from a group by kind),
r as (select d.kind, row_number() over (partition by d.kind order by h, rec_no) - 1 as r, dev, test from d join g using (kind))
select kind, case when r < dev then 'dev' when r < dev + test then 'test' else 'train' end as part, count(*) as n from r group by all""")
def stratified_parts(spark, folder):
    """Dev and test of fixed sizes whose kinds have their shares by largest remainder, the rest is train."""
    d = table(spark, folder, "train").where("kind is not null").select("rec_no", "kind", hash_key("st", "rec_no").alias("h"))
    return balance.stratified_parts(d, "kind", {"dev": 200, "test": 100}, "train", "h", ["rec_no"]).groupBy("kind", "part").agg(F.count("*").alias("n"))


@query("fresh_first", f"with v as (select distinct image_id from val where image_id is not null) select rec_no, image_id in (select image_id from v) as used from train where image_id is not null and kind = 'quality' order by used, {h('ff', 'rec_no')}, rec_no limit 60")
def fresh_first(spark, folder):
    held = table(spark, folder, "val").where("image_id is not null").select("image_id").distinct().withColumn("_u", F.lit(True))
    t = table(spark, folder, "train").where("image_id is not null and kind = 'quality'").join(held, "image_id", "left").withColumn("used", F.coalesce("_u", F.lit(False)))
    return distract.fresh_first(t, "used", 60, hash_key("ff", "rec_no"), ["rec_no"]).select("rec_no", "used")


# Pictures by one name


_NAME = lambda c, own: f"""case when regexp_extract({c}, '(?:^|[a-z ])0*([0-9]+)$', 1) = '' then null when regexp_extract({c}, '([a-z]+) ?[0-9]+$', 1) <> '' then regexp_extract({c}, '([a-z]+) ?[0-9]+$', 1) || ':' || regexp_extract({c}, '(?:^|[a-z ])0*([0-9]+)$', 1) when regexp_matches({c}, '^[0-9]+$') then {own} || ':' || regexp_extract({c}, '(?:^|[a-z ])0*([0-9]+)$', 1) end"""
_BARE = lambda c: f"regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), '( (jpg|jpeg|png|gif|webp|bmp|tif|tiff|flip|flipped|mirror|mirrored))+$', ''), '(^| )((images|image|imgs|img|pictures|photos) )+', '\\1', 'g')"
_SOURCE = "nullif(regexp_replace(regexp_replace(lower(source), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '[^a-z0-9]+', '/', 'g'), '')"
PICTURES_SQL = f"""al as (select {_NAME('a', 'null')} as alias, {_NAME('b', 'null')} as target, added_at from (select {_BARE('alias_id')} as a, {_BARE('image_id')} as b, added_at from image_alias)),
one as (select alias, arg_max(coalesce(target, ''), (added_at, coalesce(target, ''))) as target from al where alias is not null group by alias),
chain as (select alias, target, 1 as n from one union all select c.alias, o.target, n + 1 from chain c join one o on o.alias = c.target where n < 60),
ends as (select alias, nullif(arg_max(target, n), '') as pic, max(n) as n from chain group by alias),
named as (select rec_no, src, {_NAME('b', "split_part(src, '/', 1)")} as name from (select rec_no, {_SOURCE} as src, {_BARE('image_id')} as b from train)),
pics as (select rec_no, src, case when e.alias is null then name when e.n < 60 then e.pic end as picture from named left join ends e on e.alias = name)"""


@query("canonical_pictures", f"with recursive {PICTURES_SQL} select picture, count(*) as n, count(distinct src) as sources from pics group by picture")
def canonical_pictures(spark, folder):
    t = with_picture(table(spark, folder, "train").select("rec_no", "source", "image_id"), table(spark, folder, "image_alias"))
    return t.groupBy("picture").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("alias_closure", f"with recursive {PICTURES_SQL} select pic as picture, list(alias order by alias) as aliases from ends where n < 60 and pic is not null group by pic")
def alias_closure(spark, folder):
    """All older names of each picture that has any; a picture's own few names."""
    e = alias_ends(table(spark, folder, "image_alias")).where("end is not null")
    return e.groupBy(F.col("end").alias("picture")).agg(F.sort_array(F.collect_list("alias")).alias("aliases"))


@query("dev_by_picture", f"with recursive {PICTURES_SQL}, d as (select ('0x' || substr(sha256('dev:' || picture), 1, 8))::bigint / 4294967295.0 < 0.1 as dev from pics where picture is not null) select dev, count(*) as n from d group by dev")
def dev_by_picture(spark, folder):
    """Which side a row falls on follows from its picture's one name, however the row spells it."""
    t = with_picture(table(spark, folder, "train").select("source", "image_id"), table(spark, folder, "image_alias")).where("picture is not null")
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("dev:"), "picture"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return t.groupBy((u < 0.1).alias("dev")).agg(F.count("*").alias("n"))


@query("capped_dev", f"""with d as (select rec_no, kind, {h('cd', 'rec_no')} as h, ('0x' || substr({h('side', 'id')}, 1, 8))::bigint / 4294967296.0 < 0.2 as dev from train where id is not null and kind is not null), r as (select *, row_number() over (partition by kind, dev order by h, rec_no) as r from d)
select kind, case when dev then 'dev' else 'train' end as part, count(*) as n from r where not dev or r <= 20 group by all""")
def capped_dev(spark, folder):
    """A split by id whose dev side has at most 20 rows a kind."""
    d = table(spark, folder, "train").where("id is not null and kind is not null").select("rec_no", "kind", "id", hash_key("cd", "rec_no").alias("h")).withColumn("dev", unit(hash_key("side", "id")) < 0.2)
    caps = d.select("kind").distinct().withColumn("cap", F.lit(20))
    out = d.where("not dev").unionByName(balance.first_by_cell(d.where("dev"), ["kind"], caps, "h", ["rec_no"]).select(d.columns))
    return out.groupBy("kind", F.when(F.col("dev"), "dev").otherwise("train").alias("part")).agg(F.count("*").alias("n"))


# Boxes, starts, spreads


@query("same_start", """with x as (select *, row_number() over (partition by kind, sample_id, qid order by loaded_at, asked_at) as o from eval_records where run_id = 'r21' and control is null), y as (select *, row_number() over (partition by kind, sample_id, qid order by loaded_at, asked_at) as o from eval_records where run_id = 'r24' and control is null),
j as (select coalesce(x.kind, y.kind) as kind, x.sample_id as a, y.sample_id as b, case when x.sample_id is not null and y.sample_id is not null then coalesce(list_max(list_transform(x.probabilities, lambda e: abs(e.p - coalesce(list_filter(y.probabilities, lambda d: d.key = e.key)[-1].p, 0)))), 0) end as far from x full join y on x.kind = y.kind and x.sample_id = y.sample_id and x.qid = y.qid and x.o = y.o)
select kind, count(far) as n, count_if(b is null)::bigint as only_a, count_if(a is null)::bigint as only_b, coalesce(count_if(far > 0.3), 0)::bigint as differ, round(max(far), 6) as worst from j group by kind""")
def same_start(spark, folder):
    from gleanwork.operators import validate

    r = records(spark, folder).where("control is null")
    s = validate.same_start(r.where("run_id = 'r21'"), r.where("run_id = 'r24'"), ["kind"], ["sample_id", "qid"], ["loaded_at", "asked_at"], "probabilities", 0.3)
    return rounded(s, "worst")


@query("output_errors", """with v as (select distinct on (id) id as sample_id, split from val), x as (select id as sample_id, count(*) as n from val group by id), y as (select sample_id, count(*) as m from eval_records where run_id = 'r24' group by sample_id),
s as (select case when n is null then 'missing in a' when m is null then 'missing in b' when n > 1 or m > 1 then 'repeated' end as problem from x full join y using (sample_id)),
e as (select list_transform(probabilities, lambda d: d.key) as ks, list_transform(probabilities, lambda d: d.p) as ps, options from eval_records where run_id = 'r24'),
o as (select 'keys' as problem from e where ks is distinct from options union all select 'value' from e where len(list_filter(ps, lambda p: p < 0 or p > 1)) > 0 union all select 'sum' from e where abs(list_sum(ps) - 1) > 1e-4)
select problem, count(*) as n from (select problem from s where problem is not null union all select problem from o) group by problem""")
def output_errors(spark, folder):
    from gleanwork.operators import validate

    r = records(spark, folder).where("run_id = 'r24'")
    return validate.output_errors(r, table(spark, folder, "val").select(F.col("id").alias("sample_id")), ["sample_id"], [])


@query("uneven_kinds", "with c as (select kind, prediction, count(*) as n from eval_records group by all) select kind, max(n) as top, round(avg(n), 6) as mean from c group by kind having max(n) > avg(n) * 2")
def uneven_kinds(spark, folder):
    from gleanwork.operators import validate

    return rounded(validate.flat(records(spark, folder), "kind", "prediction"), "mean")


@query("value_spread", "select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.1), 4) as p10, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(avg((l_extendedprice < 1000)::int), 6) as below_1000, round(avg((l_extendedprice < 20000)::int), 6) as below_20000 from lineitem group by l_returnflag")
def value_spread(spark, folder):
    s = metrics.value_spread(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"], [1000, 20_000])
    return rounded(s.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90")}), "below_1000", "below_20000")


_BOXES = "b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 500)::double as x, (l_suppkey % 300)::double as y, l_quantity + 10 as w, l_tax * 1000 + 10 as h from lineitem)"


def _boxes(spark, folder):
    from gleanwork.plans.queries_identity import boxes

    return boxes(spark, folder)


@query("crop_windows", f"""with {_BOXES}, u as (select *, ('0x' || substr({h('crop', "l_orderkey || '-' || l_linenumber || '-' || l_partkey")}, 1, 8))::bigint / 4294967296.0 as u, greatest(0, floor(y + h) - 200 + 1) as lo, least(floor(y), 400 - 200.0) as hi from b)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when x + w <= 561 and y + h <= 401 and h <= 200 and hi >= lo then lo + floor(u * (hi - lo + 1)) end as top from u""")
def crop_windows(spark, folder):
    from gleanwork.functions import geometry as G

    u = unit(F.md5(F.concat(F.lit("crop|"), F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))))))
    w = G.crop_window(F.col("box"), F.lit(560.0), F.lit(400.0), 560, 200, u)
    return _boxes(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w["y"].alias("top"))


@query("region_patches", f"""with {_BOXES}, i as (select unnest(range(0, 64)) as i), p as (select b.*, i, ((i % 8 + 0.5) * 32 - 0) / (256 / 560.0::double) as cx, ((i // 8 + 0.5) * 32 - 36) / (256 / 560.0::double) as cy, 32 / (256 / 560.0::double) as s from b, i),
t as (select * from p where least(cx + s / 2, 560, x + w) - greatest(cx - s / 2, 0, x) > 1e-9 and least(cy + s / 2, 400, y + h) - greatest(cy - s / 2, 0, y) > 1e-9)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*)::int as n, min(i)::int as first, (max(i % 8) - min(i % 8))::int as width, (max(i // 8) - min(i // 8))::int as height from t group by l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, w, h""")
def region_patches(spark, folder):
    """Which of 8 x 8 patches of the fitted picture a box touches."""
    from gleanwork.functions import geometry as G

    r = G.region(F.col("box"), G.box(F.lit(0), F.lit(0), F.lit(560), F.lit(400)), F.lit(560.0), F.lit(400.0), 256, 8)
    b = _boxes(spark, folder)
    b = b.groupBy(*b.columns).count().drop("count").withColumn("r", r).where("size(r) > 0")
    most = lambda f: F.array_max(F.transform("r", f))
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("r").alias("n"), F.array_min(F.transform("r", lambda p: p["patch"])).alias("first"), most(lambda p: p["col"]).alias("width"), most(lambda p: p["row"]).alias("height"))


@query("closer_of_two", """with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 500 - 280) * l_quantity / (560 / (2 * tan(radians(30)))) as ax, l_quantity as az, (l_suppkey % 300 - 280) * l_discount * 100 / (560 / (2 * tan(radians(30)))) as bx, l_discount * 100 as bz from lineitem),
d as (select *, sqrt(ax * ax + (az - 10) * (az - 10)) as da, sqrt(bx * bx + (bz - 10) * (bz - 10)) as db from p)
select case when least(da, db) > 0 and greatest(da, db) / least(da, db) >= 1.3 and greatest(da, db) - least(da, db) >= 1 then case when da < db then 'a' else 'b' end end as closer, count(*) as n from d group by 1""")
def closer_of_two(spark, folder):
    from gleanwork.functions import geometry as G

    at = lambda x, z: G.backprojected(x, F.lit(200.0), z, F.lit(560.0), F.lit(400.0))
    c = G.closer_of_two(G.box(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).withField("z", F.lit(10.0)), at(F.col("l_partkey") % 500, F.col("l_quantity")), at(F.col("l_suppkey") % 300, F.col("l_discount") * 100), 1.3, 1.0)
    return table(spark, folder, "lineitem").groupBy(c.alias("closer")).agg(F.count("*").alias("n"))


# Converting, voting, mixing


@query("question_items", f"""select run_id, sample_id, asked_at, loaded_at, list_transform(a, lambda x: round(x / nullif(list_sum(a), 0), 6)) as gold
from (select *, list_transform(options, lambda o: coalesce(list_filter(gold, lambda e: e.key = o)[-1].p, 0)) as a from eval_records) where list_sum(a) > 0""")
def question_items(spark, folder):
    g = P.aligned(F.col("options"), F.col("gold"))
    d = records(spark, folder).select("run_id", "sample_id", "asked_at", "loaded_at", g.alias("gold")).where("gold is not null")
    return d.withColumn("gold", F.transform("gold", lambda x: F.round(x, 6)))


@query("converted_questions", f"""with d as (select rec_no, kind as g, {_ARG} as a from train), u as (select distinct g, a from d where g is not null and a is not null), e as (select g, a, {h('conv', 'a')} as h from u),
s as (select g, a, coalesce(lead(a) over (partition by g order by h, a), first_value(a) over (partition by g order by h, a rows between unbounded preceding and unbounded following)) as o from e)
select rec_no, case when d.a in ('true', 'false') then 'noul' else 'choice' end as type, case when d.a in ('true', 'false') then ['false', 'true'] when {h('side', 'rec_no')} < '8' then [d.a, o] else [o, d.a] end as options, d.a as gold from d join s on s.g = d.g and s.a = d.a where d.a in ('true', 'false') or o <> d.a""")
def converted_questions(spark, folder):
    """Yes/no rows as they are, others as a choice between the answer and the next one of its kind."""
    r = gold_rows(spark, folder)
    s = distract.siblings(r, "kind", "answer", hash_key("conv", "answer"))
    yes = F.col("answer").isin("true", "false")
    two = F.when(hash_key("side", "rec_no") < "8", F.array("answer", "sibling")).otherwise(F.array("sibling", "answer"))
    options = F.when(yes, F.array(F.lit("false"), F.lit("true"))).otherwise(two)
    return r.join(s, ["kind", "answer"]).where(yes | (F.col("sibling") != F.col("answer"))).select("rec_no", F.when(yes, "noul").otherwise("choice").alias("type"), options.alias("options"), F.col("answer").alias("gold"))


@query("vote_labels", "select sample_id, qid, count(*) as votes, round(avg((prediction = 'true')::int), 4) as p_true from eval_records where prediction in ('true', 'false') group by all having count(*) >= 2")
def vote_labels(spark, folder):
    """Answers of one question as votes: a soft label where there are two or more."""
    v = records(spark, folder).where("prediction in ('true', 'false')").groupBy("sample_id", "qid").agg(F.count("*").alias("votes"), F.avg((F.col("prediction") == "true").cast("double")).alias("p_true"))
    return v.where("votes >= 2").withColumn("p_true", F.round("p_true", 4))


_U = lambda salt, x: f"('0x' || substr({h(salt, x)}, 1, 8))::bigint / 4294967296.0"


@query("count_runs", f"""with n as (select rec_no, {_NUM(_ARG)} as n, 3 + floor({_U('len', 'rec_no')} * 3)::int as k, {_U('run', 'rec_no')} as u from train where kind = 'count'), s as (select *, greatest(0, n - k + 1) as lo, least(n, 10 - k + 1) as hi from n where n is not null),
r as (select rec_no, n, k, (lo + floor(u * (hi - lo + 1)))::int as s from s where n between 0 and 10) select rec_no, list_transform(range(s, s + k), lambda x: x::varchar) as options, case when n <= 1 then n::varchar when n <= 3 then '2-3' when n <= 6 then '4-6' else '7+' end as bucket from r""")
def count_runs(spark, folder):
    n = gold_rows(spark, folder).where("kind = 'count'").select("rec_no", X.whole_number(F.col("answer")).alias("n"))
    length = (F.lit(3) + F.floor(unit(hash_key("len", "rec_no")) * 3)).cast("int")
    d = n.select("rec_no", X.count_run(F.col("n"), length, unit(hash_key("run", "rec_no"))).alias("options"), X.count_bucket(F.col("n")).alias("bucket"))
    return d.where("options is not null")


@query("unambiguous_phrases", "with c as (select image_id, unnest(captions) as caption, id from captions where image_id is not null) select image_id, caption, min(id) as id from c where caption is not null group by image_id, caption having min(id) = max(id)")
def unambiguous_phrases(spark, folder):
    c = table(spark, folder, "captions").select("image_id", "id", F.explode("captions").alias("caption"))
    return distract.unambiguous(c, "image_id", "caption", "id")


_SWAPS = {"black": "white", "red": "green", "blue": "yellow", "orange": "purple", "pink": "silver"}
_BOTH = {**_SWAPS, **{v: k for k, v in _SWAPS.items()}}
_PARTNER = lambda w: "case " + " ".join(f"when {w} = '{a}' then '{b}'" for a, b in _BOTH.items()) + " end"


@query("negative_captions", f"""with d as (select distinct image_id, caption from (select image_id, unnest(captions) as caption from captions) where image_id is not null and caption is not null), w as (select *, string_split(caption, ' ') as ws from d),
p as (select *, list_position(list_transform(ws, lambda w: ({_PARTNER('w')}) is not null), true) as place from w), n as (select image_id, caption, array_to_string(list_transform(ws, lambda w, i: case when i = place then {_PARTNER('w')} else w end), ' ') as negative from p where place > 0)
select * from n where not exists (select 1 from d where d.image_id = n.image_id and d.caption = n.negative)""")
def negative_captions(spark, folder):
    c = table(spark, folder, "captions").select("image_id", F.explode("captions").alias("caption"))
    return distract.negative_captions(c, "image_id", "caption", _SWAPS)


@query("pools_in_use", f"""with d as (select kind, kind || ':' || array_to_string(list_slice(string_split({_WORDING}, ' '), 1, 4), ' ') as fine, {_ARG} as a from train), n as (select fine, count(distinct a) >= 8 as many from d where a is not null group by fine)
select case when many then d.fine else kind end as pool, count(*) as n from d left join n on d.fine is not distinct from n.fine group by 1""")
def pools_in_use(spark, folder):
    d = gold_rows(spark, folder).select("kind", "answer", F.concat("kind", F.lit(":"), X.wording_prefix(F.col("instructions"), 4)).alias("fine"))
    return distract.finest_pool(d, "fine", "kind", "answer").groupBy("pool").agg(F.count("*").alias("n"))


@query("matched_frequency", f"""with d as (select kind, {_ARG} as a from train), c as (select kind, a, count(*) as n from d where a is not null group by all), r as (select *, row_number() over (partition by kind order by n desc, a) as r from c),
p as (select x.kind as kind, x.a as answer, x.n as n, y.a as other, greatest(x.n, y.n)::double / least(x.n, y.n) as q from r x join r y on x.kind is not distinct from y.kind and y.r <> x.r and y.r between x.r - 2 and x.r + 2),
b as (select kind, answer, case when min(q) <= 2 then 2.0::double when min(q) <= 4 then 4.0::double end as ratio from p group by all)
select b.kind as kind, b.answer as answer, b.ratio as ratio, list(other order by other) as others from b join p on p.kind is not distinct from b.kind and p.answer = b.answer and p.q <= b.ratio where b.ratio is not null group by b.kind, b.answer, b.ratio""")
def matched_frequency(spark, folder):
    return distract.matched_frequency(gold_rows(spark, folder).select("kind", "answer"), "kind", "answer")


@query("family_deltas", f"""with {_LAST}, f as (select kind, image_id, avg(cb::int - ca::int) as d, avg((pa <> pb)::int) as c from p where image_id is not null group by all)
select kind, count(*) as families, round(avg(d), 6) as delta, round(avg(c), 6) as changed from f group by kind""")
def family_deltas(spark, folder):
    """Differences first inside each picture, then over pictures, so that a picture of many questions counts once."""
    p = run_pairs(spark, folder).where("image_id_b is not null")
    f = p.groupBy(F.col("kind_b").alias("kind"), "image_id_b").agg(F.avg(F.col("correct_b").cast("int") - F.col("correct_a").cast("int")).alias("d"), F.avg((F.col("prediction_a") != F.col("prediction_b")).cast("int")).alias("c"))
    return rounded(f.groupBy("kind").agg(F.count("*").alias("families"), F.avg("d").alias("delta"), F.avg("c").alias("changed")), "delta", "changed")


@query("flattened_wordings", f"""with d as (select rec_no, {_WORDING} as w, {_ARG} as a, {h('fw', 'rec_no')} as h from train), c as (select w, a, count(*) as n from d group by all), t as (select w, list_reverse_sort(list(n)) as ns, sum(n) as s from c group by w),
k as (select w, case when s < 5 then s else coalesce(ns[2], 1) end as cap from t), x as (select d.*, cap, row_number() over (partition by d.w, a order by h, rec_no) as r from d join k on d.w is not distinct from k.w), y as (select rec_no, a, h from x where r <= cap),
m as (select greatest(1, floor(2.0 * sum(n) / count(*))::bigint) as cap from (select a, count(*) as n from y group by a)), z as (select a, row_number() over (partition by a order by h, rec_no) as r from y) select a as answer, count(*) as n from z, m where r <= cap group by a""")
def flattened_wordings(spark, folder):
    """No answer of a wording more often than its second, then no answer at all beyond twice the mean."""
    d = gold_rows(spark, folder).select("rec_no", X.norm(F.col("instructions")).alias("w"), "answer").withColumn("h", hash_key("fw", "rec_no"))
    out = balance.flatten_answers(balance.flatten_top(d, "w", "answer", "h", ["rec_no"]), "answer", "h", ["rec_no"])
    return out.groupBy("answer").agg(F.count("*").alias("n"))


@query("rounds_of_kinds", f"""with d as (select rec_no, kind, {_ARG} as a, {h('rk', 'rec_no')} as h from train where kind is not null), n as (select kind, least(count_if(a = 'true'), count_if(a = 'false')) as cap from d where a in ('true', 'false') group by kind),
b as (select d.rec_no, d.kind, d.h from (select *, row_number() over (partition by kind, a order by h, rec_no) as r from d where a in ('true', 'false')) d join n using (kind) where r <= cap union all select rec_no, kind, h from d where a not in ('true', 'false') or a is null),
t as (select *, row_number() over (partition by kind order by h, rec_no) as t from b) select kind, count(*) as n from (select * from t where t <= 200 order by t, kind, h, rec_no limit 200) group by kind""")
def rounds_of_kinds(spark, folder):
    """Yes and no made even, then kinds taken in turn up to 200 rows."""
    d = gold_rows(spark, folder).where("kind is not null").select("rec_no", "kind", "answer").withColumn("h", hash_key("rk", "rec_no"))
    even = balance.drop_surplus(d, ["kind"], "answer", ("true", "false"), "h", ["rec_no"])
    return balance.round_robin(even, "kind", 200, ["h", "rec_no"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("priority_picks", f"""with d as (select rec_no, image_id, case kind when 'spatial' then 0 when 'color' then 1 else 2 end as p, {h('pp', 'rec_no')} as h from train where image_id is not null), r as (select *, row_number() over (partition by image_id order by p, h, rec_no) as r from d)
select rec_no, p as priority from r where r <= 3 order by p, h, rec_no limit 300""")
def priority_picks(spark, folder):
    """Kinds by priority, at most three rows a picture, the first 300."""
    p = F.when(F.col("kind") == "spatial", 0).when(F.col("kind") == "color", 1).otherwise(2)
    d = table(spark, folder, "train").where("image_id is not null").select("rec_no", "image_id", p.alias("priority"), hash_key("pp", "rec_no").alias("h"))
    return balance.cap_per(d, ["image_id"], 3, ["priority", "h", "rec_no"]).orderBy("priority", "h", "rec_no").limit(300).select("rec_no", "priority")


@query("replay_mix", f"""with d as (select rec_no, kind, {_ARG} as a, {h('rm', 'rec_no')} as h from train), b as (select 'base' as origin, kind from d where kind = 'reading'), r as (select kind, row_number() over (partition by a order by h, rec_no) as r from d where kind is distinct from 'reading' and a in ('true', 'false'))
select origin, kind, count(*) as n from (select * from b union all select 'replay', kind from r where r <= 100) group by all""")
def replay_mix(spark, folder):
    """One kind whole, and of the others as many yes as no."""
    d = gold_rows(spark, folder).select("rec_no", "kind", "answer").withColumn("h", hash_key("rm", "rec_no"))
    rest = d.where(~F.col("kind").eqNullSafe(F.lit("reading")) & F.col("answer").isin("true", "false"))
    caps = rest.select("answer").distinct().withColumn("cap", F.lit(100))
    both = d.where("kind = 'reading'").select(F.lit("base").alias("origin"), "kind").unionByName(balance.first_by_cell(rest, ["answer"], caps, "h", ["rec_no"]).select(F.lit("replay").alias("origin"), "kind"))
    return both.groupBy("origin", "kind").agg(F.count("*").alias("n"))


@query("smallest_threshold", """with t as (select unnest([0.0::double, 0.2::double, 0.4::double, 0.5::double, 0.6::double, 0.7::double, 0.8::double]) as t), s as (select run_id, t, avg((p_prediction >= t)::int) as c, avg(case when p_prediction >= t then (prediction = gold_answer)::int end) as a from eval_records, t group by all),
z as (select run_id, a as a0 from s where t = 0) select s.run_id as run_id, min(t) as threshold from s join z using (run_id) where c >= 0.3 and a >= a0 + 0.01 group by s.run_id""")
def smallest_threshold(spark, folder):
    """The lowest threshold that keeps three in ten answers and gains a point of accuracy over all of them."""
    s = metrics.thresholds(records(spark, folder), (0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8))
    z = s.where("threshold = 0").select("run_id", F.col("accuracy").alias("_a"))
    return s.join(z, "run_id").where("coverage >= 0.3 and accuracy >= _a + 0.01").groupBy("run_id").agg(F.min("threshold").alias("threshold"))


@query("question_agreement", """with g as (select sample_id, qid, count(distinct run_id) as runs, count(distinct list_sort(options)) as o, count(distinct gold_answer) as g, count(distinct coalesce(image_id, '')) as i from eval_records where control is null group by all)
select runs, o = 1 as same_options, g <= 1 as same_gold, i = 1 as same_picture, count(*) as n from g group by all""")
def question_agreement(spark, folder):
    """Whether all answers to a question were given the same options, gold and picture, in one run or both."""
    g = records(spark, folder).where("control is null").groupBy("sample_id", "qid").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct(F.sort_array("options")).alias("o"), F.count_distinct("gold_answer").alias("g"), F.count_distinct(F.coalesce("image_id", F.lit(""))).alias("i"))
    return g.groupBy("runs", (F.col("o") == 1).alias("same_options"), (F.col("g") <= 1).alias("same_gold"), (F.col("i") == 1).alias("same_picture")).agg(F.count("*").alias("n"))


@query("whole_scenes", "with o as (select l_orderkey, bool_and(l_quantity >= 5) as big, count(distinct l_partkey) as parts from lineitem group by l_orderkey) select big, parts, count(*) as n from o group by all")
def whole_scenes(spark, folder):
    """Scenes all of whose things are big enough."""
    o = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") >= 5).alias("big"), F.count_distinct("l_partkey").alias("parts"))
    return o.groupBy("big", "parts").agg(F.count("*").alias("n"))
