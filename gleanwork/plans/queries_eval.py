"""Queries over evaluation records: scores, summaries, baselines, comparisons, calibration, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import calibrate, compare, metrics, scorer, validate
from gleanwork.operators.ordered import hash_key, unit
from gleanwork.plans.registry import Registry, table

query = Registry()

_P = "coalesce(list_filter(probabilities, lambda e: e.key = g.key)[-1].p, 0)"
_SCORED = f"""
r as (select *, prediction = gold_answer as is_right,
  coalesce(list_sum(list_transform(gold, lambda g: case when g.p > 0 then -g.p * ln(greatest({_P}, 1e-12)) else 0 end)), 0) as nll,
  coalesce(list_sum(list_transform(gold, lambda g: power({_P} - g.p, 2))), 0) as brier from eval_records)"""
_KIND = "regexp_replace(lower(type), '[^a-z]', '', 'g')"


def records(spark, folder):
    return table(spark, folder, "eval_records")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("score_records", f"with {_SCORED} select run_id, sample_id, qid, asked_at, loaded_at, is_right, round(nll, 6) as nll, round(brier, 6) as brier from r")
def score_records(spark, folder):
    return rounded(metrics.scored(records(spark, folder)), "nll", "brier").select("run_id", "sample_id", "qid", "asked_at", "loaded_at", "is_right", "nll", "brier")


@query("decision_summary", f"""
with {_SCORED}, g as (
  select run_id, unnest([{{'field': 'all', 'value': 'all'}}, {{'field': 'source', 'value': coalesce(nullif(source, ''), '-')}}, {{'field': 'kind', 'value': coalesce(nullif(kind, ''), '-')}},
    {{'field': 'axis', 'value': coalesce(nullif(axis, ''), '-')}}, {{'field': 'options', 'value': cast(len(options) as varchar)}}]) as x, image_id, is_right, nll, brier, p_prediction from r),
f as (select run_id, x.field as field, x.value as value, image_id, is_right::int as ok, nll, brier, p_prediction, least(floor(p_prediction * 15), 14) as bin from g),
b as (select run_id, field, value, bin, count(*) as n, sum(ok) as k, sum(p_prediction) as c from f group by all),
e as (select run_id, field, value, sum(abs(c - k)) / sum(n) as ece from b group by all)
select run_id, field, value, count(*) as n, count(distinct image_id) as images, round(avg(ok), 6) as accuracy, round(avg(nll), 6) as nll, round(avg(brier), 6) as brier, round(any_value(ece), 6) as ece
from f join e using (run_id, field, value) group by run_id, field, value""")
def decision_summary(spark, folder):
    return rounded(metrics.summary(records(spark, folder)), "accuracy", "nll", "brier", "ece")


@query("reliability", """
select run_id, cast(least(floor(p_prediction * 10), 9) as int) as bin, count(*) as n, round(avg(p_prediction), 6) as confidence, round(avg((prediction = gold_answer)::int), 6) as accuracy
from eval_records group by all""")
def reliability(spark, folder):
    return rounded(metrics.reliability(records(spark, folder)), "confidence", "accuracy")


@query("thresholds", """
select run_id, t as threshold, round(avg((p_prediction >= t)::int), 6) as coverage, round(avg(case when p_prediction >= t then (prediction = gold_answer)::int end), 6) as accuracy
from eval_records, (select unnest([0.6::double, 0.7::double, 0.8::double, 0.9::double]) as t) group by all""")
def thresholds(spark, folder):
    return rounded(metrics.thresholds(records(spark, folder)), "coverage", "accuracy")


@query("confusion", f"""
with c as (select run_id, kind, count_if(prediction = 'true' and gold_answer = 'true') as tp, count_if(prediction = 'true' and gold_answer = 'false') as fp,
  count_if(prediction = 'false' and gold_answer = 'true') as fn, count_if(prediction = 'false' and gold_answer = 'false') as tn, count(*) as n
  from eval_records where {_KIND} in ('noul', 'yesno') group by all),
d as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as re from c)
select run_id, kind, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, n, round((tp + tn) / n, 6) as accuracy, round(pr, 6) as precision, round(re, 6) as recall,
  round((tp + fp) / n, 6) as yes_ratio, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1 from d""")
def confusion(spark, folder):
    r = records(spark, folder).where(F.regexp_replace(F.lower("type"), "[^a-z]", "").isin("noul", "yesno"))
    return rounded(metrics.confusion(r, ["run_id", "kind"]), "accuracy", "precision", "recall", "yes_ratio", "f1")


@query("latency_percentiles", """
select run_id, count(*) as n, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(avg(latency_ms), 6) as mean_ms, round(count(*) * 1000.0 / sum(latency_ms), 6) as per_second
from eval_records where latency_ms is not null group by run_id""")
def latency_percentiles(spark, folder):
    return rounded(metrics.latency(records(spark, folder), "latency_ms", ["run_id"]), "p50", "p95", "mean_ms", "per_second")


@query("macro_accuracy", """
with g as (select run_id, kind, avg(correct::int) as m, sum(correct::int) as s, count(*) as n from eval_records group by all)
select run_id, round(avg(m), 6) as macro, round(sum(s) / sum(n), 6) as micro, count(*) as n_groups from g group by run_id""")
def macro_accuracy(spark, folder):
    return rounded(metrics.macro(records(spark, folder), ["run_id"], "kind", F.col("correct").cast("double")), "macro", "micro")


@query("accuracy_by_folded_source", """
with n as (select source, count(*) >= 30 as often from eval_records group by source)
select run_id, case when often then coalesce(r.source, '-') else '(other)' end as folded, count(*) as n, round(avg(correct::int), 6) as accuracy,
  round(avg(case when control = 'mismatched' then correct::int end), 6) as mismatched
from eval_records r join n on r.source is not distinct from n.source group by all""")
def accuracy_by_folded_source(spark, folder):
    d = metrics.folded_field(records(spark, folder), "source", 30)
    ok = F.col("correct").cast("double")
    return rounded(d.groupBy("run_id", "folded").agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.avg(F.when(F.col("control") == "mismatched", ok)).alias("mismatched")), "accuracy", "mismatched")


@query("bucket_metrics", f"""
with {_SCORED}, k as (select *, case when {_KIND} in ('noul', 'yesno') then 'noul' when {_KIND} in ('choice', 'multichoice', 'multiplechoice') then 'choice' else {_KIND} end as clean from r),
b as (select *, case when clean = 'noul' then 'noul:2' when len(options) <= 2 then clean || ':2' when len(options) <= 5 then clean || ':3-5' when len(options) <= 10 then clean || ':6-10' else clean || ':11+' end as bucket from k)
select run_id, coalesce(bucket, 'all') as bucket, count(*) as n, round(avg(is_right::int), 6) as accuracy, round(avg(nll), 6) as nll from b group by grouping sets ((run_id, bucket), (run_id))""")
def bucket_metrics(spark, folder):
    d = with_buckets(metrics.scored(records(spark, folder)))
    both = d.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit("all"))))
    return rounded(both.groupBy("run_id", "bucket").agg(F.count("*").alias("n"), F.avg(F.col("is_right").cast("double")).alias("accuracy"), F.avg("nll").alias("nll")), "accuracy", "nll")


def with_buckets(df):
    s = F.regexp_replace(F.lower("type"), "[^a-z]", "")
    clean = F.when(s.isin("noul", "yesno"), "noul").when(s.isin("choice", "multichoice", "multiplechoice"), "choice").otherwise(s)
    return df.withColumn("clean", clean).withColumn("bucket", P.option_bucket(F.col("clean"), F.size("options")))


@query("record_errors", """
with e as (select *, list_transform(probabilities, lambda x: x.key) as ks, list_transform(probabilities, lambda x: x.p) as ps, list_transform(gold, lambda x: x.p) as gs, list_transform(gold, lambda x: x.key) as gk from eval_records)
select case when ks is distinct from options then 'p keys' end as p_keys, len(list_filter(ps, lambda p: p < 0 or p > 1)) > 0 as p_value, abs(list_sum(ps) - 1) > 1e-4 as p_sum,
  len(list_filter(gk, lambda k: not list_contains(options, k))) > 0 as gold_name, abs(list_sum(gs) - 1) > 1e-6 as gold_sum, len(options) < 2 as few, count(*) as n from e group by all""")
def record_errors(spark, folder):
    r = records(spark, folder)
    e = validate.distribution_errors(F.col("options"), F.col("probabilities"))
    s = validate.sample_errors(F.col("options"), F.col("gold"), F.col("type"))
    d = r.select(F.when(F.array_contains(e, "keys"), "p keys").alias("p_keys"), F.array_contains(e, "value").alias("p_value"), F.array_contains(e, "sum").alias("p_sum"), F.array_contains(s, "gold names no option").alias("gold_name"), (F.abs(P.total(F.col("gold")) - 1) > 1e-6).alias("gold_sum"), F.array_contains(s, "too few options").alias("few"))
    return d.groupBy(*d.columns).agg(F.count("*").alias("n"))


@query("answers", """
with t as (select run_id, sample_id, asked_at, loaded_at, probabilities, list_max(list_transform(probabilities, lambda e: e.p)) as top from eval_records)
select run_id, sample_id, asked_at, loaded_at, list_filter(probabilities, lambda e: e.p = top)[1].key as prediction, round(top, 6) as p_prediction, round((len(probabilities) * top - 1) / nullif(len(probabilities) - 1, 0), 6) as confidence from t""")
def answers(spark, folder):
    return rounded(scorer.answered(records(spark, folder)), "p_prediction", "confidence").select("run_id", "sample_id", "asked_at", "loaded_at", "prediction", "p_prediction", "confidence")


@query("smoothed_gold", """
select run_id, sample_id, asked_at, loaded_at, list_transform(gold, lambda e: round(e.p / list_sum(list_transform(gold, lambda x: x.p)) * 0.9 + 0.1 / len(gold), 6)) as p from eval_records""")
def smoothed_gold(spark, folder):
    p = F.transform(P.smoothed(P.normalised(F.col("gold")), 0.1), lambda e: F.round(e["p"], 6))
    return records(spark, folder).select("run_id", "sample_id", "asked_at", "loaded_at", p.alias("p"))


_RUNS = "a as (select * from eval_records where run_id = 'r21'), b as (select * from eval_records where run_id = 'r24')"
_LAST = f"""{_RUNS},
la as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc) as rn from a) where rn = 1),
p as (select b.kind as kind, la.correct as ca, b.correct as cb, la.prediction as pa, b.prediction as pb, b.image_id as image_id from la join b using (sample_id, qid))"""


def runs(spark, folder):
    r = records(spark, folder)
    return r.where("run_id = 'r21'"), r.where("run_id = 'r24'")


def run_pairs(spark, folder):
    return compare.paired(*runs(spark, folder), ["loaded_at", "asked_at"])


@query("paired_compare", f"with {_LAST} select kind, count(*) as n, round(avg(ca::int), 6) as accuracy_a, round(avg(cb::int), 6) as accuracy_b, round(avg(cb::int - ca::int), 6) as difference from p group by kind")
def paired_compare(spark, folder):
    a, b = F.col("correct_a").cast("double"), F.col("correct_b").cast("double")
    d = run_pairs(spark, folder).groupBy(F.col("kind_b").alias("kind")).agg(F.count("*").alias("n"), F.avg(a).alias("accuracy_a"), F.avg(b).alias("accuracy_b"), F.avg(b - a).alias("difference"))
    return rounded(d, "accuracy_a", "accuracy_b", "difference")


@query("head_to_head", f"with {_LAST} select kind, count_if(ca and cb)::bigint as both, count_if(ca and not cb)::bigint as only_a, count_if(not ca and cb)::bigint as only_b, count_if(not ca and not cb)::bigint as neither from p group by kind")
def head_to_head(spark, folder):
    return compare.head_to_head(run_pairs(spark, folder).withColumnRenamed("kind_b", "kind"), ["kind"])


@query("transitions", f"with {_LAST} select kind, count(*) as n, count_if(pa <> pb)::bigint as changed, count_if(not ca and cb)::bigint as wrong_to_right, count_if(ca and not cb)::bigint as right_to_wrong from p group by kind")
def transitions(spark, folder):
    return compare.transitions(run_pairs(spark, folder).withColumnRenamed("kind_b", "kind"), ["kind"])


@query("match_bags", f"""with {_RUNS}, x as (select sample_id, qid, count(*) as n from a group by all), y as (select sample_id, qid, count(*) as m from b group by all),
j as (select coalesce(n, 0) as n, coalesce(m, 0) as m from x full join y using (sample_id, qid))
select sum(least(n, m))::bigint as matched, sum(greatest(n - m, 0))::bigint as only_a, sum(greatest(m - n, 0))::bigint as only_b from j""")
def match_bags(spark, folder):
    return compare.match_bags(*runs(spark, folder), compare.KEY, ["loaded_at", "asked_at"])


@query("evaluation_differences", f"""with {_RUNS}, x as (select sample_id, qid, count(*) as n, min(gold_answer) as g, max(gold_answer) as h from a group by all), y as (select sample_id, qid, count(*) as m, min(gold_answer) as k from b group by all)
select coalesce(x.sample_id, y.sample_id) as sample_id, coalesce(x.qid, y.qid) as qid, case when n is null then 'missing in a' when m is null then 'missing in b' when n > 1 or m > 1 then 'repeated' else 'gold_answer differs' end as problem
from x full join y on x.sample_id = y.sample_id and x.qid = y.qid where n is null or m is null or n > 1 or m > 1 or g <> k""")
def evaluation_differences(spark, folder):
    return compare.differences(*runs(spark, folder), compare.KEY, ["gold_answer"])


@query("order_sensitivity", """
with a as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc, run_id desc) as rn from eval_records where control is null) where rn = 1),
b as (select * from eval_records where control = 'reversed'),
j as (select b.run_id as run_id, a.prediction <> b.prediction as flip, list_transform(a.probabilities, lambda e: abs(e.p - coalesce(list_filter(b.probabilities, lambda x: x.key = e.key)[-1].p, 0))) as c from a join b using (sample_id, qid))
select run_id, count(*) as n, round(avg(flip::int), 6) as flip_rate, round(avg(list_sum(c) / len(c)), 6) as mean_change, round(max(list_max(c)), 6) as max_change from j where len(c) > 0 group by run_id""")
def order_sensitivity(spark, folder):
    r = records(spark, folder)
    p = compare.paired(r.where("control is null"), r.where("control = 'reversed'"), ["loaded_at", "asked_at", "run_id"]).withColumnRenamed("run_id_b", "run_id")
    return rounded(compare.order_sensitivity(p, ["run_id"]), "flip_rate", "mean_change", "max_change")


@query("teacher_blend", f"""with {_RUNS}, t as (select * from (select *, row_number() over (partition by sample_id, qid order by loaded_at desc, asked_at desc) as rn from b) where rn = 1)
select a.sample_id as sample_id, a.asked_at as asked_at, a.loaded_at as loaded_at, case when t.sample_id is null then list_transform(a.gold, lambda e: round(e.p, 6)) else list_transform(a.gold, lambda e: round(e.p * 0.7 + 0.3 * coalesce(list_filter(t.probabilities, lambda x: x.key = e.key)[-1].p, 0), 6)) end as p from a left join t using (sample_id, qid)""")
def teacher_blend(spark, folder):
    """Rows that the teacher did not answer keep their gold."""
    a, b = runs(spark, folder)
    j = compare.with_teacher(a, b, compare.KEY, ["loaded_at", "asked_at"], out="t", missing="keep")
    mixed = F.when(F.col("t").isNull(), F.col("gold")).otherwise(compare.blended(F.col("gold"), F.col("t"), 0.3))
    return j.select("sample_id", "asked_at", "loaded_at", F.transform(mixed, lambda e: F.round(e["p"], 6)).alias("p"))


@query("gain_change", """
with c as (select run_id, kind, len(options) as k, avg(case when control is null then correct::int end) as real, avg(case when control = 'mismatched' then correct::int end) as mis from eval_records group by all)
select x.kind as kind, count(*) as n, round(avg((y.real - y.mis) - (x.real - x.mis)), 6) as gain_change from c x join c y on x.kind = y.kind and x.k = y.k where x.run_id = 'r21' and y.run_id = 'r24' and x.real is not null and x.mis is not null and y.real is not null and y.mis is not null group by x.kind""")
def gain_change(spark, folder):
    """Questions hardly have all four answers in these data, so the units are the questions of one kind with as many options."""
    r = records(spark, folder).withColumn("k", F.size("options"))
    return rounded(compare.gain_change(r, "run_id", ("r21", "r24"), ["kind", "k"], ["kind"]), "gain_change")


GRID = calibrate.log_grid(0.3, 8.0, 400)
_FIT = f"""
with k as (select case when {_KIND} in ('noul', 'yesno') then 'noul' when {_KIND} in ('choice', 'multichoice', 'multiplechoice') then 'choice' else {_KIND} end as clean, options, gold, probabilities from eval_records),
b as (select case when clean = 'noul' then 'noul:2' when len(options) <= 2 then clean || ':2' when len(options) <= 5 then clean || ':3-5' when len(options) <= 10 then clean || ':6-10' else clean || ':11+' end as bucket, gold, probabilities from k),
t as (select unnest({sorted({*GRID, 1.0})}::double[]) as t),
z as (select bucket, t, gold, probabilities, list_transform(probabilities, lambda e: ln(greatest(e.p, 1e-12)) / t) as z from b, t),
s as (select bucket, t, gold, probabilities, list_transform(z, lambda x: exp(x - list_max(z))) as e from z),
q as (select bucket, t, coalesce(list_sum(list_transform(gold, lambda g: case when g.p > 0 then -g.p * ln(greatest(coalesce(e[list_position(list_transform(probabilities, lambda d: d.key), g.key)], 0) / list_sum(e), 1e-12)) else 0 end)), 0) as l from s),
m as (select bucket, t, round(avg(l), 9) as loss, count(*) as n from q group by all)
select bucket, any_value(n) as n, case when any_value(n) >= 50 then arg_min(t, (loss, t)) else 1.0 end as temperature, round(case when any_value(n) >= 50 then min(loss) else max(loss) filter (t = 1.0) end, 6) as loss, round(max(loss) filter (t = 1.0), 6) as loss_at_1 from m group by bucket"""


@query("calibrate_grid", _FIT)
def calibrate_grid(spark, folder):
    d = with_buckets(records(spark, folder))
    return rounded(calibrate.fit(d, ["bucket"], GRID, F.col("gold"), F.col("probabilities")), "loss", "loss_at_1")


_CALIBRATED = f"""
with k as (select *, case when {_KIND} in ('noul', 'yesno') then 'noul' when {_KIND} in ('choice', 'multichoice', 'multiplechoice') then 'choice' else {_KIND} end as clean from eval_records),
b as (select *, case when clean = 'noul' then 'noul:2' when len(options) <= 2 then clean || ':2' when len(options) <= 5 then clean || ':3-5' when len(options) <= 10 then clean || ':6-10' else clean || ':11+' end as bucket from k),
u as (select bucket as grp, gold, probabilities from b union all select 'kind ' || clean, gold, probabilities from b),
t as (select unnest({sorted({*GRID, 1.0})}::double[]) as t),
z as (select grp, t, gold, probabilities, list_transform(probabilities, lambda e: ln(greatest(e.p, 1e-12)) / t) as z from u, t),
s as (select grp, t, gold, probabilities, list_transform(z, lambda x: exp(x - list_max(z))) as e from z),
q as (select grp, t, coalesce(list_sum(list_transform(gold, lambda g: case when g.p > 0 then -g.p * ln(greatest(coalesce(e[list_position(list_transform(probabilities, lambda d: d.key), g.key)], 0) / list_sum(e), 1e-12)) else 0 end)), 0) as l from s),
m as (select grp, t, round(avg(l), 9) as loss, count(*) as n from q group by all),
f as (select grp, case when any_value(n) >= 50 then arg_min(t, (loss, t)) else 1.0 end as temperature from m group by grp),
c as (select b.*, coalesce(f.temperature, g.temperature, 1.0) as tt from b left join f on f.grp = bucket left join f g on g.grp = 'kind ' || clean),
y as (select *, list_transform(probabilities, lambda e: ln(greatest(e.p, 1e-12)) / tt) as zz from c),
x as (select *, list_transform(zz, lambda v: exp(v - list_max(zz))) as ee from y),
w as (select * exclude (probabilities, prediction, p_prediction), list_transform(probabilities, lambda d, i: {{'key': d.key, 'p': ee[i] / list_sum(ee)}}) as probabilities from x),
r as (select *, list_max(list_transform(probabilities, lambda e: e.p)) as p_prediction, list_filter(probabilities, lambda e: e.p = list_max(list_transform(probabilities, lambda d: d.p)))[1].key as prediction from w)"""


@query("calibrated_metrics", f"""{_CALIBRATED},
v as (select run_id, image_id, source, kind, axis, options, p_prediction, (prediction = gold_answer)::int as ok, coalesce(list_sum(list_transform(gold, lambda g: case when g.p > 0 then -g.p * ln(greatest({_P}, 1e-12)) else 0 end)), 0) as nll, coalesce(list_sum(list_transform(gold, lambda g: power({_P} - g.p, 2))), 0) as brier from r),
g as (select run_id, unnest([{{'field': 'all', 'value': 'all'}}, {{'field': 'source', 'value': coalesce(nullif(source, ''), '-')}}, {{'field': 'kind', 'value': coalesce(nullif(kind, ''), '-')}}, {{'field': 'axis', 'value': coalesce(nullif(axis, ''), '-')}}, {{'field': 'options', 'value': cast(len(options) as varchar)}}]) as x, image_id, ok, nll, brier, p_prediction from v),
h as (select run_id, x.field as field, x.value as value, image_id, ok, nll, brier, p_prediction, least(floor(p_prediction * 15), 14) as bin from g),
n as (select run_id, field, value, bin, count(*) as n, sum(ok) as k, sum(p_prediction) as c from h group by all), e as (select run_id, field, value, sum(abs(c - k)) / sum(n) as ece from n group by all)
select run_id, field, value, count(*) as n, count(distinct image_id) as images, round(avg(ok), 6) as accuracy, round(avg(nll), 6) as nll, round(avg(brier), 6) as brier, round(any_value(ece), 6) as ece from h join e using (run_id, field, value) group by run_id, field, value""")
def calibrated_metrics(spark, folder):
    d = with_buckets(records(spark, folder))
    fit = lambda by: calibrate.fit(d, [by], GRID, F.col("gold"), F.col("probabilities"))
    t = calibrate.with_temperature(d, "bucket", "clean", fit("bucket"), fit("clean")).withColumn("probabilities", P.rescaled(F.col("probabilities"), F.col("temperature")))
    return rounded(metrics.summary(scorer.answered(t).drop("confidence")), "accuracy", "nll", "brier", "ece")


@query("out_of_fold_temperatures", f"""
with k as (select *, case when {_KIND} in ('noul', 'yesno') then 'noul' when {_KIND} in ('choice', 'multichoice', 'multiplechoice') then 'choice' else {_KIND} end as clean from eval_records),
b as (select *, case when clean = 'noul' then 'noul:2' when len(options) <= 2 then clean || ':2' when len(options) <= 5 then clean || ':3-5' when len(options) <= 10 then clean || ':6-10' else clean || ':11+' end as bucket,
  case when ('0x' || substr(md5('half|' || sample_id), 1, 8))::bigint / 4294967296.0 < 0.5 then 0 else 1 end as half from k),
t as (select unnest({sorted({*GRID, 1.0})}::double[]) as t),
z as (select bucket, half, t, gold, probabilities, list_transform(probabilities, lambda e: ln(greatest(e.p, 1e-12)) / t) as z from b, t),
s as (select bucket, half, t, gold, probabilities, list_transform(z, lambda x: exp(x - list_max(z))) as e from z),
q as (select bucket, half, t, coalesce(list_sum(list_transform(gold, lambda g: case when g.p > 0 then -g.p * ln(greatest(coalesce(e[list_position(list_transform(probabilities, lambda d: d.key), g.key)], 0) / list_sum(e), 1e-12)) else 0 end)), 0) as l from s),
m as (select bucket, 1 - half as half, t, round(avg(l), 9) as loss, count(*) as n from q group by all),
f as (select bucket, half, case when any_value(n) >= 50 then arg_min(t, (loss, t)) else 1.0 end as temperature from m group by all)
select b.bucket as bucket, b.half::int as half, coalesce(any_value(f.temperature), 1.0) as temperature, count(*) as n from b left join f using (bucket, half) group by b.bucket, b.half""")
def out_of_fold_temperatures(spark, folder):
    d = with_buckets(records(spark, folder)).withColumn("half", F.when(unit(hash_key("half", "sample_id")) < 0.5, 0).otherwise(1))
    t = calibrate.out_of_fold(d, "half", "bucket", GRID, F.col("gold"), F.col("probabilities"))
    return t.groupBy("bucket", "half").agg(F.first("temperature").alias("temperature"), F.count("*").alias("n"))


@query("bootstrap_ci")
def bootstrap_ci(spark, folder):
    p = run_pairs(spark, folder).withColumns({"kind": F.col("kind_b"), "image": F.coalesce("image_id_b", F.concat(F.lit("sample "), "sample_id"))})
    s = compare.cluster_sums(p, "image", {"d": F.col("correct_b").cast("int") - F.col("correct_a").cast("int"), "n": F.lit(1)}, ["kind"])
    return rounded(compare.bootstrap_ratio(s, "d", "n", "image", ["kind"], 1000, 7), "estimate", "low", "high")


@query("picture_interval")
def picture_interval(spark, folder):
    r = records(spark, folder).where("image_id is not null")
    s = compare.cluster_sums(r, "image_id", {"ok": F.col("correct").cast("int"), "n": F.lit(1)}, ["run_id"]).select("run_id", "image_id", (F.col("ok") / F.col("n")).alias("share"), F.lit(1.0).alias("one"))
    return rounded(compare.bootstrap_ratio(s, "share", "one", "image_id", ["run_id"], 1000, 11), "estimate", "low", "high")


@query("clustered_accuracy", """
with p as (select run_id, kind, image_id, avg(correct::int) as m from eval_records where image_id is not null group by all)
select run_id, kind, count(*) as pictures, round(avg(m), 6) as share from p group by all""")
def clustered_accuracy(spark, folder):
    p = records(spark, folder).where("image_id is not null").groupBy("run_id", "kind", "image_id").agg(F.avg(F.col("correct").cast("double")).alias("m"))
    return rounded(p.groupBy("run_id", "kind").agg(F.count("*").alias("pictures"), F.avg("m").alias("share")), "share")


@query("completeness", """
with v as (select distinct id as sample_id from val), r as (select run_id, sample_id, count(*) as n from eval_records group by all), k as (select distinct run_id from eval_records)
select run_id, count(*) as asked, count_if(n is null)::bigint as missing, count_if(n > 1)::bigint as repeated from (select k.run_id, v.sample_id, r.n from k, v left join r on r.run_id = k.run_id and r.sample_id = v.sample_id) group by run_id""")
def completeness(spark, folder):
    r = records(spark, folder).groupBy("run_id", "sample_id").agg(F.count("*").alias("n"))
    v = table(spark, folder, "val").select(F.col("id").alias("sample_id")).distinct()
    runs_there = r.select("run_id").distinct().agg(F.collect_list("run_id").alias("names"))  # runs are named by hand: a few
    asked = v.join(runs_there).withColumn("run_id", F.explode("names")).drop("names")
    return asked.join(r, ["run_id", "sample_id"], "left").groupBy("run_id").agg(F.count("*").alias("asked"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("option_rates", """
with o as (select kind, options, gold_answer as a, list_transform(options, lambda x: len(x)) as l from eval_records where len(options) > 0)
select kind, count(*) as n, round(avg((options[1] = a)::int), 6) as first, round(avg((options[-1] = a)::int), 6) as last, round(avg((options[list_position(l, list_max(l))] = a)::int), 6) as longest,
  round(avg((options[list_position(l, list_min(l))] = a)::int), 6) as shortest, round(avg(1.0::double / len(options)), 6) as chance from o group by kind""")
def option_rates(spark, folder):
    return rounded(metrics.option_rates(records(spark, folder), "options", "gold_answer", ["kind"]), "first", "last", "longest", "shortest", "chance")


@query("position_histogram", "select kind, len(options)::int as n_options, (coalesce(list_position(options, gold_answer), 0) - 1)::int as position, count(*) as n from eval_records group by all")
def position_histogram(spark, folder):
    return metrics.position_histogram(records(spark, folder), "options", "gold_answer", ["kind"])


_HALF = "('0x' || substr(md5('half|' || sample_id), 1, 8))::bigint / 4294967296.0 < 0.5"


@query("question_only_baseline", f"""
with m as (select kind, gold_answer, count(*) as n from eval_records where {_HALF} group by all), b as (select kind, arg_min(gold_answer, (-n, gold_answer)) as best from m group by kind)
select round(avg(case when best is null then 1.0::double / len(options) else (best = gold_answer)::int end), 6) as accuracy, count(*) as n from eval_records r left join b on r.kind is not distinct from b.kind where not ({_HALF})""")
def question_only_baseline(spark, folder):
    r = records(spark, folder).withColumn("_half", unit(hash_key("half", "sample_id")) < 0.5)
    return rounded(metrics.majority_accuracy(r.where("_half"), r.where("not _half"), "kind", "gold_answer", 1.0 / F.size("options")), "accuracy")


@query("wording_prior_loo", """with d as (select regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(instructions), '\\s+', ' ', 'g'), '[ ?]+$', '')), '"[^"]*"', '_', 'g'), '[0-9]+(\\.[0-9]+)?', '#', 'g') as w,
  list_filter(gold, lambda e: e.p = list_max(list_transform(gold, lambda x: x.p)))[1].key as a from train),
c as (select w, a, count(*) as c from d where w is not null and a is not null group by all), n as (select w, sum(c) as n from c group by w),
p as (select x.w, x.a, x.c, n.n, max(y.c) as rest, count(y.c) filter (y.c = x.c - 1) as ties from c x join n using (w) left join c y on x.w = y.w and x.a <> y.a group by all),
k as (select *, case when n < 2 then null when c - 1 > coalesce(rest, 0) then 1.0 when c - 1 = coalesce(rest, 0) and c > 1 then 1.0 / (1 + ties) else 0.0 end as credit from p)
select sum(c)::bigint as n, coalesce(sum(c) filter (n > 1), 0)::bigint as seen, round(sum(credit * c) / sum(c) filter (n > 1), 6) as accuracy from k""")
def wording_prior_loo(spark, folder):
    d = table(spark, folder, "train").select(X.template(X.norm(F.col("instructions"))).alias("w"), P.argmax_key(F.col("gold")).alias("a"))
    return rounded(metrics.loo_prior(d.where("w is not null and a is not null"), "w", "a"), "accuracy")
