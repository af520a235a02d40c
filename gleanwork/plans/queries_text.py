"""Queries over wordings: scalar functions, baselines of text alone, Naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import bayes, metrics
from gleanwork.operators.ordered import hash_key, unit
from gleanwork.plans.registry import Registry, table

query = Registry()

_WS = "[ \\t\\n\\r\\f\\x0B]"
_NORM = f"regexp_replace(regexp_replace(regexp_replace(lower(instructions), '{_WS}+', ' ', 'g'), '[ ?]+$', ''), '^ +', '')"
_KIND = f"""case when regexp_matches({_NORM}, '^how many ') then 'count' when regexp_matches({_NORM}, '^what colou?r ') then 'color' when regexp_matches({_NORM}, '^(is|are|does|do|was|were|can|has|have) ') then 'yesno'
  when regexp_matches({_NORM}, '^which ') then 'which' when regexp_matches({_NORM}, '^what ') then 'what' else 'other' end"""
_ARG = "list_filter(gold, lambda e: e.p = list_max(list_transform(gold, lambda x: x.p)))[1].key"
_WORDS = "regexp_extract_all(replace(lower(instructions), 'n''t', ' n''t'), '(n''t|[a-z0-9]+)')"


@query("normalised_wordings", f"select rec_no, {_NORM} as wording, {_KIND} as question_kind, array_to_string(string_split({_NORM}, ' ')[1:3], ' ') as prefix from train")
def normalised_wordings(spark, folder):
    i = F.col("instructions")
    return table(spark, folder, "train").select("rec_no", X.norm(i).alias("wording"), X.question_kind(i).alias("question_kind"), X.wording_prefix(i).alias("prefix"))


@query("word_features", f"""with w as (select rec_no, {_WORDS} as ws from val) select rec_no, len(ws)::int as n_words, list_sort(list_distinct(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), ['len:' || least(8, len(ws) // 2)]))) as features from w""")
def word_features(spark, folder):
    i = F.col("instructions")
    return table(spark, folder, "val").select("rec_no", F.size(X.words(i)).alias("n_words"), F.sort_array(F.array_distinct(X.features(i))).alias("features"))


@query("document_words", f"select w as word, count(*) as n from (select unnest({_WORDS.replace('instructions', 'text')}) as w from documents where text is not null) group by w having count(*) >= 20")
def document_words(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select(F.explode(X.words(F.col("text"))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


@query("number_parsing", """with a as (select distinct g.key as answer from (select unnest(gold) as g from train)), b as (select answer, replace(replace(answer, ',', ''), ' ', '') as bare from a)
select answer, try_cast(regexp_replace(trim(answer), '[,%$€£ ]', '', 'g') as double) as number, case when regexp_matches(lower(bare), '^-?[0-9]+(\\.[0-9]+)?%?$') then regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(bare), '%$', ''), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), '^(-?)0+([0-9])', '\\1\\2') || case when bare like '%\\%' escape '\\' then '%' else '' end
  else regexp_replace(lower(trim(answer)), '\\bgrey\\b', 'gray', 'g') end as canonical from b""")
def number_parsing(spark, folder):
    a = table(spark, folder, "train").select(F.explode("gold.key").alias("answer")).distinct()
    return a.select("answer", X.parse_number(F.col("answer")).alias("number"), X.canonical_answer(F.col("answer")).alias("canonical"))


@query("answer_pools", f"""with t as (select {_NORM} as w, lower(trim({_ARG})) as a from train), c as (select a, case when a in ('yes', 'no', 'true', 'false') then 'yesno' when a in ({', '.join(repr(c) for c in X.COLOURS)}) then 'color'
  when regexp_matches(a, '^(1[5-9]|20)[0-9]{{2}}$') then 'year' when a in ({', '.join(repr(c) for c in X.NUMBER_WORDS)}) or regexp_matches(replace(a, ' ', ''), '^-?[0-9]+(\\.[0-9]+)?%?$') then 'number' else 'text:' || array_to_string(string_split(w, ' ')[1:4], ' ') end as pool from t where a is not null)
select pool, a as answer, count(*) as n from c group by all""")
def answer_pools(spark, folder):
    t = table(spark, folder, "train").select("instructions", P.argmax_key(F.col("gold")).alias("a")).where("a is not null")
    return t.groupBy(X.answer_class(F.col("instructions"), F.col("a")).alias("pool"), F.lower(F.trim("a")).alias("answer")).agg(F.count("*").alias("n"))


@query("option_geometry", """select rec_no, len(list_distinct(list_transform(gold, lambda g: lower(trim(g.key)))))::int as n_options, list_transform(range(0, len(gold)), lambda k: list_concat(list_transform(gold, lambda g: g.key)[k + 1:], list_transform(gold, lambda g: g.key)[1:k])) as orders from val where len(gold) > 0""")
def option_geometry(spark, folder):
    keys = F.transform("gold", lambda g: g["key"])
    return table(spark, folder, "val").where(F.size("gold") > 0).select("rec_no", F.size(X.clean_options(keys)).alias("n_options"), X.cyclic_orders(keys).alias("orders"))


@query("mirrored_gold", """select rec_no, list_transform(gold, lambda e: round(coalesce(list_filter(gold, lambda x: x.key = case e.key when 'to the left of' then 'to the right of' when 'to the right of' then 'to the left of' else e.key end)[-1].p, 0), 6)) as p from train where axis is not null""")
def mirrored_gold(spark, folder):
    s = P.swapped(F.col("gold"), {"to the left of": "to the right of"})
    return table(spark, folder, "train").where("axis is not null").select("rec_no", F.transform(s, lambda e: F.round(e["p"], 6)).alias("p"))


@query("answer_prior", f"""with o as (select {_ARG} as a, unnest(list_distinct(list_transform(gold, lambda g: g.key))) as option from train) select option, count(*) as offered, count_if(option = a)::bigint as gold, round((count_if(option = a) + 1) / (count(*) + 2), 6) as prior from o group by option""")
def answer_prior(spark, folder):
    t = table(spark, folder, "train").select(F.transform("gold", lambda g: g["key"]).alias("options"), P.argmax_key(F.col("gold")).alias("answer"))
    return bayes.answer_prior(t, "options", "answer").withColumn("prior", F.round("prior", 6))


def answered(spark, folder, name):
    i = F.col("instructions")
    t = table(spark, folder, name).select("rec_no", X.norm(i).alias("wording"), X.wording_prefix(i).alias("prefix"), P.argmax_key(F.col("gold")).alias("answer"), F.get("gold.key", F.lit(0)).alias("first"))
    return t.where("answer is not null")


_ANS = f"select {_NORM} as wording, array_to_string(string_split({_NORM}, ' ')[1:3], ' ') as prefix, {_ARG} as answer, gold[1].key as first from"


@query("wording_backoff", f"""with t as ({_ANS} train), v as ({_ANS} val), a as (select wording, arg_min(answer, (-n, answer)) as a0 from (select wording, answer, count(*) as n from t where answer is not null group by all) group by wording),
b as (select prefix, arg_min(answer, (-n, answer)) as a1 from (select prefix, answer, count(*) as n from t where answer is not null group by all) group by prefix)
select round(avg((coalesce(a0, a1, first) = answer)::int), 6) as accuracy, count(*) as n from v left join a using (wording) left join b using (prefix) where answer is not null""")
def wording_backoff(spark, folder):
    return bayes.backoff_accuracy(answered(spark, folder, "train"), answered(spark, folder, "val"), ["wording", "prefix"], "answer", "first").withColumn("accuracy", F.round("accuracy", 6))


@query("varied_wordings", f"with t as ({_ANS} train) select wording, count(*) as n, count(distinct answer) as n_answers from t where answer is not null group by wording having count(distinct answer) > 1")
def varied_wordings(spark, folder):
    return metrics.several_answers(answered(spark, folder, "train"), "wording", "answer")


@query("majority_by_kind", f"""with t as (select kind, {_ARG} as answer from train), c as (select kind, answer, count(*) as n from t where answer is not null group by all) select kind, arg_min(answer, (-n, answer)) as best, sum(n)::bigint as n from c group by kind""")
def majority_by_kind(spark, folder):
    t = table(spark, folder, "train").select("kind", P.argmax_key(F.col("gold")).alias("answer")).where("answer is not null")
    return metrics.majority(t, "kind", "answer")


@query("overlap_slices", f"""with s as (select distinct {_NORM} as wording from train), v as (select split, {_NORM} as wording, state_text, axis from val)
select split, x.name as slice, count(*) as n from (select split, unnest(list_filter([{{'name': 'all', 'y': true}}, {{'name': 'wording seen', 'y': s.wording is not null}}, {{'name': 'wording unseen', 'y': s.wording is null}}, {{'name': 'has state', 'y': v.state_text is not null}}, {{'name': 'has axis', 'y': v.axis is not null}}], lambda e: e.y)) as x from v left join s using (wording)) group by all""")
def overlap_slices(spark, folder):
    seen = table(spark, folder, "train").select(X.norm(F.col("instructions")).alias("wording")).distinct().withColumn("_s", F.lit(True))
    v = table(spark, folder, "val").withColumn("wording", X.norm(F.col("instructions"))).join(seen, "wording", "left")
    s = F.coalesce("_s", F.lit(False))
    flags = {"all": F.lit(True), "wording seen": s, "wording unseen": ~s, "has state": F.col("state_text").isNotNull(), "has axis": F.col("axis").isNotNull()}
    x = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda e: e.isNotNull())
    return v.select("split", F.explode(x).alias("slice")).groupBy("split", "slice").agg(F.count("*").alias("n"))


@query("shortened_hints", f"select rec_no, array_to_string(string_split_regex(trim(state_text), '{_WS}+')[1:5], ' ') as hint from train where state_text is not null")
def shortened_hints(spark, folder):
    return table(spark, folder, "train").where("state_text is not null").select("rec_no", X.word_budget(F.col("state_text"), 5).alias("hint"))


def noul_rows(spark, folder):
    """Yes/no rows with features of their wording; the label is whether the answer is yes."""
    t = table(spark, folder, "train").select("rec_no", P.argmax_key(F.col("gold")).alias("answer"), X.features(F.col("instructions")).alias("f"))
    return t.where(F.col("answer").isin("true", "false")).select("rec_no", (F.col("answer") == "true").alias("yes"), F.array_distinct("f").alias("f"))


_NB = f"""
d as (select rec_no, {_ARG} as answer, {_WORDS} as ws from train),
k as (select rec_no, answer = 'true' as yes, ('0x' || substr(sha256(rec_no::varchar), 64, 1))::int % 2 as fold, list_distinct(list_concat(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), ['len:' || least(8, len(ws) // 2)])) as f from d where answer in ('true', 'false')),
l as (select rec_no, yes, fold, unnest(f) as f from k), c as (select 1 - fold as fold, f, count_if(yes) as p, count_if(not yes) as q from l group by all having count(*) >= 3),
s as (select fold, sum(p + 1) as sp, sum(q + 1) as sq from c group by fold), w as (select c.fold as fold, f, ln((p + 1) / sp) - ln((q + 1) / sq) as w from c join s using (fold)),
n as (select 1 - fold as fold, ln((count_if(yes) + 1.0) / (count_if(not yes) + 1.0)) as prior from k group by fold),
x as (select l.rec_no as rec_no, sum(w) as s from l join w using (fold, f) group by l.rec_no),
scores as (select k.rec_no as rec_no, k.yes as yes, k.fold as fold, n.prior + coalesce(x.s, 0) as score from k join n using (fold) left join x on x.rec_no = k.rec_no)"""


@query("nb_text_baseline", f"with {_NB} select round(avg(((score > 0) = yes)::int), 6) as accuracy, count(*) as n from scores")
def nb_text_baseline(spark, folder):
    return bayes.accuracy(bayes.cross_scores(noul_rows(spark, folder), "rec_no", "yes", "f"), "yes").withColumn("accuracy", F.round("accuracy", 6))


@query("nb_debias", f"""with {_NB}, rs as (select rec_no, yes, round(score, 9) as s from scores), q as (select quantile_disc(s, list_transform(range(1, 20), lambda i: i / 20.0::double)) as e from rs), es as (select list_sort(list_distinct(list_append(e, 0.0::double))) as edges from q),
bs as (select rec_no, yes, len(list_filter(edges, lambda x: s > x))::int as bin from rs, es), cs as (select bin, least(count_if(yes), count_if(not yes)) as cap from bs group by bin),
ks as (select bs.*, cap, row_number() over (partition by bs.bin, yes order by md5('debias|' || rec_no), rec_no) as r from bs join cs using (bin)) select rec_no, yes, bin from ks where r <= cap""")
def nb_debias(spark, folder):
    return bayes.debias(bayes.cross_scores(noul_rows(spark, folder), "rec_no", "yes", "f"), "rec_no", "yes").select("rec_no", "yes", "bin")


@query("unsettled_answers", f"""with t as (select rec_no, kind, list_reverse_sort(list_transform(gold, lambda g: g.p / list_sum(list_transform(gold, lambda x: x.p)))) as ps from train where list_sum(list_transform(gold, lambda x: x.p)) > 0)
select kind, count(*) as n, round(avg(ps[1]), 6) as mean_top, count_if(ps[1] - coalesce(ps[2], 0) < 0.2)::bigint as close from t group by kind""")
def unsettled_answers(spark, folder):
    ps = F.sort_array(F.transform(P.normalised(F.col("gold")), lambda g: g["p"]), asc=False)
    t = table(spark, folder, "train").select("kind", ps.alias("ps")).where("ps is not null")
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.get("ps", F.lit(0))), 6).alias("mean_top"), F.count_if(F.get("ps", F.lit(0)) - F.coalesce(F.get("ps", F.lit(1)), F.lit(0.0)) < 0.2).alias("close"))


_HASH = "('0x' || substr(md5('lm|' || doc_id), 1, 8))::bigint / 4294967296.0"


@query("document_sample_share", f"select source, count(*) as n, count_if({_HASH} < 0.5)::bigint as kept from documents group by source")
def document_sample_share(spark, folder):
    u = unit(hash_key("lm", "doc_id"))
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(u < 0.5).alias("kept"))
