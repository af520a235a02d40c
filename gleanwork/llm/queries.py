"""Queries of the training-corpus problems."""

from __future__ import annotations

from gleanwork.llm import encode, mixing, overlap, quota, skeleton, splits
from gleanwork.plans.queries_build import PICTURES_SQL
from gleanwork.plans.registry import Registry, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("p5_ids")
def p5_ids(spark, folder):
    return encode.encode_corpus(table(spark, folder, "documents"))


@query("p7_found")
def p7_found(spark, folder):
    return skeleton.lookalike_pairs(table(spark, folder, "documents"))


@query("p7_text")
def p7_text(spark, folder):
    return skeleton.consistent_text(table(spark, folder, "documents"))


@query("p7_classes")
def p7_classes(spark, folder):
    return skeleton.lookalike_classes(table(spark, folder, "documents"))


def _p2(operator):
    return lambda spark, folder: operator(*(table(spark, folder, t) for t in ("train", "val", "image_alias")))


query("p2_found")(_p2(overlap.overlap_pairs))
query("p2_counts")(_p2(overlap.overlap_counts))


@query("p3_found", f"""with recursive {PICTURES_SQL}, t as (select distinct src, picture from pics where src is not null and picture is not null), e as (select distinct x.src as a, y.src as b from t x join t y using (picture) where x.src <> y.src),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as source_a, b as source_b from r where a < b""")
def p3_found(spark, folder):
    return splits.tied_sources(table(spark, folder, "train"), table(spark, folder, "image_alias"))


def _record_splits(spark, folder):
    return splits.record_splits(table(spark, folder, "train"), table(spark, folder, "image_alias"), table(spark, folder, "split_targets"))


@query("p3_splits")
def p3_splits(spark, folder):
    return _record_splits(spark, folder)


@query("p3_report")
def p3_report(spark, folder):
    return splits.split_report(_record_splits(spark, folder), table(spark, folder, "split_targets"))


_LETTERS = "regexp_replace(lower(type), '[^a-z]', '', 'g')"


@query("p4_found", f"""with t as (select id, case when {_LETTERS} in ('noul', 'yesno', 'yesorno', 'boolean', 'bool', 'binary') then 'noul' when {_LETTERS} in ('choice', 'multichoice', 'multiplechoice', 'mc', 'singlechoice') then 'choice' when {_LETTERS} in ('score', 'rating', 'rate') then 'score' end as type,
  nullif(split_part(regexp_replace(regexp_replace(lower(source), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '[^a-z0-9]+', '/', 'g'), '/', 1), '') as collection from train where id is not null),
n as (select type, collection, count(distinct id) as n from t group by all), s as (select count(distinct id) * 0.25::double as size from t)
select q.type as type, q.collection as collection from s, quota_targets q left join n on n.type = q.type and n.collection = q.collection where coalesce(n, 0) < greatest(q.min_rows::double, q.share * size)""")
def p4_found(spark, folder):
    return quota.quota_plan(table(spark, folder, "train"), table(spark, folder, "quota_targets")).where("short").select("type", "collection")


@query("p4_sample")
def p4_sample(spark, folder):
    return quota.quota_sample(table(spark, folder, "train"), table(spark, folder, "quota_targets"))


@query("p4_report")
def p4_report(spark, folder):
    return quota.quota_report(table(spark, folder, "train"), table(spark, folder, "quota_targets"))


@query("p6_found")
def p6_found(spark, folder):
    return mixing.short_sources(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))


@query("p6_mix")
def p6_mix(spark, folder):
    return mixing.mix_corpus(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))


@query("p6_report")
def p6_report(spark, folder):
    return mixing.mix_report(table(spark, folder, "documents"), table(spark, folder, "mix_weights"))
