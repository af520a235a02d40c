"""Queries on identity, joins, sets and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import geometry as G
from gleanwork.operators import identity, mix, validate
from gleanwork.plans.registry import Registry, table

query = Registry()

_HALF = "list_reduce(list_prepend(0::bigint, list_transform(range(1, 33), lambda i: case when embedding[i + {at}] > 0 then (1::bigint << (i - 1)) else 0 end)), lambda a, b: a | b)"


@query("hamming_pairs", f"with e as (select vec_id, {_HALF.format(at=0)} as l, {_HALF.format(at=32)} as h from embeddings), p as (select a.vec_id as vec_a, b.vec_id as vec_b, (bit_count(xor(a.l, b.l)) + bit_count(xor(a.h, b.h)))::int as distance from e a, e b where a.vec_id < b.vec_id) select * from p where distance <= 16")
def hamming_pairs(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", identity.sign_bits("embedding").alias("h"))
    p = identity.hamming_pairs(e.withColumnRenamed("vec_id", "vec_a"), e.withColumnRenamed("vec_id", "vec_b"), "vec_a", "vec_b", "h", 16)
    return p.where("vec_a < vec_b")


@query("first_match", """with x as (select c_custkey, c_mktsegment as k0, c_nationkey as k1 from customer), i as (select s_name as name, case when s_suppkey % 3 = 0 then 'BUILDING' end as k0, s_nationkey as k1 from supplier),
m0 as (select k0, min(name) as m from i where k0 is not null group by k0), m1 as (select k1, min(name) as m from i where k1 is not null group by k1)
select c_custkey, coalesce(m0.m, m1.m) as match, case when m0.m is not null then 0 when m1.m is not null then 1 end::int as matched_by from x left join m0 using (k0) left join m1 using (k1)""")
def first_match(spark, folder):
    x = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("k0"), F.col("c_nationkey").alias("k1"))
    i = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").alias("k0"), F.col("s_nationkey").alias("k1"))
    return identity.first_match(x, i, ["k0", "k1"], "name").select("c_custkey", "match", "matched_by")


@query("set_roles", """with s as (select split as set_name, id, nullif(image_id, '') as image_id from val), f as (select id, nullif(image_id, '') as image_id from train), w as (select id, nullif(image_id, '') as image_id from captions),
x as (select set_name, (id in (select id from f where id <> '') or coalesce(image_id in (select image_id from f where image_id is not null), false)) as a, (id in (select id from w where id <> '') or coalesce(image_id in (select image_id from w where image_id is not null), false)) as b from s)
select set_name, count(*) as n, count_if(a)::bigint as in_fit, count_if(b)::bigint as in_watched, case when count_if(a) > 0 then 'seen' when count_if(b) > 0 then 'watched' else 'test' end as role from x group by set_name""")
def set_roles(spark, folder):
    pick = lambda n, *c: table(spark, folder, n).select("id", "image_id", *c)
    return identity.roles(pick("val", F.col("split").alias("set_name")), pick("train"), pick("captions"), "id", "image_id")


@query("set_intersections", """with d as (select distinct source, image_id from documents where image_id is not null and source is not null) select x.source as a, y.source as b, count(*) as n from d x join d y using (image_id) where x.source < y.source group by all""")
def set_intersections(spark, folder):
    return identity.intersections(table(spark, folder, "documents").where("source is not null"), "source", "image_id")


@query("cooccurrence", """with d as (select distinct l_orderkey, p_brand from lineitem join part on p_partkey = l_partkey) select x.p_brand as a, y.p_brand as b, count(*) as n from d x join d y using (l_orderkey) where x.p_brand < y.p_brand group by all having count(*) >= 5""")
def cooccurrence(spark, folder):
    d = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey")
    return identity.cooccurrence(d, "l_orderkey", "p_brand", 5)


@query("clean_relations", """with e as (select distinct l_partkey as a, case when l_quantity > 25 then 'above' else 'below' end as relation, l_suppkey as b from lineitem where l_partkey <> l_suppkey)
select a, relation, b from e where not exists (select 1 from e x where x.a = e.a and x.b = e.b and x.relation <> e.relation) and not exists (select 1 from e x where x.a = e.b and x.b = e.a and x.relation = e.relation)""")
def clean_relations(spark, folder):
    e = table(spark, folder, "lineitem").where("l_partkey <> l_suppkey")
    e = e.select(F.col("l_partkey").alias("a"), F.when(F.col("l_quantity") > 25, "above").otherwise("below").alias("relation"), F.col("l_suppkey").alias("b"))
    return identity.without_contradictions(e, {"above": "below", "below": "above"})


@query("interval_join", """with e as (select event_id, user_id, event_type, floor(epoch(ts))::bigint as t from events), i as (select user_id, t as start, lead(t) over (partition by user_id order by t, event_id) as stop, event_id as segment from e where event_type = 'purchase')
select e.event_id as event_id, segment from e join i on i.user_id = e.user_id and e.t between start and stop where e.event_type = 'click'""")
def interval_join(spark, folder):
    from pyspark.sql import Window

    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    i = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), F.lead("t").over(w).alias("stop"), F.col("event_id").alias("segment")).where("stop is not null")
    return identity.covering(e.where("event_type = 'click'"), i, "user_id", "t", "start", "stop", 86_400).select("event_id", "segment")


@query("merged_ranges", """with r as (select user_id, floor(epoch(ts))::bigint as a, floor(epoch(ts))::bigint + 3600 as b from events), m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as p from r),
g as (select *, sum(case when p is null or a - p > 7200 then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) as g from m) select user_id, min(a) as a, max(b) as b, count(*) as members from g group by user_id, g""")
def merged_ranges(spark, folder):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return identity.merged_ranges(table(spark, folder, "events").select("user_id", s.alias("a"), (s + 3600).alias("b")), "user_id", "a", "b", 7200)


@query("as_of", """with e as (select event_id, user_id, event_type, ts, value from events) select c.event_id, (select max_by(p.value, (p.ts, p.event_id)) from e p where p.user_id = c.user_id and p.event_type = 'view' and p.ts <= c.ts) as value_before from e c where event_type = 'purchase'""")
def as_of(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return identity.nearest_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "value", F.datediff("ts", F.lit("2000-01-01"))).select("event_id", "value_before")


@query("exclusions", """with h as (select distinct image_id from val where image_id is not null), i as (select distinct id from val), c as (select distinct image_id from captions where image_id is not null)
select case when image_id in (select image_id from h) then 'picture' when id in (select id from i) then 'id' when image_id in (select image_id from c) then 'caption' end as dropped, kind, count(*) as n from train group by all""")
def exclusions(spark, folder):
    v, c = table(spark, folder, "val"), table(spark, folder, "captions")
    d = mix.exclude(table(spark, folder, "train").select("id", "image_id", "kind"), [("picture", v, ["image_id"]), ("id", v, ["id"]), ("caption", c, ["image_id"])])
    return d.groupBy("dropped", "kind").agg(F.count("*").alias("n"))


@query("replay_pool", "select rec_no from train t where not exists (select 1 from val v where v.image_id = t.image_id) and not exists (select 1 from eval_records e where e.sample_id = t.id) and coalesce(source, '') not like 'kiln%'")
def replay_pool(spark, folder):
    t = table(spark, folder, "train").where("coalesce(source, '') not like 'kiln%'")
    t = t.join(table(spark, folder, "val").select("image_id").distinct(), "image_id", "left_anti")
    return t.join(table(spark, folder, "eval_records").select(F.col("sample_id").alias("id")).distinct(), "id", "left_anti").select("rec_no")


@query("used_pictures", "select image_id from train where image_id is not null union select image_id from val where image_id is not null union select image_id from captions where image_id is not null")
def used_pictures(spark, folder):
    one = lambda n: table(spark, folder, n).where("image_id is not null").select("image_id")
    return one("train").union(one("val")).union(one("captions")).distinct()


@query("missing_pictures", "select image, min(id) as named_by from val where image is not null and image not in (select image from captions where image is not null) group by image")
def missing_pictures(spark, folder):
    there = table(spark, folder, "captions").select("image").distinct()
    return table(spark, folder, "val").where("image is not null").join(there, "image", "left_anti").groupBy("image").agg(F.min("id").alias("named_by"))


@query("caption_groups", """with c as (select distinct image_id, unnest(captions) as caption from captions where image_id is not null) select image_id, count(*) as n, list_sort(list(caption)) as captions from c where caption <> '' group by image_id""")
def caption_groups(spark, folder):
    c = table(spark, folder, "captions").where("image_id is not null").select("image_id", F.explode("captions").alias("caption")).where("caption <> ''").distinct()
    return c.groupBy("image_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("caption")).alias("captions"))  # a picture's own few captions


@query("side_coverage", """with s as (select id, count(*) as s from captions group by id), r as (select distinct id, true as r from val)
select coalesce(r.id, s.id) as id, case when s is null then 'missing' when r is null then 'unknown' else 'repeated' end as problem from r full join s on r.id = s.id where s is null or r is null or s > 1""")
def side_coverage(spark, folder):
    return validate.covers_once(table(spark, folder, "captions"), table(spark, folder, "val"), ["id"])


@query("manifest", "select split, kind, count(*) as rows, count(distinct id) as ids, count(distinct image_id) as pictures from val group by rollup (split, kind)")
def manifest(spark, folder):
    return validate.manifest(table(spark, folder, "val"), ["split", "kind"], "id", "image_id")


@query("field_histogram", "select 'type' as field, type as value, count(*) as n from train group by type union all select 'kind', kind, count(*) from train group by kind union all select 'axis', axis, count(*) from train group by axis")
def field_histogram(spark, folder):
    return validate.histogram(table(spark, folder, "train"), ["type", "kind", "axis"])


@query("repeated_ids", "select id, count(*) as n from train group by id having count(*) > 1")
def repeated_ids(spark, folder):
    return validate.repeated(table(spark, folder, "train"), ["id"])


@query("sample_errors", """with e as (select list_transform(gold, lambda g: g.p) as ps, list_transform(gold, lambda g: g.key) as ks, type from train)
select list_filter([case when type is null then 'no type' end, case when len(ks) < 2 or ks is null then 'too few options' end, case when len(list_distinct(ks)) < len(ks) then 'repeated option' end, case when ks is null or len(ks) = 0 then 'no gold' end,
  case when len(list_filter(ps, lambda p: p is null or p < 0)) > 0 then 'gold value' end, case when len(list_filter(ps, lambda p: p is null or p < 0)) = 0 and coalesce(list_sum(ps), 0) <= 0 and ks is not null then 'gold sums to zero' end], lambda x: x is not null) as errors, count(*) as n from e group by all""")
def sample_errors(spark, folder):
    keys = F.transform("gold", lambda g: g["key"])
    return table(spark, folder, "train").select(validate.sample_errors(keys, F.col("gold"), F.col("type")).alias("errors")).groupBy("errors").agg(F.count("*").alias("n"))


@query("unbalanced_kinds", "with c as (select kind, answer, count(*) as n from (select kind, correct as answer from eval_records) group by all) select kind, min(n) as least, max(n) as most from c group by kind having min(n) < max(n)")
def unbalanced_kinds(spark, folder):
    return validate.unbalanced(table(spark, folder, "eval_records"), "kind", "correct")


def boxes(spark, folder):
    """Line items as boxes: where they lie comes from their numbers."""
    b = G.box(F.col("l_partkey") % 500, F.col("l_suppkey") % 300, F.col("l_quantity") + 10, F.col("l_tax") * 1000 + 10)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", b.alias("box"))


_BOX = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 500)::double as x, (l_suppkey % 300)::double as y, l_quantity + 10 as w, l_tax * 1000 + 10 as h from lineitem"


@query("box_pairs", f"""with b as ({_BOX}), p as (select a.l_orderkey as o, a.l_partkey as pa, b.l_partkey as pb, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as s, a.w * a.h as aa, b.w * b.h as ab,
  (b.x + b.w / 2) - (a.x + a.w / 2) as dx, (b.y + b.h / 2) - (a.y + a.h / 2) as dy from b a join b b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)
select o as l_orderkey, pa, pb, round(s / (aa + ab - s), 6) as iou, case when abs(dx) > 40 and abs(dy) <= 40 then case when dx > 0 then 'left' else 'right' end when abs(dy) > 40 and abs(dx) <= 40 then case when dy > 0 then 'above' else 'below' end end as relation from p""")
def box_pairs(spark, folder):
    b = boxes(spark, folder)
    p = b.select("l_orderkey", F.col("l_partkey").alias("pa"), F.col("box").alias("a")).join(b.select("l_orderkey", F.col("l_partkey").alias("pb"), F.col("box").alias("b")), "l_orderkey").where("pa < pb")
    return p.select("l_orderkey", "pa", "pb", F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"), G.relation(F.col("a"), F.col("b"), 40).alias("relation"))


@query("box_grids", f"""with b as ({_BOX}), c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform(range(0, 16), lambda i: greatest(least((i % 4) * 140.0 + 140, x + w) - greatest((i % 4) * 140.0, x), 0) * greatest(least(floor(i / 4) * 100.0 + 100, y + h) - greatest(floor(i / 4) * 100.0, y), 0)) as g from b)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform(g, lambda v: round(coalesce(v / nullif(list_sum(g), 0), 1 / 16.0) * 0.9 + 0.1 / 16, 12)) as grid from c""")
def box_grids(spark, folder):
    g = G.box_grid(F.col("box"), F.lit(560.0), F.lit(400.0), 4, 0.1)
    return boxes(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.transform(g, lambda x: F.round(x, 12)).alias("grid"))
