"""Queries that balance, cap, sample, split and repeat. Order inside groups is by md5, the same in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.functions import probs as P
from gleanwork.functions import text as X
from gleanwork.operators import balance, mix
from gleanwork.operators.ordered import hash_key, next_in_circle, running_total, unit
from gleanwork.plans.registry import Registry, table

query = Registry()


def rows(spark, folder):
    """Train rows with the answer (argmax of the gold), the hash order and a grouping by kind."""
    t = table(spark, folder, "train").select("rec_no", "id", "source", "kind", "axis", "image_id", "type", "gold")
    return t.withColumns({"answer": P.argmax_key(F.col("gold")), "h": hash_key("s", "rec_no")}).drop("gold")


_ARG = "list_filter(gold, lambda e: e.p = list_max(list_transform(gold, lambda x: x.p)))[1].key"
_T = f"t as (select rec_no, id, source, kind, axis, image_id, type, {_ARG} as answer, md5('s|' || rec_no) as h from train)"
_U = "('0x' || substr({h}, 1, 8))::bigint / 4294967296.0"


def nos(df):
    return df.select("rec_no")


@query("equalize", f"""with {_T}, c as (select kind, answer, count(*) as n from t group by all), m as (select kind, min(n) as cap, count(*) as k from c group by kind),
r as (select t.*, row_number() over (partition by kind, answer order by h, rec_no) as rn from t) select rec_no from r join m on r.kind is not distinct from m.kind where k >= 2 and rn <= cap""")
def equalize(spark, folder):
    return nos(balance.equalize(rows(spark, folder), "kind", "answer", "h", ["rec_no"]))


@query("flatten_top", f"""with {_T}, c as (select kind, answer, count(*) as n from t group by all), m as (select kind, sum(n) as total, list_reverse_sort(list(n)) as ns from c group by kind),
k as (select kind, case when total < 5 then total else coalesce(ns[2], 1) end as cap from m), r as (select t.*, row_number() over (partition by kind, answer order by h, rec_no) as rn from t)
select rec_no from r join k on r.kind is not distinct from k.kind where rn <= cap""")
def flatten_top(spark, folder):
    return nos(balance.flatten_top(rows(spark, folder), "kind", "answer", "h", ["rec_no"]))


@query("balance_overall", f"""with {_T}, y as (select * from t where answer in ('true', 'false')), m as (select min(n) as cap from (select count(*) as n from y group by answer)),
r as (select y.*, row_number() over (partition by answer order by h, rec_no) as rn from y) select rec_no from r, m where rn <= cap""")
def balance_overall(spark, folder):
    return nos(balance.balance_overall(rows(spark, folder).where(F.col("answer").isin("true", "false")), "answer", "h", ["rec_no"]))


@query("flatten_answers", f"""with {_T}, m as (select greatest(1, floor(2.0 * count(*) / count(distinct coalesce(answer, chr(1))))) as cap from t),
r as (select t.*, row_number() over (partition by answer order by h, rec_no) as rn from t) select rec_no from r, m where rn <= cap""")
def flatten_answers(spark, folder):
    return nos(balance.flatten_answers(rows(spark, folder), "answer", "h", ["rec_no"]))


@query("balance_yes_no", f"""with {_T}, c as (select kind, count_if(answer = 'true') as a, count_if(answer = 'false') as b from t where answer in ('true', 'false') group by kind),
r as (select t.*, row_number() over (partition by kind, answer order by h, rec_no) as rn from t)
select rec_no from r left join c on r.kind is not distinct from c.kind where answer is null or answer not in ('true', 'false') or rn <= least(a, b)""")
def balance_yes_no(spark, folder):
    return nos(balance.drop_surplus(rows(spark, folder), ["kind"], "answer", ("true", "false"), "h", ["rec_no"]))


@query("drop_surplus_yes", f"""with {_T}, c as (select kind, count_if(answer = 'true') as a, count_if(answer = 'false') as b from t where answer in ('true', 'false') group by kind),
r as (select t.*, row_number() over (partition by kind, answer order by h, rec_no) as rn from t)
select rec_no from r left join c on r.kind is not distinct from c.kind where answer is null or answer <> 'true' or rn <= least(a, b)""")
def drop_surplus_yes(spark, folder):
    return nos(balance.drop_surplus(rows(spark, folder), ["kind"], "answer", ("true", "false"), "h", ["rec_no"], True))


@query("cap_per_customer", "select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by md5('c|' || o_orderkey), o_orderkey) as rn from orders) where rn <= 3")
def cap_per_customer(spark, folder):
    return balance.cap_per(table(spark, folder, "orders"), ["o_custkey"], 3, [hash_key("c", "o_orderkey"), "o_orderkey"]).select("o_orderkey")


@query("cap_mixed", """with a as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey, o_orderpriority order by md5('c|' || o_orderkey), o_orderkey) as k from orders)
select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by k, md5('c|' || o_orderkey), o_orderkey) as rn from a) where rn <= 4""")
def cap_mixed(spark, folder):
    return balance.cap_mixed(table(spark, folder, "orders"), "o_custkey", "o_orderpriority", 4, [hash_key("c", "o_orderkey"), "o_orderkey"]).select("o_orderkey")


@query("quota_largest_remainder", """with c as (select o_orderpriority as p, count(*) as n from orders group by all), x as (select *, n * 1000.0 / sum(n) over () as q from c), f as (select *, floor(q + 1e-9) as b from x),
r as (select *, row_number() over (order by round(q - b, 9) desc, p) as rn, 1000 - sum(b) over () as spare from f) select p as o_orderpriority, n, (b + case when rn <= spare then 1 else 0 end)::bigint as quota from r""")
def quota_largest_remainder(spark, folder):
    c = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return balance.apportion(c, "n", 1000, ["o_orderpriority"])


@query("stratified_sample", """with c as (select o_orderpriority as p, count(*) as n from orders group by all), x as (select *, n * 1000.0 / sum(n) over () as q from c), f as (select *, floor(q + 1e-9) as b from x),
r as (select *, row_number() over (order by round(q - b, 9) desc, p) as rn, 1000 - sum(b) over () as spare from f), k as (select p, (b + case when rn <= spare then 1 else 0 end) as quota from r),
o as (select *, row_number() over (partition by o_orderpriority order by md5('t|' || o_orderkey), o_orderkey) as rn from orders) select o_orderkey from o join k on p = o_orderpriority where rn <= quota""")
def stratified_sample(spark, folder):
    o = table(spark, folder, "orders").withColumn("h", hash_key("t", "o_orderkey"))
    return balance.stratified(o, "o_orderpriority", 1000, "h", ["o_orderkey"]).select("o_orderkey")


@query("water_fill", """with c as (select kind, count(*) as n from train where kind is not null group by all), s as (select distinct n as level from c union select 0),
t as (select least(2000, (select sum(n) from c)) as total), k as (select unnest(generate_series(0, 2000)) as level), g as (select max(level) as level from (select k.level as level, sum(least(n, k.level)) as used from k, c group by k.level), t where used <= total),
b as (select kind, n, least(n, level) as q, case when n > level then row_number() over (partition by n > level order by kind) end as rn from c, g), sp as (select total - (select sum(q) from b) as spare from t)
select kind, n, (q + case when rn is not null and rn <= spare then 1 else 0 end)::bigint as quota from b, sp""")
def water_fill(spark, folder):
    c = table(spark, folder, "train").where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).limit(10_001).collect()  # kinds are named by hand: a few
    if len(c) > 10_000:
        raise ValueError("more than 10,000 kinds")
    q = balance.water_fill({r.kind: r.n for r in c}, 2000)
    return spark.createDataFrame([(r.kind, r.n, q[r.kind]) for r in c], "kind string, n bigint, quota bigint")


@query("take_whole_groups", """with g as (select o_custkey, count(*) as n, md5('w|' || o_custkey) as h from orders group by all), r as (select *, sum(n) over (order by h, o_custkey) - n as before from g)
select o_orderkey from orders join r using (o_custkey) where before < 2000""")
def take_whole_groups(spark, folder):
    return balance.whole_groups(table(spark, folder, "orders"), "o_custkey", 2000, hash_key("w", "o_custkey")).select("o_orderkey")


@query("half_by_group", """with g as (select o_orderpriority as p, o_custkey, count(*) as n, md5('w|' || o_custkey) as h from orders group by all), r as (select *, sum(n) over (partition by p order by h, o_custkey) - n as before, sum(n) over (partition by p) as total from g)
select o_orderkey from orders o join r on r.p = o.o_orderpriority and r.o_custkey = o.o_custkey where before < total * 0.5""")
def half_by_group(spark, folder):
    return balance.whole_groups_per(table(spark, folder, "orders"), "o_orderpriority", "o_custkey", 0.5, hash_key("w", "o_custkey")).select("o_orderkey")


@query("sample_rows", "select rec_no from train order by md5('s|' || rec_no), rec_no limit 500")
def sample_rows(spark, folder):
    t = table(spark, folder, "train").select("rec_no", hash_key("s", "rec_no").alias("h"))
    return nos(t.orderBy("h", "rec_no").limit(500))


@query("one_per_picture", "select rec_no from (select rec_no, row_number() over (partition by image_id order by md5('s|' || rec_no), rec_no) as rn from train where image_id is not null) where rn = 1")
def one_per_picture(spark, folder):
    t = table(spark, folder, "train").where("image_id is not null").select("rec_no", "image_id", hash_key("s", "rec_no").alias("h"))
    return t.groupBy("image_id").agg(F.min_by("rec_no", F.struct("h", "rec_no")).alias("rec_no")).select("rec_no")


@query("hash_split", "select c_custkey, case when ('0x' || substr(sha1(c_custkey::varchar), 1, 8))::bigint < 0.2 * 4294967296 then 'dev' else 'train' end as split from customer")
def hash_split(spark, folder):
    u = F.conv(F.substring(F.sha1(F.col("c_custkey").cast("string")), 1, 8), 16, 10).cast("bigint")
    return table(spark, folder, "customer").select("c_custkey", F.when(u < 0.2 * 4294967296, "dev").otherwise("train").alias("split"))


@query("three_way_split", """with u as (select c_custkey, ('0x' || substr(sha256('held|' || c_custkey), 1, 12))::bigint / 281474976710656.0 as u from customer)
select c_custkey, case when u < 0.1 then 'dev' when u < 0.3 then 'test' else 'train' end as split from u""")
def three_way_split(spark, folder):
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("held|"), F.col("c_custkey").cast("string")), 256), 1, 12), 16, 10).cast("double") / 281474976710656.0
    return table(spark, folder, "customer").select("c_custkey", F.when(u < 0.1, "dev").when(u < 0.3, "test").otherwise("train").alias("split"))


@query("fold_parity", "select c_custkey, ('0x' || substr(sha256(c_custkey::varchar), 64, 1))::int % 2 as fold from customer")
def fold_parity(spark, folder):
    from gleanwork.operators.bayes import fold

    return table(spark, folder, "customer").select("c_custkey", fold("c_custkey").alias("fold"))


@query("participant_split", """with g as (select c_nationkey, count(*) as n, md5('p|' || c_nationkey) as h from customer group by all), r as (select *, sum(n) over (order by h, c_nationkey) - n as before, sum(n) over () as total from g)
select c_nationkey, n, case when before < total * 0.1 then 'test' when before < total * 0.2 then 'dev' else 'train' end as split from r""")
def participant_split(spark, folder):
    g = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("h", hash_key("p", "c_nationkey"))
    total = g.agg(F.sum("n").alias("s")).first().s or 0
    d = running_total(g, "h", F.col("n"), [], "before", ["c_nationkey"])
    return d.select("c_nationkey", "n", F.when(F.col("before") < total * 0.1, "test").when(F.col("before") < total * 0.2, "dev").otherwise("train").alias("split"))


@query("repeat_rows", """with o as (select p_partkey, row_number() over (order by md5('r|' || p_partkey), p_partkey) - 1 as rn, count(*) over () as n from part), k as (select unnest(range(0, 3)) as pass)
select case when pass > 0 then p_partkey || '#r' || pass else p_partkey::varchar end as p_partkey, pass::int as pass from o, k where pass * n + rn < floor(n * 2.5)""")
def repeat_rows(spark, folder):
    p = table(spark, folder, "part").select("p_partkey").withColumn("h", hash_key("r", "p_partkey"))
    return balance.repeat_to(p, int(p.count() * 2.5), "h", "p_partkey").select("p_partkey", "pass")


@query("round_robin", "select rec_no from (select rec_no, kind, row_number() over (partition by kind order by md5('s|' || rec_no), rec_no) as turn from train where kind is not null) order by turn, kind, rec_no limit 300")
def round_robin(spark, folder):
    t = table(spark, folder, "train").where("kind is not null").select("rec_no", "kind", hash_key("s", "rec_no").alias("h"))
    return nos(balance.round_robin(t, "kind", 300, ["h", "rec_no"]))


@query("request_groups", "select rec_no, floor((rn - 1) / 3)::int as request, ((rn - 1) % 3)::int as place from (select rec_no, row_number() over (partition by image_id, coalesce(state_text, '') order by md5('req|' || rec_no), rec_no) as rn from val)")
def request_groups(spark, folder):
    v = table(spark, folder, "val").withColumn("_s", F.coalesce("state_text", F.lit("")))
    return balance.requests(v.withColumn("h", hash_key("req", "rec_no")), ["image_id", "_s"], 3, "h", ["rec_no"]).select("rec_no", "request", "place")


@query("mismatched_pictures", """with p as (select distinct image_id from val where image_id <> ''), o as (select image_id, row_number() over (order by md5('m|' || image_id), image_id) as rn, count(*) over () as n from p)
select a.image_id, b.image_id as "next" from o a join o b on b.rn = a.rn % a.n + 1""")
def mismatched_pictures(spark, folder):
    p = table(spark, folder, "val").where("image_id <> ''").select("image_id").distinct().withColumn("h", hash_key("m", "image_id"))
    return next_in_circle(p, "h", "image_id").select("image_id", "next")


@query("mismatched_within_kind", """with p as (select distinct kind, image_id from val where image_id <> '' and kind is not null), o as (select kind, image_id, row_number() over (partition by kind order by md5('m|' || image_id), image_id) as rn, count(*) over (partition by kind) as n from p)
select a.kind, a.image_id, b.image_id as "next" from o a join o b on b.kind = a.kind and b.rn = a.rn % a.n + 1 where a.n >= 2""")
def mismatched_within_kind(spark, folder):
    p = table(spark, folder, "val").where("image_id <> '' and kind is not null").select("kind", "image_id").distinct().withColumn("h", hash_key("m", "image_id"))
    return next_in_circle(p, "h", "image_id", ["kind"]).where("next <> image_id").select("kind", "image_id", "next")


@query("quota_union", """with q as (select * from (values ('run-log', 40), ('faq', 30), ('guideline', 25)) as v(source, cap)), r as (select doc_id, source, row_number() over (partition by source order by md5('q|' || doc_id), doc_id) as rn from documents)
select doc_id, r.source as source from r join q on q.source = r.source where rn <= cap""")
def quota_union(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source").withColumn("h", hash_key("q", "doc_id"))
    return mix.quota_union(d, "source", {"run-log": 40, "faq": 30, "guideline": 25}, "h", ["doc_id"]).select("doc_id", "source")


@query("short_quotas", """with q as (select * from (values ('run-log', 40), ('faq', 30000000), ('nowhere', 5)) as v(source, quota)), n as (select source, count(*) as n from documents group by all)
select q.source as source, quota::bigint as quota, coalesce(n, 0) as n from q left join n using (source) where coalesce(n, 0) < quota""")
def short_quotas(spark, folder):
    return mix.short_quotas(table(spark, folder, "documents"), "source", {"run-log": 40, "faq": 30_000_000, "nowhere": 5})


@query("first_wins", """with a as (select id, rec_no, kind, 'train' as origin, 0 as p from train union all select id, rec_no, kind, 'val', 1 from val)
select id, rec_no, kind, origin from (select *, row_number() over (partition by id order by p, rec_no) as rn from a) where rn = 1""")
def first_wins(spark, folder):
    sets = [(n, table(spark, folder, n).select("id", "rec_no", "kind")) for n in ("train", "val")]
    return mix.first_wins(sets, "id", ["rec_no"]).select("id", "rec_no", "kind", "origin")


@query("balance_positions", """with o as (select rec_no, axis, list_position(list_transform(gold, lambda x: x.key), {A}) as pos, md5('s|' || rec_no) as h from train where axis is not null and len(gold) = 2),
c as (select axis, pos, count(*) as n from o group by all), m as (select axis, min(n) as cap, count(*) as k from c group by axis)
select rec_no from (select o.*, row_number() over (partition by axis, pos order by h, rec_no) as rn from o) r join m using (axis) where k >= 2 and rn <= cap""".replace("{A}", _ARG))
def balance_positions(spark, folder):
    t = table(spark, folder, "train").where(F.col("axis").isNotNull() & (F.size("gold") == 2))
    t = t.select("rec_no", "axis", F.array_position(F.transform("gold", lambda e: e["key"]), P.argmax_key(F.col("gold"))).alias("pos"), hash_key("s", "rec_no").alias("h"))
    return nos(balance.equalize(t, "axis", "pos", "h", ["rec_no"]))


@query("keep_share", f"select rec_no from train where {_U.format(h='md5(' + chr(39) + 'keep|' + chr(39) + ' || id)')} < 0.25")
def keep_share(spark, folder):
    return nos(table(spark, folder, "train").where(unit(hash_key("keep", "id")) < 0.25))


@query("wording_counts", "select regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(instructions), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '[ ?]+$', ''), '^ +', ''), '\"[^\"]*\"', '_', 'g'), '[0-9]+(\\.[0-9]+)?', '#', 'g') as wording, count(*) as n from train group by all")
def wording_counts(spark, folder):
    return table(spark, folder, "train").groupBy(X.template(X.norm(F.col("instructions"))).alias("wording")).agg(F.count("*").alias("n"))
