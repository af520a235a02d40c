"""Queries over made tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.operators import generate
from gleanwork.plans.registry import Registry, table
from gleanwork.streaming import streams

query = Registry()

_D = "(('0x' || substr(md5('panel {s}|' || id), 1, 8))::bigint % {n})"
_FAM = f"""f as (select id as family, {_D.format(s='split', n=10)} as s, list_extract({generate.QUANTITIES}, ({_D.format(s='quantity', n=6)} + 1)::int) as quantity, (100 + {_D.format(s='value', n=900)})::int as value, (1 + {_D.format(s='step', n=50)})::int as d from range(2000) t(id)),
g as (select family, case s when 0 then 'tune' when 1 then 'confirm' else 'train' end as split, quantity, value, value + d as twin_value from f)"""


@query("panel_families", f"with {_FAM} select * from g")
def panel_families(spark, folder):
    return generate.families(spark, 2000)


@query("panel_questions", f"""with {_FAM}, v as (select family, quantity, value, twin_value, unnest([{{'view': 'scene', 'shown': value}}, {{'view': 'twin', 'shown': twin_value}}]) as x from g)
select family, x.view as "view", 'value' as qid, 'choice' as type, 'What ' || quantity || ' does the panel show?' as instructions, [value::varchar, twin_value::varchar] as options, x.shown::varchar as answer from v
union all select family, x.view, 'above', 'noul', 'Is the ' || quantity || ' above ' || value || '?', ['false', 'true'], (x.shown > value)::varchar from v""")
def panel_questions(spark, folder):
    return generate.questions(generate.families(spark, 2000))


@query("step_means", "select floor(event_id / 100)::bigint as part, event_type, count(*) as steps, round(avg(value), 6) as value from events group by all")
def step_means(spark, folder):
    return streams.step_means(table(spark, folder, "events"), "event_id", 100, ["value"], ["event_type"]).withColumn("value", F.round("value", 6))


@query("stream_once", "select event_type, count(*) as n from (select distinct user_id, event_type, ts from events) group by event_type")
def stream_once(spark, folder):
    s = streams.follow_files(spark, f"{folder}/events.parque*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.drained(streams.once(s, ["user_id", "event_type", "ts"], "ts", "60 days")).groupBy("event_type").agg(F.count("*").alias("n"))
