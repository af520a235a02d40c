"""Problem 1: the flat tables of nested question records."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.operators import nested
from gleanwork.plans.lineage import settle
from gleanwork.plans.registry import Registry, table

query = Registry()


@query("p1_found")
def p1_found(spark, folder):
    return nested.question_options(table(spark, folder, "train"))


def _flat(name):
    return lambda spark, folder: nested.flat_tables(table(spark, folder, "train"), only=name)[name]


for _name in ("records", "questions", "options", "regions", "votes", "spans"):
    query(f"p1_{_name}")(_flat(_name))


@query("p1_inside")
def p1_inside(spark, folder):
    """The innermost question around each option, vote, region and span, joined again from the written node table."""
    nodes = settle(nested.node_table(table(spark, folder, "train")))
    kinds = (nested.OPTION, nested.VOTE, nested.REGION, nested.SPAN)
    found = nested.inside(nodes.withColumn("kind", F.when(F.col("kind").isin(*kinds), "leaf").otherwise(F.col("kind"))), nested.QUESTION, "leaf")
    return found.select("rec_no", F.col("outer_pre").alias("question_pre"), F.col("inner_pre").alias("pre"))
