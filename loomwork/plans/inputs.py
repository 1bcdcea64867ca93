"""Inputs of the registered queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.sources.tables import edges, table


def documents(spark, d):
    return table(spark, d, "documents")


def part_graph(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return nodes, edges(table(spark, d, "lineitem"))


def repeated(spark, d):
    """As part_graph(), with the pairs that at least two orders have."""
    return part_graph(spark, d)[0], edges(table(spark, d, "lineitem"), 2)


def roots(links):
    """Nodes that nothing leads to."""
    return links.select(F.col("src").alias("node")).distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti")


def first_order(spark, d):
    """Parts of the order with the smallest key, where walks over all edges begin: with all edges no part is without a predecessor."""
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node"))
    least = items.agg(F.min("l_orderkey").alias("l_orderkey"))
    return items.join(least, "l_orderkey", "left_semi").select("node").distinct()


def findings(spark, d):
    """Events as findings: the type is the category, the value decides the severity, the user is the file."""
    v = F.col("value")
    severity = F.when(v >= 90, "critical").when(v >= 60, "high").when(v >= 30, "medium").when(v >= 10, "low").otherwise("info")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("user_id").alias("file"), severity.alias("severity")
    )


LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"
EDGES = "edges as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) where dst is not null)"
#: Pairs that at least two orders have: a thin graph for the walks.
REPEATED = "edges as (select src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) where dst is not null group by src, dst having count(*) >= 2)"
FIRST = "first as (select distinct l_partkey as node from lineitem where l_orderkey = (select min(l_orderkey) from lineitem))"
DEGREES = EDGES + """, degrees as (select p_partkey as node, coalesce(o, 0) as outgoing, coalesce(i, 0) as incoming from part
  left join (select src, count(*) as o from edges group by src) on src = p_partkey left join (select dst, count(*) as i from edges group by dst) on dst = p_partkey)"""
FINDINGS = """findings as (select event_id as id, event_type as category, user_id as file,
  case when value >= 90 then 'critical' when value >= 60 then 'high' when value >= 30 then 'medium' when value >= 10 then 'low' else 'info' end as severity from events),
ranked as (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end as r from findings)"""
