"""Graph queries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import graphs as G
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query

#: Suppliers lead to parts modulo 100, which share their numbers; every edge but self-loops.
EDGES = f"{cte('edges')}, e as (select distinct src, dst from edges where src <> dst)"


def edges(spark, d):
    return view(spark, d, "edges").where("src <> dst").select("src", "dst").distinct()


@query("g02_graph_integrity", f"with {cte('edges')} select 'open_target' as code, count(*) as n from (select distinct src, dst from edges) where dst not in (select s_suppkey from supplier) union all select 'self_loop', count(*) from edges where src = dst union all select 'duplicate', (select count(*) from edges) - (select count(*) from (select distinct src, dst from edges))")
def g02(spark, d):
    """The raw edges, before self-loops and duplicates are taken out."""
    raw, s = view(spark, d, "edges").select("src", "dst"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"))
    e = raw.groupBy("src", "dst").agg(F.count("*").alias("m"))
    row = lambda code, df, n: df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(code).alias("code"), "n")
    return row("open_target", e.join(s, "dst", "left_anti"), F.count("*")).unionByName(row("self_loop", e.where("src = dst"), F.sum("m"))).unionByName(row("duplicate", e, F.sum(F.col("m") - 1)))


@query("g03_adjacency", f"with {EDGES} select src, string_agg(cast(dst as varchar), ',' order by dst) as targets from e group by 1")
def g03(spark, d):
    a = edges(spark, d).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t"))
    return a.select("src", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("targets"))


@query("g04_centrality", f"with {EDGES}, n as (select dst, count(distinct src) as n from e group by 1) select dst as node, n, cast(n as double) / (select max(n) from n) as centrality from n")
def g04(spark, d):
    n = edges(spark, d).groupBy("dst").agg(F.countDistinct("src").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("m")))).select(F.col("dst").alias("node"), "n", (F.col("n") / F.col("m")).alias("centrality"))  # one row


@query("g05_communities")
def g05(spark, d):
    return G.communities(view(spark, d, "edges").withColumn("repo", F.col("flag")), "repo")


@query("g06_group_roles", f"with {cte('files')} select unit, case when bool_or(path like '%.tf') then 'infrastructure' when bool_or(path like '%.py') then 'service' else 'general' end as role from files group by 1")
def g06(spark, d):
    has = lambda e: F.bool_or(F.col("path").endswith(e))
    return view(spark, d, "files").groupBy("unit").agg(F.when(has(".tf"), "infrastructure").when(has(".py"), "service").otherwise("general").alias("role"))


@query("g07_bounded_paths")
def g07(spark, d):
    """Breadth first over all edges from all starts; of up to 8 nodes before the sink."""
    e = edges(spark, d)
    sinks = e.select(F.col("dst").alias("node")).distinct().where("node % 7 = 3")
    p = G.first_paths(e, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), sinks)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g11_reverse_closure", f"with recursive {EDGES}, t as (select cast(p_partkey as bigint) as node from part where p_partkey in (5, 6) union select src from t join e on dst = node) select node from t")
def g11(spark, d):
    s = table(spark, d, "part").where("p_partkey in (5, 6)").select(F.col("p_partkey").alias("node"))
    return G.reach(edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), s).select("node")


@query("g12_fold_chains", "with recursive l as (select c_custkey as node, c_custkey - c_custkey % 16 + (c_custkey % 16) // 2 as next from customer where c_custkey % 16 > 0), t as (select node, next, 1 as k from l union all select t.node, l.next, k + 1 from t join l on l.node = t.next where k < 20) select node, arg_max(next, k) as representative from t group by 1")
def g12(spark, d):
    links = table(spark, d, "customer").where("c_custkey % 16 > 0").selectExpr("c_custkey as node", "c_custkey - c_custkey % 16 + (c_custkey % 16) div 2 as next")
    return G.follow(links).select("node", F.col("end").alias("representative"))


@query("g13_levels", "with recursive n as (select cast(n_nationkey as bigint) as node from nation), e as (select a.node as src, b.node as dst from n a join n b on b.node = a.node * 2 + 1 or b.node = a.node * 2 + 2), t as (select node, 0 as level from n where node = 0 union all select dst, level + 1 from t join e on src = node) select node, max(level) as level from t group by 1")
def g13(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    e = n.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("dst")).join(n.select(F.col("node").alias("dst")), "dst", "left_semi")
    return G.peel(n, e)


@query("g18_context_map", f"with {EDGES}, o as (select src as node, count(*) as imports from e group by 1), i as (select dst as node, count(*) as imported_by from e group by 1) select coalesce(o.node, i.node) as node, coalesce(imports, 0) as imports, coalesce(imported_by, 0) as imported_by from o full join i on o.node = i.node")
def g18(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("o").cast("long").alias("imports"), F.sum("i").cast("long").alias("imported_by"))
