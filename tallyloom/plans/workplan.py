"""Queries of work plans (G14, G15): parts as files of their brands, lineitems as edges between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import workplan as P
from tallyloom.plans.bindings import table
from tallyloom.plans.registry import query

POLICY = P.Policy(max_context_files=12, max_context_tokens=60_000, max_owned_files=20, max_owned_tokens=90_000)

_FILES = {"unit": "p_brand", "path": "'f' || lpad(cast(p_partkey as string), 8, '0')", "bytes": "cast(p_size as bigint) * 997 + p_partkey", "sha256": "'s' || cast(p_partkey as string)", "tokens": "cast(ceil((cast(p_size as bigint) * 997 + p_partkey) / 4.0) as bigint)"}
_EDGES = {
    "src": "'f' || lpad(cast(l_partkey as string), 8, '0')", "ord": "l_orderkey * 10 + l_linenumber", "specifier": "'./' || cast(l_orderkey as string)",
    "kind": "case l_returnflag when 'N' then 'local-resolved' when 'A' then 'local-unresolved' else 'external' end", "target": "'f' || lpad(cast(l_suppkey as string), 8, '0')",
}


def files(spark, d):
    return table(spark, d, "part").selectExpr(*(f"{e} as {c}" for c, e in _FILES.items()))


def edges(spark, d):
    return table(spark, d, "lineitem").selectExpr(*(f"{e} as {c}" for c, e in _EDGES.items())).withColumn("targets", F.array("target")).drop("target")


_FITS = f"w.n < {POLICY.max_context_files} and c.tokens <= {POLICY.max_context_tokens} - w.z"
_NEW = f"w.n >= {POLICY.max_owned_files} or w.z + o.tokens > {POLICY.max_owned_tokens}"


@query("g14_unit_plan", f"""with recursive f as (select {", ".join(f"{e} as {c}" for c, e in _FILES.items())} from part), e as (select {", ".join(f"{e} as {c}" for c, e in _EDGES.items())} from lineitem),
    o as (select *, row_number() over (partition by unit order by path) as rn from f),
    k as (select unit, path, tokens, rn, 1 as n, tokens as z, 0 as chunk from o where rn = 1 union all
        select o.unit, o.path, o.tokens, o.rn, case when {_NEW} then 1 else w.n + 1 end, case when {_NEW} then o.tokens else w.z + o.tokens end, case when {_NEW} then w.chunk + 1 else w.chunk end from k w join o on o.unit = w.unit and o.rn = w.rn + 1),
    t as (select unit, chunk, target, count(*) as refs from k join e on e.src = k.path where kind = 'local-resolved' and not exists (select 1 from k y where y.unit = k.unit and y.chunk = k.chunk and y.path = e.target) group by 1, 2, 3),
    c as (select t.*, coalesce(f.tokens, 0) as tokens, row_number() over (partition by t.unit, chunk order by refs desc, coalesce(f.tokens, 0), target) as rn from t left join f on f.path = target),
    s as (select unit, chunk, rn, tokens <= {POLICY.max_context_tokens} as taken, case when tokens <= {POLICY.max_context_tokens} then 1 else 0 end as n, case when tokens <= {POLICY.max_context_tokens} then tokens else 0 end as z from c where rn = 1 union all
        select c.unit, c.chunk, c.rn, {_FITS}, case when {_FITS} then w.n + 1 else w.n end, case when {_FITS} then w.z + c.tokens else w.z end from s w join c on c.unit = w.unit and c.chunk = w.chunk and c.rn = w.rn + 1),
    b as (select unit, chunk, count(*) as candidates, count(*) filter (taken) as selected, count(*) filter (not taken) as omitted, max(z) as selected_tokens from s group by 1, 2),
    u as (select unit, chunk, count(*) as open from k join e on e.src = k.path where kind = 'local-unresolved' group by 1, 2),
    g as (select unit, chunk, min(path) as first_path, count(*) as files, count(*) filter (tokens > {POLICY.max_owned_tokens}) as oversized, cast(sum(tokens) as bigint) as owned_tokens from k group by 1, 2)
    select g.unit as source_unit, first_path, files, oversized, owned_tokens, coalesce(candidates, 0) as candidates, coalesce(selected, 0) as selected, coalesce(selected_tokens, 0) as selected_tokens,
        owned_tokens + coalesce(selected_tokens, 0) as estimated_tokens, coalesce(omitted, 0) as omitted, coalesce(open, 0) + coalesce(omitted, 0) as unresolved from g left join b using (unit, chunk) left join u using (unit, chunk)""")
def g14_unit_plan(spark, d):
    plan = P.work_plan(files(spark, d), edges(spark, d), POLICY)
    count = lambda t, n: t.groupBy("unit_key").agg(F.count("*").alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    first = plan.owned.groupBy("unit_key").agg(F.min("path").alias("first_path"))
    units = plan.units.join(first, "unit_key").join(count(plan.omitted, "omitted"), "unit_key", "left").join(count(plan.unresolved, "unresolved"), "unit_key", "left")
    return units.select("source_unit", "first_path", "files", "oversized", "owned_tokens", "candidates", "selected", "selected_tokens", "estimated_tokens", zero("omitted"), zero("unresolved"))


@query("g15_plan_violations")
def g15_violations(spark, d):
    """What the check finds in a stored plan whose tables were changed since: a byte more in some owned files, a token more in some units, other omissions."""
    plan = P.work_plan(files(spark, d), edges(spark, d), POLICY)
    damaged = plan._replace(
        owned=plan.owned.withColumn("bytes", F.col("bytes") + F.when(F.col("bytes") % 41 == 0, 1).otherwise(0)), units=plan.units.withColumn("owned_tokens", F.col("owned_tokens") + F.when(F.col("owned_tokens") % 7 == 0, 1).otherwise(0)),
        omitted=plan.omitted.withColumn("reason", F.when(F.col("refs") % 5 == 0, "file-cap").otherwise(F.col("reason"))),
    )
    return P.violations(damaged, files(spark, d), edges(spark, d))
