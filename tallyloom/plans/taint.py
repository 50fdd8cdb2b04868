"""Queries of taint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import taint as T
from tallyloom.plans.bindings import table
from tallyloom.plans.registry import query

#: Lines of orders as assignments: the first reads input or the parameter, others the variable before or, if returned, the one behind; an order calls the next one's function.
_READS = "case when l_linenumber = 1 and l_returnflag = 'A' then 'req.body.x' when l_linenumber = 1 then 'p' when l_returnflag = 'R' then 'v' || cast(l_linenumber + 1 as string) else 'v' || cast(l_linenumber - 1 as string) end"
_G09 = f"""with recursive a as (select distinct l_orderkey as file, l_linenumber as ord, 'v' || cast(l_linenumber as string) as name, {_READS} as ref from lineitem),
c as (select l_orderkey as file, 'v' || cast(max(l_linenumber) as string) as ref from lineitem where l_orderkey % 12 > 0 group by 1),
arrows as (select file, ref, file as to_file, name as to_name, case when ref = 'p' or cast(substr(ref, 2) as int) > ord then 1 else 0 end as cost from a where ref <> 'req.body.x'
  union all select file, ref, file + 1, 'p', 0 from c where file + 1 in (select o_orderkey from orders)),
t as (select file, name, 1 as round from a where ref = 'req.body.x' union select to_file, to_name, round + cost from t join arrows on t.file = arrows.file and t.name = ref where round + cost <= 8)
select file, name, min(round) as round from t group by 1, 2"""


@query("g09_taint_fixpoint", _G09)
def g09(spark, d):
    rows, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = rows.selectExpr("l_orderkey as file", "l_linenumber as ord", "coalesce(l_returnflag = if(l_linenumber = 1, 'A', 'R'), false) as other").distinct()  # numbers alone, no texts
    a = a.selectExpr("file", "ord", "'v' || cast(ord as string) as name", "case when ord = 1 then if(other, 'req.body.x', 'p') else 'v' || cast(ord + if(other, 1, -1) as string) end as expr")
    calls = rows.where("l_orderkey % 12 > 0").groupBy(F.col("l_orderkey").alias("file")).agg(F.max("l_linenumber").alias("n"))
    calls = calls.selectExpr("file", "0 as ord", "'lib.g' || cast(file + 1 as string) as callee", "array('1', 'wrap(v' || cast(n as string) || ')') as args")
    return T.tainted(a, calls, o.selectExpr("'g' || cast(o_orderkey as string) as name", "o_orderkey as file", "array('q', 'p') as params"))


#: Made names of calls, one for each remainder of a part's key.
_CALLEES = ("lib.sanitizeInput", "unescape", "cleanup", "a.b.clean", "VALIDATE", "validateNothing", "escape_html", "x.numberOfItems", "parseInt2", "dompurify", "encodeuri", "prepare-all", "Prepared", "")
_ROUTES = ("app.get", "config.get", "authRouter.use", "myApp.all", "app.listen", "this.post", "svc.api.Delete", "mux.HandleFunc", "get", "wrap.get", "a.fs.put", "x.Get", "happ.Get", "app.get.x")


def _pick(names: tuple[str, ...], key: str = "p_partkey") -> str:
    return f"case {key} % {len(names)} {' '.join(f'''when {i} then '{n}' ''' for i, n in enumerate(names))} end"


_LAST = f"regexp_replace({_pick(_CALLEES)}, '^.*[.]', '')"
_BEGINS = "|".join(s for s in T.SANITIZERS if s.lower() not in T.WHOLE_ONLY)


@query("x20_sanitizers", f"select p_partkey, lower({_LAST}) in ({', '.join(f"'{s.lower()}'" for s in T.SANITIZERS)}) or regexp_matches({_LAST}, '^(?i:{_BEGINS})[_A-Z0-9-]') as hit from part")
def x20(spark, d):
    return table(spark, d, "part").select("p_partkey", T.is_sanitizer(F.expr(_pick(_CALLEES))).alias("hit"))


_X24 = f"""with c as (select p_partkey, {_pick(_ROUTES)} as callee from part), m as (select *, lower(regexp_extract(callee, '([^.]+)[.][^.]+$', 1)) as receiver, regexp_extract(callee, '[.]([^.]+)$', 1) as method from c)
select p_partkey, callee, method in ({', '.join(f"'{x}'" for x in T.ROUTE_METHODS.split('|'))}) and case when lower(method) in {T.LOOKUPS} then receiver in {T.ROUTERS} or regexp_matches(receiver, '(router|routes|.app)$') else receiver not in {T.NO_ROUTERS} end as is_route from m"""


@query("x24_route_registration", _X24)
def x24(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_pick(_ROUTES)} as callee").withColumn("is_route", T.is_route(F.col("callee")))


_CATEGORY = "case l_suppkey % 3 when 0 then 'sql' when 1 then 'file' else 'ssrf' end"
_X21 = f"""with s as (select l_orderkey, l_linenumber, ((0.85e0 - 0.08e0 * least(l_linenumber, 5) - 0.25e0 * least(cast(l_quantity as bigint) % 5, 3) + case when l_returnflag = 'A' then 0.1e0 else 0e0 end
  + case when {_CATEGORY} = 'file' then 0e0 else 0.1e0 end) * case when l_partkey % 2 = 0 then 1e0 else 0.45e0 end) as p from lineitem)
select l_orderkey, l_linenumber, greatest(0e0, least(1e0, case p when 0.045e0 then 0.04e0 when 0.135e0 then 0.14e0 when 0.315e0 then 0.32e0 else floor(p * 100 + 0.5e0) / 100 end)) as confidence from s"""


@query("x21_confidence", _X21)
def x21(spark, d):
    score = T.confidence(F.col("l_linenumber"), F.expr("cast(l_quantity as bigint) % 5"), F.col("l_returnflag") == "A", F.expr(_CATEGORY), F.col("l_partkey") % 2 == 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("confidence"))


#: Made callees of the last calls of flows, and the kinds that they are by the rule.
_ENDS = ("db.query", "JSON.parse", "url.parse", "EXEC", "x.eval", "http.get", "map.get", "a.$queryRaw", "myquery", "res.send", "cursor.findOne", "fs.rename", "location.assign")
_KINDS = ("sql", "deserialize", "", "command", "eval", "ssrf", "", "sql", "", "response", "nosql", "file", "redirect")
#: A line of an order is a flow from its supplier's file into another; orders are the calls that may clean, parts the variables that input reaches.
_LINES = "select l_orderkey as o, l_linenumber as n, min(l_suppkey) as s, min(l_partkey) as p, cast(min(l_quantity) as bigint) as q from lineitem group by 1, 2"
_FLOW = {
    "ord": "cast(o * 10 + n as bigint)",
    "entry_type": "case when p % 6 = 0 then 'sdk_export' else 'http' end",
    "entry_file": "'s' || cast(s as string)",
    "entry_line": "(o * 13 + n * 400) % 40000 + 1",
    "terminal_file": "'s' || cast(p % 97 as string)",
    "terminal_line": "(o * 31 + p) % 40000 + 1",
    "callee": _pick(_ENDS, "(s + n)"),
    "arg": "case q % 4 when 0 then 'req.query.id' when 1 then 'wrap(v' || cast(q as string) || ', 1)' else 'x' end",
    "step": "'s' || cast(s + 1 as string) || ':' || cast(p % 40000 + 1 as string) || ' f -> g'",
    "read": "case when q % 7 = 0 then 'req.body.z' else 'plain' end",
    "hops": "cast(n as int)",
}
_CALL = {"file": "'s' || cast(floor(o_custkey / 15) as int)", "line": "o_orderkey * 7 % 40000 + 1", "callee": _pick(_CALLEES, "o_orderkey")}
_CLEANS = ("lib.sanitizeInput", "a.b.clean", "VALIDATE", "escape_html", "parseInt2", "dompurify", "encodeuri", "prepare-all")
_columns = lambda c: ", ".join(f"{e} as {n}" for n, e in c.items())
_G10 = f"""with l as ({_LINES}), f0 as (select {_columns(_FLOW)}, {_pick(_KINDS, "(s + n)")} as category, p % 40000 + 1 as step_line, 's' || cast(s + 1 as string) as step_file from l),
f as (select * from f0 where category <> '' and entry_type <> 'sdk_export'),
c as (select distinct {_columns(_CALL)} from orders where {_CALL['callee']} in {_CLEANS}),
ends as (select ord, entry_file as file, entry_line as line from f union all select ord, terminal_file, terminal_line from f union all select ord, step_file, step_line from f),
spans as (select ord, file, greatest(min(line) - 50, 1) as lo, max(line) + 50 as hi from ends group by 1, 2),
san as (select ord, count(*) as n, string_agg(file || ':' || line || ' ' || callee, ',' order by file, line, callee) as names from spans join c using (file) where line between lo and hi group by 1),
r as (select distinct 's' || cast(p_partkey % 97 as string) as file, 'v' || cast(p_size as string) as name from part),
a as (select f.*, coalesce(san.n, 0) as n_sanitizers, coalesce(names, '') as sanitizers, case when arg like 'req%' or r.name is not null or read like 'req%' then arg else '' end as tainted
  from f left join san using (ord) left join r on r.file = terminal_file and arg = 'wrap(' || r.name || ', 1)'),
s as (select *, (0.85e0 - 0.08e0 * least(hops, 5) - 0.25e0 * least(n_sanitizers, 3) + case when category in {T.GRAVE} then 0.1e0 else 0e0 end) * case when tainted = '' then 0.45e0 else 1e0 end as p from a),
z as (select *, greatest(0e0, least(1e0, case p when 0.045e0 then 0.04e0 when 0.135e0 then 0.14e0 when 0.315e0 then 0.32e0 else floor(p * 100 + 0.5e0) / 100 end)) as confidence from s)
select ord, category, case category {' '.join(f"when '{k}' then '{w}'" for k, w in T.WEAKNESSES.items())} end as potential_cwe, hops, n_sanitizers, sanitizers, tainted, confidence from z where confidence >= 0.1e0
qualify row_number() over (partition by entry_file, entry_line, terminal_file, terminal_line, callee, step, read order by ord) = 1"""


@query("g10_taint_paths", _G10)
def g10(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    lines = lines.agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"))
    flows = lines.selectExpr(*(f"{e} as {n}" for n, e in _FLOW.items())).selectExpr(
        "ord", "entry_type", "entry_file", "entry_line", "'GET' as entry_method", "'/o' as route", "'' as handler", "terminal_file", "terminal_line", "callee",
        "array(arg) as args", "array(step, read) as via", "hops",
    )
    calls = table(spark, d, "orders").selectExpr(*(f"{e} as {n}" for n, e in _CALL.items()))
    reached = table(spark, d, "part").selectExpr("'s' || cast(p_partkey % 97 as string) as file", "'v' || cast(p_size as string) as name")
    names = F.transform("sanitizers", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"), F.lit(" "), x["function"]))
    return T.taint_paths(flows, calls, reached).select(
        "ord", "category", "potential_cwe", "hops", F.size("sanitizers").cast("long").alias("n_sanitizers"), F.array_join(names, ",").alias("sanitizers"),
        F.array_join("tainted_arguments", ",").alias("tainted"), "confidence",
    )
