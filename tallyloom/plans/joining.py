"""Join queries (J), pages and ranks (T), knowledge lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import joins as J
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query


@query("j01_ownership", "select p_partkey as id, count(ps) as owners from part left join (select distinct l_partkey as ps, l_suppkey from lineitem where l_suppkey % 10 = 0) l on ps = p_partkey group by 1 having count(ps) <> 1")
def j01(spark, d):
    owners = table(spark, d, "lineitem").where("l_suppkey % 10 = 0").select(F.col("l_partkey").alias("id"), "l_suppkey").distinct()
    return J.owned_once(table(spark, d, "part").select(F.col("p_partkey").alias("id")), owners, "id")


@query("j02_merge_classification", f"with {cte('candidates', 'classifications')} select coalesce(c.candidate_id, k.candidate_id) as candidate_id, coalesce(nullif(k.status, ''), nullif(c.status, '')) as status, coalesce(nullif(k.severity, ''), nullif(c.severity, '')) as severity, coalesce(nullif(k.evidence, ''), nullif(c.evidence, '')) as evidence from candidates c full join classifications k on c.candidate_id = k.candidate_id")
def j02(spark, d):
    return J.merge_ledgers(view(spark, d, "candidates"), view(spark, d, "classifications"), "candidate_id", ["status", "severity", "evidence"])


@query("j03_scenario_coverage", f"with {cte('candidates')}, need as (select * from candidates where needs_test), s as (select distinct 't' || cast(l_partkey % 40 as varchar) as ref from lineitem union select distinct 'r' || cast(l_suppkey % 20 as varchar) from lineitem), c as (select n.candidate_id, exists(select 1 from s where s.ref = n.target) or exists(select 1 from s where s.ref = n.route) as routed from need n) select count(*) as total, count(*) filter (routed) as routed, case when count(*) = 0 then 1e0 else cast(count(*) filter (routed) as double) / count(*) end as coverage from c")
def j03(spark, d):
    need = view(spark, d, "candidates").where("needs_test").select("candidate_id", F.explode(F.array("target", "route")).alias("ref"))
    li = table(spark, d, "lineitem")
    refs = li.select(F.concat(F.lit("t"), (F.col("l_partkey") % 40).cast("string")).alias("ref")).union(li.select(F.concat(F.lit("r"), (F.col("l_suppkey") % 20).cast("string")))).distinct().withColumn("hit", F.lit(1))
    c = need.join(refs, "ref", "left").groupBy("candidate_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return c.agg(F.count("*").alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("routed")).withColumn("coverage", F.when(F.col("total") == 0, 1.0).otherwise(F.col("routed") / F.col("total")))


@query("j04_completeness", "select c_custkey from customer where c_nationkey <> 3 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def j04(spark, d):
    return table(spark, d, "customer").where("c_nationkey <> 3").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_DIRS = f"{cte('files')}, u as (select distinct regexp_extract(path, '^([^/]+/[^/]+)/', 1) as unit from files), a as (select distinct regexp_extract(path, '^([^/]+)/', 1) as audit from files where file_id % 3 = 0 union select distinct path from files where file_id % 97 = 0)"


@query("j05_prefix_cover", f"with {_DIRS} select unit, audit from u join a on unit = audit or starts_with(unit, audit || '/') or starts_with(audit, unit || '/')")
def j05(spark, d):
    f = view(spark, d, "files")
    units = f.select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("unit"))
    audits = f.where("file_id % 3 = 0").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("audit")).union(f.where("file_id % 97 = 0").select("path"))
    return J.prefix_covers(units, audits)


@query("j06_suffix_anti", f"with {cte('files')}, s as (select regexp_extract(path, '([^/]+)$', 1) as name from files where file_id % 2 = 0) select path from files where not exists (select 1 from s where path = name or ends_with(path, '/' || name))")
def j06(spark, d):
    f = view(spark, d, "files").withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return f.join(f.where("file_id % 2 = 0").select("name"), "name", "left_anti").select("path")


@query("j07_longest_prefix", f"with {cte('files')}, r as (select distinct regexp_extract(path, '^([^/]+/[^/]+)/', 1) as root from files where file_id % 5 = 0 union select distinct regexp_extract(path, '^([^/]+)/', 1) from files where file_id % 400 = 0) select path, coalesce((select arg_max(root, length(root)) from r where starts_with(path, root || '/')), '.') as root from files")
def j07(spark, d):
    f = view(spark, d, "files")
    roots = f.where("file_id % 5 = 0").select(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1).alias("root")).union(f.where("file_id % 400 = 0").select(F.regexp_extract("path", "^([^/]+)/", 1)))
    return J.longest_prefix(f, roots)


@query("j12_call_target", f"with {cte('files')}, n as (select unit, file_id, p_name as name from files join part on p_partkey = file_id) select a.file_id, coalesce(min(case when b.unit = a.unit and b.file_id <> a.file_id then b.file_id end), min(case when b.unit <> a.unit then b.file_id end)) as target from n a left join n b on a.name = b.name group by 1")
def j12(spark, d):
    n = view(spark, d, "files").join(table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name")), "file_id").select("unit", "file_id", "name")
    # The two least ids of a name and unit, and the least of the two best units of a name, are enough: no pairs.
    two = n.groupBy("name", "unit").agg(F.slice(F.array_sort(F.collect_list("file_id")), 1, 2).alias("ids"))
    units = two.select("name", F.struct(F.col("ids")[0].alias("id"), "unit").alias("u")).groupBy("name").agg(F.slice(F.array_sort(F.collect_list("u")), 1, 2).alias("best"))
    j = n.join(two, ["name", "unit"]).join(units, "name")
    same = F.get(F.filter("ids", lambda i: i != F.col("file_id")), F.lit(0))
    other = F.get(F.filter("best", lambda u: u["unit"] != F.col("unit")), F.lit(0))["id"]
    return j.select("file_id", F.coalesce(same, other).alias("target"))


@query("j13_range_join", "with r as (select l_orderkey as k, l_linenumber * 10 as a, l_linenumber * 10 + cast(l_quantity as bigint) as b from lineitem where l_returnflag = 'A'), p as (select l_orderkey as k, l_linenumber * 7 as pos, l_partkey as part from lineitem where l_returnflag = 'R') select k, pos, part, a, b from p join r using (k) where pos between a and b")
def j13(spark, d):
    li = table(spark, d, "lineitem")
    r = li.where("l_returnflag = 'A'").selectExpr("l_orderkey as k", "l_linenumber * 10 as a", "l_linenumber * 10 + cast(l_quantity as bigint) as b")
    p = li.where("l_returnflag = 'R'").selectExpr("l_orderkey as k", "l_linenumber * 7 as pos", "l_partkey as part")
    return J.in_ranges(p, r, "k", "pos", "a", "b").select("k", "pos", "part", "a", "b")


@query("j14_unique_suffix", "with n as (select distinct 'n' || cast(p_size as varchar) as name from part), f as (select distinct p_type || '.' || replace(p_brand, '#', '') || '.n' || cast(p_size as varchar) as id from part where p_partkey % 50 = 0) select name, case when count(id) = 1 then min(id) end as id from n left join f on id = name or ends_with(id, '.' || name) group by 1")
def j14(spark, d):
    p = table(spark, d, "part")
    full = p.where("p_partkey % 50 = 0").select(F.concat("p_type", F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".n"), F.col("p_size").cast("string")).alias("id")).distinct()
    return J.unique_suffix(p.select(F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name")), full)


_ASOF = f"{cte('revisions')}, best as (select * from revisions where revision <= 12000 qualify row_number() over (partition by cve_id order by modified desc, revision desc) = 1)"


@query("j15_as_of_lookup", f"with {_ASOF} select cve_id, revision, state, title from best where contains(lower(title), 'high')")
def j15(spark, d):
    best = J.as_of(view(spark, d, "revisions"), "cve_id", 12000, ["modified", "revision"])
    return best.where(F.lower("title").contains("high")).select("cve_id", "revision", "state", "title")


@query("j16_exact_version", f"with {cte('revisions')} select cve_id, revision, title from revisions where revision = 777 and revision <= 12000 and sha256(title) = sha256('1-URGENT') union all select cve_id, revision, title from revisions where revision between 100 and 120 and sha256(title) = sha256('2-HIGH')")
def j16(spark, d):
    r = view(spark, d, "revisions")
    is_ = lambda t: F.sha2("title", 256) == F.sha2(F.lit(t), 256)
    return r.where((F.col("revision") == 777) & is_("1-URGENT")).union(r.where(F.col("revision").between(100, 120) & is_("2-HIGH"))).select("cve_id", "revision", "title")


@query("j17_contributors", "select c_custkey, c_name, (select string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) from orders where o_custkey = c_custkey) as contributors from customer")
def j17(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("contributors"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(c, "c_custkey", "left")


@query("j18_paired_differences", f"with {cte('observations')}, v as (select case_id, repetition, avg(value) filter (arm = 'A') - avg(value) filter (arm = 'N') as diff from observations group by 1, 2) select case_id, count(diff) as pairs, round(avg(diff), 8) as difference from v where diff is not null group by 1 having count(diff) >= 3")
def j18(spark, d):
    return J.paired(view(spark, d, "observations"), "A", "N", 3).select("case_id", "pairs", F.round("difference", 8).alias("difference"))


@query("j20_prediction_judgment", f"with {cte('predictions')} select p.prediction_id, p.decided = 1 as accepted, q.prediction_id is not null and q.decided = 1 as duplicate_of_accepted from predictions p left join predictions q on q.prediction_id = p.prediction_id - 1")
def j20(spark, d):
    p = view(spark, d, "predictions")
    q = p.where("decided = 1").select((F.col("prediction_id") + 1).alias("prediction_id"), F.lit(True).alias("ok"))
    return p.join(q, "prediction_id", "left").select("prediction_id", (F.col("decided") == 1).alias("accepted"), F.coalesce("ok", F.lit(False)).alias("duplicate_of_accepted"))


@query("j23_positional_arguments", "with a as (select c_custkey, unnest(string_split(c_name, '0')) as arg, generate_subscripts(string_split(c_name, '0'), 1) - 1 as pos from customer), p as (select c_custkey, unnest([c_mktsegment, cast(c_nationkey as varchar)]) as param, unnest([0, 1]) as pos from customer) select c_custkey, cast(pos as int) as pos, arg, param from a join p using (c_custkey, pos)")
def j23(spark, d):
    c = table(spark, d, "customer")
    a = c.select("c_custkey", F.posexplode(F.split("c_name", "0")).alias("pos", "arg"))
    p = c.select("c_custkey", F.posexplode(F.array("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("pos", "param"))
    return a.join(p, ["c_custkey", "pos"])


@query("j24_three_way_reconcile", "with a as (select o_custkey as k, count(*) as reserved from orders where o_orderstatus = 'P' group by 1), b as (select o_custkey as k, count(*) as done from orders where o_orderstatus = 'F' group by 1), c as (select c_custkey as k, c_nationkey as lim from customer where c_nationkey > 2) select coalesce(a.k, b.k, c.k) as k, coalesce(reserved, 0) as reserved, coalesce(done, 0) as done, lim, coalesce(reserved, 0) + coalesce(done, 0) > coalesce(lim, 0) as over from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k")
def j24(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    n = lambda s, name: o.where(F.col("o_orderstatus") == s).groupBy("k").agg(F.count("*").alias(name))
    c = table(spark, d, "customer").where("c_nationkey > 2").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("lim"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    j = n("P", "reserved").join(n("F", "done"), "k", "full").join(c, "k", "full")
    return j.select("k", zero(F.col("reserved")).alias("reserved"), zero(F.col("done")).alias("done"), "lim", (zero(F.col("reserved")) + zero(F.col("done")) > F.coalesce("lim", F.lit(0))).alias("over"))


@query("j25_plan_result_codes", "with p as (select c_custkey as k from customer where c_custkey % 3 <> 0), r as (select o_custkey as k, count(*) as n from orders where o_custkey % 4 <> 0 group by 1) select coalesce(p.k, r.k) as k, case when r.k is null then 'missing' when p.k is null then 'unknown' when n > 1 then 'duplicate' else 'ok' end as code from p full join r on p.k = r.k")
def j25(spark, d):
    p = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("planned"))
    r = table(spark, d, "orders").where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return p.join(r, "k", "full").select("k", F.when(F.col("n").isNull(), "missing").when(F.col("planned").isNull(), "unknown").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("code"))


@query("j26_answers", "select u.conv_id, u.turn, case when a.text is null then 'unanswered' when length(a.text) < 40 then 'unverified' else 'answered' end as status from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'")
def j26(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("n"))
    return c.where("role = 'user'").select("conv_id", "turn").join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("n").isNull(), "unanswered").when(F.col("n") < 40, "unverified").otherwise("answered").alias("status"))


@query("j27_possible_duplicates", f"with {cte('candidates')} select a.candidate_id as a, b.candidate_id as b from candidates a join candidates b on a.remediation_key = b.remediation_key and a.target = b.target and a.ord < b.ord and a.remediation_key <> ''")
def j27(spark, d):
    c = view(spark, d, "candidates").where("remediation_key <> '' and target is not null").select("remediation_key", "target", "ord", "candidate_id")
    o = c.select("remediation_key", "target", F.col("ord").alias("ord2"), F.col("candidate_id").alias("b"))
    return c.join(o, ["remediation_key", "target"]).where("ord < ord2").select(F.col("candidate_id").alias("a"), "b")


@query("j28_unassigned_flows", f"with {cte('edges')}, p as (select distinct src % 10 as a, dst % 10 as b from edges), r as (select distinct s_nationkey % 10 as a, s_suppkey % 10 as b from supplier) select a, b from p where not exists (select 1 from r where r.a = p.a and r.b = p.b)")
def j28(spark, d):
    p = view(spark, d, "edges").select((F.col("src") % 10).alias("a"), (F.col("dst") % 10).alias("b")).distinct()
    r = table(spark, d, "supplier").select((F.col("s_nationkey") % 10).alias("a"), (F.col("s_suppkey") % 10).alias("b"))
    return p.join(r, ["a", "b"], "left_anti")


@query("j29_first_provenance", f"with {cte('candidates', 'classifications')} select c.candidate_id, coalesce(nullif(trim(k.status), ''), nullif(trim(c.status), ''), 'none') as status from candidates c left join classifications k on k.candidate_id = c.candidate_id")
def j29(spark, d):
    k = view(spark, d, "classifications").select("candidate_id", F.col("status").alias("k"))
    t = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return view(spark, d, "candidates").select("candidate_id", "status").join(k, "candidate_id", "left").select("candidate_id", F.coalesce(t("k"), t("status"), F.lit("none")).alias("status"))


@query("j30_parent_chain", "select c.conv_id, c.turn, p.turn is not null as has_parent, coalesce(p.role <> c.role, false) as differs from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1")
def j30(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("before").isNotNull().alias("has_parent"), F.coalesce(F.col("before") != F.col("role"), F.lit(False)).alias("differs"))


@query("t01_page", "with m as (select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT') select o_orderkey, o_totalprice, (select count(*) from m) as total, case when (select count(*) from m) > 15 then 15 end as next_offset from m order by o_totalprice desc, o_orderkey limit 5 offset 10")
def t01(spark, d):
    m = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    return J.page(m, [F.col("o_totalprice").desc(), "o_orderkey"], 10, 5)


@query("t02_top_paths", "select event_id, value from (select distinct event_id, value from events) order by value desc, event_id limit 50")
def t02(spark, d):
    return table(spark, d, "events").select("event_id", "value").distinct().orderBy(F.col("value").desc(), "event_id").limit(50)


@query("t03_top_per_unit", f"with {cte('files')} select unit, path, bytes from files qualify row_number() over (partition by unit order by bytes desc, path) <= 5")
def t03(spark, d):
    return J.top_k(view(spark, d, "files"), "unit", [F.col("bytes").desc(), "path"], 5).select("unit", "path", "bytes")


@query("t04_context_rank", f"with {cte('edges', 'files')}, r as (select src, dst, count(*) as refs from edges group by 1, 2) select src, dst, refs, row_number() over (partition by src order by refs desc, bytes, path) as rank from r join files on file_id = dst")
def t04(spark, d):
    r = view(spark, d, "edges").groupBy("src", "dst").agg(F.count("*").alias("refs")).join(view(spark, d, "files").select(F.col("file_id").alias("dst"), "bytes", "path"), "dst")
    from pyspark.sql import Window as W

    return r.select("src", "dst", "refs", F.row_number().over(W.partitionBy("src").orderBy(F.col("refs").desc(), "bytes", "path")).alias("rank"))


@query("t05_findings_cap", "with f as (select event_type, user_id, event_id from events where value > 40) select event_type, user_id, event_id, (select count(*) from f) > 100 as truncated from f order by event_type, user_id, event_id limit 100")
def t05(spark, d):
    f = table(spark, d, "events").where("value > 40").select("event_type", "user_id", "event_id")
    return f.orderBy("event_type", "user_id", "event_id").limit(100).crossJoin(F.broadcast(f.agg((F.count("*") > 100).alias("truncated"))))  # one row


@query("t06_followup_selection", "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders) select o_custkey, o_orderkey, greatest(n - 3, 0) as omitted from r where rn <= 3")
def t06(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.greatest(F.count("*") - 3, F.lit(0)).cast("long").alias("omitted"))
    return J.top_k(o, "o_custkey", ["o_orderpriority", "o_orderkey"], 3).select("o_custkey", "o_orderkey").join(n, "o_custkey")


@query("t07_codepoint_order", "select p_partkey, row_number() over (order by p_name, p_partkey) as place from part")
def t07(spark, d):
    return J.places(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "place")


@query("t09_cap_flags", f"with {cte('files')} select unit, count(*) as n, count(*) >= 80 as truncated from files group by 1")
def t09(spark, d):
    return view(spark, d, "files").groupBy("unit").agg(F.count("*").alias("n"), (F.count("*") >= 80).alias("truncated"))
