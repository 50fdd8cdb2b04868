"""Assessment queries: evidence against sources, coverage of reads, plans and their integrity, reviews, reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import graphs as G
from tallyloom.operators import joins as J
from tallyloom.operators import revisions as V
from tallyloom.operators import search as FTS
from tallyloom.operators.graphs import shared_folder
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query
from tallyloom.sources import files as R

EV, CA, FI, ED = cte("run_events"), cte("candidates"), cte("files"), cte("edges")


def n(condition) -> F.Column:
    return F.count(F.when(condition if not isinstance(condition, str) else F.expr(condition), 1))


@query("s03_eligible_scan", f"with {FI} select path, bytes from files where bytes between 1000 and 40000 and not regexp_matches(path, '^standard/')")
def s03(spark, d):
    return view(spark, d, "files").where(F.col("bytes").between(1000, 40000) & ~F.col("path").rlike("^standard/")).select("path", "bytes")


@query("s16_shared_upsert", f"with {CA} select remediation_key, count(*) as rows, count(distinct target) as bodies, count(distinct target) > 1 as conflict, string_agg(distinct route, ',' order by route) as contributors from candidates group by 1")
def s16(spark, d):
    return view(spark, d, "candidates").groupBy("remediation_key").agg(F.count("*").alias("rows"), F.countDistinct("target").alias("bodies"), (F.countDistinct("target") > 1).alias("conflict"), F.when(F.count("route") > 0, F.array_join(F.array_sort(F.collect_set("route")), ",")).alias("contributors"))


@query("s19_archive_manifest", "select conv_id, sha256(string_agg(cast(turn as varchar) || ':' || sha256(coalesce(text, '')), '|' order by lpad(cast(turn as varchar), 9, '0'))) as digest, count(*) as parts from conversations group by 1")
def s19(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("p"))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.concat(p["turn"].cast("string"), F.lit(":"), p["h"])), "|"), 256).alias("digest"), F.count("*").alias("parts"))


@query("s22_markdown_findings", "select p_partkey, p_name as title, 'src/' || lower(p_type) || '.ts' as file, p_size as line, 'CWE-' || cast(p_size as varchar) as cwe from part")
def s22(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit("# Report\n## "), "p_name", F.lit("\nat src/"), F.lower("p_type"), F.lit(".ts:"), F.col("p_size").cast("string"), F.lit("-9 (CWE-"), F.col("p_size").cast("string"), F.lit(")\n")).alias("text"))
    return R.markdown_findings(t, "p_partkey", "text").drop("n")


@query("f04_content_class", "select page_id, case when regexp_matches(url, '/de/') then 'german' when contains(substr(html, 1, 65536), '<script') then 'script' when contains(substr(html, 1, 65536), '<style') then 'style' else 'plain' end as class from pages")
def f04(spark, d):
    head = F.substring("html", 1, 65536)
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").rlike("/de/"), "german").when(head.contains("<script"), "script").when(head.contains("<style"), "style").otherwise("plain").alias("class"))


#: Quotes of the earlier revision are held against the later one: whole cited lines (F12), or a part of the first (F13); every 29th range is reversed.
_EVIDENCE = f"""{cte('revised')}, s as (select doc_id, line_from, case when doc_id % 29 = 0 then line_from - 1 else line_to end as line_to, doc_id % 7 <> 0 as in_scope,
    string_split(replace(before, chr(13) || chr(10), chr(10)), chr(10)) as o, string_split(replace(after, chr(13) || chr(10), chr(10)), chr(10)) as n from revised),
    q as (select *, array_to_string(n[line_from:line_to], chr(10)) as seen, array_to_string(o[line_from:line_to], chr(10)) as quoted from s),
    e as (select *, regexp_replace(seen, '^\\s+|\\s+$', '', 'g') = regexp_replace(quoted, '^\\s+|\\s+$', '', 'g') as is_whole, contains(seen, substr(quoted, 3, 25)) as is_part from q)"""
_STATUS = "select doc_id, case when line_to < line_from then 'reversed' when not in_scope then 'outside' when line_to > len(n) then 'beyond' when coalesce({0}, false) then 'holds' else 'differs' end as status from e"


def evidence(spark, d, part: bool):
    last = F.when(F.col("doc_id") % 29 == 0, F.col("line_from") - 1).otherwise(F.col("line_to"))
    rows = view(spark, d, "revised").withColumn("line_to", last).withColumn("in_scope", F.col("doc_id") % 7 != 0).withColumnRenamed("after", "text")
    quote = V.cited(V.logical_lines(F.col("before")), F.col("line_from"), F.col("line_to"))
    return rows.withColumn("quote", F.substring(quote, 3, 25) if part else quote)


@query("f12_evidence_equality", f"with {_EVIDENCE} {_STATUS.format('is_whole')}")
def f12(spark, d):
    return V.evidence_status(evidence(spark, d, False)).select("doc_id", "status")


@query("f13_evidence_containment", f"with {_EVIDENCE} {_STATUS.format('is_part')}")
def f13(spark, d):
    return V.evidence_status(evidence(spark, d, True), whole=False).select("doc_id", "status")


@query("f16_unit_scope", f"with {ED}, {FI} select unit, e.flag, count(*) as touching from edges e join files on file_id = e.dst group by 1, 2")
def f16(spark, d):
    f = view(spark, d, "files").select("unit", F.col("file_id").alias("dst"))
    return view(spark, d, "edges").join(f, "dst").groupBy("unit", "flag").agg(F.count("*").alias("touching"))


@query("j21_receipts_required", "select o_orderkey as path, count(l_orderkey) as receipts, count(*) filter (l_linestatus = 'F') as current, count(*) filter (l_linestatus = 'F') > 0 as satisfied from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def j21(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("r"), n("l_linestatus = 'F'").alias("c"))  # noqa: E741
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("path")).join(l, "path", "left").select("path", z("r").alias("receipts"), z("c").alias("current"), (z("c") > 0).alias("satisfied"))


@query("j22_sanitizers_in_window", "with s as (select l_orderkey as k, l_linenumber * 10 as line from lineitem where l_returnflag = 'N'), f as (select l_orderkey as k, l_linenumber * 10 as line, l_partkey as flow from lineitem where l_returnflag = 'A') select f.k, f.flow, f.line, count(*) as sanitizers from f join s on s.k = f.k and s.line between f.line - 15 and f.line + 15 group by 1, 2, 3")
def j22(spark, d):
    li = table(spark, d, "lineitem")
    s = li.where("l_returnflag = 'N'").selectExpr("l_orderkey as k", "l_linenumber * 10 as at")
    f = li.where("l_returnflag = 'A'").selectExpr("l_orderkey as k", "l_linenumber * 10 as line", "l_partkey as flow", "l_linenumber * 10 - 15 as a", "l_linenumber * 10 + 15 as b")
    return J.in_ranges(s, f, "k", "at", "a", "b").groupBy("k", "flow", "line").agg(F.count("*").alias("sanitizers"))


@query("a22_read_coverage", f"with {FI}, r as (select distinct l_partkey as file_id from lineitem where l_quantity > 30) select unit, count(*) as owned, count(r.file_id) as read, string_agg(cast(files.file_id as varchar), ',' order by files.file_id) filter (r.file_id is null) as unread from files left join r on r.file_id = files.file_id group by 1")
def a22(spark, d):
    r = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("file_id")).distinct().withColumn("hit", F.lit(1))
    j = view(spark, d, "files").select("unit", "file_id").join(r, "file_id", "left")
    gone = F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("file_id"))))
    return j.groupBy("unit").agg(F.count("*").alias("owned"), F.count("hit").alias("read"), F.when(F.size(gone) > 0, F.array_join(F.transform(gone, lambda x: x.cast("string")), ",")).alias("unread"))


@query("a23_case_tallies", f"with {CA} select target, count(*) filter (reason = 'because') as resolved, count(*) filter (reason is null) as unresolved, count(*) filter (reason is null) = 0 as complete from candidates where target is not null group by 1")
def a23(spark, d):
    return view(spark, d, "candidates").where("target is not null").groupBy("target").agg(n("reason = 'because'").alias("resolved"), n("reason is null").alias("unresolved"), (n("reason is null") == 0).alias("complete"))


@query("a31_review_totals", "select o_orderpriority as assignee, count(*) as files, count(distinct o_custkey) as paths, count(distinct o_custkey * 10 + length(o_orderstatus)) as versions, bool_and(o_orderstatus <> 'X') as all_accepted from orders group by 1")
def a31(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("assignee")).agg(F.count("*").alias("files"), F.countDistinct("o_custkey").alias("paths"), F.countDistinct("o_custkey", F.length("o_orderstatus")).alias("versions"), F.bool_and(F.col("o_orderstatus") != "X").alias("all_accepted"))


@query("a34_ledger_counters", f"with {EV}, {CA} select 'event:' || type as counter, count(*) as n from run_events group by 1 union all select 'candidate', count(*) from candidates")
def a34(spark, d):
    e = view(spark, d, "run_events").groupBy(F.concat(F.lit("event:"), "type").alias("counter")).agg(F.count("*").alias("n"))
    return e.unionByName(view(spark, d, "candidates").agg(F.count("*").alias("n")).select(F.lit("candidate").alias("counter"), "n"))


@query("a36_callers", f"with {ED}, e as (select distinct src, dst from edges), r as (select dst, src, row_number() over (partition by dst order by src) as rn from e) select dst, count(*) as callers, string_agg(cast(src as varchar), ',' order by src) filter (rn <= 10) as shown from r group by 1")
def a36(spark, d):
    e = view(spark, d, "edges").groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("s"))  # a node has as many callers as there are nodes at most
    return e.select("dst", F.size("s").cast("long").alias("callers"), F.array_join(F.transform(F.slice("s", 1, 10), lambda x: x.cast("string")), ",").alias("shown"))


@query("d04_target_tokens", f"with {CA} select candidate_id, unnest(list_distinct(list_filter([target, route, case when ord % 4 <> 0 then 'h' || cast(ord % 7 as varchar) end], lambda x: x is not null))) as token from candidates")
def d04(spark, d):
    return view(spark, d, "candidates").select("candidate_id", F.explode(F.array_distinct(F.array_compact(F.array("target", "route", F.when(F.col("ord") % 4 != 0, F.concat(F.lit("h"), (F.col("ord") % 7).cast("string"))))))).alias("token"))


@query("d11_group_review", f"with {CA}, g as (select remediation_key as k, count(*) as members, count(*) filter (score_included) as scored, count(*) filter (reason = 'because') as reasons, case when count(*) % 2 = 0 then 'MERGE' else 'KEEP' end as action from candidates group by 1) select k, action, case when action = 'MERGE' and scored > 1 then 'SEVERAL_SCORED' when action = 'KEEP' and reasons < members then 'REASON_MISSING' else 'OK' end as code from g")
def d11(spark, d):
    g = view(spark, d, "candidates").groupBy(F.col("remediation_key").alias("k")).agg(F.count("*").alias("members"), n("score_included").alias("scored"), n("reason = 'because'").alias("reasons"))
    g = g.withColumn("action", F.when(F.col("members") % 2 == 0, "MERGE").otherwise("KEEP"))
    return g.select("k", "action", F.when((F.col("action") == "MERGE") & (F.col("scored") > 1), "SEVERAL_SCORED").when((F.col("action") == "KEEP") & (F.col("reasons") < F.col("members")), "REASON_MISSING").otherwise("OK").alias("code"))


@query("iv03_observed_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents) select doc_id, count(*) as lines, sha256(string_agg(cast(no as varchar) || '|' || line, chr(10) order by no)) as numbered from l group by 1")
def iv03(spark, d):
    ls = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(ls).cast("long").alias("lines"), F.sha2(F.array_join(F.transform(ls, lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x)), "\n"), 256).alias("numbered"))


@query("pk06_task_owner", f"with {FI}, {ED} select src, arg_min(unit, file_id) as owner, count(*) as flows from edges join files on file_id = dst group by 1")
def pk06(spark, d):
    f = view(spark, d, "files").select(F.col("file_id").alias("dst"), "unit")
    return view(spark, d, "edges").join(f, "dst").groupBy("src").agg(F.min_by("unit", "dst").alias("owner"), F.count("*").alias("flows"))


#: Customers as a heap, each leading to the two whose keys halve to its own, and every seventh also back: a sparse graph with cycles.
HEAP = "e as (select a.c_custkey as src, b.c_custkey as dst from customer a join customer b on b.c_custkey in (2 * a.c_custkey, 2 * a.c_custkey + 1) or (a.c_custkey % 7 = 0 and b.c_custkey = a.c_custkey // 2))"


@query("g08_terminals", f"with recursive {HEAP}, p as (select [c_custkey] as path, c_custkey as last from customer union all select list_append(path, dst), dst from p join e on src = last where len(path) <= 8 and not list_contains(path, dst)) select array_to_string(path, '>') as path, cast(2 * (len(path) - 1) as bigint) as hops from p where len(path) = 9 or not exists (select 1 from e where src = last and not list_contains(path, dst))")
def g08(spark, d):
    """All paths of up to 8 edges from every customer to where nothing goes on."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("node"))
    out = F.array(2 * F.col("node"), 2 * F.col("node") + 1, F.when(F.col("node") % 7 == 0, F.expr("node div 2")))
    e = c.select(F.col("node").alias("src"), F.explode(out).alias("dst")).where("dst is not null").join(c.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return G.terminals(e, c).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


@query("g10_path_scores", f"with {ED} select src, dst, case when count(*) > 2 then 'strong' when bool_or(flag = 'A') then 'likely' else 'weak' end as class, count(*) as via from edges group by 1, 2")
def g10(spark, d):
    return view(spark, d, "edges").groupBy("src", "dst").agg(F.when(F.count("*") > 2, "strong").when(F.bool_or(F.col("flag") == "A"), "likely").otherwise("weak").alias("class"), F.count("*").alias("via"))


@query("g14_work_plan", f"with {FI}, {ED}, r as (select f.unit, e.dst, count(*) as refs from edges e join files f on f.file_id = e.src group by 1, 2), o as (select unit, count(*) as owned, cast(sum(bytes) as bigint) as bytes from files group by 1) select o.unit, owned, bytes, count(r.dst) as contexts from o left join r on r.unit = o.unit group by 1, 2, 3")
def g14(spark, d):
    f = view(spark, d, "files")
    refs = view(spark, d, "edges").join(f.select(F.col("file_id").alias("src"), "unit"), "src").groupBy("unit").agg(F.countDistinct("dst").alias("contexts"))
    return f.groupBy("unit").agg(F.count("*").alias("owned"), F.sum("bytes").alias("bytes")).join(refs, "unit", "left").select("unit", "owned", "bytes", F.coalesce("contexts", F.lit(0)).cast("long").alias("contexts"))


@query("g15_plan_integrity", f"with {FI}, u as (select unit, count(*) as n, cast(sum(loc) as bigint) as loc, max(loc) as most from files group by 1) select unit, n, loc, case when n > 100 then 'TOO_MANY' when loc > 30000 then 'TOO_LARGE' else 'OK' end as code from u")
def g15(spark, d):
    u = view(spark, d, "files").groupBy("unit").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))
    return u.withColumn("code", F.when(F.col("n") > 100, "TOO_MANY").when(F.col("loc") > 30000, "TOO_LARGE").otherwise("OK"))


@query("x12_fingerprint", f"with {CA} select candidate_id, sha256('{{\"target\":\"' || coalesce(target, '') || '\",\"ordinal\":' || cast(ord % 5 as varchar) || '}}') as fingerprint from candidates")
def x12(spark, d):
    return view(spark, d, "candidates").select("candidate_id", F.sha2(F.to_json(F.struct(F.coalesce("target", F.lit("")).alias("target"), (F.col("ord") % 5).alias("ordinal"))), 256).alias("fingerprint"))


@query("x26_citation_tokens", "select page_id, len(list_distinct(list_filter(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_])', 1), lambda w: length(w) >= 4 and regexp_matches(w, '_|\\.|[a-z][A-Z]')))) as tokens from pages")
def x26(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(X.citation_tokens(F.col("html"))).cast("long").alias("tokens"))


@query("x27_guard_exists", "select doc_id, contains(lower(regexp_replace(array_to_string(string_split(text, chr(10))[1:3], ''), '[ \\t\\n\\r\\f\\v]+', '', 'g')), 'ofthe') as found from documents")
def x27(spark, d):
    near = F.lower(F.regexp_replace(F.array_join(F.slice(F.split("text", "\n"), 1, 3), ""), r"[ \t\n\r\f\x0b]+", ""))
    return table(spark, d, "documents").select("doc_id", near.contains("ofthe").alias("found"))


@query("x29_gates", f"with {CA} select candidate_id, case when event = 'false positive' and ord % 2 = 0 then 'DISPUTED' when event = 'CONFIRMED' and evidence = '' then 'CANDIDATE' else coalesce(event, 'NONE') end as status from (select *, status as event from candidates)")
def x29(spark, d):
    s = F.col("status")
    return view(spark, d, "candidates").select("candidate_id", F.when((s == "false positive") & (F.col("ord") % 2 == 0), "DISPUTED").when((s == "CONFIRMED") & (F.col("evidence") == ""), "CANDIDATE").otherwise(F.coalesce(s, F.lit("NONE"))).alias("status"))


_PLAIN = "case when ends_with({0}, chr(10)) then left({0}, length({0}) - 1) else {0} end"


#: Each revision as a file of some language; every sixth holds JSON, whose line ends are what changes in every second of them.
_X37 = {
    "path": "case doc_id % 3 when 0 then 'a' || cast(doc_id as string) || '.json' when 1 then 'b.ts' else 'c.md' end", "before": "case when doc_id % 6 = 0 then '[' || chr(10) || cast(doc_id as string) || ']' || chr(10) else before end",
    "after": "case when doc_id % 12 = 0 then '[' || chr(13) || chr(10) || cast(doc_id as string) || ']' when doc_id % 6 = 0 then '[' || chr(10) || cast(doc_id as string) || ']' else after end",
}


@query("x37_change_kind", f"""with {cte('revised')}, r as (select doc_id, {", ".join(f"{e} as {c}" for c, e in _X37.items())} from revised), p as (select doc_id, path, before, after, replace(before, chr(13) || chr(10), chr(10)) as b, replace(after, chr(13) || chr(10), chr(10)) as a from r)
    select doc_id, case when before is null or after is null then 'unknown' when before = after then 'identical' when {_PLAIN.format('b')} <> {_PLAIN.format('a')} then 'analysis-relevant'
        when contains(a || chr(10) || b, chr(13)) or contains(a || chr(10) || b, chr(65279)) or contains(a || chr(10) || b, '`') or contains(a || chr(10) || b, chr(92) || chr(10)) then 'unknown'
        when ends_with(path, '.json') and json_valid(before) and json_valid(after) then 'supported-format-only' else 'unknown' end as kind from p""")
def x37(spark, d):
    r = view(spark, d, "revised").select("doc_id", *(F.expr(e).alias(c) for c, e in _X37.items()))
    return r.select("doc_id", V.change_kind(F.col("path"), F.col("before"), F.col("after")).alias("kind"))


@query("x44_obligations", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents), s as (select * from (values ('licence', '[Ll]icense'), ('mail', '@'), ('secret', 'password|AKIA')) as t(seed, pattern)) select doc_id, seed, no as line from l join s on regexp_matches(line, pattern) qualify row_number() over (partition by doc_id, seed order by no) <= 3")
def x44(spark, d):
    seeds = {"licence": "[Ll]icense", "mail": "@", "secret": "password|AKIA"}
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hit = lines.select("doc_id", (F.col("i") + 1).alias("no"), F.explode(F.array_compact(F.array(*(F.when(F.col("line").rlike(p), s) for s, p in seeds.items())))).alias("seed"))
    return hit.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "seed").orderBy("no"))).where("r <= 3").select("doc_id", "seed", F.col("no").alias("line"))


@query("st03_compare_and_set", f"with {EV}, r as (select run_id, seq, attempt, lag(attempt) over (partition by run_id order by seq) as held from run_events) select run_id, count(*) filter (held is null or attempt >= held) as accepted, count(*) filter (attempt < held) as rejected from r group by 1")
def st03(spark, d):
    r = view(spark, d, "run_events").withColumn("held", F.lag("attempt").over(W.partitionBy("run_id").orderBy("seq")))
    return r.groupBy("run_id").agg(n("held is null or attempt >= held").alias("accepted"), n("attempt < held").alias("rejected"))


@query("st08_ready_queue", "with recursive e as (select p_partkey as node, p_partkey // 2 as needs from part where p_partkey > 0), bad as (select p_partkey as node from part where p_partkey % 31 = 7 union select e.node from e join bad on e.needs = bad.node) select p_partkey as node, case when b.node is not null then 'rejected' else 'ready' end as state from part left join (select distinct node from bad) b on b.node = p_partkey")
def st08(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    edges = p.where("node > 0").select(F.expr("node div 2").alias("src"), F.col("node").alias("dst"))
    bad = G.reach(edges, p.where("node % 31 = 7")).select("node", F.lit(True).alias("bad"))
    return p.join(bad, "node", "left").select("node", F.when(F.col("bad"), "rejected").otherwise("ready").alias("state"))


@query("st11_mediation", f"with {EV} select run_id, phase, count(distinct type) as opinions, case when arg_max(type, seq) = 'purchase' then 'adopted' when count(distinct type) > 2 then 'competing' else 'open' end as state from run_events group by 1, 2")
def st11(spark, d):
    g = view(spark, d, "run_events").groupBy("run_id", "phase").agg(F.countDistinct("type").alias("opinions"), F.max_by("type", "seq").alias("last"))
    return g.select("run_id", "phase", "opinions", F.when(F.col("last") == "purchase", "adopted").when(F.col("opinions") > 2, "competing").otherwise("open").alias("state"))


@query("st13_bounded_rounds", f"with {EV} select run_id, least(count(*) filter (type = 'view'), 3) as rounds, greatest(count(*) filter (type = 'view') - 3, 0) as pending from run_events group by 1")
def st13(spark, d):
    v, three = n("type = 'view'"), F.lit(3).cast("long")
    return view(spark, d, "run_events").groupBy("run_id").agg(F.least(v, three).alias("rounds"), F.greatest(v - 3, F.lit(0).cast("long")).alias("pending"))


@query("st16_checkpoint_seal", f"with {EV} select run_id, sha256(string_agg(cast(seq as varchar), ',' order by seq)) as seal from run_events group by 1")
def st16(spark, d):
    return view(spark, d, "run_events").groupBy("run_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ","), 256).alias("seal"))


@query("z03_write_once", f"with {EV} select run_id, min(seq) as finalized_at, count(*) - 1 as refused from run_events where type = 'purchase' group by 1")
def z03(spark, d):
    return view(spark, d, "run_events").where("type = 'purchase'").groupBy("run_id").agg(F.min("seq").alias("finalized_at"), (F.count("*") - 1).alias("refused"))


@query("z05_assessment_codes", f"with {FI}, a as (select l_partkey as file_id, count(*) as n from lineitem where l_quantity > 40 group by 1) select files.file_id, case when n is null then 'missing' when n > 1 then 'repeated' else 'ok' end as code from files left join a on a.file_id = files.file_id")
def z05(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("file_id")).agg(F.count("*").alias("n"))
    return view(spark, d, "files").select("file_id").join(a, "file_id", "left").select("file_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("ok").alias("code"))


@query("z09_resume_receipts", f"with {cte('revised')} select doc_id, strlen(before) as bytes, coalesce(strlen(before) = strlen(after) and sha256(before) = sha256(after), false) as intact from revised")
def z09(spark, d):
    """Receipts were taken of the earlier revision; the later one resumes only where bytes and digest still agree."""
    same = (F.octet_length("before") == F.octet_length("after")) & (F.sha2("before", 256) == F.sha2("after", 256))
    return view(spark, d, "revised").select("doc_id", F.octet_length("before").cast("long").alias("bytes"), F.coalesce(same, F.lit(False)).alias("intact"))


@query("z17_shared_page", "with m as (select p_partkey, substr(p_name, 1, 6) as summary from part where list_contains(string_split(p_name, ' '), 'red') and p_type = 'PROMO') select p_partkey, summary, (select count(*) from m) as total, case when (select count(*) from m) > 5 then 5 end as next_offset from m order by p_partkey limit 5")
def z17(spark, d):
    p = table(spark, d, "part")
    m = p.where(X.matches_query(X.search_tokens(F.col("p_name")), F.col("p_name"), "red") & (F.col("p_type") == "PROMO")).select("p_partkey", F.left("p_name", F.lit(6)).alias("summary"))
    return J.page(m, ["p_partkey"], 0, 5)


_WORD = "regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){}([^\\p{{L}}\\p{{N}}]|$)')"


@query("z17_indexed_page", f"""with m as (select doc_id, text from documents where (({_WORD.format('license')} and not {_WORD.format('mit')}) or {_WORD.format('apache license')} or {_WORD.format('password')}) and source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') and lang in ('en', 'de'))
    select doc_id, left(text, 60) as summary, (select count(*) from m) as total, case when (select count(*) from m) > 20 then 20 end as next_offset from m order by doc_id limit 20""")
def z17_indexed(spark, d):
    """The first page of a search over the documents' index; texts are fetched for the page alone."""
    docs = table(spark, d, "documents")
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
    FTS.write_index(docs.withColumn("tags", F.array(F.concat(F.lit("s:"), "source"), F.concat(F.lit("l:"), "lang"))), root, "doc_id", "text", "tags")
    matches = FTS.search(spark, root, 'license -mit or "apache license" or password', [[f"s:src{i}" for i in range(10)], ["l:en", "l:de"]])
    shown = FTS.matched_page(spark, root, matches, 0, 20)
    return docs.join(F.broadcast(shown.withColumnRenamed("id", "doc_id")), "doc_id").select("doc_id", F.left("text", F.lit(60)).alias("summary"), "total", "next_offset")  # 20 rows at most


@query("z23_enclosing_function", "with f as (select o_custkey as k, o_orderkey as start, o_orderkey + 500 as stop from orders where o_orderkey % 3 = 0), c as (select o_custkey as k, o_orderkey as line from orders where o_orderkey % 3 = 1) select k, line, min(start) as enclosing from c join f using (k) where line between start and stop group by 1, 2")
def z23(spark, d):
    o = table(spark, d, "orders")
    f = o.where("o_orderkey % 3 = 0").selectExpr("o_custkey as k", "o_orderkey as start", "o_orderkey + 500 as stop")
    return J.in_ranges(o.where("o_orderkey % 3 = 1").selectExpr("o_custkey as k", "o_orderkey as line"), f, "k", "line", "start", "stop", 256).groupBy("k", "line").agg(F.min("start").alias("enclosing"))


@query("z26_issue_collector", f"with {CA} select remediation_key, count(*) filter (reason is null) as issues, bool_or(reason is null and score_included) as has_error from candidates group by 1")
def z26(spark, d):
    return view(spark, d, "candidates").groupBy("remediation_key").agg(n("reason is null").alias("issues"), F.bool_or(F.col("reason").isNull() & F.col("score_included")).alias("has_error"))


@query("z27_budget_recovery", f"with {EV}, b as (select run_id, round(sum(value), 4) as used, max(value) as most from run_events group by 1) select run_id, used, greatest(used, 1000e0) as budget, used > 1000 as raised from b")
def z27(spark, d):
    b = view(spark, d, "run_events").groupBy("run_id").agg(F.round(F.sum("value"), 4).alias("used"))
    return b.select("run_id", "used", F.greatest("used", F.lit(1000.0)).alias("budget"), (F.col("used") > 1000).alias("raised"))


@query("z32_fanout_limits", f"with {FI}, u as (select unit, count(*) as n, cast(sum(loc) as bigint) as loc from files group by 1) select unit, case when n > 85 then 8 when loc > 26000 then 4 else 1 end as agents from u")
def z32(spark, d):
    u = view(spark, d, "files").groupBy("unit").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))
    return u.select("unit", F.when(F.col("n") > 85, 8).when(F.col("loc") > 26000, 4).otherwise(1).alias("agents"))


def contract_codes(ids, references, depends):
    """(code, n): ids that repeat, references (node) to no id, and ids on or behind a cycle of depends (src before dst)."""
    row = lambda code, df, m: df.agg(m.cast("long").alias("n")).select(F.lit(code).alias("code"), "n")
    known = ids.select("node").distinct()
    stuck = G.peel(known, depends.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")).where("level is null")
    return (
        row("unknown_reference", references.join(known, "node", "left_anti"), F.count("*"))
        .unionByName(row("duplicate_id", ids, F.count("*") - F.countDistinct("node")))
        .unionByName(row("cycle", stuck, F.count("*")))
    )


@query("z33_contract_validation")
def z33(spark, d):
    """Nations as the tasks of a contract, each after the one that half its key names (g13_levels)."""
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    after = ids.where("node > 0").selectExpr("(node - 1) div 2 as src", "node as dst")
    return contract_codes(ids, after.selectExpr("src as node"), after)


@query("x08_jsonc_strip", "select event_id, props as plain from events")
def x08(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("/* note */ "), F.replace("props", F.lit("}"), F.lit(", } // end"))).alias("t"))
    return e.select("event_id", F.trim(X.without_comments(F.col("t"))).alias("plain"))


@query("x45_severity_lint", f"with {CA} select candidate_id, len(regexp_extract_all(coalesce(severity, '') || ' then HIGH, low', '(?i)(critical|high|medium|low)')) as named, len(list_distinct(list_transform(regexp_extract_all(coalesce(severity, '') || ' then HIGH, low', '(?i)(critical|high|medium|low)'), lambda x: upper(x)))) > 2 as inconsistent from candidates")
def x45(spark, d):
    found = F.regexp_extract_all(F.concat(F.coalesce("severity", F.lit("")), F.lit(" then HIGH, low")), F.lit("(?i)(critical|high|medium|low)"), F.lit(1))
    return view(spark, d, "candidates").select("candidate_id", F.size(found).cast("long").alias("named"), (F.size(F.array_distinct(F.transform(found, F.upper))) > 2).alias("inconsistent"))


@query("z06_followup_answers", "with q as (select conv_id, count(*) as asked from conversations where role = 'user' group by 1), a as (select conv_id, count(*) as given, count(*) filter (length(text) > 40) as proven from conversations where role = 'assistant' group by 1) select q.conv_id, asked, coalesce(given, 0) as given, case when coalesce(given, 0) <> asked then 'count' when proven < given then 'evidence' else 'ok' end as code from q left join a using (conv_id)")
def z06(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(n("role = 'user'").alias("asked"), n("role = 'assistant'").alias("given"), n("role = 'assistant' and length(text) > 40").alias("proven")).where("asked > 0")
    return g.select("conv_id", "asked", "given", F.when(F.col("given") != F.col("asked"), "count").when(F.col("proven") < F.col("given"), "evidence").otherwise("ok").alias("code"))


@query("z07_reuse", f"with {FI}, h as (select unit, file_id, sha256(path || ':' || cast(bytes as varchar)) as identity from files), o as (select file_id, sha256(path || ':' || cast(bytes + case when file_id % 10 = 0 then 1 else 0 end as varchar)) as identity from files), gone as (select distinct l_partkey as file_id from lineitem where l_quantity = 50) select unit, h.file_id from h join o on o.file_id = h.file_id and o.identity = h.identity where h.file_id not in (select file_id from gone)")
def z07(spark, d):
    f = view(spark, d, "files")
    ident = lambda size: F.sha2(F.concat("path", F.lit(":"), size.cast("string")), 256)
    old = f.select("file_id", ident(F.col("bytes") + F.when(F.col("file_id") % 10 == 0, 1).otherwise(0)).alias("identity"))
    gone = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("file_id"))
    return f.select("unit", "file_id", ident(F.col("bytes")).alias("identity")).join(old, ["file_id", "identity"]).join(gone, "file_id", "left_anti").select("unit", "file_id")


@query("z13_evaluation_classes", f"with {CA} select remediation_key, case when count(*) > 1 then 'MERGE' else 'KEEP' end as action, min(candidate_id) as representative, count(distinct root_cause_location) as locations from candidates group by 1")
def z13(spark, d):
    return view(spark, d, "candidates").groupBy("remediation_key").agg(F.when(F.count("*") > 1, "MERGE").otherwise("KEEP").alias("action"), F.min("candidate_id").alias("representative"), F.countDistinct("root_cause_location").alias("locations"))


@query("z14_projection_equality", f"with {CA}, a as (select status, count(*) as n from candidates group by 1), b as (select status, count(*) as n from candidates where score_included is not false group by 1) select a.status, a.n as projected, coalesce(b.n, 0) as kept, a.n = coalesce(b.n, 0) as equal from a left join b on a.status is not distinct from b.status")
def z14(spark, d):
    return view(spark, d, "candidates").groupBy("status").agg(F.count("*").alias("projected"), n("score_included is null or score_included").alias("kept")).withColumn("equal", F.col("projected") == F.col("kept"))


@query("z15_artifact_counts", f"with {CA}, k as (select cast(event_id * 2 as varchar) as id from events) select count(*) as ids, count(*) filter (c.candidate_id is null) as unknown, count(*) filter (k.id is null) as uncovered from candidates c full join k on k.id = c.candidate_id")
def z15(spark, d):
    k = view(spark, d, "classifications").select("candidate_id", F.lit(1).alias("k"))
    j = view(spark, d, "candidates").select("candidate_id", F.lit(1).alias("c")).join(k, "candidate_id", "full")
    return j.agg(F.count("*").alias("ids"), n("c is null").alias("unknown"), n("k is null").alias("uncovered"))


@query("z21_represented_ids", "select item_id from benchmark b where not exists (select 1 from documents d where contains(d.text, b.text))")
def z21(spark, d):
    from tallyloom.operators.ledger import leaks

    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    # leaks() finds pairs in any case by an equality join; those that stand exactly so are kept.
    pairs = leaks(docs, b).join(docs.select("doc_id", F.col("text").alias("hay")), "doc_id").join(b.select("item_id", F.col("text").alias("needle")), "item_id")
    return b.select("item_id").join(pairs.where(F.col("hay").contains(F.col("needle"))).select("item_id").distinct(), "item_id", "left_anti")


@query("z30_note_append", f"with {EV}, f as (select run_id, attempt, min(seq) as first from run_events group by 1, 2) select e.run_id, count(*) filter (e.seq = f.first) as accepted, count(*) filter (e.seq <> f.first) as collisions from run_events e join f on f.run_id = e.run_id and f.attempt = e.attempt group by 1")
def z30(spark, d):
    g = view(spark, d, "run_events").groupBy("run_id", "attempt").agg(F.count("*").alias("m"))
    return g.groupBy("run_id").agg(F.count("*").alias("accepted"), F.sum(F.col("m") - 1).alias("collisions"))
