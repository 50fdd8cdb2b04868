"""Ledger queries: predicates and constraints (F), counts and scores (A), deduplication (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import ledger as L
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query

#: The ledger's normal form in SQL.
NORMAL = f"""{cte("candidates")}, norm as (select *,
    coalesce(nullif(upper(regexp_replace(trim(status), '[\\s-]+', '_', 'g')), ''), 'UNCLASSIFIED') as st,
    coalesce(nullif(upper(regexp_replace(trim(status), '[\\s-]+', '_', 'g')), ''), 'CONFIRMED') as st_score,
    case upper(trim(severity)) when 'STRUCTURAL' then 'STRUCTURAL_WEAKNESS' when 'CRITICAL' then 'CRITICAL' when 'HIGH' then 'HIGH' when 'MEDIUM' then 'MEDIUM' when 'LOW' then 'LOW' else 'INFO' end as sev,
    coalesce(nullif(remediation_key, ''), nullif(root_cause_location, ''), candidate_id) as root_key from candidates),
    scored as (select *, coalesce(st in ('CONFIRMED', 'DOWNGRADED') and sev <> 'STRUCTURAL_WEAKNESS' and coalesce(score_included, true), false) as inc,
    case sev when 'CRITICAL' then 25 when 'HIGH' then 10 when 'MEDIUM' then 3 when 'LOW' then 1 else 0 end as w from norm)"""


def ledger(spark, d):
    return L.normal(view(spark, d, "candidates"))


@query("f01_alias_projection", f"with {cte('candidates')} select candidate_id, coalesce(nullif(remediation_key, ''), nullif(root_cause_location, ''), candidate_id) as root_key from candidates")
def f01(spark, d):
    c = view(spark, d, "candidates")
    return c.select("candidate_id", S.first_truthy(F.col("remediation_key"), F.col("root_cause_location"), F.col("candidate_id")).alias("root_key"))


@query("f02_has_content", f"with {cte('candidates')} select candidate_id, coalesce(length(trim(evidence)) > 0, false) as has_evidence, coalesce(length(trim(reason)) > 0, false) as has_reason, coalesce(length(trim(evidence)) > 0, false) or coalesce(length(trim(reason)) > 0, false) as has_any from candidates")
def f02(spark, d):
    e, r = S.has_content(F.col("evidence")), S.has_content(F.col("reason"))
    return view(spark, d, "candidates").select("candidate_id", e.alias("has_evidence"), r.alias("has_reason"), (e | r).alias("has_any"))



@query("f03_inventory_class", f"with {cte('files')} select path, regexp_matches(path, 'x') as has_x, case when path like '%.lock' then 'dependency' when regexp_matches(path, '\\.(ts|py|go|rs|js)$') then 'source' when path like '%.tf' then 'security' when path like '%.md' then 'doc' else 'other' end as class from files")
def f03(spark, d):
    p = F.col("path")
    return view(spark, d, "files").select("path", p.rlike("x").alias("has_x"), L.inventory_class(p).alias("class"))


@query("f05_recon_flags", f"with {cte('files')}, t as (select path, unnest(case when len(l) = 0 then ['general'] else l end) as flag from (select path, list_filter([case when regexp_matches(path, 'promo') then 'promo' end, case when regexp_matches(path, 'economy|standard') then 'basic' end, case when regexp_matches(path, '\\.(tf|lock)$') then 'infra' end], lambda x: x is not null) as l from files)) select path, flag from t")
def f05(spark, d):
    return L.flags(view(spark, d, "files"), "path", {"promo": "promo", "basic": "economy|standard", "infra": r"\.(tf|lock)$"}, "general")


@query("f06_language", f"with {cte('files')} select path, case regexp_extract(path, '(\\.[^./]+)$', 1) when '.ts' then 'typescript' when '.js' then 'javascript' when '.py' then 'python' when '.go' then 'go' when '.rs' then 'rust' else 'unsupported' end as language from files")
def f06(spark, d):
    return view(spark, d, "files").select("path", S.language(F.col("path")).alias("language"))


@query("f07_terminal_filter", "select event_id, event_type from events where event_type in ('error', 'purchase')")
def f07(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type")


@query("f08_score_inclusion", f"with {NORMAL} select candidate_id, st as status, sev as severity from scored where inc")
def f08(spark, d):
    return ledger(spark, d).where("included").select("candidate_id", "status", "severity")


#: Candidates in every status in turn (and an unknown one), whose reasons and contexts stand in the columns that the statuses demand.
_STATUSES = (*L.STATUSES, "OPEN")
_CLASSIFIED = f"""classified as (select candidate_id, ord, sev, root_key, inc, [{', '.join(f"'{s}'" for s in _STATUSES)}][ord % {len(_STATUSES)} + 1] as st, evidence, reason, folded_into,
    reason as downgrade_reason, reason as backlog_reason, route as required_access, target as pentest_route, evidence as counter_evidence, reason as scope_reason, target as dispute_reason,
    target as reachable, route as exploit_path from scored)"""
_HAS = "coalesce(length(trim({0})) > 0, false)"
_LACKS = {
    "MISSING_EVIDENCE": "st in ('CONFIRMED', 'DOWNGRADED') and not " + _HAS.format("evidence"), "DOWNGRADE_REASON_MISSING": "st = 'DOWNGRADED' and not " + _HAS.format("downgrade_reason"),
    "BACKLOG_REASON_MISSING": "st = 'BACKLOG' and not " + _HAS.format("backlog_reason"), "EXCLUSION_REASON_MISSING": "st = 'EXCLUDED' and not " + _HAS.format("reason"),
    "PENDING_EXTERNAL_CONTEXT_MISSING": "st = 'PENDING_EXTERNAL' and not " + _HAS.format("required_access"), "PENDING_PENTEST_ROUTE_MISSING": "st = 'PENDING_PENTEST' and not " + _HAS.format("pentest_route"),
    "FOLDED_TARGET_MISSING": "st = 'FOLDED_INTO' and not " + _HAS.format("folded_into"), "FALSE_POSITIVE_COUNTER_EVIDENCE_MISSING": "st = 'FALSE_POSITIVE' and not " + _HAS.format("counter_evidence"),
    "OUT_OF_SCOPE_REASON_MISSING": "st = 'OUT_OF_SCOPE' and not " + _HAS.format("scope_reason"), "DISPUTE_REASON_MISSING": "st = 'DISPUTED' and not " + _HAS.format("dispute_reason"),
    "INVALID_STATUS": "st = 'OPEN'", "CANDIDATE_UNCLASSIFIED": "st in ('UNCLASSIFIED', 'CANDIDATE')",
    "CONFIRMED_VALIDITY_MISSING": f"st = 'CONFIRMED' and sev in ('CRITICAL', 'HIGH') and not {_HAS.format('reachable')} and not {_HAS.format('exploit_path')}",
}
_VIOLATIONS_SQL = f"select candidate_id, unnest(list_filter([{', '.join(f"case when {c} then '{n}' end" for n, c in _LACKS.items())}], lambda x: x is not null)) as code from classified"


def classified(spark, d):
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("ord") % len(_STATUSES) + 1).cast("int"))
    given = {"downgrade_reason": "reason", "backlog_reason": "reason", "required_access": "route", "pentest_route": "target", "counter_evidence": "evidence", "scope_reason": "reason", "dispute_reason": "target", "reachable": "target", "exploit_path": "route"}
    return ledger(spark, d).withColumn("status", status).withColumns({k: F.col(v) for k, v in given.items()})


@query("f09_candidate_violations", f"with {NORMAL}, {_CLASSIFIED} {_VIOLATIONS_SQL}")
def f09(spark, d):
    return L.violations(classified(spark, d))


@query("f10_validity_appraisal", f"with {NORMAL}, m as (select *, (case when target is null then 1 else 0 end) + (case when route is null then 1 else 0 end) + (case when coalesce(length(trim(reason)) = 0, true) then 1 else 0 end) as missing from scored) select candidate_id, cast(missing as bigint) as missing, case when missing = 3 and sev in ('CRITICAL', 'HIGH') then 'error' when missing > 0 then 'warning' else 'ok' end as level from m")
def f10(spark, d):
    return L.appraisal(ledger(spark, d), ["target", "route", "reason"])


@query("f11_submit_constraints", f"with {NORMAL} select candidate_id, unnest(list_filter([case when st = 'CONFIRMED' and length(evidence) = 0 then 'evidence' end, case when sev in ('CRITICAL', 'HIGH') and route is null then 'reachability' end, case when sev in ('CRITICAL', 'HIGH') and coalesce(length(trim(reason)), 0) < 20 then 'rationale' end], lambda x: x is not null)) as code from scored")
def f11(spark, d):
    high = F.col("severity").isin("CRITICAL", "HIGH")
    return L.codes(ledger(spark, d), {"evidence": (F.col("status") == "CONFIRMED") & (F.length("evidence") == 0), "reachability": high & F.col("route").isNull(), "rationale": high & (F.coalesce(F.length(F.trim("reason")), F.lit(0)) < 20)})


@query("f14_three_valued", f"with {cte('files')} select path, case when path like '%.ts' then true when path like '%.md' then null else false end as applies, (case when path like '%.ts' then true when path like '%.md' then null else false end) and bytes > 20000 as applies_and_large from files")
def f14(spark, d):
    a = F.when(F.col("path").endswith(".ts"), True).when(F.col("path").endswith(".md"), F.lit(None).cast("boolean")).otherwise(False)
    return view(spark, d, "files").select("path", a.alias("applies"), (a & (F.col("bytes") > 20000)).alias("applies_and_large"))


@query("f15_path_range", f"with {cte('ranges')} select path, start, start between greatest(1, 30 - 10) and stop + 10 as inside from ranges")
def f15(spark, d):
    return view(spark, d, "ranges").select("path", "start", L.in_window(F.col("start"), F.lit(30), F.col("stop"), 10).alias("inside"))


@query("f17_hard_gates", f"with {cte('observations')} select case_id, repetition, arm, bool_and(gate = 0) as passes from observations group by 1, 2, 3")
def f17(spark, d):
    return view(spark, d, "observations").groupBy("case_id", "repetition", "arm").agg(F.bool_and(F.col("gate") == 0).alias("passes"))


@query("f18_leak_check", "select d.doc_id, b.item_id from documents d join benchmark b on contains(lower(d.text), lower(b.text))")
def f18(spark, d):
    return L.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("f19_markers", "select conv_id, turn, array_to_string(list_filter([case when regexp_matches(lower(t), 'the') then 'the' end, case when regexp_matches(lower(t), 'und') then 'und' end, case when regexp_matches(t, '[0-9]') then 'digit' end], lambda x: x is not null), ',') as markers from (select *, translate(text, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), '') as t from conversations)")
def f19(spark, d):
    return L.markers(table(spark, d, "conversations"), "text", {"the": "(?i)the", "und": "(?i)und", "digit": "[0-9]"}).select("conv_id", "turn", "markers")


@query("f20_closed_schema", "select event_id, props = '{\"k\": ' || regexp_extract(props, '([0-9]+)', 1) || '}' as closed from events")
def f20(spark, d):
    return table(spark, d, "events").select("event_id", L.only_keys(F.col("props"), ["k"]).alias("closed"))


@query("a01_summary", f"with {NORMAL} select count(*) as total, count(*) filter (st = 'CONFIRMED') as confirmed, count(*) filter (st = 'DOWNGRADED') as downgraded, count(*) filter (st = 'FALSE_POSITIVE') as false_positive, count(*) filter (st = 'PENDING_EXTERNAL') as pending, count(*) filter (st = 'UNCLASSIFIED') as unclassified, count(*) filter (sev = 'CRITICAL') as critical, count(*) filter (sev = 'HIGH') as high, count(*) filter (sev = 'MEDIUM') as medium, count(*) filter (sev = 'LOW') as low, count(*) filter (sev = 'INFO') as info, count(*) filter (sev = 'STRUCTURAL_WEAKNESS') as structural, count(*) filter (st = 'UNCLASSIFIED') = 0 as publishable from scored")
def a01(spark, d):
    return L.summary(ledger(spark, d))


_COUNTS = "count(*) filter (sev = 'CRITICAL') as critical, count(*) filter (sev = 'HIGH') as high, count(*) filter (sev = 'MEDIUM') as medium, count(*) filter (sev = 'LOW') as low"
_SCORE_ROWS = "from scored where st_score in ('CONFIRMED', 'DOWNGRADED') and sev <> 'STRUCTURAL_WEAKNESS' and coalesce(score_included, true)"


@query("a02_scored_counts", f"with {NORMAL} select {_COUNTS} {_SCORE_ROWS}")
def a02(spark, d):
    return L.score_counts(ledger(spark, d))


@query("a03_security_score", f"with {NORMAL}, c as (select root_key, {_COUNTS} {_SCORE_ROWS} group by 1) select root_key, greatest(0, 100 - (25 * critical + 10 * high + 3 * medium + low)) as score from c")
def a03(spark, d):
    return L.with_score(L.score_counts(ledger(spark, d), ["root_key"])).select("root_key", "score")


_FOLDED = f"""{NORMAL}, ranked as (select *, row_number() over (partition by root_key order by w desc, case when length(evidence) > 0 then 0 else 1 end, ord) as rn from scored where inc),
    kept as (select root_key, sev from ranked where rn = 1), counts as (select {_COUNTS} from kept), s as (select *, greatest(0, 100 - (25 * critical + 10 * high + 3 * medium + low)) as score from counts)"""


@query("a04_pass_decision", f"with {_FOLDED}, c as (select max(cvss) as max_cvss from ranked where rn = 1) select critical, high, medium, low, max_cvss, score, critical = 0 and high <= 2 and coalesce(max_cvss < 9, true) and score >= 70 as passes from s, c")
def a04(spark, d):
    kept = L.deduplicate(ledger(spark, d).where("included")).where("representative")
    return L.decide(L.with_score(L.score_counts(kept, with_cvss=True))).select("critical", "high", "medium", "low", "max_cvss", "score", "passes")


@query("a05_score_consistency", f"with {_FOLDED} select score, 100 as reported, score = 100 as consistent from s")
def a05(spark, d):
    kept = L.deduplicate(ledger(spark, d).where("included")).where("representative")
    return L.with_score(L.score_counts(kept)).select("score", F.lit(100).alias("reported"), (F.col("score") == 100).alias("consistent"))


@query("a14_unit_breakdown", f"with {cte('files')} select unit, count(*) as file_count, cast(sum(loc) as bigint) as loc from files group by 1")
def a14(spark, d):
    return view(spark, d, "files").groupBy("unit").agg(F.count("*").alias("file_count"), F.sum("loc").alias("loc"))


@query("a15_extension_counts", f"with {cte('files')} select regexp_extract(path, '(\\.[^./]+)$', 1) as extension, count(*) as n from files group by 1")
def a15(spark, d):
    return view(spark, d, "files").groupBy(S.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


@query("a16_root_cause_groups", f"with {NORMAL} select root_key, count(*) as members, min(ord) as first_ord from scored group by 1")
def a16(spark, d):
    return ledger(spark, d).groupBy("root_key").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord"))


@query("a17_merged_instances", f"with {NORMAL}, f as (select root_key, target, min(ord) as o from scored where target is not null group by 1, 2) select root_key, string_agg(target, ',' order by o) as targets from f group by 1")
def a17(spark, d):
    return L.merged_instances(ledger(spark, d), "root_key", "target", "ord").select("root_key", F.array_join("instances", ",").alias("targets"))


@query("a18_representative", f"with {NORMAL} select root_key, candidate_id from scored qualify row_number() over (partition by root_key order by w desc, case when length(evidence) > 0 then 0 else 1 end, ord) = 1")
def a18(spark, d):
    return L.representatives(ledger(spark, d)).select("root_key", "candidate_id")


@query("a19_coverage_ratio", f"with {cte('files')}, u as (select unit, cast(count(*) filter (file_id % 4 <> 0) as double) / count(*) as coverage from files group by 1) select unit, coverage, coverage < 0.7e0 as violation from u")
def a19(spark, d):
    u = view(spark, d, "files").groupBy("unit").agg((F.sum((F.col("file_id") % 4 != 0).cast("double")) / F.count("*")).alias("coverage"))
    return u.withColumn("violation", F.col("coverage") < 0.7)


@query("a20_violation_summary", f"with {NORMAL}, {_CLASSIFIED}, v as ({_VIOLATIONS_SQL}) select code, count(*) as n from v group by 1")
def a20(spark, d):
    return L.violations(classified(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query("a21_excluded_sources", f"with {cte('files')}, x as (select * from (values ('promo'), ('economy'), ('none')) as t(prefix)) select prefix, count(path) as n from x left join files on starts_with(path, prefix || '/') and regexp_matches(path, '\\.(ts|py)$') group by 1")
def a21(spark, d):
    excluded = spark.createDataFrame([("promo",), ("economy",), ("none",)], "prefix string")  # a stated list
    hit = view(spark, d, "files").where(F.col("path").rlike(r"\.(ts|py)$"))
    return excluded.join(hit, F.col("path").startswith(F.concat("prefix", F.lit("/"))), "left").groupBy("prefix").agg(F.count("path").alias("n"))


@query("a24_reservations", f"with {cte('run_events')} select run_id, phase, count(*) filter (type = 'signup') as reserved, count(*) filter (type = 'purchase') as committed, count(*) filter (type = 'error') as cancelled, count(*) filter (type = 'signup') - count(*) filter (type in ('purchase', 'error')) as pending from run_events group by 1, 2")
def a24(spark, d):
    n = lambda *t: F.count(F.when(F.col("type").isin(*t), 1))
    return view(spark, d, "run_events").groupBy("run_id", "phase").agg(n("signup").alias("reserved"), n("purchase").alias("committed"), n("error").alias("cancelled"), (n("signup") - n("purchase", "error")).alias("pending"))


@query("a25_committed_budget", f"with {cte('run_events')}, a as (select run_id, attempt, greatest(coalesce(sum(value) filter (type = 'purchase'), 0e0), coalesce(max(value) filter (type = 'click'), max(value))) as charged from run_events group by 1, 2) select run_id, round(sum(charged), 4) as committed from a group by 1")
def a25(spark, d):
    return L.committed_budget(view(spark, d, "run_events")).select("run_id", F.round("committed", 4).alias("committed"))


@query("a26_cost_guard", f"with {cte('run_events')}, r as (select run_id, seq, value, sum(value) over (partition by run_id order by seq) as running from run_events) select run_id, seq, round(running, 4) as running, case when value > 100 then 'attempt' when running > 500 then 'run' else 'ok' end as decision from r")
def a26(spark, d):
    return L.cost_guard(view(spark, d, "run_events"), 100, 500).select("run_id", "seq", F.round("running", 4).alias("running"), "decision")


@query("a27_phase_metrics", f"with {cte('run_events')}, p as (select phase, count(*) as n, sum(value) as total, sum(case when type = 'click' then value else 0 end) as part from run_events group by 1) select phase, n, round(total, 4) as total, floor(part / total * 10000 + 0.5e0) / 100 as percent from p")
def a27(spark, d):
    p = view(spark, d, "run_events").groupBy("phase").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.when(F.col("type") == "click", F.col("value")).otherwise(0)).alias("part"))
    return p.select("phase", "n", F.round("total", 4).alias("total"), (F.floor(F.col("part") / F.col("total") * 10000 + 0.5) / 100).alias("percent"))


@query("a28_disposition_distribution", f"with {NORMAL} select st as status, sev as severity, count(*) as n from scored group by 1, 2")
def a28(spark, d):
    return ledger(spark, d).groupBy("status", "severity").agg(F.count("*").alias("n"))


@query("a29_cause_inventory", f"with {NORMAL} select root_key, max(w) as top_weight, count(distinct target) as targets, count(distinct route) as routes, count(distinct nullif(evidence, '')) as evidence_items, case when bool_or(st = 'UNCLASSIFIED') then null else count(*) end as total from scored group by 1")
def a29(spark, d):
    return L.cause_inventory(ledger(spark, d))


@query("a30_citation_groups", f"with {NORMAL}, g as (select target, string_agg(distinct root_key, ',' order by root_key) as ids, count(distinct root_key) as n from scored where target is not null group by 1) select distinct ids, n from g where n > 1")
def a30(spark, d):
    g = ledger(spark, d).where("target is not null").groupBy("target").agg(F.array_sort(F.collect_set("root_key")).alias("ids"))
    return g.where(F.size("ids") > 1).select(F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n")).distinct()


@query("a32_consensus", f"with r as (select o_orderpriority as packet, o_custkey % 50 as grp, o_orderkey % 3 as reviewer, o_orderstatus as decision, o_orderkey from orders), f as (select packet, grp, count(*) filter (reviewer < 2) as n, count(distinct decision) filter (reviewer < 2) as d, min(decision) filter (reviewer < 2) as lo, max(decision) filter (reviewer = 2) as adj, count(*) filter (reviewer = 2) as n_adj from (select packet, grp, reviewer, arg_min(decision, o_orderkey) as decision from r group by 1, 2, 3) group by 1, 2) select packet, grp, case when n = 2 and d = 1 then lo when n_adj = 1 then adj end as decision from f")
def a32(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("packet"), (F.col("o_custkey") % 50).alias("grp"), (F.col("o_orderkey") % 3).alias("reviewer"), F.col("o_orderstatus").alias("decision"), "o_orderkey")
    return L.consensus(o.groupBy("packet", "grp", "reviewer").agg(F.min_by("decision", "o_orderkey").alias("decision")))


@query("a33_competing_responses", f"with {cte('run_events')} select run_id, phase, count(*) as n, count(distinct type) as kinds, count(distinct type) > 1 as competing from run_events group by 1, 2")
def a33(spark, d):
    return view(spark, d, "run_events").groupBy("run_id", "phase").agg(F.count("*").alias("n"), F.countDistinct("type").alias("kinds"), (F.countDistinct("type") > 1).alias("competing"))


@query("a35_version_hash", f"with {cte('candidates')} select remediation_key, sha256(string_agg(candidate_id || ':' || coalesce(status, ''), '|' order by candidate_id)) as digest from candidates group by 1")
def a35(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("candidate_id", F.coalesce("status", F.lit("")).alias("s"))))
    return view(spark, d, "candidates").groupBy("remediation_key").agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["candidate_id"], F.lit(":"), r["s"])), "|"), 256).alias("digest"))


@query("a37_large_scale", f"with {cte('files')}, u as (select unit, count(*) as n, cast(sum(loc) as bigint) as loc, cast(sum(bytes) as bigint) as bytes from files group by 1) select unit, n > 85 or loc > 28000 or bytes > 2200000 as large from u")
def a37(spark, d):
    u = view(spark, d, "files").groupBy("unit").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes"))
    return u.select("unit", ((F.col("n") > 85) | (F.col("loc") > 28000) | (F.col("bytes") > 2200000)).alias("large"))


@query("a38_usage_reconcile", f"with {cte('run_events')}, l as (select run_id, attempt, arg_max(value, seq) as value from run_events group by 1, 2) select run_id, round(sum(value), 4) as usage, count(*) as attempts from l group by 1")
def a38(spark, d):
    latest = view(spark, d, "run_events").groupBy("run_id", "attempt").agg(F.max_by("value", "seq").alias("value"))
    return latest.groupBy("run_id").agg(F.round(F.sum("value"), 4).alias("usage"), F.count("*").alias("attempts"))


@query("a39_circuit_breaker", f"with {cte('run_events')}, r as (select run_id, type, value, row_number() over (partition by run_id order by seq desc) as rn from run_events) select run_id, bool_or(value > 200) or (count(*) filter (rn <= 3) = 3 and bool_and(type = 'error') filter (rn <= 3)) as opened from r group by 1")
def a39(spark, d):
    return L.circuit_breaker(view(spark, d, "run_events"))


@query("d01_keep_first", f"with {cte('candidates')} select remediation_key, candidate_id from candidates qualify row_number() over (partition by remediation_key order by ord) = 1")
def d01(spark, d):
    return view(spark, d, "candidates").groupBy("remediation_key").agg(F.min_by("candidate_id", "ord").alias("candidate_id"))


@query("d02_fold_duplicates", f"with {NORMAL}, r as (select *, row_number() over (partition by root_key order by w desc, case when length(evidence) > 0 then 0 else 1 end, ord) as rn, first_value(candidate_id) over (partition by root_key order by w desc, case when length(evidence) > 0 then 0 else 1 end, ord) as rep from scored) select candidate_id, case when rn = 1 then st else 'FOLDED_INTO' end as status, case when rn = 1 then null else rep end as folded_into, rn = 1 and inc as score_included from r")
def d02(spark, d):
    return L.deduplicate(ledger(spark, d)).select("candidate_id", F.when(F.col("representative"), F.col("status")).otherwise("FOLDED_INTO").alias("status"), F.when(~F.col("representative"), F.col("rep")).alias("folded_into"), (F.col("representative") & F.col("included")).alias("score_included"))


@query("d03_equivalence_clusters", f"""with {NORMAL}, t1 as (select 1 as tier, root_key as key, count(*) as members from scored group by root_key having count(*) >= 2), t2 as (select 2 as tier, target as key, count(*) as members from scored where target is not null group by target having count(distinct root_key) >= 2),
    inside as (select distinct a.target, b.root_key from (select distinct target, candidate_id from scored where target is not null) a join scored b on b.candidate_id = a.candidate_id join t1 on t1.key = b.root_key
        group by a.target, b.root_key having count(distinct a.candidate_id) = (select count(distinct candidate_id) from scored c where c.target = a.target))
    select * from t1 union all select * from t2 where key not in (select target from inside)""")
def d03(spark, d):
    return L.equivalence_clusters(ledger(spark, d))


@query("d05_set_difference", f"with {cte('files')} select unit from files where file_id % 2 = 0 except select unit from files where file_id % 50 = 1")
def d05(spark, d):
    f = view(spark, d, "files")
    return f.where("file_id % 2 = 0").select("unit").distinct().join(f.where("file_id % 50 = 1").select("unit"), "unit", "left_anti")


@query("d06_missing_unexpected", "select 'missing' as kind, p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 25) union all select 'unexpected', l_partkey from (select distinct l_partkey from lineitem where l_quantity > 25) where l_partkey not in (select p_partkey from part)")
def d06(spark, d):
    planned = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    done = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("id")).distinct()
    return L.set_compare(planned, done, "id")


@query("d07_uniqueness", f"with {cte('candidates')} select remediation_key as key, count(*) as n from candidates group by 1 having count(*) > 1")
def d07(spark, d):
    return L.repeated(view(spark, d, "candidates"), "remediation_key")


@query("d08_repeat_filter", "select conv_id, turn from conversations c where role = 'user' and not exists (select 1 from conversations p where p.role = 'user' and lower(trim(p.text)) = lower(trim(c.text)) and (p.conv_id < c.conv_id or (p.conv_id = c.conv_id and p.turn < c.turn)))")
def d08(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    return c.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("f")).select("f.conv_id", "f.turn")


@query("d09_union_in_order", f"with {cte('candidates', 'classifications')} select 'ledger' as src, candidate_id, status from candidates union all select 'classification', candidate_id, status from classifications")
def d09(spark, d):
    a = view(spark, d, "candidates").select(F.lit("ledger").alias("src"), "candidate_id", "status")
    return a.unionByName(view(spark, d, "classifications").select(F.lit("classification").alias("src"), "candidate_id", "status"))


@query("d10_patch_merge", f"with {cte('candidates', 'classifications')} select coalesce(c.candidate_id, p.candidate_id) as candidate_id, coalesce(p.severity, c.severity) as severity, p.candidate_id is not null as patched from candidates c full join (select * from classifications where severity is not null) p on c.candidate_id = p.candidate_id")
def d10(spark, d):
    p = view(spark, d, "classifications").where("severity is not null").select("candidate_id", F.col("severity").alias("new"), F.lit(True).alias("patched"))
    return view(spark, d, "candidates").select("candidate_id", "severity").join(p, "candidate_id", "full").select("candidate_id", F.coalesce("new", "severity").alias("severity"), F.coalesce("patched", F.lit(False)).alias("patched"))


@query("d12_unfolded_groups", f"with {NORMAL} select root_key, count(*) as scored from scored where inc group by 1 having count(*) >= 2 and bool_and(folded_into is null) and not bool_and(reason = 'because')")
def d12(spark, d):
    g = ledger(spark, d).where("included").groupBy("root_key").agg(F.count("*").alias("scored"), F.bool_and(F.col("folded_into").isNull()).alias("open"), F.bool_and(F.col("reason") == "because").alias("distinct_all"))
    return g.where("scored >= 2 and open and not distinct_all").select("root_key", "scored")


@query("d13_publication_gate", f"with {NORMAL}, {_CLASSIFIED}, v as ({_VIOLATIONS_SQL}) select 'violations' as gate, count(*) as n, count(*) = 0 as ok from v union all select 'duplicates', count(*), count(*) = 0 from (select root_key from scored where inc group by 1 having count(*) > 1)")
def d13(spark, d):
    rows = ledger(spark, d)
    gate = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("gate"), "n", (F.col("n") == 0).alias("ok"))
    return gate("violations", L.violations(classified(spark, d))).unionByName(gate("duplicates", L.repeated(rows.where("included"), "root_key")))
