"""Queries of the gate before publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ledger as L
from tallyloom.operators import review as R
from tallyloom.plans.bindings import table
from tallyloom.plans.ledger import _CLASSIFIED, _VIOLATIONS_SQL, NORMAL, classified, ledger
from tallyloom.plans.registry import query

#: Five candidates in order are a reviewed group; the fields of group k.
_GROUP = {
    "group_id": "'g' || cast(k as string)",
    "decision": "case k % 7 when 0 then ' merge' when 1 then 'SPLIT' when 2 then 'Keep ' when 3 then 'FOLDED_INTO' when 4 then null else 'MERGE' end",
    "reason": "case when k % 3 = 0 then 'apart' when k % 3 = 1 then ' ' end",
}
_FIELDS = ", ".join(f"{e} as {n}" for n, e in _GROUP.items())
#: Members, the representative and the instances, as the rule reads them; group k has no members if 11 divides it and a stranger as representative if 13 does.
_G = f"""g as (select k, {_FIELDS}, ids, case when k % 13 = 0 then 'stranger' else ids[1] end as rep, k % 5 = 0 as inst, sc from
  (select ord // 5 as k, case when (ord // 5) % 11 = 0 then [] else list(candidate_id order by ord) end as ids, case when (ord // 5) % 11 = 0 then 0 else count(*) filter (inc) end as sc from scored group by 1, (ord // 5) % 11)),
q as (select *, upper(trim(coalesce(decision, ''))) as d, coalesce(length(trim(reason)) > 0, false) as r from g),
gv as (select group_id, unnest(case when d not in ('MERGE', 'SPLIT', 'KEEP') then ['EQUIVALENCE_GROUP_DECISION_INVALID'] when len(ids) = 0 then ['EQUIVALENCE_GROUP_MEMBERS_MISSING']
  when d = 'MERGE' then list_filter([case when not list_contains(ids, rep) then 'EQUIVALENCE_MERGE_REPRESENTATIVE_INVALID' end, case when sc > 1 then 'MERGED_GROUP_MULTIPLE_SCORE_INCLUDED' end,
    case when not inst then 'MERGE_AFFECTED_INSTANCES_MISSING' end], lambda x: x is not null)
  when not r then ['EQUIVALENCE_' || d || '_REASON_MISSING'] else [] end) as code from q)"""


def _groups(spark, d):
    c = ledger(spark, d).selectExpr("ord div 5 as k", "ord", "candidate_id")
    g = c.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ord", "candidate_id"))).alias("all"))
    g = g.selectExpr("k", *(f"{e} as {n}" for n, e in _GROUP.items()), "case when k % 11 = 0 then array() else all.candidate_id end as members")
    return g.selectExpr("group_id", "decision", "reason", "members", "case when k % 13 = 0 then 'stranger' else get(members, 0) end as representative", "case when k % 5 = 0 then array('x') end as affected_instances")


@query("d11_review_groups", f"with {NORMAL}, {_G} select group_id, code from gv")
def d11(spark, d):
    return R.group_violations(_groups(spark, d), ledger(spark, d))


_D13 = f"""with {NORMAL}, {_CLASSIFIED}, {_G}, v as ({_VIOLATIONS_SQL}),
told as (select distinct unnest(ids) as candidate_id from q where d in ('SPLIT', 'KEEP') and r),
u as (select root_key, count(*) filter (inc) as n from scored left join told using (candidate_id) group by 1
  having count(*) > 1 and count(*) filter (st = 'FOLDED_INTO') = 0 and count(*) filter (inc and told.candidate_id is null) > 0)
select level, code, count(*) as n from (
  select 'error' as level, code from gv union all select 'error', code from v union all select case when n > 1 then 'error' else 'warning' end, 'UNFOLDED_ROOT_CAUSE_GROUP' from u
  union all select 'error', 'DISPUTED_UNRESOLVED_AT_PUBLISH' from scored where st = 'DISPUTED' union all select 'error', 'PENTEST_ROUTE_COVERAGE_INCOMPLETE' from scored where st = 'PENDING_PENTEST'
  union all select 'error', 'EQUIVALENCE_REVIEW_INCOMPLETE' union all select 'error', 'EQUIVALENCE_REVIEW_COVERAGE_INCOMPLETE' from (select count(*) as n from scored where inc) where n > 7
  union all select 'warning', 'PROVENANCE_MISSING' union all select 'error', 'SCORE_NOT_PROVIDED') group by 1, 2"""


@query("d13_publication_violations", _D13)
def d13(spark, d):
    """The report's counts by level and code; the operator gives a row for each candidate, group or cause."""
    review = table(spark, d, "region").limit(1).selectExpr("'open' as status", "7 as reviewed_count", "0 as unresolved")
    scenarios = ledger(spark, d).where("status = 'OUT_OF_SCOPE'").selectExpr("candidate_id as scenario_id", "candidate_id")
    found = R.publication_gate(ledger(spark, d), _groups(spark, d), review, scenarios, L.violations(classified(spark, d)))
    return found.groupBy("level", "code").agg(F.count("*").alias("n"))


#: Lines of orders as findings.
_FINDING = {
    "finding_id": "cast(l_orderkey as string) || ':' || cast(l_linenumber as string) || ':' || cast(l_partkey as string)",
    "verdict": "case l_suppkey % 5 when 0 then 'supported' when 1 then 'unsupported' when 2 then 'abstain' when 3 then 'escalate' end",
    "evidence": "cast(case when l_partkey % 4 = 0 then 0 else l_linenumber end as int)",
    "severity": "case l_linenumber % 4 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'LOW' end",
    "evidence_class": "case when l_returnflag = 'R' then 'documentation' else 'code' end",
    "reachability": "case l_partkey % 5 when 0 then 'confirmed' when 1 then 'plausible' when 2 then 'theoretical' when 3 then 'confirmed' end",
    "rationale": "repeat('because ', cast(l_quantity as int) % 6)",
    "confidence": "cast(1 - l_discount * 2 as double)",
}
_F = ", ".join(f"{e} as {n}" for n, e in _FINDING.items())
_F11 = f"""with f as (select {_F}, l_suppkey % 3 as u, l_partkey % 7 as p from lineitem)
select finding_id, unnest(list_filter([case when verdict in ('supported', 'unsupported') and evidence = 0 then 'evidence' end, case when verdict in ('abstain', 'escalate') and u = 0 then 'unresolved' end,
  case when severity in ('CRITICAL', 'HIGH') and (evidence_class = 'documentation' or coalesce(reachability, '') not in ('confirmed', 'plausible')) then 'reachability' end,
  case when severity in ('CRITICAL', 'HIGH') and (p = 0 or length(trim(rationale)) < 20) then 'rationale' end, case when confidence > 0.9e0 and coalesce(reachability, '') <> 'confirmed' then 'confidence' end], lambda x: x is not null)) as code from f"""


@query("f11_finding_constraints", _F11)
def f11(spark, d):
    lists = ("case when l_suppkey % 3 = 0 then array() else array('u') end as unresolved", "case when l_partkey % 7 > 0 then array('p') end as preconditions")
    return R.submit_violations(table(spark, d, "lineitem").selectExpr(*(f"{e} as {n}" for n, e in _FINDING.items()), *lists))
