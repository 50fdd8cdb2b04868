"""The gate before publication: reviewed groups, groups left unfolded, disputes, routes, the score, and all of it as one table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import has_content
from tallyloom.operators.ledger import score_counts, with_score

DECISIONS = ("MERGE", "SPLIT", "KEEP")
RESOLUTIONS = ("ciso_decision", "ciso_acknowledged", "dispute_resolution", "resolution")


def _has(df: DataFrame, *names: str) -> Column:
    """Some of these columns, those that there are, has content."""
    return F.coalesce(*(F.when(has_content(F.col(n).cast("string")), True) for n in names if n in df.columns), F.lit(False))


def _groups(groups: DataFrame) -> DataFrame:
    members = F.filter(F.transform(F.coalesce("members", F.array().cast("array<string>")), lambda m: F.trim(m)), has_content)
    reason = lambda own: _has(groups, own, "rationale", "reason")
    instances = F.coalesce(F.size("affected_instances") > 0, F.lit(False)) if "affected_instances" in groups.columns else F.lit(False)
    decision = F.upper(F.trim(F.coalesce("decision", F.lit(""))))
    return groups.select(
        F.coalesce("group_id", F.lit("UNKNOWN")).alias("group_id"), decision.alias("decision"), members.alias("members"), F.trim(F.coalesce("representative", F.lit(""))).alias("representative"),
        F.when(decision == "SPLIT", reason("split_reason")).otherwise(reason("keep_reason")).alias("has_reason"), _has(groups, "split_reason", "keep_reason", "rationale", "reason").alias("declared"),
        instances.alias("has_instances"),
    )


def group_violations(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(group_id, code): what reviewed groups lack.

    groups (group_id, decision, members, representative; if there are any split_reason, keep_reason, rationale, reason, affected_instances) have an id once, null
    is UNKNOWN; candidates (ord, candidate_id, included; if there is one affected_instances) are in normal form; of repeated ids the last by ord counts.
    A group whose decision isn't MERGE, SPLIT or KEEP, or that has no members, has that violation alone. A MERGE names a representative among its members, has one
    member at most that scores (a member that is listed twice counts twice), and the group or its representative records instances; SPLIT and KEEP give a reason. Members
    meet candidates in a join by id, so a group may have any number that fits its own row.
    """
    g = _groups(groups)
    instances = F.coalesce(F.size("affected_instances") > 0, F.lit(False)) if "affected_instances" in candidates.columns else F.lit(False)
    by_id = candidates.groupBy("candidate_id").agg(F.max_by(F.struct("included", instances.alias("instances")), "ord").alias("c")).select("candidate_id", "c.*")
    merges = g.where("decision = 'MERGE'")
    scored = merges.select("group_id", F.explode("members").alias("candidate_id")).join(by_id.where("included"), "candidate_id").groupBy("group_id").agg(F.count("*").alias("scored"))
    recorded = merges.select("group_id", F.col("representative").alias("candidate_id")).join(by_id.where("instances"), "candidate_id").select("group_id", F.lit(True).alias("recorded")).distinct()
    all_ = g.join(scored, "group_id", "left").join(recorded, "group_id", "left")
    merge = F.col("decision") == "MERGE"
    rules = {
        "EQUIVALENCE_MERGE_REPRESENTATIVE_INVALID": merge & ~F.array_contains("members", F.col("representative")),
        "MERGED_GROUP_MULTIPLE_SCORE_INCLUDED": merge & (F.col("scored") > 1),
        "MERGE_AFFECTED_INSTANCES_MISSING": merge & ~F.col("has_instances") & F.col("recorded").isNull(),
        "EQUIVALENCE_SPLIT_REASON_MISSING": (F.col("decision") == "SPLIT") & ~F.col("has_reason"),
        "EQUIVALENCE_KEEP_REASON_MISSING": (F.col("decision") == "KEEP") & ~F.col("has_reason"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    found = F.when(~F.col("decision").isin(*DECISIONS), F.array(F.lit("EQUIVALENCE_GROUP_DECISION_INVALID"))).when(F.size("members") == 0, F.array(F.lit("EQUIVALENCE_GROUP_MEMBERS_MISSING"))).otherwise(found)
    return all_.select("group_id", F.explode(found).alias("code"))


def unfolded_groups(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(root_key, level): causes with several candidates of which none is folded and some scoring one isn't declared distinct by a SPLIT or KEEP with a reason.

    error with two scoring ones or more, else warning. A cause of any size is counted before it moves.
    """
    declared = _groups(groups).where("decision in ('SPLIT', 'KEEP') and declared").select(F.explode("members").alias("candidate_id")).distinct().withColumn("distinct", F.lit(True))
    c = candidates.select("candidate_id", "root_key", "status", "included").join(declared, "candidate_id", "left")
    open_ = F.col("included") & F.col("distinct").isNull()
    by_cause = c.groupBy("root_key").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FOLDED_INTO").alias("folded"), F.count_if("included").alias("scored"), F.count_if(open_).alias("open"))
    return by_cause.where("n > 1 and folded = 0 and open > 0").select("root_key", F.when(F.col("scored") >= 2, "error").otherwise("warning").alias("level"))


def open_disputes(candidates: DataFrame) -> DataFrame:
    """(candidate_id) of disputed candidates without a decision, acknowledgement or resolution that says something."""
    return candidates.where((F.col("status") == "DISPUTED") & ~_has(candidates, *RESOLUTIONS)).select("candidate_id")


def unrouted(candidates: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(candidate_id) of candidates that wait for a test and have no route, or neither a scenario that names them nor one that they name.

    candidates with, if there are, pentest_required, pentest_route and scenario_refs (array); scenarios (scenario_id, candidate_id), a row for each candidate of one.
    """
    waits = F.col("status") == "PENDING_PENTEST"
    if "pentest_required" in candidates.columns:
        waits = waits | F.coalesce("pentest_required", F.lit(False))
    w = candidates.where(waits).withColumn("routed", _has(candidates, "pentest_route"))
    covered = w.select("candidate_id").join(scenarios.select("candidate_id").distinct(), "candidate_id", "left_semi")
    if "scenario_refs" in candidates.columns:
        refs = w.select("candidate_id", F.explode("scenario_refs").alias("scenario_id"))
        covered = covered.unionByName(refs.join(scenarios.select("scenario_id").distinct(), "scenario_id", "left_semi").select("candidate_id"))
    covered = covered.distinct().withColumn("covered", F.lit(True))
    return w.join(covered, "candidate_id", "left").where("not routed or covered is null").select("candidate_id")


def publication_gate(
    candidates: DataFrame, groups: DataFrame, review: DataFrame, scenarios: DataFrame, violations: DataFrame, reported_score: float | None = None, provenance: tuple[str | None, str | None] = (None, None),
    require_score: bool = True, require_review: bool = True, require_provenance: bool = False, allow_empty: bool = False,
) -> DataFrame:
    """(level, code, subject): all that stands against publication; the gate is open if no row has the level error.

    candidates are in normal form after the checks of citations and proofs, violations (candidate_id, code) what their statuses demand (`ledger.violations`), review has a
    row (status, reviewed_count, unresolved) or none, provenance is branch and commit. subject is the candidate, group or cause, null for the whole. Totals are a row each.
    """
    at = lambda df, code, subject, level="error": df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject") if subject else F.lit(None).cast("string").alias("subject"))
    level = lambda needed: "error" if needed else "warning"
    totals = candidates.agg(F.count("*").alias("n"), F.count_if("included").alias("scored"))
    reviews = review.agg(F.count("*").alias("reviews"), F.max(F.upper(F.trim("status"))).alias("status"), F.max("reviewed_count").alias("reviewed"), F.coalesce(F.max("unresolved"), F.lit(0)).alias("unresolved"))
    facts = totals.crossJoin(reviews)  # a row each
    there = F.col("reviews") > 0
    out = [
        at(facts.where("reviews = 0"), "EQUIVALENCE_REVIEW_MISSING", None, level(require_review)),
        at(facts.where(there & (F.coalesce("status", F.lit("")) != "COMPLETE")), "EQUIVALENCE_REVIEW_INCOMPLETE", None),
        at(facts.where(there & F.col("reviewed").isNull()), "EQUIVALENCE_REVIEW_COUNT_MISSING", None),
        at(facts.where(there & (F.col("reviewed") < F.col("scored"))), "EQUIVALENCE_REVIEW_COVERAGE_INCOMPLETE", None),
        at(facts.where(there & (F.col("unresolved") > 0)), "EQUIVALENCE_REVIEW_UNRESOLVED", None),
        group_violations(groups, candidates).select(F.lit("error").alias("level"), "code", F.col("group_id").alias("subject")),
        unfolded_groups(candidates, groups).select("level", F.lit("UNFOLDED_ROOT_CAUSE_GROUP").alias("code"), F.col("root_key").cast("string").alias("subject")),
        at(open_disputes(candidates), "DISPUTED_UNRESOLVED_AT_PUBLISH", "candidate_id"),
        violations.select(F.lit("error").alias("level"), "code", F.col("candidate_id").alias("subject")),
        at(unrouted(candidates, scenarios), "PENTEST_ROUTE_COVERAGE_INCOMPLETE", "candidate_id"),
    ]
    if not allow_empty:
        out.append(at(totals.where("n = 0"), "RAW_LEDGER_MISSING", None))
    if not all(p and p.strip() for p in provenance):
        out.append(at(totals, "PROVENANCE_MISSING", None, level(require_provenance)))
    if reported_score is None:
        out.append(at(totals, "SCORE_NOT_PROVIDED", None, level(require_score)))
    else:
        out.append(at(with_score(score_counts(candidates)).where(F.col("score") != F.lit(reported_score)), "SCORE_FORMULA_MISMATCH", None))
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def submit_violations(findings: DataFrame) -> DataFrame:
    """(finding_id, code): what a finding lacks to be submitted.

    findings (finding_id, verdict, evidence, unresolved, severity, evidence_class, reachability, preconditions, rationale, confidence); evidence counts the verified places,
    unresolved and preconditions are arrays. supported and unsupported need evidence, abstain and escalate what is unresolved; CRITICAL and HIGH need evidence that isn't
    documentation and is confirmed or plausible to be reached, a precondition and a rationale of 20 characters; a confidence above 0.9 needs confirmed reachability.
    Null counts as lacking, a null confidence as low.
    """
    none = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    grave = F.coalesce(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(False))
    reached = lambda *v: F.coalesce(F.col("reachability").isin(*v), F.lit(False))
    rules = {
        "evidence": F.col("verdict").isin("supported", "unsupported") & (F.coalesce("evidence", F.lit(0)) == 0),
        "unresolved": F.col("verdict").isin("abstain", "escalate") & none("unresolved"),
        "reachability": grave & (F.coalesce(F.col("evidence_class") == "documentation", F.lit(False)) | ~reached("confirmed", "plausible")),
        "rationale": grave & (none("preconditions") | (F.coalesce(F.length(F.trim("rationale")), F.lit(0)) < 20)),
        "confidence": (F.col("confidence") > 0.9) & ~reached("confirmed"),
    }
    return findings.select("finding_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("code"))
