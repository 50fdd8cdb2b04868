"""Ledger operators: normal form, constraints, scores, representatives and folds. Each groups or ranks on its key with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S


def normal(candidates: DataFrame) -> DataFrame:
    """Status (missing: UNCLASSIFIED), score_status (missing: CONFIRMED), severity, root_key, weight and whether the row counts for the score."""
    raw = F.col("status")
    return (
        candidates.withColumn("score_status", S.status_token(raw, "CONFIRMED"))
        .withColumn("status", S.status_token(raw, "UNCLASSIFIED"))
        .withColumn("severity", S.severity(F.col("severity")))
        .withColumn("root_key", S.first_truthy(F.col("remediation_key"), F.col("root_cause_location"), F.col("candidate_id")))
        .withColumn("weight", S.weight(F.col("severity")))
        .withColumn("included", S.scored(F.col("status"), F.col("severity"), F.col("score_included")))
    )


def inventory_class(path: Column) -> Column:
    """The first class whose rule holds."""
    return F.when(path.endswith(".lock"), "dependency").when(path.rlike(r"\.(ts|py|go|rs|js)$"), "source").when(path.endswith(".tf"), "security").when(path.endswith(".md"), "doc").otherwise("other")


def flags(rows: DataFrame, column: str, rules: dict[str, str], otherwise: str) -> DataFrame:
    """A row for each rule that holds; one with `otherwise` if none does."""
    found = F.array_compact(F.array(*(F.when(F.col(column).rlike(p), name) for name, p in rules.items())))
    return rows.select(column, F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))).alias("flag"))


def codes(rows: DataFrame, rules: dict[str, Column], key: str = "candidate_id") -> DataFrame:
    """A row for each rule that a row breaks."""
    return rows.select(key, F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))).alias("code"))


#: The final statuses, and of some the code of a row that has none of the fields which its status demands.
STATUSES = ("CANDIDATE", "CONFIRMED", "DOWNGRADED", "FOLDED_INTO", "BACKLOG", "EXCLUDED", "PENDING_PENTEST", "PENDING_EXTERNAL", "FALSE_POSITIVE", "OUT_OF_SCOPE", "DISPUTED", "UNCLASSIFIED")
DEMANDS = {
    "DOWNGRADED": ("DOWNGRADE_REASON_MISSING", ("downgrade_reason", "severity_rationale")),
    "BACKLOG": ("BACKLOG_REASON_MISSING", ("backlog_reason", "rationale", "next_step")),
    "EXCLUDED": ("EXCLUSION_REASON_MISSING", ("exclusion_reason", "excluded_category", "rationale", "reason")),
    "PENDING_EXTERNAL": ("PENDING_EXTERNAL_CONTEXT_MISSING", ("required_access", "external_system")),
    "PENDING_PENTEST": ("PENDING_PENTEST_ROUTE_MISSING", ("pentest_route",)),
    "FOLDED_INTO": ("FOLDED_TARGET_MISSING", ("folded_into",)),
    "FALSE_POSITIVE": ("FALSE_POSITIVE_COUNTER_EVIDENCE_MISSING", ("counter_evidence", "exclusion_reason")),
    "OUT_OF_SCOPE": ("OUT_OF_SCOPE_REASON_MISSING", ("scope_reason", "exclusion_reason")),
    "DISPUTED": ("DISPUTE_REASON_MISSING", ("dispute_reason", "decision_needed")),
}
EVIDENCE_FIELDS, VALIDITY_FIELDS = ("evidence", "evidence_ref", "file", "location"), ("reachable", "business_relevance", "exploit_path")


def _has_any(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """Some of the fields that the rows have has content."""
    return F.coalesce(*(F.when(S.has_content(F.col(f)), True) for f in fields if f in rows.columns), F.lit(False))


def violations(rows: DataFrame) -> DataFrame:
    """What each status demands: a row for each code that a candidate (in normal form) breaks. A field that the rows don't have is missing in all."""
    status = F.col("status")
    none_valid = ~_has_any(rows, VALIDITY_FIELDS)
    return codes(
        rows,
        {
            "INVALID_STATUS": ~status.isin(*STATUSES),
            "CANDIDATE_UNCLASSIFIED": status.isin("UNCLASSIFIED", "CANDIDATE"),
            "MISSING_EVIDENCE": status.isin("CONFIRMED", "DOWNGRADED") & ~_has_any(rows, EVIDENCE_FIELDS),
            **{code: (status == s) & ~_has_any(rows, fields) for s, (code, fields) in DEMANDS.items()},
            "CONFIRMED_VALIDITY_MISSING": (status == "CONFIRMED") & F.col("severity").isin("CRITICAL", "HIGH") & none_valid,
        },
    )


def appraisal(rows: DataFrame, fields: list[str]) -> DataFrame:
    """All fields missing on a severe row is an error; any missing is a warning."""
    missing = sum((F.when(S.has_content(F.col(f)), 0).otherwise(1) for f in fields), F.lit(0)).cast("long")
    level = F.when((missing == len(fields)) & F.col("severity").isin("CRITICAL", "HIGH"), "error").when(missing > 0, "warning").otherwise("ok")
    return rows.select("candidate_id", missing.alias("missing"), level.alias("level"))


def in_window(line: Column, low: Column, high: Column, margin: int) -> Column:
    """Within the bounds and a margin; without bounds always."""
    return F.coalesce(line.between(F.greatest(F.lit(1), low - margin), high + margin), F.lit(True))


def leaks(texts: DataFrame, sealed: DataFrame) -> DataFrame:
    """Texts that contain a sealed text in any case.

    A sealed text that is contained has its longest word in the text too, so pairs are found by an equality join on words and only these are looked into.
    """
    words = lambda c: F.split(F.lower(c), r"\s+")
    inner = sealed.select("item_id", F.lower("text").alias("needle")).withColumn("inner", F.slice(F.split("needle", r"\s+"), 2, F.greatest(F.size(F.split("needle", r"\s+")) - 2, F.lit(0))))
    anchored = inner.withColumn("anchor", F.expr("reduce(inner, '', (a, w) -> if(length(w) > length(a), w, a))"))
    # A needle of one or two words has no word that must stand free: the few such needles are compared with every text.
    short = anchored.where("anchor = ''").select("item_id", "needle")
    long = anchored.where("anchor <> ''").select("item_id", "needle", "anchor")
    hay = texts.select("doc_id", F.lower("text").alias("hay"))
    # Only ids and words meet the anchors; a text moves once for each needle whose anchor it has.
    met = hay.select("doc_id", F.explode(F.array_distinct(words(F.col("hay")))).alias("anchor")).join(long, "anchor").select(F.col("doc_id").alias("met"), "item_id", "needle").distinct()
    found = hay.join(met, F.col("doc_id").eqNullSafe(F.col("met"))).where(F.col("hay").contains(F.col("needle")))
    return found.select("doc_id", "item_id").unionByName(hay.join(short, F.col("hay").contains(F.col("needle"))).select("doc_id", "item_id"))


ZERO_WIDTH = "​‌‍⁠﻿"


def markers(rows: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """Names of the patterns that a text matches once zero-width characters are gone."""
    plain = F.translate(F.col(column), ZERO_WIDTH, "")
    return rows.withColumn("markers", F.array_join(F.array_compact(F.array(*(F.when(plain.rlike(p), name) for name, p in patterns.items()))), ","))


def only_keys(json: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))) == 0


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def summary(rows: DataFrame) -> DataFrame:
    """Zero-filled counts in one pass."""
    by = lambda c, v: _count(F.col(c) == v)
    status = {"confirmed": "CONFIRMED", "downgraded": "DOWNGRADED", "false_positive": "FALSE_POSITIVE", "pending": "PENDING_EXTERNAL", "unclassified": "UNCLASSIFIED"}
    sev = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "info": "INFO", "structural": "STRUCTURAL_WEAKNESS"}
    return rows.agg(F.count("*").alias("total"), *(by("status", v).alias(k) for k, v in status.items()), *(by("severity", v).alias(k) for k, v in sev.items()), (by("status", "UNCLASSIFIED") == 0).alias("publishable"))


def score_counts(rows: DataFrame, keys: list[str] | None = None, with_cvss: bool = False) -> DataFrame:
    """Counts by severity of the rows that score, and if asked their greatest CVSS score; a missing status scores as confirmed."""
    scoring = rows.where(S.scored(F.col("score_status"), F.col("severity"), F.col("score_included")))
    cvss = [F.max("cvss").alias("max_cvss")] if with_cvss else []
    return scoring.groupBy(*(keys or [])).agg(*(_count(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")), *cvss)


def with_score(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    w = {k.lower(): v for k, v in (weights or S.WEIGHTS).items()}
    return counts.withColumn("score", F.greatest(F.lit(0).cast("long"), F.lit(100).cast("long") - sum((F.col(k) * v for k, v in w.items()), F.lit(0).cast("long"))))


def decide(scores: DataFrame, most_high: int = 2, least: int = 70, none_of: tuple[str, ...] = ("critical",), cvss_gate: float = 9.0) -> DataFrame:
    """passes: no finding of the zero-tolerance severities, few high ones, no CVSS score at the gate (column max_cvss, if there is one), and enough points."""
    passes = (F.col("high") <= most_high) & (F.col("score") >= least)
    for severity in none_of:
        passes = passes & (F.col(severity) == 0)
    if "max_cvss" in scores.columns:
        passes = passes & F.coalesce(F.col("max_cvss") < cvss_gate, F.lit(True))
    return scores.withColumn("passes", passes)



def representatives(rows: DataFrame) -> DataFrame:
    """Of each root cause the heaviest row, then one with evidence, then the first: an aggregate, so a common cause is reduced before it moves."""
    rank = F.struct((-F.col("weight")).alias("w"), F.when(F.length("evidence") > 0, 0).otherwise(1).alias("e"), F.col("ord").alias("o"))
    return rows.groupBy("root_key").agg(F.min_by("candidate_id", rank).alias("candidate_id"))


def deduplicate(rows: DataFrame) -> DataFrame:
    """rep and representative for each row."""
    reps = representatives(rows).withColumnRenamed("candidate_id", "rep")
    return rows.join(reps, "root_key").withColumn("representative", F.col("candidate_id") == F.col("rep"))


def merged_instances(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order in which they are first seen."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("instances"))


def committed_budget(events: DataFrame) -> DataFrame:
    """For each attempt the larger of what was used and what was charged, or reserved where nothing was."""
    value = F.col("value")
    used = F.coalesce(F.sum(F.when(F.col("type") == "purchase", value)), F.lit(0.0))
    charged = F.coalesce(F.max(F.when(F.col("type") == "click", value)), F.max(value))
    return events.groupBy("run_id", "attempt").agg(F.greatest(used, charged).alias("c")).groupBy("run_id").agg(F.sum("c").alias("committed"))


def cost_guard(events: DataFrame, attempt_limit: float, run_limit: float) -> DataFrame:
    running = F.sum("value").over(W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("running", running).withColumn("decision", F.when(F.col("value") > attempt_limit, "attempt").when(F.col("running") > run_limit, "run").otherwise("ok"))


def cause_inventory(rows: DataFrame) -> DataFrame:
    """Facts of each cause; no total where any row is unclassified."""
    return rows.groupBy("root_key").agg(
        F.max("weight").alias("top_weight"), F.countDistinct("target").alias("targets"), F.countDistinct("route").alias("routes"),
        F.countDistinct(F.when(F.col("evidence") != "", F.col("evidence"))).alias("evidence_items"), F.when(~F.bool_or(F.col("status") == "UNCLASSIFIED"), F.count("*")).alias("total"),
    )


def consensus(judgments: DataFrame) -> DataFrame:
    """Two reviewers (0, 1) that agree decide; else exactly one adjudicator (2)."""
    mine = F.col("reviewer") < 2
    g = judgments.groupBy("packet", "grp").agg(_count(mine).alias("n"), F.countDistinct(F.when(mine, F.col("decision"))).alias("d"), F.min(F.when(mine, F.col("decision"))).alias("lo"), F.max(F.when(~mine, F.col("decision"))).alias("adj"), _count(~mine).alias("n_adj"))
    return g.select("packet", "grp", F.when((F.col("n") == 2) & (F.col("d") == 1), F.col("lo")).when(F.col("n_adj") == 1, F.col("adj")).alias("decision"))


def circuit_breaker(events: DataFrame) -> DataFrame:
    """Opened by any pressure signal, or by three failures at the end of a run's events in order."""
    last = W.partitionBy("run_id").orderBy(F.col("seq").desc())
    r = events.withColumn("rn", F.row_number().over(last))
    tail = F.col("rn") <= 3
    return r.groupBy("run_id").agg((F.bool_or(F.col("value") > 200) | ((_count(tail) == 3) & F.bool_and(F.when(tail, F.col("type") == "error")))).alias("opened"))


def equivalence_clusters(rows: DataFrame) -> DataFrame:
    """Tier 1: a root cause with two rows or more; tier 2: a target under two root causes or more whose ids aren't all in one group of tier 1."""
    one = rows.groupBy("root_key").agg(F.count("*").alias("members")).where("members >= 2")
    targets = rows.where("target is not null").groupBy("target").agg(F.count("*").alias("members"), F.countDistinct("root_key").alias("causes"), F.countDistinct("candidate_id").alias("ids"))
    two = targets.where("causes >= 2")
    # How many of a target's ids each group of tier 1 has: ids meet their groups by a join on the id.
    in_one = rows.join(one.select("root_key"), "root_key").select("candidate_id", F.col("root_key").alias("group")).distinct()
    met = rows.where("target is not null").select("target", "candidate_id").distinct().join(in_one, "candidate_id").groupBy("target", "group").agg(F.count("*").alias("met"))
    most = met.groupBy("target").agg(F.max("met").alias("met"))
    two = two.join(most, "target", "left").where("met is null or met < ids")
    return one.select(F.lit(1).alias("tier"), F.col("root_key").alias("key"), "members").unionByName(two.select(F.lit(2).alias("tier"), F.col("target").alias("key"), "members"))


def set_compare(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return planned.join(done, key, "left_anti").select(F.lit("missing").alias("kind"), key).unionByName(done.join(planned, key, "left_anti").select(F.lit("unexpected").alias("kind"), key))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
