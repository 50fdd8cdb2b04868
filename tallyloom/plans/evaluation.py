"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import evaluation as E
from tallyloom.operators import joins as J
from tallyloom.plans.bindings import cte, view
from tallyloom.plans.registry import query

_CONF = "count(*) filter (decided = 1 and truth = 1) as tp, count(*) filter (decided = 1 and truth = 0) as fp, count(*) filter (decided = 0 and truth = 1) as fn"


@query("a06_precision_recall", f"with {cte('predictions')}, c as (select {_CONF} from predictions) select tp, fp, fn, cast(tp as double) / nullif(tp + fp, 0) as precision, cast(tp as double) / nullif(tp + fn, 0) as recall from c")
def a06(spark, d):
    return E.confusion(view(spark, d, "predictions")).drop("f1")


@query("a07_severity_accuracy", f"with {cte('predictions')} select case when severity > expected then 'over' when severity < expected then 'under' when severity = expected then 'exact' else 'unknown' end as direction, count(*) as n from predictions group by 1")
def a07(spark, d):
    s, e = F.col("severity"), F.col("expected")
    return view(spark, d, "predictions").groupBy(F.when(s > e, "over").when(s < e, "under").when(s == e, "exact").otherwise("unknown").alias("direction")).agg(F.count("*").alias("n"))


@query("a08_cause_quality", f"with {cte('predictions')}, c as (select prediction_id % 7 as project, {_CONF}, count(*) filter (not valid) as unresolved from predictions group by 1), r as (select *, cast(tp as double) / nullif(tp + fp, 0) as precision, cast(tp as double) / nullif(tp + fp + unresolved, 0) as lower_bound, cast(tp as double) / nullif(tp + fn, 0) as recall from c) select project, tp, fp, fn, precision, lower_bound, recall, round(2 * precision * recall / nullif(precision + recall, 0), 10) as f1, coalesce(precision >= 0.5e0 and recall >= 0.9e0, false) as passes from r")
def a08(spark, d):
    p = view(spark, d, "predictions").withColumn("project", F.col("prediction_id") % 7)
    open_ = p.groupBy("project").agg(F.count(F.when(~F.col("valid"), 1)).alias("unresolved"))
    c = E.confusion(p, ["project"]).join(open_, "project")
    total = F.col("tp") + F.col("fp") + F.col("unresolved")
    return c.select("project", "tp", "fp", "fn", "precision", F.when(total != 0, F.col("tp") / total).alias("lower_bound"), "recall", F.round("f1", 10).alias("f1"), F.coalesce((F.col("precision") >= 0.5) & (F.col("recall") >= 0.9), F.lit(False)).alias("passes"))


@query("a09_benchmark_rates", f"with {cte('predictions')}, l as (select prediction_id // 5 as label, bool_and(valid) as valid, max(decided) as found, max(truth) as truth from predictions group by 1) select count(*) filter (truth = 1) as labels, count(*) filter (truth = 1 and found = 1) as hit, count(*) filter (truth = 1 and found = 1 and valid) as valid_hits, count(*) filter (truth = 0 and found = 1) as false_hits, case when count(*) filter (truth = 1 or found = 1) = 0 then 0e0 else cast(count(*) filter (truth = 0 and found = 1) as double) / count(*) filter (truth = 1 or found = 1) end as fpr from l")
def a09(spark, d):
    l = view(spark, d, "predictions").groupBy(F.expr("prediction_id div 5").alias("label")).agg(F.bool_and("valid").alias("valid"), F.max("decided").alias("found"), F.max("truth").alias("truth"))  # noqa: E741
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return l.agg(n("truth = 1").alias("labels"), n("truth = 1 and found = 1").alias("hit"), n("truth = 1 and found = 1 and valid").alias("valid_hits"), n("truth = 0 and found = 1").alias("false_hits"), F.when(n("truth = 1 or found = 1") == 0, 0.0).otherwise(n("truth = 0 and found = 1") / n("truth = 1 or found = 1")).alias("fpr"))


@query("a10_mean_of_means", f"with {cte('observations')}, v as (select case_id, repetition, avg(value) filter (arm = 'A') - avg(value) filter (arm = 'N') as diff from observations group by 1, 2), c as (select case_id, avg(diff) as m from v where diff is not null group by 1 having count(diff) >= 3) select count(*) as cases, round(avg(m), 8) as mean from c")
def a10(spark, d):
    return J.paired(view(spark, d, "observations"), "A", "N", 3).agg(F.count("*").alias("cases"), F.round(F.avg("difference"), 8).alias("mean"))


_DECLARED = ["c0", "c1", "c2"]


def _cases(spark, d):
    """Observations by corpus as capabilities; the seventh line of an order fails a hard gate, if it is of corpus 1."""
    seen = view(spark, d, "observations").withColumn("capability", F.concat(F.lit("c"), "corpus"))
    metrics = {"primary": "value", "evidence": "evidence", "false_positive": "fpr"}
    return E.paired_cases(seen, ["capability", "case_id"], "A", "N", 3, metrics, (F.col("gate") == 0) & (F.col("corpus") == 1)).withColumn("case", F.col("case_id").cast("string"))


@query("a11_bootstrap_interval")
def a11(spark, d):
    return E.bootstrap_by(_cases(spark, d), "capability", "primary", "case", 10_000, 0.05 / 9, "17 + cast(substr(capability, 2) as bigint)")


@query("a12_claim_decision")
def a12(spark, d):
    out = E.compared_arms(_cases(spark, d), "capability", _DECLARED, 10_000, 17, 0.05, 0.02, 0.02, 10)
    return out.select("capability", "cases", "pairs", "baseline_failures", "candidate_failures", *(f"{m}_{e}" for m in E.SEED_OFFSETS for e in ("mean", "low", "high")), "decision")


@query("a13_arm_averages", f"with {cte('observations')} select arm, round(avg(value), 8) as value, round(avg(fpr), 8) as fpr, round(avg(case when gate = 0 then 1e0 else 0e0 end), 8) as gate_rate, count(*) as n from observations group by 1")
def a13(spark, d):
    return view(spark, d, "observations").groupBy("arm").agg(F.round(F.avg("value"), 8).alias("value"), F.round(F.avg("fpr"), 8).alias("fpr"), F.round(F.avg((F.col("gate") == 0).cast("double")), 8).alias("gate_rate"), F.count("*").alias("n"))


@query("j19_judgment_labels", f"with {cte('predictions')} select p.prediction_id, l.doc_id is not null as labelled, coalesce(l.quality, -1) as quality from predictions p left join (select doc_id, quality from labels where doc_id % 2 = 0) l on l.doc_id = p.prediction_id")
def j19(spark, d):
    from tallyloom.plans.bindings import table

    l = table(spark, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("prediction_id"), "quality")  # noqa: E741
    return view(spark, d, "predictions").select("prediction_id").join(l, "prediction_id", "left").select("prediction_id", F.col("quality").isNotNull().alias("labelled"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("t08_arm_order")
def t08(spark, d):
    return E.shuffled_by(view(spark, d, "observations"), "repetition", "arm", 17)


@query("z10_provenance", f"with {cte('observations')} select case_id, count(distinct corpus) as corpora, count(distinct corpus) = 1 as consistent from observations group by 1")
def z10(spark, d):
    return view(spark, d, "observations").groupBy("case_id").agg(F.countDistinct("corpus").alias("corpora"), (F.countDistinct("corpus") == 1).alias("consistent"))


@query("z11_observation_keys", f"with {cte('observations')} select case_id, repetition, arm, count(*) as n from observations group by 1, 2, 3 having count(*) > 1")
def z11(spark, d):
    return view(spark, d, "observations").groupBy("case_id", "repetition", "arm").agg(F.count("*").alias("n")).where("n > 1")


@query("z12_adjacency_lists", f"with {cte('edges')} select src, string_agg(distinct cast(dst as varchar), ',' order by cast(dst as varchar)) as targets from edges where flag = 'R' group by 1")
def z12(spark, d):
    return view(spark, d, "edges").where("flag = 'R'").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ",").alias("targets"))
