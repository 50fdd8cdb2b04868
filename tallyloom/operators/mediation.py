"""Review notes: opinions on a subject's exact version, mediations that bind them, disputes and their resolutions, and what has become stale since.

notes: run, pos (the order in a run), id, sha256 (of the entry), kind (review-opinion, review-mediation, dispute, resolution), subject_path, subject_sha, topic, position, outcome (adopt, defer,
needs-information; of resolutions any), selected_id, selected_sha, opinions (array of id and sha256), refs (array of path and sha256), dispute_id.
versions: run, path, at, sha256: what a path holds from `at` on, until its next version. A reference is stale if the version that is valid when one asks isn't the one cited.

A note's own lists are short; everything that grows with a run or a subject is joined and counted, so neither has to fit a task. Null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graphs import cut
from tallyloom.operators.scans import prefix_scan

SUBJECT = ["run", "subject_path", "subject_sha", "topic"]
_REFS = "array<struct<path:string,sha256:string>>"
_OPINIONS = "array<struct<id:string,sha256:string>>"


def validity(versions: DataFrame) -> DataFrame:
    """versions with `until`, the time of the path's next version; null for the present one."""
    later = prefix_scan(versions.select("run", "path", "at", "sha256", (-F.col("at")).alias("_back")), ["run", "path"], ["_back"], last={"until": "at"}, name="validity")
    return later.select("run", "path", "at", "sha256", "until")


def stale_references(notes: DataFrame, versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """run, id, path of each reference whose path doesn't hold the cited version at `as_of` (null: now), with `since`, when the cited version ended (null if it never was)."""
    held = validity(versions)
    then = held.where("until is null") if as_of is None else held.where((F.col("at") <= as_of) & (F.col("until").isNull() | (F.col("until") > as_of)))
    cited = notes.select("run", "id", F.explode(F.coalesce(F.col("refs").cast(_REFS), F.array().cast(_REFS))).alias("r")).select("run", "id", F.col("r.path").alias("path"), F.col("r.sha256").alias("cited")).distinct()
    ends = held.where("until is not null").groupBy("run", "path", F.col("sha256").alias("cited")).agg(F.max("until").alias("since"))
    met = cited.join(then.select("run", "path", F.col("sha256").alias("now")), ["run", "path"], "left").where(~F.col("cited").eqNullSafe(F.col("now")))
    return met.join(ends, ["run", "path", "cited"], "left").groupBy("run", "id", "path").agg(F.max("since").alias("since"))


def _bound(mediations: DataFrame, opinions: DataFrame) -> DataFrame:
    """run, id (of a mediation), bound_before and bound_all: distinct opinions of its subject that it names by id and hash, among those before it and among all."""
    named = mediations.select(*SUBJECT, F.col("id").alias("mediation"), F.col("pos").alias("at"), F.explode("opinions").alias("o")).select(*SUBJECT, "mediation", "at", F.col("o.id").alias("id"), F.col("o.sha256").alias("sha256"))
    met = named.join(opinions.select(*SUBJECT, "id", "sha256", "pos"), [*SUBJECT, "id", "sha256"])
    return met.groupBy("run", F.col("mediation").alias("id")).agg(F.countDistinct(F.when(F.col("pos") < F.col("at"), F.col("id"))).alias("bound_before"), F.countDistinct("id").alias("bound_all"))


def note_violations(notes: DataFrame) -> DataFrame:
    """run, id, code of each opinion or mediation that breaks a rule, by the first that it breaks: subject-is-history, subject-not-cited, opinions-not-bound (every opinion before it exactly once),
    adopts-nothing (an opinion before it has to be selected), adopts-uncertain, selects-without-adopting, evidence-not-cited."""
    notes = _whole(notes).where(F.col("kind").isin("review-opinion", "review-mediation"))
    one = F.when(F.col("kind") == "review-opinion", 1).otherwise(0)
    seen = cut(prefix_scan(notes.withColumn("_one", one), SUBJECT, ["pos"], total={"before": "_one"}, name="opinions-before"), "notes-seen")
    opinions, mediations = seen.where("kind = 'review-opinion'"), seen.where("kind = 'review-mediation'")
    bound = _bound(mediations, opinions)
    chosen = mediations.select(*SUBJECT, F.col("id").alias("mediation"), F.col("pos").alias("at"), F.col("selected_id").alias("id"), F.col("selected_sha").alias("sha256")).join(opinions.select(*SUBJECT, "id", "sha256", "pos", "position"), [*SUBJECT, "id", "sha256"]).where("pos < at")
    picked = chosen.groupBy("run", F.col("mediation").alias("id")).agg(F.bool_or(F.col("position") == "uncertain").alias("uncertain"), F.lit(True).alias("picked"))
    paths = opinions.select(*SUBJECT, "pos", F.explode("refs").alias("r")).groupBy(*SUBJECT, F.col("r.path").alias("path")).agg(F.min("pos").alias("pos"))
    asked = mediations.select(*SUBJECT, "id", F.col("pos").alias("at")).join(paths, SUBJECT).where("pos < at").select("run", "id", "path")
    missing = asked.join(mediations.select("run", "id", F.explode("refs").alias("r")).select("run", "id", F.col("r.path").alias("path")), ["run", "id", "path"], "left_anti").select("run", "id").distinct().withColumn("missing", F.lit(True))
    told = seen.join(bound, ["run", "id"], "left").join(picked, ["run", "id"], "left").join(missing, ["run", "id"], "left")
    is_mediation, named = F.col("kind") == "review-mediation", F.size("opinions")
    distinct = F.size(F.array_distinct(F.transform("opinions", lambda o: o["id"])))
    cites = F.exists("refs", lambda r: (r["path"] == F.col("subject_path")) & (r["sha256"] == F.col("subject_sha")))
    adopts, true = F.col("outcome") == "adopt", lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(true(F.col("subject_path").startswith("review-notes/")), "subject-is-history").when(~true(cites), "subject-not-cited")
        .when(is_mediation & ~((named == F.col("before")) & (distinct == F.col("before")) & (F.coalesce("bound_before", F.lit(0)) == F.col("before"))), "opinions-not-bound")
        .when(is_mediation & true(adopts) & F.col("picked").isNull(), "adopts-nothing").when(is_mediation & true(adopts) & true(F.col("uncertain")), "adopts-uncertain")
        .when(is_mediation & ~true(adopts) & F.col("selected_id").isNotNull(), "selects-without-adopting").when(is_mediation & true(F.col("missing")), "evidence-not-cited")
    )
    return told.select("run", "id", code.alias("code")).where("code is not null")


def _whole(notes: DataFrame) -> DataFrame:
    return notes.withColumn("refs", F.coalesce(F.col("refs").cast(_REFS), F.array().cast(_REFS))).withColumn("opinions", F.coalesce(F.col("opinions").cast(_OPINIONS), F.array().cast(_OPINIONS)))


def mediation_summary(notes: DataFrame, versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """A row for each subject: opinions, mediations, conflicting (positions differ), decision_current (the last mediation binds all opinions), status (stale, awaiting-mediation, adopted, deferred,
    needs-information), selected (of an adopted one), stale_paths (that the status goes by) and historical_stale_paths (of the opinions). Notes should be legal."""
    notes = cut(_whole(notes).where(F.col("kind").isin("review-opinion", "review-mediation")), "notes")
    opinions, mediations = notes.where("kind = 'review-opinion'"), notes.where("kind = 'review-mediation'")
    stale = cut(stale_references(notes, versions, as_of), "stale")
    is_opinion = F.col("kind") == "review-opinion"
    last = F.max_by(F.when(~is_opinion, F.struct("id", "outcome", "selected_id", F.size("opinions").alias("named"), F.size(F.array_distinct(F.transform("opinions", lambda o: o["id"]))).alias("distinct"))), F.when(~is_opinion, F.col("pos"))).alias("last")
    groups = notes.groupBy(*SUBJECT).agg(F.count(F.when(is_opinion, 1)).alias("n_opinions"), F.count(F.when(~is_opinion, 1)).alias("n_mediations"), (F.countDistinct(F.when(is_opinion, F.col("position"))) > 1).alias("conflicting"), last)
    bound = _bound(mediations, opinions).select("run", F.col("id").alias("last_id"), "bound_all")
    of_last = stale.groupBy("run", F.col("id").alias("last_id")).agg(F.countDistinct("path").alias("last_stale"))
    of_opinions = opinions.select(*SUBJECT, "id").join(stale, ["run", "id"]).groupBy(*SUBJECT).agg(F.countDistinct("path").alias("historical"))
    told = groups.withColumn("last_id", F.col("last.id")).join(bound, ["run", "last_id"], "left").join(of_last, ["run", "last_id"], "left")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SUBJECT]
    told = told.alias("a").join(of_opinions.alias("b"), same[0] & same[1] & same[2] & same[3], "left").select("a.*", "b.historical")
    current = F.coalesce((F.col("last.named") == F.col("n_opinions")) & (F.col("last.distinct") == F.col("n_opinions")) & (F.coalesce("bound_all", F.lit(0)) == F.col("n_opinions")), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = told.withColumn("decision_current", current & F.col("last").isNotNull()).withColumn("stale_paths", F.when(F.col("decision_current"), zero("last_stale")).otherwise(zero("historical")))
    status = F.when(F.col("stale_paths") > 0, "stale").when(~F.col("decision_current"), "awaiting-mediation").when(F.col("last.outcome") == "adopt", "adopted").when(F.col("last.outcome") == "defer", "deferred").otherwise("needs-information")
    told = told.withColumn("status", status)
    return told.select(*SUBJECT, F.col("n_opinions").alias("opinions"), F.col("n_mediations").alias("mediations"), "conflicting", "decision_current", "status", F.when(F.col("status") == "adopted", F.col("last.selected_id")).alias("selected"), "stale_paths", zero("historical").alias("historical_stale_paths"))


def dispute_summary(notes: DataFrame, versions: DataFrame, as_of: int | None = None) -> DataFrame:
    """A row for each dispute: run, id, status (stale, the latest resolution's outcome, or open), latest resolution, resolutions and stale_paths (of the latest resolution, or of the dispute if it has none)."""
    notes = _whole(notes).where(F.col("kind").isin("dispute", "resolution"))
    stale = stale_references(notes, versions, as_of).groupBy("run", "id").agg(F.countDistinct("path").alias("n"))
    last = notes.where("kind = 'resolution'").groupBy("run", "dispute_id").agg(F.max_by(F.struct("id", "outcome"), "pos").alias("last"), F.count("*").alias("resolutions"))
    told = notes.where("kind = 'dispute'").select("run", "id").join(last.withColumnRenamed("dispute_id", "id"), ["run", "id"], "left").withColumn("by", F.coalesce(F.col("last.id"), F.col("id")))
    told = told.join(stale.select("run", F.col("id").alias("by"), "n"), ["run", "by"], "left").withColumn("stale_paths", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("stale_paths") > 0, "stale").otherwise(F.coalesce(F.col("last.outcome"), F.lit("open")))
    return told.select("run", "id", status.alias("status"), F.col("last.id").alias("latest"), F.coalesce("resolutions", F.lit(0)).alias("resolutions"), "stale_paths")
