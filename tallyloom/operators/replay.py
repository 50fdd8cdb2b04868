"""Replay of run ledgers: every event is held against the state before it, without a task for each run.

An illegal event ends a replay, so an event may be judged as if all events before it were legal: the first that is illegal under that assumption is the
one at which a fold in order would stop. Under it, all that an event has to know of the past is a last value or a sum, over its run (status, budget, inputs,
publication, revisions, active attempts) or over its attempt (status, usage, reservation). These are prefix scans, by attempt first, then by run, in
which neither a run nor an attempt has to fit a task.

Events have the columns of EVENT. `log` names the ledger, `pos` the place in it. One row for each ledger comes back: either the code and place of its first
illegal event, or the state after its last. An event that can't be read (unknown type, missing parts) spoils its ledger wherever it stands, as ledgers are
read before they are replayed. Repeated rows are repeated event ids; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graphs import cut
from tallyloom.operators.scans import prefix_scan

EVENT = (
    "log string, pos long, run_id string, seq long, event_id string, type string, domain string, budget double, previous_budget double, input_revision long, manifest_sha string, parent_manifest_sha string, "
    "parent_trigger_sha string, phase string, round string, attempt long, cost double, complete boolean, receipt_id string, resources string, attempt_key string, amount double, recovered boolean, charged double, "
    "stage string, revision long, invalidated array<string>, preserve boolean, reason string, artifact_sha string, role string"
)

#: The event types.
ATTEMPT_TYPES = ("phase.started", "attempt.received", "usage.reconciled", "phase.context-compacted", "phase.result-identity-bound", "phase.completed", "phase.failed")
BUDGET_TYPES = ("budget.reserved", "budget.settled")
REVISION_TYPES = ("analysis.revised", "evaluation.reopened")
OTHER_TYPES = (
    "run.created", "input.recorded", "input.revised", "run.budget-increased", "analysis.checkpoint", "coverage.finalized", "run.completed", "run.incomplete", "run.awaiting-input", "run.resumed", "run.blocked",
    "publication.completed",
)
TYPES = ATTEMPT_TYPES + BUDGET_TYPES + REVISION_TYPES + OTHER_TYPES
#: What may follow once a run no longer runs; phases that a reopened evaluation starts anew.
ADMINISTRATIVE = ("usage.reconciled", "analysis.revised", "evaluation.reopened", "run.budget-increased")
DOWNSTREAM = ("evaluate", "report")

_is = lambda *types: F.col("type").isin(*types)
_some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
_true = lambda c: F.coalesce(c, F.lit(False))


def unreadable() -> F.Column:
    """Whether an event lacks what its type asks for."""
    needs = [
        (("run.created",), _some("domain") & F.coalesce(F.col("budget") > 0, F.lit(True))),
        (("input.recorded", "input.revised"), _true(F.col("input_revision") >= 0) & _some("manifest_sha")),
        (ATTEMPT_TYPES, _some("phase") & _true(F.col("attempt") >= 1) & F.coalesce(F.col("round") != "", F.lit(True))),
        (("attempt.received", "usage.reconciled"), _true(F.col("cost") >= 0)),
        (("usage.reconciled",), _some("receipt_id")),
        (("run.budget-increased",), F.coalesce(F.col("budget") > 0, F.lit(True)) & F.coalesce(F.col("previous_budget") > 0, F.lit(True))),
        (BUDGET_TYPES, _some("attempt_key")),
        (("budget.reserved",), _true(F.col("amount") > 0)),
        (("budget.settled",), _true(F.col("charged") >= 0) & F.col("complete").isNotNull()),
        (("analysis.checkpoint",), _true(F.col("stage").isin("units", "review"))),
        (("phase.failed", "run.incomplete", "run.awaiting-input", "run.blocked", *REVISION_TYPES), _some("reason")),
        (REVISION_TYPES, _true(F.col("revision") >= 1) & F.col("invalidated").isNotNull()),
        (("run.awaiting-input", "publication.completed", "coverage.finalized"), _some("artifact_sha")),
    ]
    bad = ~_true(_is(*TYPES)) | ~_some("event_id") | ~_some("run_id") | ~_true(F.col("seq") >= 1)
    for types, need in needs:
        bad = bad | (_true(_is(*types)) & ~need)
    return bad


def _with_attempts(events: DataFrame) -> DataFrame:
    """events with what each has to know of its attempt (a_*), and for revisions of the attempts that they name (n_*)."""
    own = events.where(_is(*ATTEMPT_TYPES, *BUDGET_TYPES)).select("log", "pos", "run_id", "seq", "type", "key", "unreadable", "phase", "round", "cost", "complete", "receipt_id", "resources", "recovered", F.lit(0).alias("named"))
    named = events.where(_is(*REVISION_TYPES)).select("log", "pos", "type", F.explode(F.array_distinct("invalidated")).alias("key"), F.lit(1).alias("named"))
    when = lambda types, value: F.when(_is(*types) & (F.col("named") == 0), value)
    sets = {
        "s_status": F.when(F.col("named") == 0, F.create_map(*(F.lit(x) for p in (("phase.started", "started"), ("attempt.received", "received"), ("phase.completed", "completed"), ("phase.failed", "failed")) for x in p))[F.col("type")]),
        "s_phase": when(["phase.started"], F.col("phase")), "s_round": when(["phase.started"], F.struct("round")), "s_resources": when(["phase.started"], F.struct(F.coalesce("resources", F.lit("")).alias("v"))),
        "s_cost": when(["attempt.received", "usage.reconciled"], F.col("cost")),
        # A first receipt replaces what was known of the accounting; a later one only adds to it.
        "s_complete": F.when(_is("attempt.received") | (_is("usage.reconciled") & F.col("complete").isNotNull()), F.struct(F.col("complete").alias("v"))),
        "s_gone": F.when(F.col("named") == 1, F.lit(True)), "s_reserved": when(["budget.reserved"], F.lit(1)).cast("long"), "s_settled": when(["budget.settled"], F.lit(1)).cast("long"),
    }
    touches = own.unionByName(named, allowMissingColumns=True).withColumns(sets)
    last = {f"a_{c}": f"s_{c}" for c in ("status", "phase", "round", "resources", "cost", "complete", "gone")}
    told = prefix_scan(touches, ["log", "key"], ["pos", "named"], last=last, total={"a_reserved": "s_reserved", "a_settled": "s_settled"}, name="attempts")
    known = ["log", "pos", *last, "a_reserved", "a_settled"]
    downstream = _true(F.col("a_phase").isin(*DOWNSTREAM))
    facts = told.where("named = 1").groupBy("log", "pos").agg(
        F.bool_or(F.col("a_status").isNull()).alias("n_unknown"), F.bool_or(~downstream).alias("n_other"), F.count(F.when(downstream & F.col("a_gone").isNull(), 1)).alias("n_gone"),
        F.count(F.when((F.col("a_status") == "completed") & F.col("a_gone").isNull(), 1)).alias("n_completed_gone"),
    )
    receipts = prefix_scan(told.where((F.col("named") == 0) & _is("usage.reconciled")).select("log", "pos", "receipt_id"), ["log", "receipt_id"], ["pos"], last={"r_seen": "pos"}, name="receipts").select("log", "pos", "r_seen")
    touched = told.where("named = 0").drop("named", *sets)
    touched = touched.where(_is("usage.reconciled")).join(receipts, ["log", "pos"]).unionByName(touched.where(~_is("usage.reconciled")), allowMissingColumns=True)
    revised = events.where(_is(*REVISION_TYPES)).join(facts, ["log", "pos"], "left")
    rest = events.where(~_is(*ATTEMPT_TYPES, *BUDGET_TYPES, *REVISION_TYPES))
    assert set(known) <= set(touched.columns)
    return touched.unionByName(revised, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def _run_sets() -> dict[str, F.Column]:
    """What an event sets of its run's state; null where it leaves it."""
    status = {"run.created": "running", "run.awaiting-input": "awaiting-input", "run.resumed": "running", "run.completed": "completed", "run.incomplete": "incomplete", "run.blocked": "blocked", "analysis.revised": "running", "evaluation.reopened": "running"}
    return {
        "s_status": F.create_map(*(F.lit(x) for p in status.items() for x in p))[F.col("type")],
        "s_created": F.when(_is("run.created"), F.struct("run_id", "domain")),
        "s_budget": F.when(_is("run.created", "run.budget-increased"), F.struct(F.col("budget").alias("v"))),
        "s_input": F.when(_is("input.recorded", "input.revised"), F.struct(F.col("input_revision").alias("revision"), F.col("manifest_sha").alias("sha"), F.col("parent_manifest_sha").isNotNull().alias("parent"))),
        "s_awaiting": F.when(_is("run.awaiting-input"), F.col("artifact_sha")),
        "s_stage": F.when(_is("analysis.checkpoint"), F.struct(F.col("stage").alias("v"))).when(_is("analysis.revised") & ~_true(F.col("preserve")), F.struct(F.lit(None).cast("string").alias("v"))),
        "s_published": F.when(_is("publication.completed"), True).when(_is(*REVISION_TYPES), False),
        "s_covered": F.when(_is("coverage.finalized"), True).when(_is("analysis.revised"), False),
        "s_revision": F.when(_is("analysis.revised"), F.col("revision")),
        "s_block": F.when(_is("run.blocked", "run.incomplete"), F.struct(F.col("reason").alias("v"))).when(_is(*REVISION_TYPES), F.struct(F.lit(None).cast("string").alias("v"))),
    }


def _run_sums() -> dict[str, F.Column]:
    count = lambda up, down=F.lit(False): F.when(_true(up), 1).when(_true(down), -1).otherwise(0).cast("long")
    gone = F.coalesce(F.col("n_gone"), F.lit(0))
    return {
        "d_active": count(_is("phase.started"), _is("phase.completed", "phase.failed")),
        "d_evaluations": count(_is("evaluation.reopened")),
        "d_downstream": (count(_is("phase.started") & F.col("phase").isin(*DOWNSTREAM)) - gone).cast("long"),
        "d_spent": F.when(_is("attempt.received", "usage.reconciled"), F.col("cost") - F.coalesce("a_cost", F.lit(0.0))).otherwise(0.0),
        "d_attempts": count(_is("phase.started")),
        "d_receipts": count(_is("usage.reconciled")),
        "d_unsettled": count(_is("budget.reserved"), _is("budget.settled")),
    }


def _code(publishing: tuple[str, ...]) -> F.Column:
    """Why an event is illegal in the state before it, by the first rule that it breaks; null if it is legal."""
    status, has = F.col("p_status"), lambda c: F.col(c).isNotNull()
    ended, active = F.col("a_status").isin("completed", "failed"), F.col("p_active") > 0
    later = _is("attempt.received", "phase.context-compacted", "phase.result-identity-bound", "phase.completed", "phase.failed")
    closes = _is("run.completed", "run.incomplete")
    same_cost = F.col("a_cost").eqNullSafe(F.col("cost")) & _true(F.col("complete"))
    waits = (status == "awaiting-input") & _is("input.revised", "run.resumed")
    rules = [
        (F.col("p_seq").isNull() & ~_is("run.created"), "not-created"),
        (has("id_seen"), "repeated-id"),
        (has("p_created") & (F.col("run_id") != F.col("p_created.run_id")), "other-run"),
        (F.col("seq") != F.coalesce("p_seq", F.lit(0)) + 1, "seq-gap"),
        (has("p_status") & (status != "running") & ~_is("run.created", *ADMINISTRATIVE) & ~waits, "ended"),
        (_is("run.created") & has("p_seq"), "duplicate-created"),
        (_is("run.budget-increased") & ~F.col("p_budget.v").eqNullSafe(F.col("previous_budget")), "budget-conflict"),
        (_is("run.budget-increased") & has("budget") & ~_true(F.col("budget") > F.col("p_budget.v")), "budget-not-raised"),
        (_is("budget.reserved") & (~has("a_status") | ((F.col("a_status") != "started") & ~_true(F.col("recovered")))), "reservation-without-attempt"),
        (_is("budget.reserved") & (F.col("a_reserved") > 0), "duplicate-reservation"),
        (_is("budget.settled") & ((F.col("a_reserved") == 0) | (F.col("a_settled") > 0)), "settlement-without-reservation"),
        (_is("usage.reconciled") & ~has("a_status"), "receipt-without-attempt"),
        (_is("usage.reconciled") & has("r_seen"), "duplicate-receipt"),
        (_is("usage.reconciled") & _true(F.col("a_complete.v")) & ~same_cost, "receipt-conflict"),
        (_is("evaluation.reopened") & (F.col("revision") != F.col("p_evaluations") + 1), "revision-gap"),
        (_is("analysis.revised") & (F.col("revision") != F.coalesce("p_revision", F.lit(0)) + 1), "revision-gap"),
        (_is(*REVISION_TYPES) & active, "active-attempts"),
        (_is("analysis.revised") & _true(F.col("n_unknown")), "unknown-attempt"),
        (_is("evaluation.reopened") & _true(F.col("n_other")), "not-downstream"),
        (_is("evaluation.reopened") & (F.col("p_downstream") - F.coalesce("n_gone", F.lit(0)) > 0), "downstream-left"),
        (_is("analysis.checkpoint") & _true(F.col("p_stage.v") == "review"), "sealed"),
        (_is("input.recorded") & has("p_input"), "duplicate-input"),
        (_is("input.recorded") & ((F.col("input_revision") != 0) | has("parent_manifest_sha")), "not-first-input"),
        (_is("input.revised") & ((status != "awaiting-input") | ~has("p_input")), "not-awaiting"),
        (_is("input.revised") & (F.col("input_revision") != F.col("p_input.revision") + 1), "input-gap"),
        (_is("input.revised") & ~(F.col("parent_manifest_sha").eqNullSafe(F.col("p_input.sha")) & F.col("parent_trigger_sha").eqNullSafe(F.col("p_awaiting"))), "input-lineage"),
        (_is("phase.started") & has("a_status"), "already-started"),
        (later & ~has("a_status"), "not-started"),
        (later & ended, "attempt-ended"),
        (_is("phase.result-identity-bound", "phase.completed") & (F.col("a_status") != "received"), "no-provider-receipt"),
        (_is("attempt.received") & (F.col("a_status") == "received"), "duplicate-provider-receipt"),
        (_is("phase.completed") & (F.coalesce("resources", F.lit("")) != F.col("a_resources.v")), "resources-differ"),
        (_is("run.resumed") & ((status != "awaiting-input") | ~_true(F.col("p_input.parent"))), "not-revised"),
        (closes & active, "active-attempts"),
        (closes & F.col("p_created.domain").isin(*publishing) & ~_true(F.col("p_published")) if publishing else F.lit(False), "unpublished"),
        (_is("publication.completed") & _true(F.col("p_published")), "duplicate-publication"),
        (_is("publication.completed") & ~F.col("role").eqNullSafe("host"), "not-host"),
    ]
    code = F.when(F.col("unreadable"), "unreadable")
    for wrong, name in rules:
        code = code.when(_true(wrong), name)
    return code


#: Parts of events that only some types need.
_PARTS = {
    "domain": ("run.created",), "budget": ("run.created", "run.budget-increased"), "previous_budget": ("run.budget-increased",), "input_revision": ("input.recorded", "input.revised"), "manifest_sha": ("input.recorded", "input.revised"),
    "parent_manifest_sha": ("input.recorded", "input.revised"), "parent_trigger_sha": ("input.revised",), "stage": ("analysis.checkpoint",), "revision": REVISION_TYPES, "invalidated": REVISION_TYPES, "preserve": ("analysis.revised",),
    "reason": ("run.blocked", "run.incomplete"), "artifact_sha": ("run.awaiting-input",), "role": ("publication.completed",), "phase": ("phase.started",), "round": ("phase.started",), "cost": ("attempt.received", "usage.reconciled"),
    "complete": ("attempt.received", "usage.reconciled"), "receipt_id": ("usage.reconciled",), "resources": ("phase.started", "phase.completed"), "recovered": ("budget.reserved",),
}
#: What _code asks of an event itself; all else is known by what it sets and adds.
_ASKED = (
    "log", "pos", "type", "run_id", "seq", "unreadable", "budget", "previous_budget", "recovered", "cost", "complete", "revision", "input_revision", "parent_manifest_sha", "parent_trigger_sha", "resources", "role",
    "a_status", "a_cost", "a_complete", "a_resources", "a_reserved", "a_settled", "r_seen", "n_unknown", "n_other", "n_gone",
)


def judged(events: DataFrame, publishing: tuple[str, ...] = ()) -> DataFrame:
    """log, pos and `code`, why an event is illegal if all before it are legal, with the run's state before it (p_*) and after it (s_* or p_*, d_* to be added).

    Events are written once, without the parts that their types don't need; a scan takes only what it or the rules ask for.
    """
    key = F.when(_is(*BUDGET_TYPES), F.col("attempt_key")).otherwise(F.concat_ws(":", "phase", F.coalesce("round", F.lit("-")), F.col("attempt").cast("string")))
    parts = [F.when(_is(*types), F.col(c)).alias(c) for c, types in _PARTS.items()]
    events = cut(events.select("log", "pos", "run_id", "seq", "event_id", "type", *parts, key.alias("key"), unreadable().alias("unreadable")), "events")
    seen = prefix_scan(events.select("log", "event_id", "pos"), ["log", "event_id"], ["pos"], last={"id_seen": "pos"}, name="ids").where("id_seen is not null").select(F.col("log").alias("_log"), F.col("pos").alias("_pos"), "id_seen")
    sets, sums = _run_sets(), _run_sums()
    marked = _with_attempts(events).withColumns(sets | sums | {"s_seq": F.col("seq")}).select(*_ASKED, *sets, *sums, "s_seq")
    marked = marked.join(seen, F.col("log").eqNullSafe(F.col("_log")) & (F.col("pos") == F.col("_pos")), "left").drop("_log", "_pos")
    last = {"p_" + c[2:]: c for c in (*sets, "s_seq")}
    return prefix_scan(marked, ["log"], ["pos"], last=last, total={"p_" + c[2:]: c for c in sums}, name="runs").withColumn("code", _code(publishing))


def replayed(events: DataFrame, publishing: tuple[str, ...] = ()) -> DataFrame:
    """A row for each log: its first illegal event (error, error_pos), or the state after its last event, rounded costs included. publishing: domains whose
    runs can't be completed without a publication."""
    told = judged(events, publishing)
    after = lambda c: F.coalesce(f"s_{c}", f"p_{c}")
    state = {
        "run_id": after("created")["run_id"], "domain": after("created")["domain"], "status": after("status"), "last_seq": after("seq"), "max_budget": after("budget")["v"], "input_revision": after("input")["revision"],
        "stage": after("stage")["v"], "published": _true(after("published")), "covered": _true(after("covered")), "analysis_revision": after("revision"), "block_reason": after("block")["v"],
        "attempts": F.col("p_attempts") + F.col("d_attempts"), "active": F.col("p_active") + F.col("d_active"), "evaluations": F.col("p_evaluations") + F.col("d_evaluations"),
        "receipts": F.col("p_receipts") + F.col("d_receipts"), "unsettled": F.col("p_unsettled") + F.col("d_unsettled"), "total_cost": F.round(F.col("p_spent") + F.col("d_spent"), 6),
    }
    wrong = F.when(F.col("code").isNotNull(), F.struct((F.col("code") != "unreadable").alias("later"), "pos", "code"))
    rows = told.select("log", "pos", wrong.alias("wrong"), F.struct(*(v.alias(n) for n, v in state.items())).alias("s"))
    ok = F.col("first").isNull()
    return rows.groupBy("log").agg(F.min("wrong").alias("first"), F.max_by("s", "pos").alias("s")).select("log", F.col("first.code").alias("error"), F.col("first.pos").alias("error_pos"), *(F.when(ok, F.col(f"s.{n}")).alias(n) for n in state))


def completed_phases(events: DataFrame) -> DataFrame:
    """log, phase: what has been completed and not superseded, as the names of phases with their rounds. Meant for logs that replayed() finds legal."""
    key = F.concat_ws(":", "phase", F.coalesce("round", F.lit("-")), F.col("attempt").cast("string"))
    done = events.where(_is("phase.completed")).select("log", key.alias("key"), F.concat_ws(":", "phase", "round").alias("name"))
    gone = events.where(_is(*REVISION_TYPES)).select("log", F.explode("invalidated").alias("key"))
    return done.join(gone, ["log", "key"], "left_anti").select("log", F.col("name").alias("phase")).distinct()
