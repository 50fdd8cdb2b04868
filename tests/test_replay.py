"""Replay by prefix scans against a fold of one event after the other."""

import random

from tallyloom.operators import replay

FIELDS = [f.strip().split(" ")[0] for f in replay.EVENT.split(",")]
PUBLISHING = ("journal",)


class Illegal(Exception):
    pass


def readable(e):
    g = e.get
    t, ok = g("type"), lambda c: bool(g(c))
    positive = lambda c: g(c) is None or g(c) > 0
    if t not in replay.TYPES or not ok("event_id") or not ok("run_id") or not (g("seq") or 0) >= 1:
        return False
    if t == "run.created":
        return ok("domain") and positive("budget")
    if t in ("input.recorded", "input.revised"):
        return g("input_revision") is not None and g("input_revision") >= 0 and ok("manifest_sha")
    if t in replay.ATTEMPT_TYPES:
        if not ok("phase") or (g("attempt") or 0) < 1 or g("round") == "":
            return False
        if t in ("attempt.received", "usage.reconciled") and not (g("cost") is not None and g("cost") >= 0):
            return False
        return {"usage.reconciled": ok("receipt_id"), "phase.failed": ok("reason")}.get(t, True)
    if t == "run.budget-increased":
        return positive("budget") and positive("previous_budget")
    if t == "budget.reserved":
        return ok("attempt_key") and (g("amount") or 0) > 0
    if t == "budget.settled":
        return ok("attempt_key") and g("charged") is not None and g("charged") >= 0 and g("complete") is not None
    if t == "analysis.checkpoint":
        return g("stage") in ("units", "review")
    if t in replay.REVISION_TYPES:
        return ok("reason") and (g("revision") or 0) >= 1 and g("invalidated") is not None
    if t == "run.awaiting-input":
        return ok("reason") and ok("artifact_sha")
    if t in ("publication.completed", "coverage.finalized"):
        return ok("artifact_sha")
    return ok("reason") if t in ("run.incomplete", "run.blocked") else True


class Run:
    """One run's state, changed by one legal event at a time."""

    def __init__(self):
        self.status = self.first = self.budget = self.input = self.awaiting = self.stage = self.revision = self.block = None
        self.seq, self.cost, self.evaluations = 0, 0.0, 0
        self.published = self.covered = False
        self.attempts, self.reserved, self.receipts, self.ids = {}, {}, set(), set()

    def need(self, legal, code):
        if not legal:
            raise Illegal(code)

    def active(self):
        return any(a["status"] in ("started", "received") for a in self.attempts.values())

    def apply(self, e):
        g, t, need = e.get, e["type"], self.need
        need(self.first is not None or t == "run.created", "not-created")
        need(e["event_id"] not in self.ids, "repeated-id")
        self.ids.add(e["event_id"])
        need(self.first is None or e["run_id"] == self.first["run_id"], "other-run")
        need(e["seq"] == self.seq + 1, "seq-gap")
        need(self.status in (None, "running") or t == "run.created" or t in replay.ADMINISTRATIVE or (self.status == "awaiting-input" and t in ("input.revised", "run.resumed")), "ended")
        key = f"{g('phase')}:{g('round') or '-'}:{g('attempt')}"
        a = self.attempts.get(key)
        if t == "run.created":
            need(self.first is None, "duplicate-created")
            self.first, self.status, self.budget = e, "running", g("budget")
        elif t == "run.budget-increased":
            need(self.budget == g("previous_budget"), "budget-conflict")
            need(g("budget") is None or (self.budget is not None and g("budget") > self.budget), "budget-not-raised")
            self.budget = g("budget")
        elif t == "budget.reserved":
            b = self.attempts.get(e["attempt_key"])
            need(b and (b["status"] == "started" or g("recovered")), "reservation-without-attempt")
            need(e["attempt_key"] not in self.reserved, "duplicate-reservation")
            self.reserved[e["attempt_key"]] = None
        elif t == "budget.settled":
            need(e["attempt_key"] in self.reserved and self.reserved[e["attempt_key"]] is None, "settlement-without-reservation")
            self.reserved[e["attempt_key"]] = g("charged")
        elif t == "usage.reconciled":
            need(a, "receipt-without-attempt")
            need(g("receipt_id") not in self.receipts, "duplicate-receipt")
            need(not a.get("complete") or (g("complete") and a["cost"] == g("cost")), "receipt-conflict")
            self.cost += g("cost") - a.get("cost", 0)
            a["cost"] = g("cost")
            if g("complete") is not None:
                a["complete"] = g("complete")
            self.receipts.add(g("receipt_id"))
        elif t in replay.REVISION_TYPES:
            again = t == "evaluation.reopened"
            need(e["revision"] == (self.evaluations if again else self.revision or 0) + 1, "revision-gap")
            need(not self.active(), "active-attempts")
            for k in e["invalidated"]:
                b = self.attempts.get(k)
                need(b and (not again or b["phase"] in replay.DOWNSTREAM), "not-downstream" if again else "unknown-attempt")
                b["gone"] = True
            need(not again or not any(not b.get("gone") and b["phase"] in replay.DOWNSTREAM for b in self.attempts.values()), "downstream-left")
            self.published, self.block, self.status = False, None, "running"
            if again:
                self.evaluations += 1
            else:
                self.revision, self.covered = e["revision"], False
                self.stage = self.stage if g("preserve") else None
        elif t == "coverage.finalized":
            self.covered = True
        elif t == "analysis.checkpoint":
            need(self.stage != "review", "sealed")
            self.stage = g("stage")
        elif t == "input.recorded":
            need(not self.input, "duplicate-input")
            need(g("input_revision") == 0 and g("parent_manifest_sha") is None, "not-first-input")
            self.input = e
        elif t == "input.revised":
            need(self.status == "awaiting-input" and self.input, "not-awaiting")
            need(g("input_revision") == self.input["input_revision"] + 1, "input-gap")
            need(g("parent_manifest_sha") == self.input["manifest_sha"] and g("parent_trigger_sha") == self.awaiting, "input-lineage")
            self.input = e
        elif t == "phase.started":
            need(not a, "already-started")
            self.attempts[key] = {"phase": g("phase"), "round": g("round"), "status": "started", "resources": g("resources") or ""}
        elif t in replay.ATTEMPT_TYPES:
            need(a, "not-started")
            need(a["status"] not in ("completed", "failed"), "attempt-ended")
            if t == "phase.result-identity-bound":
                need(a["status"] == "received", "no-provider-receipt")
            elif t == "attempt.received":
                need(a["status"] != "received", "duplicate-provider-receipt")
                self.cost += g("cost") - a.get("cost", 0)
                a |= {"status": "received", "cost": g("cost"), "complete": g("complete")}
            elif t == "phase.completed":
                need(a["status"] == "received", "no-provider-receipt")
                need(a["resources"] == (g("resources") or ""), "resources-differ")
                a["status"] = "completed"
            elif t == "phase.failed":
                a["status"] = "failed"
        elif t == "run.awaiting-input":
            self.status, self.awaiting = "awaiting-input", g("artifact_sha")
        elif t == "run.resumed":
            need(self.status == "awaiting-input" and self.input and self.input.get("parent_manifest_sha") is not None, "not-revised")
            self.status = "running"
        elif t in ("run.completed", "run.incomplete"):
            need(not self.active(), "active-attempts")
            need(self.first["domain"] not in PUBLISHING or self.published, "unpublished")
            self.status = t.removeprefix("run.")
            self.block = g("reason") if t == "run.incomplete" else self.block
        elif t == "publication.completed":
            need(not self.published, "duplicate-publication")
            need(g("role") == "host", "not-host")
            self.published = True
        elif t == "run.blocked":
            self.status, self.block = "blocked", g("reason")
        self.seq = e["seq"]


def folded(log, events):
    for e in events:
        if not readable(e):
            return (log, "unreadable", e["pos"], None)
    run = Run()
    for e in events:
        try:
            run.apply(e)
        except Illegal as wrong:
            return (log, str(wrong), e["pos"], None)
    unsettled = sum(v is None for v in run.reserved.values())
    return (log, None, None, (run.status, run.seq, run.budget, run.input and run.input["input_revision"], run.stage, run.published, run.covered, run.revision, run.block, len(run.attempts),
            sum(a["status"] in ("started", "received") for a in run.attempts.values()), run.evaluations, len(run.receipts), unsettled, round(run.cost, 6)))


def phases(events):
    run = Run()
    for e in events:
        run.apply(e)
    return {a["phase"] + (f":{a['round']}" if a["round"] else "") for a in run.attempts.values() if a["status"] == "completed" and not a.get("gone")}


def move(rnd, run):
    """An event that mostly suits the run's state."""
    attempts = list(run.attempts.items())
    of = lambda *status: [(k, a) for k, a in attempts if a["status"] in status]
    wild = rnd.random() < 0.03
    named = lambda k: dict(zip(("phase", "round", "attempt"), (k.split(":")[0], None if k.split(":")[1] == "-" else k.split(":")[1], int(k.split(":")[2])), strict=True))
    options = ["phase.started"] * 4 + ["coverage.finalized", "analysis.checkpoint", "run.budget-increased"]
    if run.status == "awaiting-input":
        options = ["input.revised", "run.resumed"] if run.input else ["run.resumed"]
        if run.input and run.input.get("parent_trigger_sha") == run.awaiting:
            options = ["run.resumed"]
    elif run.status != "running":
        options = ["analysis.revised", "usage.reconciled", "run.budget-increased"]
    else:
        options += ["attempt.received", "phase.context-compacted", "budget.reserved"] * 3 if of("started") else ["run.awaiting-input"] * bool(run.input) + ["analysis.revised", "evaluation.reopened"]
        options += ["phase.completed", "phase.result-identity-bound", "phase.completed"] * 2 if of("received") else []
        options += ["usage.reconciled", "budget.settled", "phase.failed"] if attempts else []
        options += [] if run.input else ["input.recorded"] * 3
        options += [] if run.published else ["publication.completed"]
        options += ["run.completed", "run.incomplete", "run.blocked"] * (rnd.random() < 0.1)
    t = rnd.choice(list(replay.TYPES)) if wild else rnd.choice(options)
    e = {"type": t, "reason": rnd.choice(["why", "so"]), "artifact_sha": f"a{rnd.randrange(99)}", "role": "host" if rnd.random() < 0.97 else "x", "stage": rnd.choice(["units", "units", "units", "review"]), "domain": rnd.choice(["other", "journal"]), "budget": rnd.choice([None, 5.0])}
    if t in replay.ATTEMPT_TYPES:
        pool = {"phase.started": [], "attempt.received": of("started"), "phase.completed": of("received"), "phase.result-identity-bound": of("received"), "usage.reconciled": attempts}.get(t, of("started", "received"))
        if pool and not wild:
            k, a = rnd.choice(pool)
            e |= named(k) | {"resources": a["resources"] or None}
        else:
            e |= {"phase": rnd.choice(["evaluate", "report", "scan", "plan"]), "round": rnd.choice([None, "r1"]), "attempt": 1 + len(attempts) if not wild else 1, "resources": rnd.choice([None, "res"])}
        e |= {"cost": rnd.choice([0.25, 1.5]), "complete": rnd.choice([None, False, True]), "receipt_id": f"r{rnd.randrange(200)}"}
        if t == "usage.reconciled" and pool and not wild and a.get("complete"):
            e |= {"cost": a["cost"], "complete": True}
    if t in replay.BUDGET_TYPES:
        pool = of("started") if t == "budget.reserved" else [(k, None) for k, v in run.reserved.items() if v is None]
        pool = [(k, x) for k, x in pool if t != "budget.reserved" or k not in run.reserved] or pool
        e |= {"attempt_key": rnd.choice(pool)[0] if pool else "scan:-:1", "amount": 2.0, "charged": 1.0, "complete": True, "recovered": rnd.choice([None, True])}
    if t == "run.budget-increased":
        e |= {"previous_budget": run.budget, "budget": None if run.budget is None or rnd.random() < 0.2 else run.budget + 1}
    if t in replay.REVISION_TYPES:
        again = t == "evaluation.reopened"
        keys = [k for k, a in attempts if a["phase"] in replay.DOWNSTREAM] if again else [k for k, _ in attempts if rnd.random() < 0.5]
        e |= {"revision": (run.evaluations if again else run.revision or 0) + 1, "invalidated": keys + keys[:1] + (["none:-:1"] if rnd.random() < 0.05 else []), "preserve": rnd.choice([None, True])}
        if wild and keys:
            e["invalidated"] = keys[1:]
    if t in ("input.recorded", "input.revised"):
        e |= {"input_revision": 0 if t == "input.recorded" else (run.input or {"input_revision": 0})["input_revision"] + 1, "manifest_sha": f"m{rnd.randrange(999)}"}
        if t == "input.revised" and run.input:
            e |= {"parent_manifest_sha": run.input["manifest_sha"], "parent_trigger_sha": run.awaiting}
    return e


def spoiled(rnd, e, run):
    """The same event with something about it that can't be."""
    e = dict(e)
    kind = rnd.randrange(8)
    if kind == 0:
        e["seq"] += 1
    elif kind == 1:
        e["run_id"] = "another"
    elif kind == 2 and run.ids:
        e["event_id"] = min(run.ids)
    elif kind == 3:
        e["type"] = "no.such"
    elif kind == 4:
        e |= {"revision": 7, "input_revision": 5, "previous_budget": 3.25}
    elif kind == 5:
        e |= {"resources": "elsewhere", "receipt_id": "r0", "parent_trigger_sha": "q"}
    elif kind == 6:
        e |= {"attempt": None, "reason": "", "cost": -1.0}
    return e


def random_log(rnd, log, n):
    run, out = Run(), []
    first = {"type": "run.created", "domain": rnd.choice(["other", "journal"]), "budget": rnd.choice([None, 3.0])}
    stopped = False
    for k in range(n):
        e = first if k == 0 and rnd.random() < 0.98 else move(rnd, run)
        e = {"run_id": f"run{log}", "seq": k + 1, "event_id": f"e{k}", **e}
        if rnd.random() < 0.012:
            e = spoiled(rnd, e, run)
        e |= {"log": log, "pos": 10 * k}
        out.append(e)
        if not stopped:
            try:
                if readable(e):
                    run.apply(e)
            except (Illegal, AttributeError, KeyError, TypeError):
                stopped = True
    return out


def test_replay_equals_the_fold(spark):
    rnd = random.Random(11)
    logs = {f"l{i}": random_log(rnd, f"l{i}", rnd.choice([1, 5, 20, 40, 80])) for i in range(500)}
    want = {log: folded(log, events) for log, events in logs.items()}
    codes = {w[1] for w in want.values()}
    rows = [tuple(e.get(f) for f in FIELDS) for events in logs.values() for e in events]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, replay.EVENT).repartition(6)
    state = ["status", "last_seq", "max_budget", "input_revision", "stage", "published", "covered", "analysis_revision", "block_reason", "attempts", "active", "evaluations", "receipts", "unsettled", "total_cost"]
    got = {r["log"]: (r["log"], r["error"], r["error_pos"], None if r["error"] else tuple(r[c] for c in state)) for r in replay.replayed(df, PUBLISHING).collect()}
    assert got == want
    assert None in codes and sum(w[1] is None for w in want.values()) > 50
    legal = [log for log, w in want.items() if w[1] is None]
    done = {}
    for r in replay.completed_phases(df).collect():
        done.setdefault(r["log"], set()).add(r["phase"])
    assert all(done.get(log, set()) == phases(logs[log]) for log in legal)
    assert len(codes) > 20, codes
    assert replay.replayed(df.limit(0)).count() == 0


def test_every_code_is_met(spark):
    """A log for each code: legal events, then the one that is wrong."""
    made = {"type": "run.created", "domain": "journal", "budget": 3.0}
    start = {"type": "phase.started", "phase": "scan", "attempt": 1}
    got = start | {"type": "attempt.received", "cost": 1.0, "complete": True}
    end = start | {"type": "phase.completed"}
    late = start | {"phase": "report"}
    whole = [late, late | {"type": "attempt.received", "cost": 1.0}, late | {"type": "phase.completed"}]
    reserve = {"type": "budget.reserved", "attempt_key": "scan:-:1", "amount": 1.0}
    settle = {"type": "budget.settled", "attempt_key": "scan:-:1", "charged": 1.0, "complete": True}
    receipt = start | {"type": "usage.reconciled", "cost": 1.0, "complete": True, "receipt_id": "r"}
    revise = {"type": "analysis.revised", "revision": 1, "reason": "x", "invalidated": []}
    reopen = revise | {"type": "evaluation.reopened"}
    first = {"type": "input.recorded", "input_revision": 0, "manifest_sha": "m0"}
    wait = {"type": "run.awaiting-input", "reason": "x", "artifact_sha": "t"}
    second = {"type": "input.revised", "input_revision": 1, "manifest_sha": "m1", "parent_manifest_sha": "m0", "parent_trigger_sha": "t"}
    publish = {"type": "publication.completed", "artifact_sha": "p", "role": "host"}
    sealed = {"type": "analysis.checkpoint", "stage": "review"}
    close = {"type": "run.completed"}
    raise_to = lambda a, b: {"type": "run.budget-increased", "previous_budget": a, "budget": b}
    cases = [
        ("not-created", [start]), ("repeated-id", [made, start | {"event_id": "0"}]), ("other-run", [made, start | {"run_id": "x"}]), ("seq-gap", [made, start | {"seq": 3}]), ("ended", [made, {"type": "run.blocked", "reason": "x"}, start]),
        ("duplicate-created", [made, made]), ("budget-conflict", [made, raise_to(2.0, 9.0)]), ("budget-not-raised", [made, raise_to(3.0, 3.0)]), ("reservation-without-attempt", [made, start, got, reserve]),
        ("duplicate-reservation", [made, start, reserve, reserve]), ("settlement-without-reservation", [made, start, reserve, settle, settle]), ("receipt-without-attempt", [made, receipt]), ("duplicate-receipt", [made, start, receipt, receipt]),
        ("receipt-conflict", [made, start, got, receipt | {"cost": 2.0}]), ("revision-gap", [made, reopen | {"revision": 2}]), ("active-attempts", [made, start, revise]), ("unknown-attempt", [made, revise | {"invalidated": ["scan:-:1"]}]),
        ("not-downstream", [made, start, got, end, reopen | {"invalidated": ["scan:-:1"]}]), ("downstream-left", [made, *whole, reopen]), ("sealed", [made, sealed, sealed]), ("duplicate-input", [made, first, first]),
        ("not-first-input", [made, first | {"input_revision": 1}]), ("not-awaiting", [made, first, second]), ("input-gap", [made, first, wait, second | {"input_revision": 2}]), ("input-lineage", [made, first, wait, second | {"parent_trigger_sha": "z"}]),
        ("already-started", [made, start, start]), ("not-started", [made, got]), ("attempt-ended", [made, start, got, end, end]), ("no-provider-receipt", [made, start, end]), ("duplicate-provider-receipt", [made, start, got, got]),
        ("resources-differ", [made, start, got, end | {"resources": "x"}]), ("not-revised", [made, first, wait, {"type": "run.resumed"}]), ("unpublished", [made, close]), ("duplicate-publication", [made, publish, publish]),
        ("not-host", [made, publish | {"role": "x"}]), ("unreadable", [made, {"type": "phase.failed", "phase": "scan", "attempt": 1}]), (None, [made, first, wait, second, {"type": "run.resumed"}, *whole, publish, close]),
        (None, [made, *whole, reopen | {"invalidated": ["report:-:1"]}, revise | {"preserve": True}, raise_to(3.0, None)]), (None, [made, start, got, reserve | {"recovered": True}, settle, receipt, end, sealed, {"type": "coverage.finalized", "artifact_sha": "c"}]),
    ]
    rows = [({"log": str(i), "pos": k, "run_id": "r", "seq": k + 1, "event_id": str(k)} | e) for i, (_, events) in enumerate(cases) for k, e in enumerate(events)]
    df = spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], replay.EVENT)
    got = {r["log"]: r["error"] for r in replay.replayed(df, PUBLISHING).collect()}
    assert {str(i): code for i, (code, _) in enumerate(cases)} == got
    assert {t for e in rows for t in [e["type"]]} >= set(replay.TYPES) - {"phase.context-compacted", "phase.result-identity-bound", "run.incomplete"}
