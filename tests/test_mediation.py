"""Review notes against a plain reading of them."""

import random

from tallyloom.operators import mediation as M

NOTE = (
    "run string, pos long, id string, sha256 string, kind string, subject_path string, subject_sha string, topic string, position string, outcome string, selected_id string, selected_sha string, "
    "opinions array<struct<id:string,sha256:string>>, refs array<struct<path:string,sha256:string>>, dispute_id string"
)
FIELDS = [f.split()[0] for f in NOTE.replace("<id:string,sha256:string>", "").replace("<path:string,sha256:string>", "").split(", ")]


def opinion(pos, id_, position="agree", subject="a", topic="t", refs=(("a", "1"),)):
    return {"run": "r", "pos": pos, "id": id_, "sha256": "h" + id_, "kind": "review-opinion", "subject_path": subject, "subject_sha": "1", "topic": topic, "position": position, "refs": list(refs)}


def mediation(pos, id_, names, outcome="adopt", selected=None, subject="a", topic="t", refs=(("a", "1"),)):
    pick = {"selected_id": selected, "selected_sha": "h" + selected} if selected else {}
    return {"run": "r", "pos": pos, "id": id_, "sha256": "h" + id_, "kind": "review-mediation", "subject_path": subject, "subject_sha": "1", "topic": topic, "outcome": outcome, "opinions": [(n, "h" + n) for n in names], "refs": list(refs)} | pick


def frame(spark, notes):
    return spark.createDataFrame([tuple(n.get(f) for f in FIELDS) for n in notes], NOTE).repartition(3)


def versions(spark, rows):
    return spark.createDataFrame(rows, "run string, path string, at long, sha256 string").repartition(2)


def test_each_rule_has_its_code(spark):
    two = [opinion(1, "x"), opinion(2, "y", "uncertain", refs=(("a", "1"), ("b", "7")))]
    both = (("a", "1"), ("b", "8"))
    cases = [
        (None, [*two, mediation(3, "m", "xy", selected="x", refs=both)]), (None, [*two, mediation(3, "m", "xy", "defer", refs=both)]), ("subject-is-history", [opinion(1, "m", subject="review-notes/z", refs=(("review-notes/z", "1"),))]),
        ("subject-not-cited", [opinion(1, "m", refs=(("a", "2"),))]), ("opinions-not-bound", [*two, mediation(3, "m", "x", selected="x", refs=both)]), ("opinions-not-bound", [*two, mediation(3, "m", "xx", selected="x", refs=both)]),
        ("opinions-not-bound", [two[0], mediation(2, "m", "xz", selected="x"), opinion(3, "z")]), ("adopts-nothing", [*two, mediation(3, "m", "xy", refs=both)]), ("adopts-uncertain", [*two, mediation(3, "m", "xy", selected="y", refs=both)]),
        ("selects-without-adopting", [*two, mediation(3, "m", "xy", "defer", selected="x", refs=both)]), ("evidence-not-cited", [*two, mediation(3, "m", "xy", selected="x")]),
    ]
    notes = [n | {"run": f"r{i}"} for i, (_, ns) in enumerate(cases) for n in ns]
    got = {(r["run"], r["id"]): r["code"] for r in M.note_violations(frame(spark, notes)).collect()}
    assert got == {(f"r{i}", "m"): code for i, (code, _) in enumerate(cases) if code}


def test_statuses(spark):
    v = [("r", "a", 0, "1"), ("r", "b", 0, "7"), ("r", "b", 5, "8"), ("r", "c", 0, "1")]
    groups = {
        "adopted": [opinion(1, "x"), mediation(2, "m", "x", selected="x")], "deferred": [opinion(1, "x"), opinion(2, "y", "disagree"), mediation(3, "m", "xy", "defer")], "needs-information": [opinion(1, "x"), mediation(2, "m", "x", "needs-information")],
        "awaiting-mediation": [opinion(1, "x"), mediation(2, "m", "x", selected="x"), opinion(3, "y", "disagree")], "stale": [opinion(1, "x", refs=(("a", "1"), ("b", "7")))],
    }
    notes = [n | {"topic": t, "id": f"{t}-{n['id']}", "sha256": f"h{t}-{n['id']}"} | ({"opinions": [(f"{t}-{i}", f"h{t}-{i}") for i, _ in n["opinions"]], "selected_id": n.get("selected_id") and f"{t}-{n['selected_id']}"} if "opinions" in n else {}) for t, ns in groups.items() for n in ns]
    got = {r["topic"]: r for r in M.mediation_summary(frame(spark, notes), versions(spark, v)).collect()}
    assert {t: r["status"] for t, r in got.items()} == {t: t for t in groups}
    assert got["adopted"]["selected"] == "adopted-x" and got["deferred"]["conflicting"] and not got["adopted"]["conflicting"] and got["stale"]["historical_stale_paths"] == 1
    earlier = {r["topic"]: r["status"] for r in M.mediation_summary(frame(spark, notes), versions(spark, v), as_of=3).collect()}
    assert earlier["stale"] == "awaiting-mediation"
    since = M.stale_references(frame(spark, notes), versions(spark, v)).collect()
    assert [(r["id"], r["path"], r["since"]) for r in since] == [("stale-x", "b", 5)]


def test_summaries_equal_a_plain_reading(spark):
    rnd = random.Random(4)
    v = [(f"r{i}", p, at, str(rnd.randrange(3))) for i in range(4) for p in "abc" for at in range(rnd.randrange(1, 4))]
    now = {}
    for run, p, _, sha in sorted(v, key=lambda x: x[2]):
        now[run, p] = sha
    notes = []
    for i in range(4):
        for pos in range(60):
            kind, topic = rnd.choice(["review-opinion"] * 3 + ["review-mediation", "dispute", "resolution"]), rnd.choice("tu")
            mine = [n for n in notes if n["run"] == f"r{i}"]
            named = [n["id"] for n in mine if n["kind"] == "review-opinion" and n["topic"] == topic]
            refs = [(p, rnd.choice([now[f"r{i}", p]] * 6 + ["9"])) for p in "abc" if rnd.random() < 0.4]
            n = opinion(pos, f"{i}-{pos}", rnd.choice(["agree", "disagree"]), topic=topic, refs=refs) if kind == "review-opinion" else mediation(pos, f"{i}-{pos}", named, rnd.choice(["adopt", "defer", "needs-information"]), topic=topic, refs=refs)
            disputes = [m["id"] for m in mine if m["kind"] == "dispute"]
            notes.append(n | {"run": f"r{i}", "kind": kind, "dispute_id": rnd.choice(disputes) if kind == "resolution" and disputes else None, "selected_id": named[0] if named and n.get("outcome") == "adopt" else None})
    stale = {n["id"]: {p for p, s in n["refs"] if now[n["run"], p] != s} for n in notes}
    want = {}
    for run in {n["run"] for n in notes}:
        for topic in "tu":
            ops = [n for n in notes if n["run"] == run and n["topic"] == topic and n["kind"] == "review-opinion"]
            meds = [n for n in notes if n["run"] == run and n["topic"] == topic and n["kind"] == "review-mediation"]
            last = meds[-1] if meds else None
            current = bool(last) and {i for i, _ in last["opinions"]} == {o["id"] for o in ops}
            past = set().union(*(stale[o["id"]] for o in ops))
            paths = stale[last["id"]] if current else past
            status = "stale" if paths else "awaiting-mediation" if not current else {"adopt": "adopted", "defer": "deferred"}.get(last["outcome"], "needs-information")
            want[run, topic] = (len(ops), len(meds), len({o["position"] for o in ops}) > 1, current, status, len(paths), len(past))
    df, vs = frame(spark, notes), versions(spark, v)
    got = {(r["run"], r["topic"]): (r["opinions"], r["mediations"], r["conflicting"], r["decision_current"], r["status"], r["stale_paths"], r["historical_stale_paths"]) for r in M.mediation_summary(df, vs).collect()}
    assert got == want
    disputes = {}
    for n in notes:
        if n["kind"] == "dispute":
            of = [m for m in notes if m["kind"] == "resolution" and m["dispute_id"] == n["id"] and m["run"] == n["run"]]
            by = of[-1] if of else n
            disputes[n["id"]] = ("stale" if stale[by["id"]] else of[-1]["outcome"] if of else "open", of[-1]["id"] if of else None, len(of))
    assert {r["id"]: (r["status"], r["latest"], r["resolutions"]) for r in M.dispute_summary(df, vs).collect()} == disputes
