"""The gate before publication against plain loops."""

import random
from collections import Counter

from tallyloom.operators import review as R

CANDIDATES = "ord int, candidate_id string, root_key string, status string, score_status string, severity string, score_included boolean, included boolean, affected_instances array<string>, ciso_decision string, pentest_required boolean, pentest_route string, scenario_refs array<string>"
GROUPS = "group_id string, decision string, members array<string>, representative string, split_reason string, keep_reason string, reason string, affected_instances array<string>"


def expected(cands, groups, review, scenarios, score):
    out, by_id, declared = [], {c[1]: c for c in sorted(cands)}, set()
    full = lambda *v: any(x and x.strip() for x in v)
    for gid, decision, members, rep, split, keep, reason, inst in groups:
        d, members = (decision or "").strip().upper(), [m.strip() for m in members or [] if m and m.strip()]
        if d in ("SPLIT", "KEEP") and full(split, keep, reason):
            declared |= set(members)
        if d not in ("MERGE", "SPLIT", "KEEP"):
            out.append(("error", "EQUIVALENCE_GROUP_DECISION_INVALID", gid))
        elif not members:
            out.append(("error", "EQUIVALENCE_GROUP_MEMBERS_MISSING", gid))
        elif d == "MERGE":
            rep = (rep or "").strip()
            if rep not in members:
                out.append(("error", "EQUIVALENCE_MERGE_REPRESENTATIVE_INVALID", gid))
            if sum(by_id[m][7] for m in members if m in by_id) > 1:
                out.append(("error", "MERGED_GROUP_MULTIPLE_SCORE_INCLUDED", gid))
            if not (inst or (rep in by_id and by_id[rep][8])):
                out.append(("error", "MERGE_AFFECTED_INSTANCES_MISSING", gid))
        elif not full(split if d == "SPLIT" else keep, reason):
            out.append(("error", f"EQUIVALENCE_{d}_REASON_MISSING", gid))
    causes = {}
    for c in cands:
        causes.setdefault(c[2], []).append(c)
    for key, cs in causes.items():
        scored = [c[1] for c in cs if c[7]]
        if len(cs) > 1 and not any(c[3] == "FOLDED_INTO" for c in cs) and not set(scored) <= declared:
            out.append(("error" if len(scored) >= 2 else "warning", "UNFOLDED_ROOT_CAUSE_GROUP", key))
    out += [("error", "DISPUTED_UNRESOLVED_AT_PUBLISH", c[1]) for c in cands if c[3] == "DISPUTED" and not full(c[9])]
    named, ids = {s[1] for s in scenarios}, {s[0] for s in scenarios}
    for c in cands:
        if (c[3] == "PENDING_PENTEST" or c[10]) and not (full(c[11]) and (c[1] in named or set(c[12] or []) & ids)):
            out.append(("error", "PENTEST_ROUTE_COVERAGE_INCOMPLETE", c[1]))
    return out


def test_the_gate_equals_the_loop(spark):
    r = random.Random(13)
    statuses = ["CONFIRMED", "FOLDED_INTO", "DISPUTED", "PENDING_PENTEST", "EXCLUDED"]
    cands = []
    for k in range(80):
        status = r.choice(statuses)
        scores = status == "CONFIRMED" and r.random() < 0.8
        cands.append((k, f"c{k}", f"k{r.randrange(30)}", status, status, "LOW", scores, scores, r.choice([None, [], ["i"]]), r.choice([None, " ", "yes"]), r.choice([None, True, False]), r.choice([None, "", "r"]), r.choice([None, ["s1"], ["s9"]])))
    cands.append((99, "c3", "k3", "CONFIRMED", "CONFIRMED", "LOW", True, True, ["i"], None, False, None, None))
    groups = []
    for k in range(40):
        members = r.choice([None, [], *[[f"c{r.randrange(85)}" for _ in range(4)] for _ in range(5)]])
        text = lambda: r.choice([None, None, " ", "so"])
        groups.append((f"g{k}", r.choice([" merge", "Split", "KEEP", "FOLDED_INTO", None, "MERGE"]), members and [f" {m} " for m in members] + [" "], r.choice([None, "c1", members[0] if members else "x"]), text(), text(), text(), r.choice([None, [], ["x"]])))
    scenarios = [("s1", "c1"), ("s1", "c2"), ("s2", None)]
    made = (
        spark.createDataFrame(cands, CANDIDATES).repartition(3), spark.createDataFrame(groups, GROUPS).repartition(2), spark.createDataFrame([("complete ", 90, 0)], "status string, reviewed_count int, unresolved int"),
        spark.createDataFrame(scenarios, "scenario_id string, candidate_id string"), spark.createDataFrame([("c1", "MISSING_EVIDENCE")], "candidate_id string, code string"),
    )
    got = [tuple(x) for x in R.publication_gate(*made, reported_score=-1, provenance=("main", "abc")).collect()]
    want = [*expected(cands, groups, None, scenarios, None), ("error", "MISSING_EVIDENCE", "c1"), ("error", "SCORE_FORMULA_MISMATCH", None)]
    assert Counter(got) == Counter(want)
    assert len({g[1] for g in got}) == 12
    none = [df.limit(0) for df in made]
    assert {tuple(x) for x in R.publication_gate(*none).collect()} == {
        ("error", "EQUIVALENCE_REVIEW_MISSING", None), ("error", "RAW_LEDGER_MISSING", None), ("warning", "PROVENANCE_MISSING", None), ("error", "SCORE_NOT_PROVIDED", None),
    }
    late = spark.createDataFrame([("open", None, 2)], "status string, reviewed_count int, unresolved int")
    codes = [x.code for x in R.publication_gate(none[0], none[1], late, none[3], none[4], 100, ("b", "c"), allow_empty=True).collect()]
    assert sorted(codes) == ["EQUIVALENCE_REVIEW_COUNT_MISSING", "EQUIVALENCE_REVIEW_INCOMPLETE", "EQUIVALENCE_REVIEW_UNRESOLVED"]


def test_submit_violations(spark):
    ok = ("supported", 1, [], "HIGH", "code", "confirmed", ["p"], "x" * 20, 0.95)
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(("verdict", "evidence", "unresolved", "severity", "cls", "reach", "pre", "why", "conf"), ok, strict=True))
    cases = {
        "a": (ok, set()), "b": (change(evidence=0), {"evidence"}), "c": (change(verdict="abstain"), {"unresolved"}), "d": (change(cls="documentation"), {"reachability"}),
        "e": (change(reach="plausible"), {"confidence"}), "f": (change(pre=[]), {"rationale"}), "g": (change(why=" " * 9 + "x" * 19), {"rationale"}), "h": (change(severity="LOW", reach=None, conf=0.9), set()),
        "i": ((None,) * 9, set()), "j": (change(verdict="escalate", evidence=None, unresolved=["u"], reach="none"), {"reachability", "confidence"}),
    }
    df = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], "finding_id string, verdict string, evidence int, unresolved array<string>, severity string, evidence_class string, reachability string, preconditions array<string>, rationale string, confidence double")
    got = {}
    for x in R.submit_violations(df).collect():
        got.setdefault(x.finding_id, set()).add(x.code)
    assert got == {k: v[1] for k, v in cases.items() if v[1]}
