"""Affected files and reuse of tasks against plain loops."""

import json
import random

from tallyloom.operators import reuse as R


def kind_by_loop(path, before, after):
    if before is None or (after is not None and before[1:] != after[1:]):
        return "analysis-relevant"
    if after is None:
        return "unknown"
    a, b = before[0], after[0]
    if a == b:
        return "identical"
    plain = lambda t: t.replace("\r\n", "\n").removesuffix("\n")
    if plain(a) != plain(b):
        return "analysis-relevant"
    try:
        json.loads(a), json.loads(b)
    except ValueError:
        return "unknown"
    return "supported-format-only" if path.endswith(".json") else "unknown"


def test_affected_files_equal_a_closure_from_scratch(spark):
    r = random.Random(11)
    for n in (3, 40, 40):
        names = [f"d/{i}.{'json' if i % 3 else 'txt'}" for i in range(n)]
        old, new = {}, {}
        for p in names:
            text = "[1,\n2]\n"
            if r.random() < 0.95:
                old[p] = (text, 420, False)
            if r.random() < 0.97:
                new[p] = (r.choice([text] * 12 + ["[1,\r\n2]", "[1,\n3]\n", "[1,\r\n2]\n"]), r.choice([420] * 25 + [493]), r.random() < 0.02)
        scope = [p for p in names if p in new or r.random() < 0.3]
        e1, e2 = ([(r.choice(names), r.choice(names)) for _ in range(n // 2)] for _ in range(2))
        df = lambda d: spark.createDataFrame([(p, *v) for p, v in d.items()], "path string, text string, mode int, symlink boolean")
        edges = lambda e: spark.createDataFrame([*e, (None, "x"), e[0]] if e else [(None, "x")], "src string, dst string")
        changes = R.source_changes(df(old), df(new), spark.createDataFrame([(p,) for p in [*scope, *scope[:2], None]], "path string"))
        kinds = {p: kind_by_loop(p, old.get(p), new.get(p)) for p in scope}
        assert {x.path: x.kind for x in changes.collect()} == kinds
        want = {p for p, k in kinds.items() if k not in R.REUSABLE} | {p for p in old if p not in scope}
        grew = True
        while grew:
            more = {a for a, b in e1 + e2 if b in want} - want
            want, grew = want | more, bool(more)
        got = [x.path for x in R.affected_files(changes, df(old), edges(e1), edges(e2)).collect()]
        assert sorted(got) == sorted(want)


OWNED = "array<struct<path:string,line_from:int,line_to:int,byte_from:int,byte_to:int>>"
TASK = f"ord int, task_id string, kind string, owned {OWNED}, flows array<struct<id:string,to:string>>, obligations array<string>"


def test_reuse_has_a_case_for_each_status(spark):
    old_text, new_text = "é\na\r\nb\n", "é\r\na\nb\r\n"  # logical places 3, 5, 7
    before = spark.createDataFrame([("f", old_text), ("g", "g\n"), ("h", "h\n")], "path string, text string")
    after = spark.createDataFrame([("f", new_text), ("g", "g\n"), ("h", "h2\n")], "path string, text string")
    was, now, g, h = [("f", 2, 3, 3, 8)], [("f", 2, 3, 4, 9)], [("g", 1, 1, 0, 2)], [("h", 1, 1, 0, 2)]
    flow, other = [("a", "b")], [("a", "c")]
    olds = [
        (1, "o1", "source", was, flow, ["q"]), (2, "o2", "source", was, flow, ["other"]), (3, "unsealed", "source", g, flow, []), (4, "open", "source", g, other, []),
        (5, "read", "source", g, [("r", "r")], []), (6, "dep", "source", g, [("d", "d")], []), (7, "late", "source", g, [("l", "l")], None),
    ]
    news = [
        (1, "n1", "source", now, flow, ["q"], ["g"]), (2, "n2", "source", now, flow, ["z"], []), (3, "n3", "review", now, flow, [], []), (4, "n4", "source", [], flow, [], []),
        (5, "n5", "source", now, other, [], []), (6, "n6", "source", g, flow, [], []), (7, "n7", "source", g, other, [], []), (8, "n8", "source", g, [("r", "r")], [], []),
        (9, "n9", "source", g, [("d", "d")], [], ["g", "h"]), (10, "n10", "source", g, [("l", "l")], [], None), (11, "n11", "source", [("gone", 1, 1, 0, 2)], flow, [], []),
        (12, "n12", None, None, None, None, None), (13, "n13", "source", [("f", 2, 3, 5, 9)], flow, ["q"], []), (14, "n14", "source", h, flow, [], []),
    ]
    sealed = spark.createDataFrame([(o[1], o[3]) for o in olds if o[1] != "unsealed"] + [("unsealed", was)], f"task_id string, owned {OWNED}")
    runs = [(1, "o1", "failed", False, ["h"]), (2, "o1", "completed", True, ["h"]), (3, "o1", "completed", None, ["g"]), (4, "open", "failed", False, []), (5, "read", "completed", False, ["g", "h"])]
    runs += [(6, "dep", "completed", False, None), (8, "late", "completed", False, ["h"]), (7, "late", "completed", False, None)]
    attempts = spark.createDataFrame(runs, "ord int, task_id string, status string, superseded boolean, observed array<string>")
    old, new = spark.createDataFrame(olds, TASK).repartition(3), spark.createDataFrame(news, TASK + ", dependencies array<string>").repartition(3)
    affected = spark.createDataFrame([("h",), ("h",)], "path string")
    got = {x.task_id: (x.status, x.prior) for x in R.reusable_tasks(old, new, before, after, sealed, attempts, affected).collect()}
    assert got == {
        "n1": ("reuse", "o1"), "n2": ("obligations", None), "n3": ("not-source", None), "n4": ("not-source", None), "n5": ("no-match", None), "n6": ("unsealed", None),
        "n7": ("unfinished", None), "n8": ("observed", None), "n9": ("affected", None), "n10": ("reuse", "late"), "n11": ("no-match", None), "n12": ("not-source", None),
        "n13": ("no-match", None), "n14": ("no-match", None),
    }
    assert R.reusable_tasks(old, new.limit(0), before, after, sealed, attempts, affected).collect() == []
