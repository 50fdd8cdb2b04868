"""Taint against a loop that does it step by step, and the rules of names."""

import random
import re

from tallyloom.functions import text as X
from tallyloom.operators import taint as T


def stepwise(assignments, calls, functions, rounds):
    """{(file, name): round}, variable by variable in the order of the rounds."""
    found = {}
    is_source = lambda e: any(re.search(p, e) for p in X.SOURCE_EXPRESSIONS)
    sees = lambda f, e: is_source(e) or any((f, n) in found for n in re.findall(T.IDENTIFIER, e))
    for k in range(1, rounds + 1):
        for file, _, name, expr in sorted(assignments):
            if sees(file, expr):
                found.setdefault((file, name), k)
        for file, _, callee, args in sorted(calls, key=lambda c: c[1]):
            for i, e in enumerate(args):
                if sees(file, e):
                    for name, to, params in functions:
                        if name == callee.split(".")[-1] and i < len(params) and re.fullmatch(T.IDENTIFIER, params[i]):
                            found.setdefault((to, params[i]), k)
    return found


def test_taint_equals_the_loop(spark):
    r = random.Random(3)
    names, files = [f"v{i}" for i in range(9)], [f"f{i}" for i in range(4)]
    for rounds in (1, 3, 8):
        a = [(r.choice(files), k, r.choice(names), "req.body.q" if k % 17 == 0 else f"{r.choice(names)} + {r.choice(names)}") for k in range(40)]
        c = [(r.choice(files), k, r.choice(["m.g0", "g1", "x.y.g2", "none"]), [f"h({r.choice(names)})", r.choice(names), ""]) for k in range(20)]
        f = [(f"g{r.randrange(3)}", r.choice(files), [r.choice(names), r.choice([*names, "{a}", "...b"])]) for _ in range(6)]
        got = T.tainted(
            spark.createDataFrame(a, "file string, ord long, name string, expr string").repartition(3), spark.createDataFrame(c, "file string, ord long, callee string, args array<string>"),
            spark.createDataFrame(f, "name string, file string, params array<string>"), rounds,
        )
        assert {(x.file, x.name): x.round for x in got.collect()} == stepwise(a, c, f, rounds)


def test_taint_stops_after_its_rounds_and_takes_nulls(spark):
    a = [("f", k, f"v{k}", f"v{k + 1}") for k in range(12)] + [("f", 12, "v12", "process.env"), ("f", 13, None, "req.body"), (None, 1, "x", "req.body"), ("f", 14, "y", None)]
    df = spark.createDataFrame(a, "file string, ord long, name string, expr string")
    none, fun = spark.createDataFrame([], "file string, ord long, callee string, args array<string>"), spark.createDataFrame([], "name string, file string, params array<string>")
    assert {x.name: x.round for x in T.tainted(df, none, fun).collect()} == {f"v{12 - k}": k + 1 for k in range(8)}
    assert T.tainted(df.limit(0), none, fun).count() == 0


def test_confidence_and_names(spark):
    rows = [("lib.sanitizeInput", True, 0, 0, 0.85), ("unescape", False, 9, 0, 0.45), ("validateX", False, 0, 3, 0.1), ("x.Validate", True, 5, 3, 0.0), (None, False, 2, 1, 0.44)]
    df = spark.createDataFrame(rows, "c string, want boolean, h int, s int, score double")
    lit = T.F.lit
    got = df.select("want", "score", T.is_sanitizer(df.c).alias("hit"), T.confidence(df.h, df.s, lit(False), lit("xss"), lit(True)).alias("got"))
    assert all(r.hit == r.want and abs(r.got - r.score) < 1e-9 for r in got.collect())


def test_a_call_with_many_arguments_comes_before_the_next_call(spark):
    a = spark.createDataFrame([], "file string, ord long, name string, expr string")
    c = spark.createDataFrame([("f", 1, "g", ["1"] * 1400 + ["req.body.x"]), ("f2", 2, "h", ["p1400"])], "file string, ord long, callee string, args array<string>")
    f = spark.createDataFrame([("g", "f2", [f"p{i}" for i in range(1401)]), ("h", "f3", ["z"])], "name string, file string, params array<string>")
    assert {(x.file, x.name): x.round for x in T.tainted(a, c, f).collect()} == {("f2", "p1400"): 1, ("f3", "z"): 1}


def paths_by_loop(flows, calls, reached, most=None):
    """The rows of taint_paths, flow by flow."""
    is_source = lambda e: any(re.search(p, e) for p in X.SOURCE_EXPRESSIONS)
    clean = lambda n: n.split(".")[-1].lower() in [s.lower() for s in T.SANITIZERS] or any(
        n.split(".")[-1].lower().startswith(s.lower()) and re.match(r"[_A-Z0-9-]", n.split(".")[-1][len(s) :]) for s in T.SANITIZERS if s.lower() not in T.WHOLE_ONLY
    )
    out, keys = [], set()
    for f in sorted(flows):
        ord_, kind, ef, el, method, route, handler, tf, tl, callee, args, via, hops = f
        cat = next((c for c, ns in T.SINKS.items() for n in ns if callee and (callee.lower() == n.lower() or callee.lower().endswith("." + n.lower()))), None)
        if cat is None or kind in T.INNER_ENTRIES or (most is not None and len(out) >= most):
            continue
        lines = {}
        steps = [re.match(r"^(.+):(\d+)\s", v) for v in via or []]
        for file, line in [(ef, el), (tf, tl), *((m[1], int(m[2])) for m in steps if m)]:
            if file:
                lines.setdefault(file, []).extend([line] if line is not None else [])
        san = {(cf, cl, c) for cf, cl, c in calls if cf in lines and c and clean(c) and (not lines[cf] or max(1, min(lines[cf]) - 50) <= cl <= max(lines[cf]) + 50)}
        hit = [a for a in args or [] if is_source(a)] or [a for a in args or [] if any((tf, n) in reached for n in re.findall(T.IDENTIFIER, a))]
        if not hit and is_source(" ".join(via or [])):
            hit = list(args or [])
        conf = T._score(min(hops or 0, 5), min(len(san), 3), 0, int(cat in T.GRAVE), int(bool(hit)))
        if conf >= 0.1:
            out.append((ord_, (ef, el, tf, tl, callee, tuple(via or [])), cat, sorted(san), hit, conf))
    return {o[0]: (o[2], [tuple(x) for x in o[3]], o[4], o[5]) for o in out if not (o[1] in keys or keys.add(o[1]))}


def test_taint_paths_equal_the_loop(spark):
    r = random.Random(10)
    files = [f"f{i}.js" for i in range(3)]
    callees = ["db.query", "JSON.parse", "url.parse", "EXEC", "x.eval", "http.get", "map.get", "a.$queryRaw", "sequelize.query", "myquery", "fetch", "res.send", None, "cursor.findOne", "parse"]
    kinds, args = ["http", "sdk_export", None, "graphql"], ["req.body.x", "a + b", "c", "'lit'", "wrap(d)"]
    place = lambda: (r.choice(files), r.choice([None, *range(1, 700, 23)]))
    flows = []
    for k in range(300):
        via = [r.choice([f"{r.choice(files)}:{r.randrange(1, 700)} g -> h", "no place", "x:y z", "f1.js:12 req.query.id"]) for _ in range(r.randrange(3))]
        flows.append((k, r.choice(kinds), *place(), r.choice([None, "GET"]), "/r", "", *place(), r.choice(callees), r.sample(args, r.randrange(4)), via, r.choice([None, 0, 1, 2, 7])))
    flows += [(300 + i, *f[1:]) for i, f in enumerate(flows[:40])] + [(400, "http", "f0.js", 1, None, None, None, None, None, "eval", None, None, None)]
    calls = [(r.choice(files), r.randrange(1, 900), r.choice(["lib.escapeHtml", "unescape", "validate", "validateAll", "x.parseInt", "plain"])) for _ in range(60)]
    calls += calls[:9]
    reached = [("f0.js", "a"), ("f1.js", "c"), ("f2.js", "d"), ("f0.js", "q")]
    schema = "ord long, entry_type string, entry_file string, entry_line int, entry_method string, route string, handler string, terminal_file string, terminal_line int, callee string"
    df = spark.createDataFrame([*flows, flows[5]], schema + ", args array<string>, via array<string>, hops int").repartition(3)
    made = spark.createDataFrame(calls, "file string, line int, callee string"), spark.createDataFrame(reached, "file string, name string")
    for most in (None, 50):
        got = {x.ord: (x.category, [tuple(s) for s in x.sanitizers], x.tainted_arguments, x.confidence) for x in T.taint_paths(df, *made, most).collect()}
        assert got == paths_by_loop(flows, calls, set(reached), most)
        assert len(got) > 30 and any(v[1] for v in got.values())
    one = T.taint_paths(df.where("ord = 400"), *made).first()
    assert (one.source_expr, one.potential_cwe, one.tainted_arguments) == ("http", "CWE-94", [])
    assert T.taint_paths(df.where("ord < 0"), *made).collect() == []
