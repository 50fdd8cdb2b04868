"""Order-dependent operators and edges on tables made by hand."""

import math
import random

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.functions import text as X
from tallyloom.operators import evaluation as E
from tallyloom.operators import graphs as G
from tallyloom.operators import intervals as I
from tallyloom.operators import joins as J
from tallyloom.operators import ledger as L
from tallyloom.operators import packing as P
from tallyloom.sources import files as R
from tallyloom.streaming import runs as ST


def test_islands_touch_and_gap(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 9), ("a", 2, 2)], "k string, start long, stop long")
    assert sorted(map(tuple, I.islands(r, "k", "start", "stop", 1).collect())) == [("a", 1, 5), ("a", 7, 9)]
    assert sorted(map(tuple, I.islands(r, "k", "start", "stop", 0).collect())) == [("a", 1, 3), ("a", 4, 5), ("a", 7, 9)]


def test_budget_goes_on_past_misfits(spark):
    r = spark.createDataFrame([("u", 5, 1), ("u", 9, 2), ("u", 2, 3)], "u string, z long, i long")
    got = {x.i: x.outcome for x in P.budget_selection(r, "u", ["i"], "i", "z", 5, 8).collect()}
    assert got == {1: "selected", 2: "token-cap", 3: "selected"}


def test_chunks_flush_before_overflow_and_isolate_oversize(spark):
    r = spark.createDataFrame([("u", 3, 1), ("u", 99, 2), ("u", 3, 3), ("u", 3, 4)], "u string, z long, i long")
    assert {x.i: x.chunk for x in P.sequential_chunks(r, "u", "i", "z", 2, 10).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_text_parts_end_at_lines_and_whole_characters():
    assert I.newline_parts(b"ab\ncdef", 4) == [(0, 3), (3, 7)]
    parts = I.newline_parts("ééé".encode(), 3)
    assert "".join("ééé".encode()[s:e].decode() for s, e in parts) == "ééé"


def test_label_propagation_takes_the_first_of_ties():
    assert G.propagate_labels({1: [2, 3], 2: [1], 3: [1]}, 1) == {1: 2, 2: 2, 3: 2}


def test_fold_chain_and_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "node long, next long")
    assert {x.node: x.end for x in G.follow(links).collect()} == {1: 3, 2: 3, 7: None, 8: None}
    for n in (65, 1000):
        chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(-1, -2), (-2, -3), (-3, -1), (-9, -1)], "node long, next long")
        assert {x.node: x.end for x in G.follow(chain).collect()} == {i: n for i in range(n)} | dict.fromkeys((-1, -2, -3, -9))


def test_peel_leaves_cycles_without_level(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)], "src long, dst long")
    assert {x.node: x.level for x in G.peel(n, e).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None}


def test_reach_least_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "node long")
    assert {x.node: x.hops for x in G.reach(e, s).collect()} == {1: 0, 2: 1, 3: 1}


def test_bootstrap_repeats_and_percentile_is_not_interpolated():
    assert E.bootstrap([0.1, 0.3, 0.2], 100, 0.05, 17) == E.bootstrap([0.1, 0.3, 0.2], 100, 0.05, 17)
    assert E.percentile([1, 2, 3, 4], 0.5) == 3 and E.percentile([1, 2], 1.0) == 2
    assert E.bootstrap([], 10, 0.05, 1) == (0.0, 0.0, 0.0)
    assert sorted(E.shuffled(list("abcd"), 3)) == list("abcd")


def test_blocks_of_samples_are_those_of_one_sequence(spark):
    values = {"a": [0.1, -0.3, 0.25, 0.0, 0.7], "b": [1.0], "c": [0.01 * i for i in range(40)]}
    rows = spark.createDataFrame([(k, f"{i:03d}", v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, case string, v double").repartition(4)
    got = {r["k"]: (r["mean"], r["low"], r["high"]) for r in E.bootstrap_by(rows, "k", "v", "case", 230, 0.1, "5 + ascii(k)", 50).collect()}
    for k, vs in values.items():
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[k], E.bootstrap(vs, 230, 0.1, 5 + ord(k)), strict=True))


def test_arms_are_compared_as_a_loop_does(spark):
    """Observations in, claims out: pairs, gates of the paired set alone, three intervals with seeds of their own."""
    rnd = random.Random(8)
    seen = [(cap, case, rep, arm, rnd.random() + (0.3 if arm == "new" and cap == "good" else 0), 0.9, rnd.random() / 50, rnd.random() < (0.02 if cap == "bad" else 0))
            for cap in ("good", "bad", "other") for case in range(14) for rep in range(6) for arm in ("new", "old", "x") if rnd.random() < 0.9 and (case != 3 or rep > 3)]
    df = spark.createDataFrame(seen, "cap string, id long, repetition long, arm string, v double, e double, f double, bad boolean").repartition(5)
    metrics = {"primary": "v", "evidence": "e", "false_positive": "f"}
    cases = E.paired_cases(df, ["cap", "id"], "new", "old", 4, metrics, F.col("bad")).withColumn("case", F.col("id").cast("string"))
    declared = ["bad", "good", "none"]
    got = {r["cap"]: r for r in E.compared_arms(cases, "cap", declared, 300, 99, 0.05, 0.02, 0.02, 10).collect()}
    for i, cap in enumerate(declared):
        diffs, base, cand, pairs = {m: [] for m in metrics}, 0, 0, 0
        for case in sorted({str(o[1]) for o in seen}):
            arms = {a: {o[2]: o for o in seen if o[0] == cap and str(o[1]) == case and o[3] == a} for a in ("new", "old")}
            both = sorted(arms["new"].keys() & arms["old"].keys())
            if len(both) < 4:
                continue
            pairs += len(both)
            base += sum(arms["old"][r][7] for r in both)
            cand += sum(arms["new"][r][7] for r in both)
            for m, at in (("primary", 4), ("evidence", 5), ("false_positive", 6)):
                diffs[m].append(sum(arms["new"][r][at] - arms["old"][r][at] for r in both) / len(both))
        assert (got[cap]["cases"], got[cap]["pairs"], got[cap]["baseline_failures"], got[cap]["candidate_failures"]) == (len(diffs["primary"]), pairs, base, cand)
        for m, offset in (("primary", 0), ("evidence", 17), ("false_positive", 31)):
            want = E.bootstrap(diffs[m], 300, 0.05 / 9, 99 + i + 1 + offset)
            assert all(abs(x - y) < 1e-9 for x, y in zip(want, (got[cap][f"{m}_mean"], got[cap][f"{m}_low"], got[cap][f"{m}_high"]), strict=True)), (cap, m)
    assert got["none"]["decision"] == "inconclusive" and got["good"]["decision"] == "superior"


def test_pressure_ignores_case(spark):
    rows = spark.createDataFrame([("enomem",), ("got Eagain",), ("Rate limit",), ("xenomem",), ("4290",)], "m string")
    assert [r[0] for r in rows.select(X.pressure(F.lit(None).cast("int"), F.col("m"))).collect()] == [True, True, True, False, False]


def test_confusion_is_null_without_denominator(spark):
    r = spark.createDataFrame([(0, 0)], "decided int, truth int")
    assert tuple(E.confusion(r).first()) == (0, 0, 0, None, None, None)


def test_missing_status_has_two_defaults(spark):
    r = spark.createDataFrame([("1", 1, None, "HIGH", None, "k", None, "e")], "candidate_id string, ord long, status string, severity string, score_included boolean, remediation_key string, root_cause_location string, evidence string")
    n = L.normal(r).first()
    assert (n.status, n.score_status, n.included) == ("UNCLASSIFIED", "CONFIRMED", False)
    assert L.score_counts(L.normal(r)).first().high == 1


def test_as_of_takes_the_latest_before_it_filters(spark):
    v = spark.createDataFrame([("c", 1, 10, "old"), ("c", 2, 20, "REJECTED"), ("c", 3, 30, "new")], "id string, revision long, modified long, title string")
    assert J.as_of(v, "id", 2, ["modified", "revision"]).first().title == "REJECTED"


def test_longest_prefix_and_root(spark):
    f = spark.createDataFrame([("a/b/c.ts",), ("x.ts",)], "path string")
    r = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {x.path: x.root for x in J.longest_prefix(f, r).collect()} == {"a/b/c.ts": "a/b", "x.ts": "."}


def test_scalars(spark):
    row = spark.createDataFrame([(" pending-external ", "a\r\nb\rc", "./a\\b/", "a/../b", "0123456789abcdef")], "t string, l string, p string, q string, h string")
    out = row.select(S.token(F.col("t")), S.line_count(F.col("l")), S.normal_path(F.col("p")), S.safe_relative(F.col("q")), S.display_id(F.col("h"))).first()
    assert tuple(out) == ("PENDING_EXTERNAL", 3, "a/b", False, f"F-{int('0123456789abcde', 16) % 10**12:012d}")


def test_text_search_phrases_and_alternatives(spark):
    r = spark.createDataFrame([("Red steel ring",), ("steel red",)], "t string")
    hit = lambda q: [x[0] for x in r.where(X.matches_query(X.search_tokens(F.col("t")), F.col("t"), q)).collect()]
    assert hit('"red steel"') == ["Red steel ring"] and hit("red -ring") == ["steel red"] and len(hit("ring or red")) == 2


def test_canonical_json_and_forms(spark):
    r = spark.createDataFrame([('{"b": 1.0, "a": [2, {"d": 1, "c": null}]}', "Ｆｕｌｌ  Width.")], "j string, t string")
    assert tuple(r.select(X.canonical_json(F.col("j")), X.nfkc_lower(F.col("t"))).first()) == ('{"a":[2,{"c":null,"d":1}],"b":1}', "full width")


def test_torn_last_line_is_left_out(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbad\n{"k": 2')
    got = R.read_ledger(spark, str(tmp_path), "k int").collect()
    assert sorted((x.line, x.k, x._bad) for x in got) == [(0, 1, False), (1, None, True)]


def test_scan_receipts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_text("1\n2\n")
    got = R.scan(spark, str(tmp_path), "*.py").collect()
    assert [(x.bytes, x.loc) for x in got] == [(4, 2)]


def test_stream_equals_batch(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{tiny}/events.parquet")
    ST.counts_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "c"), str(tmp_path / "o")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "o"))
    batch = spark.read.parquet(f"{tiny}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert out.select("start", "event_type", "n").exceptAll(batch.select("start", "event_type", "n")).count() == 0
    assert out.count() > 0


def test_upsert_stream_is_latest_wins(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{tiny}/events.parquet")
    held = {}
    ST.upsert_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "c"), "user_id", "event_id", lambda: None, lambda df: held.update(rows=df.collect())).awaitTermination(120)
    want = {r.user_id: r.m for r in spark.read.parquet(f"{tiny}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.user_id: r.event_id for r in held["rows"]} == want


def test_communities_as_joins_equal_the_sequential_order(spark):
    r = random.Random(5)
    rows = [(g, r.randrange(k), r.randrange(k)) for g, k, n in (("a", 12, 30), ("b", 40, 70), ("c", 3, 5)) for _ in range(n)]
    got = {(x.repo, x.node): x.label for x in G.communities(spark.createDataFrame(rows, "repo string, src long, dst long").repartition(5), "repo").collect()}
    want = {}
    for g in "abc":
        edges = sorted({(s, t) for h, s, t in rows if h == g})
        near = {n: [t for s, t in edges if s == n] + [s for s, t in edges if t == n] for n in sorted({n for e in edges for n in e})}
        want |= {(g, n): x for n, x in G.propagate_labels(near).items()}
    assert got == want


def test_graph_queries_see_all_edges(spark, tiny):
    from tallyloom.plans.registry import QUERIES

    e = {(r.l_suppkey, r.l_partkey % 100) for r in spark.read.parquet(f"{tiny}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    plan = QUERIES["g05_communities"](spark, tiny)
    assert {r.node for r in plan.collect()} == {n for x in e for n in x}
    got = {r.src: r.targets for r in QUERIES["g03_adjacency"](spark, tiny).collect()}
    assert got == {s: ",".join(str(t) for t in sorted(b for a, b in e if a == s != b)) for s in {a for a, b in e if a != b}}
    codes = {r.code: r.n for r in QUERIES["g02_graph_integrity"](spark, tiny).collect()}
    assert codes["self_loop"] > 0 and codes["duplicate"] > 0


def test_paths_of_eight_nodes_equal_brute_force(spark):
    r = random.Random(8)
    edges = sorted({(r.randrange(14), r.randrange(14)) for _ in range(30)} | {(100 + k, 101 + k) for k in range(9)} | {(k, 99) for k in (100, 105, 107, 108)})
    starts, sinks = [0, 1, 3, 100, 106], {5, 9, 99}
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    start = spark.createDataFrame([(s,) for s in starts], "node long")
    want = []
    for s in starts:
        seen, queue = {s}, [[s]]
        for p in queue:
            for _, t in (e for e in edges if e[0] == p[-1] and e[1] != s):
                if len(p) > 8:
                    continue
                if t in sinks:
                    want.append([*p, t])
                elif t not in seen:
                    seen.add(t)
                    queue.append([*p, t])
    got = [x.path for x in G.first_paths(df, start, spark.createDataFrame([(s,) for s in sinks], "node long")).collect()]
    assert sorted(got) == sorted(want) and [*range(100, 108), 99] in got and [*range(100, 109), 99] not in got

    def walk(p):
        on = [t for s, t in edges if s == p[-1] and t not in p] if len(p) <= 8 else []
        return [x for t in on for x in walk([*p, t])] or [p]

    got = sorted((x.path, x.hops) for x in G.terminals(df, start).collect())
    assert got == sorted((p, 2 * (len(p) - 1)) for s in starts for p in walk([s])) and max(h for _, h in got) == 16


def test_places_across_range_partitions(spark):
    r = random.Random(7)
    rows = [(r.choice("äbcZé日") * r.randrange(3), k) for k in range(500)]
    found = J.places(spark.createDataFrame(rows, "s string, k long").repartition(6), ["s", "k"])
    want = {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda x: (x[0].encode(), x[1])), 1)}
    assert {x.k: x.place for x in found.collect()} == want


def test_queries_of_all_parts(spark, tiny):
    from tallyloom.plans.registry import QUERIES

    n = spark.read.parquet(f"{tiny}/part.parquet").count()
    assert QUERIES["x10_import_specifiers"](spark, tiny).select("repo", "path").distinct().count() == n
    assert sorted(x.place for x in QUERIES["t07_codepoint_order"](spark, tiny).collect()) == list(range(1, n + 1))
    assert {x.unit for x in QUERIES["g06_group_roles"](spark, tiny).collect()} == {x.p_brand for x in spark.read.parquet(f"{tiny}/part.parquet").select("p_brand").collect()}


def test_contract_codes_name_cycles(spark):
    from tallyloom.plans.assessment import contract_codes

    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (5,)], "node long")
    after = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (1, 5), (9, 5)], "src long, dst long")
    assert {r.code: r.n for r in contract_codes(ids, after.selectExpr("src as node"), after).collect()} == {"unknown_reference": 1, "duplicate_id": 1, "cycle": 3}


def test_claims_follow_from_three_intervals_and_the_gates(spark):
    from tallyloom.operators import evaluation as E

    names = ["cases", "baseline_failures", "candidate_failures", "primary_low", "primary_high", "evidence_low", "evidence_high", "false_positive_low", "false_positive_high"]
    cases = [
        ((10, 0, 0, 0.01, 0.2, -0.01, 0.1, -0.1, 0.01), "superior"), ((10, 0, 0, -0.01, 0.2, -0.01, 0.1, -0.1, 0.01), "non-inferior"),
        ((10, 0, 0, 0.01, 0.2, -0.05, 0.1, -0.1, 0.01), "inconclusive"), ((10, 0, 0, 0.01, 0.2, -0.2, -0.03, -0.1, 0.01), "inferior"),
        ((10, 0, 0, 0.01, 0.2, 0.0, 0.1, 0.03, 0.1), "inferior"), ((10, 0, 0, -0.2, -0.1, 0.0, 0.1, 0.0, 0.0), "inferior"),
        ((9, 0, 0, 0.01, 0.2, 0.0, 0.1, 0.0, 0.0), "inconclusive"), ((10, 1, 1, 0.01, 0.2, 0.0, 0.1, 0.0, 0.0), "inconclusive"), ((10, 0, 1, 0.01, 0.2, 0.0, 0.1, 0.0, 0.0), "inferior"),
    ]
    df = spark.createDataFrame([(*map(float, c), i) for i, (c, _) in enumerate(cases)], [*names, "i"])
    assert [r.decision for r in E.claim(df, 0.02, 0.02, 10).orderBy("i").collect()] == [d for _, d in cases]


def test_decision_gates(spark):
    from tallyloom.operators import ledger as L

    rows = [(0, 2, 70, 8.9), (0, 3, 70, 1.0), (1, 0, 99, 1.0), (0, 0, 69, None), (0, 0, 70, 9.0), (0, 0, 70, None)]
    df = spark.createDataFrame(rows, "critical int, high int, score int, max_cvss double")
    assert [r.passes for r in L.decide(df).collect()] == [True, False, False, False, False, True]
    assert L.decide(df.drop("max_cvss"), none_of=("high",)).where("passes").count() == 3


def test_groups_within_a_root_cause_are_no_second_tier(spark):
    from tallyloom.operators import ledger as L

    rows = [("a", "k1", "t1"), ("b", "k1", "t2"), ("a", "k2", "t1"), ("c", "k3", "t2")]
    got = {tuple(r) for r in L.equivalence_clusters(spark.createDataFrame(rows, "candidate_id string, root_key string, target string")).collect()}
    assert got == {(1, "k1", 2), (2, "t2", 2)}  # t1 has one id, which is in k1's group


def test_revisions(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import revisions as V

    rows = [
        ("a\nb\n", "a\nb\n", 1, 2, "identical", (0, 3, 0, 3)), ("a\nbé\nc", "a\r\nbé\r\nc\n", 2, 2, "unknown", (2, 5, 3, 7)), ("a\nb", "x\nb", 2, 2, "analysis-relevant", (2, 3, 2, 3)),
        ("aa\nb", "x\nb", 2, 2, "analysis-relevant", (3, 4, 2, 3)), ("a\nb", "x\nb", 1, 2, "analysis-relevant", None), ("`a\n", "`a", 1, 1, "unknown", (0, 2, 0, 2)), ("a", None, 1, 1, "unknown", None),
        ("a", "a", 2, 2, "identical", None), ("a", "a", 1, 0, "identical", None), ("a", "a", 0, 1, "identical", None), ("", "", 1, 1, "identical", (0, 0, 0, 0)),
        ("[1,\n2]\n", "[1,\r\n2]", 2, 2, "supported-format-only", (4, 6, 5, 7)), ("[1,\n", "[1,\r\n", 2, 2, "unknown", (4, 4, 5, 5)), ("[1]\n", "[1]", 1, 1, "unknown", (0, 3, 0, 3)),
    ]
    paths = ["x.json"] * len(rows)
    paths[1], paths[-1] = "x.md", "x.ts"
    df = spark.createDataFrame([(i, p, *r[:4]) for i, (p, r) in enumerate(zip(paths, rows, strict=True))], "i int, path string, before string, after string, line_from int, line_to int")
    got = V.remapped_lines(df.withColumn("kind", V.change_kind(F.col("path"), F.col("before"), F.col("after")))).orderBy("i").collect()
    for r, (*_, kind, span) in zip(got, rows, strict=True):
        assert (r.kind, (r.previous_from, r.previous_to, r.current_from, r.current_to)) == (kind, span or (None,) * 4), r


def test_source_expressions(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions import text as X

    yes = ["req.Body", "ctx.query", "event.queryStringParameters", "STDIN", "$_GET['a']", "self.request.form", "params[:id]", "@RequestBody x", "r.FormValue(1)", "mux.Vars(r)", "process.env.A", "os.environ"]
    no = ["requests.bodyguard", "inputs", "$_FILES", "params", "@RequestBodyX", "or.Formal", "Process.env"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(yes + no)], "i int, t string").orderBy("i").select(X.is_source_expression(F.col("t")).alias("s")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_evidence_is_held_against_its_lines(spark):
    from tallyloom.operators import revisions as V

    text = "one\r\n  two \nthree"
    rows = [("two", 2, 2, True, "holds", "holds"), ("one\n  two", 1, 2, True, "holds", "holds"), ("hre", 3, 3, True, "differs", "holds"), ("three", 3, 4, True, "beyond", "beyond"), ("one", 2, 1, True, "reversed", "reversed"),
            ("one", 1, 1, False, "outside", "outside"), ("four", 1, 3, True, "differs", "differs"), (None, 1, 1, True, "differs", "differs"), ("one", 0, 1, True, "beyond", "beyond")]
    df = spark.createDataFrame([(i, text, *r[:4]) for i, r in enumerate(rows)], "i int, text string, quote string, line_from int, line_to int, in_scope boolean")
    for k, whole in ((4, True), (5, False)):
        assert [r.status for r in V.evidence_status(df, whole).orderBy("i").collect()] == [r[k] for r in rows]


def test_every_status_demands_its_fields(spark):
    from tallyloom.operators import ledger as L

    fields = {"downgrade_reason": "DOWNGRADED", "backlog_reason": "BACKLOG", "reason": "EXCLUDED", "required_access": "PENDING_EXTERNAL", "pentest_route": "PENDING_PENTEST", "folded_into": "FOLDED_INTO",
              "counter_evidence": "FALSE_POSITIVE", "scope_reason": "OUT_OF_SCOPE", "dispute_reason": "DISPUTED"}
    names = ["candidate_id", "status", "severity", "evidence", "reachable", "exploit_path", *fields]
    rows = [(f"{s}-bare", s, "HIGH", " ", None, "", *[None] * len(fields)) for s in (*L.STATUSES, "OPEN")] + [(f"{s}-full", s, "HIGH", "e", None, "p", *["x" if fields[f] == s else "" for f in fields]) for s in (*L.STATUSES, "OPEN")]
    got = {(r.candidate_id, r.code) for r in L.violations(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()}
    want = {(f"{s}-bare", code) for s, (code, _) in L.DEMANDS.items()} | {(f"{s}-bare", "MISSING_EVIDENCE") for s in ("CONFIRMED", "DOWNGRADED")} | {("CONFIRMED-bare", "CONFIRMED_VALIDITY_MISSING")}
    want |= {(f"{s}-{k}", "CANDIDATE_UNCLASSIFIED") for s in ("CANDIDATE", "UNCLASSIFIED") for k in ("bare", "full")} | {(f"OPEN-{k}", "INVALID_STATUS") for k in ("bare", "full")}
    assert got == want


def test_times_and_retries(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions import text as X

    times = {"2024-02-29T10:00:00": "2024-02-29T10:00:00Z", "2024-02-29T23:59:59.5+02:00": "2024-02-29T23:59:59.5+02:00", "2023-02-29T10:00:00Z": None, "2024-02-29T24:00:00Z": None, "2024-02-29 10:00:00": None, "2024-13-01T10:00:00": None}
    got = spark.createDataFrame([(t,) for t in times], "t string").select("t", X.record_time(F.col("t")).alias("out")).collect()
    assert {r.t: r.out for r in got} == times
    rows = [(429, "x", None, True, True, None), (None, "overloaded", "2.5", True, True, 2500.0), (503, "not authorized", None, True, False, None), (None, "network down", "Thu, 01 Jan 1970 00:00:10 GMT", False, True, 5000.0),
            (None, None, "later", False, False, None), (None, "ETIMEDOUT", "Thu, 01 Jan 1970 00:00:01 GMT", False, True, 0.0), (500, "bad", "0", False, False, 0.0)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, s int, m string, h string").withColumn("now", F.expr("timestamp_seconds(5)")).orderBy("i")
    s, m = F.col("s"), F.col("m")
    assert [tuple(r) for r in df.select(X.pressure(s, m), X.retryable(s, m), X.retry_delay(F.col("h"), F.col("now"))).collect()] == [r[3:] for r in rows]
