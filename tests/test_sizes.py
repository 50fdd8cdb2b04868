"""Queries whose results changed only on larger tables, on a few made rows of such tables."""

import duckdb
import pytest

from tallyloom.plans import registry


def both(spark, folder, name):
    """A query's rows and those of its SQL over the tables in the folder."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    found, said = registry.QUERIES[name](spark, str(folder)), c.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in said.description]
    return sorted(tuple(r) for r in found.select(*columns).collect()), sorted(said.fetchall())


#: Queries that rank by a number in which the event's id has six digits.
RANKED = ["w01_latest_by_rank", "w03_latest_attempt", "z04_retained_claims"]


@pytest.mark.parametrize("name", RANKED)
def test_ranks_with_ids_over_a_million(spark, tmp_path, name):
    rows = ", ".join(f"({i}, timestamp '2024-01-01', {i % 3}, '{t}', 1.0, '{{\"k\": {k}}}')" for i, t, k in [(10, "view", 0), (11, "click", 35), (12, "view", 70), (2_500_010, "view", 35), (2_500_011, "view", 0), (2_500_013, "click", 0), (3_999_999, "view", 1), (7_000_008, "error", 35), (9_000_000_011, "view", 35)])
    duckdb.execute(f"copy (select * from (values {rows}) t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    found, said = both(spark, tmp_path, name)
    assert found == said


def test_json_is_all_of_a_text(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions import scalars as S

    bad = ["4798 Lyer", "1],[2", "1] xx", "1, 2", "", "  ", "[1", "01", "'a'", '"a\tb"', "{a:1}", "[1]//c", "1}", "tru", "[NaN]", '{"a":1}{"b":2}', '"a" "b"', '["\\u12"]']
    good = ["1", " 1 ", "[1]\r\n", '{"a":1,"a":2}', "null", '"x"', "[]", '{"a":{"b":[1,{"c":null}]}}', "123456789012345678901234567890", "1e999"]
    rows = spark.createDataFrame([(t,) for t in bad + good] + [(None,)], "t string").select("t", S.valid_json(F.col("t")).alias("v")).collect()
    assert {r.t for r in rows if r.v} == set(good)


def test_change_kind_of_a_text_that_begins_with_a_value(spark, tmp_path):
    texts = ["4798 words\nmore", "12\n", "plain\ntext", "\"a\" b\n"]  # ids that end in 21 of 30: .json, with other line ends
    rows = ", ".join(f"({21 + 30 * i}, '{t}')" for i, t in enumerate(texts))
    duckdb.execute(f"copy (select * from (values {rows}) t(doc_id, text)) to '{tmp_path}/documents.parquet'")
    found, said = both(spark, tmp_path, "x37_change_kind")
    assert found == said
    assert [k for _, k in found] == ["unknown", "supported-format-only", "unknown", "unknown"]


def test_paths_are_written_for_sinks_and_new_nodes_alone(spark, monkeypatch):
    from tallyloom.operators import graphs as G

    n, written = 20, []

    def counted(df, name, cut=G.cut):
        out = cut(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "src long, dst long")
    found = G.first_paths(edges, nodes, nodes.where("node = 7")).count()
    # Each edge twice, each pair of start and node twice at most, and what is found; the steps that lead back are about n ** 3.
    assert found == (n - 1) ** 2
    assert sum(written) <= 6 * n * n + found


def test_a_tree_is_read_in_no_more_tasks_than_wanted(tmp_path):
    from tallyloom.sources import trees

    for i in range(300):
        (tmp_path / "src" / f"d{i}").mkdir(parents=True)
        (tmp_path / "src" / f"d{i}" / "a.ts").write_text(str(i))
    for content in ("none", "whole"):
        reader = trees._Reader({"path": str(tmp_path), "content": content, "partitions": "8"})
        parts = reader.partitions()
        assert len(parts) <= 16
        assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(f"src/d{i}/a.ts" for i in range(300))


def test_model_tables_come_as_columns(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from tallyloom.llm import toxicity as T

    def rows(*_):
        raise AssertionError("rows as objects")

    for name in ("collect", "toPandas"):
        monkeypatch.setattr(DataFrame, name, rows)
    train = spark.createDataFrame([(i % 2, f"{'bad vile word' if i % 2 else 'good kind word'} number {i % 5}") for i in range(60)], "toxic int, text string")
    model = T.train_models(train)
    assert (model.keys[1:] > model.keys[:-1]).all() and (model.telling[1:] > model.telling[:-1]).all()
    tox, ordinary = model.log_likelihoods([b"bad", b"vile", b"word"])
    assert tox > ordinary


def test_labels_are_guessed_for_nodes_that_lead_others_alone(spark, monkeypatch):
    from tallyloom.operators import graphs as G

    hubs, n, written = 6, 200, {}

    def counted(df, name, cut=G.cut):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(G, "cut", counted)
    pairs = {(i, i + 1) for i in range(hubs - 1)} | {(hubs + i, i % hubs) for i in range(n)} | {(hubs + i, (i * 7 + 1) % hubs) for i in range(n)}
    found = {r.node: r.label for r in G.communities(spark.createDataFrame([("g", a, b) for a, b in pairs], "repo string, src long, dst long"), "repo").collect()}
    near = {x: sorted(b for a, b in pairs if a == x) + sorted(a for a, b in pairs if b == x) for x in range(hubs + n)}
    assert found == G.propagate_labels(near)
    # All labels once at the start and once a sweep; in a sweep's rounds, one for each hub at most, those of hubs alone.
    assert written["labels"] <= 6 * (hubs + n) + 5 * (hubs + 2) * hubs


def test_task_tables_come_from_one_that_is_written(spark, tiny):
    from tallyloom.operators import reuse as R

    found = registry.QUERIES["z07_reusable_tasks"](spark, tiny)
    assert not any("lineitem" in f for f in found.inputFiles())  # four task tables come from one that is written
    r = "struct('a' as path, 1 as line_from, 1 as line_to, 0 as byte_from, 2 as byte_to)"
    t = spark.sql(f"select 1 as ord, 't' as task_id, 'source' as kind, array({r}) as owned, array(1) as flows, array(1) as obligations, array('b') as dependencies")
    texts = spark.sql("select 'a' as path, 'x\ny\n' as text")
    runs = spark.sql("select 1 as ord, 't' as task_id, 'completed' as status, false as superseded, array('c') as observed")
    status = lambda path, sealed=t: R.reusable_tasks(t.drop("dependencies"), t, texts, texts, sealed.select("task_id", "owned"), runs, spark.sql(f"select '{path}' as path")).first().status
    assert [status(p) for p in "abcd"] == ["affected", "affected", "observed", "reuse"]
    assert status("d", t.where("false")) == "unsealed"


def test_texts_are_read_once_for_all_languages(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators import imports as M

    met = spark.sparkContext.accumulator(0)

    def seen(text):
        met.add(1)
        return text

    rows = [("r", "a.ts", "import './b'"), ("r", "b.ts", ""), ("r", "c.py", "import os"), ("r", "d.rs", "use std::fmt;"), ("r", "e.go", 'import "fmt"')]
    files = spark.createDataFrame(rows, "repo string, path string, text string").withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    found = {(r.path, r.specifier): r.classification for r in M.resolved(files).collect()}
    assert found == {("a.ts", "./b"): "local-resolved", ("c.py", "os"): "external", ("d.rs", "std::fmt"): "external", ("e.go", "fmt"): "external"}
    assert met.value == len(rows)


def test_paths_are_never_the_table_of_the_join_with_roots(spark):
    from tallyloom.operators import joins as J

    f = spark.sql("select * from values ('a/b/c.ts'), ('a/x.ts'), ('y.ts') as t(path)")
    found = J.longest_prefix(f, spark.sql("select * from values ('a'), ('a/b'), ('a') as t(root)"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan
    assert sorted(map(tuple, found.collect())) == [("a/b/c.ts", "a/b"), ("a/x.ts", "a"), ("y.ts", ".")]


def test_candidates_and_edges_of_a_plan_are_written_once(spark, monkeypatch):
    from tallyloom.operators import packing, scans
    from tallyloom.operators import workplan as P

    written = {}

    def counted(df, name, cut=P.cut):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    for module in (P, packing, scans):
        monkeypatch.setattr(module, "cut", counted)
    files = spark.range(60).selectExpr("'u' || id % 3 as unit", "'f' || lpad(id, 3, '0') as path", "id as bytes", "'s' || id as sha256", "10 + id as tokens")
    kinds = "element_at(array('local-resolved', 'local-unresolved', 'external', 'external'), cast(1 + id % 4 as int))"
    edges = spark.range(4000).selectExpr("'f' || lpad(id % 60, 3, '0') as src", "id as ord", "'./' || id as specifier", f"{kinds} as kind", "array('f' || lpad(id * 7 % 60, 3, '0')) as targets")
    P.derived(files.selectExpr("unit as unit_key", "path"), files, edges, P.Policy(5, 200))
    # Edges inside once, candidates of three units once, unresolved edges once.
    assert sum(written.values()) <= 2000 + 3 * 60 + 1000 + 60


def test_equal_tables_of_plans_arent_held_against_each_other_row_by_row(spark):
    from tallyloom.operators import workplan as P

    have = spark.range(900).selectExpr("'u' || id % 3 as unit_key", "id as n", "case when id % 2 = 0 then 'a' end as target", "case when id % 2 = 1 then 'a' end as cap")
    swapped = have.selectExpr("unit_key", "n", "if(n = 4, cap, target) as target", "if(n = 4, target, cap) as cap")  # a null changes places
    twice = have.where("n <> 5").unionByName(have.where("n = 8"))
    differ = lambda want: sorted(r[0] for r in P._units_that_differ(have, want).collect())
    assert [differ(have.repartition(5)), differ(swapped), differ(twice), differ(have.where("n < 0"))] == [[], ["u1"], ["u2"], ["u0", "u1", "u2"]]


def test_events_are_replayed_without_parts_that_their_types_dont_need(spark, monkeypatch):
    from tallyloom.operators import replay as P

    written = {}

    def counted(df, name, cut=P.cut):
        out = cut(df, name)
        written[name] = (len(out.columns), out.where("invalidated is not null").count() if "invalidated" in out.columns else 0)
        return out

    monkeypatch.setattr(P, "cut", counted)
    made = {"log": "'a'", "pos": "id", "run_id": "'r'", "seq": "id + 1", "event_id": "'e' || id", "type": "if(id = 0, 'run.created', 'coverage.finalized')", "domain": "'d'", "artifact_sha": "'x'", "invalidated": "array('k')", "complete": "true", "preserve": "true", "recovered": "true"}
    kinds = dict(c.strip().split(" ") for c in P.EVENT.split(","))
    events = spark.range(50).selectExpr(*(f"cast({made.get(c, 'null')} as {k}) as {c}" for c, k in kinds.items()))
    found = P.replayed(events).collect()
    assert [(r.error, r.last_seq, r.covered) for r in found] == [(None, 50, True)]
    assert "judged" not in written and written["events"][1] == 0


def test_ends_of_a_scan_are_taken_from_marked_rows(spark):
    from tallyloom.operators.scans import prefix_scan

    found = prefix_scan(spark.range(5000).repartition(7), [], ["id"], total={"t": "id"})
    ends = spark.read.parquet(*found.inputFiles()).where("_scan_end").collect()
    assert sorted(r["_scan_part"] for r in ends) == sorted({r["_scan_part"] for r in ends}) and max(r["id"] for r in ends) == 4999
    assert found.where("t <> id * (id - 1) / 2").count() == 0


def test_lines_of_a_flow_are_gathered_in_its_row(spark):
    import random
    import re

    from tallyloom.operators import taint as T

    rnd = random.Random(8)
    line = lambda: rnd.choice([None, rnd.randrange(1, 700)])
    file = lambda: rnd.choice("ab")
    flows = [(i, file(), line(), rnd.choice(["a", "b", "", None]), line(), [f"{file()}:{rnd.randrange(1, 700)} x" for _ in range(rnd.randrange(3))] + ["no place"]) for i in range(80)]
    calls = [(file(), rnd.randrange(1, 800), rnd.choice(["escape", "lib.parseInt", "other"])) for _ in range(60)]
    found = T.path_sanitizers(spark.createDataFrame(flows, "ord long, entry_file string, entry_line int, terminal_file string, terminal_line int, via array<string>"), spark.createDataFrame(calls, "file string, line int, callee string"))
    want = {}
    for i, ef, el, tf, tl, via in flows:
        at = [(ef, el), (tf, tl), *((v[0], int(v[2:-2])) for v in via if v != "no place")]
        for f in {f for f, _ in at if f}:
            lines = [x for g, x in at if g == f and x is not None]
            want.setdefault(i, set()).update(c for c in calls if c[2] != "other" and c[0] == f and (not lines or min(lines) - 50 <= c[1] <= max(lines) + 50))
    assert {r.ord: [tuple(s) for s in r.sanitizers] for r in found.collect()} == {i: sorted(s) for i, s in want.items() if s}
    assert not re.search(r"Aggregate \[ord#\d+L?, ", found._jdf.queryExecution().optimizedPlan().toString())


def test_variables_with_one_arrow_are_no_turns_of_taint(spark, monkeypatch):
    from tallyloom.operators import taint as T

    written = []

    def counted(df, name, cut=T.cut):
        written.append(name)
        return cut(df, name)

    monkeypatch.setattr(T, "cut", counted)
    n = 40
    rows = [("f", 0, "v0", "req.body.x")] + [("f", k, f"v{k}", f"wrap(v{k - 1})") for k in range(1, n)] + [("f", n, "a", "b"), ("f", n + 1, "b", "a"), ("f", n + 2, "c", "c + b")]
    calls = spark.createDataFrame([], "file string, ord long, callee string, args array<string>")
    functions = spark.createDataFrame([], "name string, file string, params array<string>")
    found = T.tainted(spark.createDataFrame(rows, "file string, ord long, name string, expr string"), calls, functions)
    assert {r.name: r.round for r in found.collect()} == {f"v{k}": 1 for k in range(n)}
    assert len(written) <= 16  # the doublings of a chain of 40, no table for each of its steps
