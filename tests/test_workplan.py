"""Work plans against a plain construction; each check of a stored plan provoked."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import digests, workplan


def plain_plan(files, edges, p):
    """units, context, omitted, unresolved by loops over sorted lists."""
    tokens = {f[1]: f[4] for f in files}
    chunks = []
    for unit in sorted({f[0] for f in files}):
        mine, n, z = [], 0, 0
        for _, path, _, _, t in sorted(f for f in files if f[0] == unit):
            if n and (n >= p.max_owned_files or z + t > p.max_owned_tokens):
                chunks.append((unit, mine))
                mine, n, z = [], 0, 0
            mine, n, z = [*mine, path], n + 1, z + t
        chunks.append((unit, mine))
    units, context, omitted, unresolved = {}, set(), [], []
    for unit, owned in chunks:
        at, refs, first, open_ = owned[0], {}, {}, []
        for path in owned:
            for src, ord_, spec, kind, targets in sorted(e for e in edges if e[0] == path):
                if kind == "local-unresolved":
                    open_.append((src, spec, "unresolved", None, None))
                for t in targets if kind == "local-resolved" else []:
                    if t not in owned:
                        refs[t] = refs.get(t, 0) + 1
                        first.setdefault(t, (src, spec))
        n, z, misfits, taken = p.max_context_files, p.max_context_tokens, [], 0
        for t in sorted(refs, key=lambda t: (-refs[t], tokens.get(t, 0), t)):
            if n > 0 and tokens.get(t, 0) <= z:
                n, z, taken = n - 1, z - tokens.get(t, 0), taken + tokens.get(t, 0)
                if t in tokens:
                    context.add((at, t))
            else:
                reason = "token-cap" if n > 0 else "file-cap"
                misfits.append((t, reason, tokens.get(t, 0), refs[t]))
                open_.append((*first[t], "context-cap", t, reason))
        own = sum(tokens[x] for x in owned)
        units[at] = (unit, len(owned), len(refs), own, taken, own + taken)
        omitted += [(at, i, *m) for i, m in enumerate(misfits)]
        unresolved += [(at, i, *u) for i, u in enumerate(open_)]
    return units, context, omitted, unresolved


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(3)
    files = [(f"u{i % 4}", f"f{i:02d}", 4 * i, f"sha{i}", rnd.choice([0, 5, 10, 90])) for i in range(40)]
    edges = [(f"f{rnd.randrange(40):02d}", i, f"./s{i}", rnd.choice(["local-resolved"] * 4 + ["local-unresolved", "external"]), [f"f{rnd.randrange(40):02d}" for _ in range(rnd.randrange(1, 3))]) for i in range(160)]
    df = spark.createDataFrame(files, "unit string, path string, bytes long, sha256 string, tokens long").repartition(3)
    return files, edges, df, spark.createDataFrame(edges, "src string, ord long, specifier string, kind string, targets array<string>").repartition(4)


POLICY = workplan.Policy(4, 60, 3, 100)


@pytest.fixture(scope="module")
def plan(graph):
    return workplan.work_plan(graph[2], graph[3], POLICY)


def test_plan_equals_a_plain_construction(graph, plan):
    units, context, omitted, unresolved = plain_plan(graph[0], graph[1], POLICY)
    at = {r["unit_key"]: r["p"] for r in plan.owned.groupBy("unit_key").agg(F.min("path").alias("p")).collect()}
    assert {at[r["unit_key"]]: (r["source_unit"], r["files"], r["candidates"], r["owned_tokens"], r["selected_tokens"], r["estimated_tokens"]) for r in plan.units.collect()} == units
    assert {(at[r["unit_key"]], r["path"]) for r in plan.context.collect()} == context
    assert sorted((at[r["unit_key"]], *r[1:]) for r in plan.omitted.collect()) == sorted(omitted)
    assert sorted(((at[r["unit_key"]], *r[1:]) for r in plan.unresolved.collect()), key=str) == sorted(unresolved, key=str)
    assert len(omitted) > 20


def test_digest_is_of_the_rows_alone(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1]), (2, None, [1])], "x long, y string, z array<int>")
    same = spark.createDataFrame([(None, "a", 1), ([1], None, 2), ([1], None, 2)], "z array<int>, y string, x long").repartition(3)
    assert digests.digest_of(t=df) == digests.digest_of(t=same) != digests.digest_of(t=df.distinct())
    assert digests.digest_of(t=df.limit(0)) != digests.digest_of(t=df)


def test_each_check_is_provoked(spark, graph, plan):
    _, _, files, edges = graph
    codes = lambda p, f=files, e=edges, **how: {r["code"] for r in workplan.violations(p, f, e, **how).collect()}
    assert codes(plan) == set()
    first = plan.owned.orderBy("path").first()
    hit = (F.col("path") == first["path"]) & (F.col("unit_key") == first["unit_key"])
    changed = lambda df, column, value, where: df.withColumn(column, F.when(where, value).otherwise(F.col(column)))
    other = plan.owned.where(F.col("unit_key") != first["unit_key"]).first()["unit_key"]
    picked = plan.context.first()
    ctx = (F.col("path") == picked["path"]) & (F.col("unit_key") == picked["unit_key"])
    one = F.col("unit_key") == first["unit_key"]
    units = plan.units
    for c in ("candidates", "selected", "owned_tokens", "selected_tokens", "estimated_tokens"):
        units = changed(units, c, F.col(c) + 1, one)
    damaged = plan._replace(
        units=units, owned=changed(changed(plan.owned, "bytes", F.col("bytes") + 1, hit), "source_unit", F.lit("no"), hit), context=changed(plan.context, "sha256", F.lit("x"), ctx).unionByName(plan.context.where(ctx).withColumn("path", F.lit("elsewhere"))),
        omitted=plan.omitted.withColumn("n", 1 - F.col("n")), unresolved=plan.unresolved.unionByName(plan.unresolved.limit(1)),
    )
    assert codes(damaged) == {
        "bytes-differ", "owner-differs", "candidate-count", "selected-count", "owned-tokens", "selected-tokens", "estimated-tokens", "context-differs", "context-without-receipt", "context-receipt-differs", "omitted-differs", "unresolved-differs", "plan-digest",
    }
    third = plan.owned.orderBy(F.desc("path")).first()["path"]
    owned = plan.owned.where(~hit).unionByName(plan.owned.where(F.col("path") == third).withColumn("unit_key", F.lit(other))).unionByName(plan.owned.where(hit).withColumn("path", F.lit("elsewhere")))
    assert {"duplicate-owned", "node-without-unit", "owned-not-in-graph", "plan-digest"} <= codes(plan._replace(owned=owned, plan_digest="0"))
    assert {"graph-digest", "policy"} <= codes(plan, e=edges.where("ord > 0"), chars_per_token=3)
    with pytest.raises(ValueError, match="several units"):
        workplan.work_plan(files.unionByName(files.limit(1)), edges, POLICY)
