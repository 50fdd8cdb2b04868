"""Prefix scans and what is built on them, against loops."""

import random

import pytest

from tallyloom.operators import packing
from tallyloom.operators.scans import prefix_scan


@pytest.fixture
def small_batches(spark):
    """Keys that go on over batches and over partitions."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("n_keys", [1, 2, 40])
def test_prefix_scan_equals_a_loop(spark, small_batches, n_keys):
    rnd = random.Random(n_keys)
    rows = [(rnd.choice([None, *map(str, range(n_keys))]), i, rnd.choice([None, None, (rnd.randrange(9), None)]), rnd.choice([None, rnd.randrange(-5, 6)]), rnd.random()) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, s struct<a:long,b:long>, x long, y double").repartition(5)
    got = prefix_scan(df, ["k"], ["i"], last={"s0": "s", "i0": "i"}, total={"x0": "x", "y0": "y"}, most={"m0": "x"}).collect()
    folds = {}
    want = {}
    for k, i, s, x, y in sorted(rows, key=lambda r: r[1]):
        f = folds.setdefault(k, [None, None, 0, 0.0, None])
        want[i] = tuple(f)
        f[0] = s if s is not None else f[0]
        f[1], f[2], f[3] = i, f[2] + (x or 0), f[3] + y
        f[4] = x if f[4] is None or (x is not None and x > f[4]) else f[4]
    assert len(got) == 300
    for r in got:
        s0, i0, x0, y0, m0 = want[r.i]
        assert (r.s0 and tuple(r.s0), r.i0, r.x0, r.m0) == (s0, i0, x0, m0) and abs(r.y0 - y0) < 1e-9
    assert prefix_scan(df.limit(0), ["k"], ["i"], last={"s0": "s"}, total={"x0": "x"}).count() == 0


def test_scan_without_key_is_one_order(spark, small_batches):
    df = spark.range(100).repartition(7)
    assert all(r.t == r.id * (r.id - 1) // 2 for r in prefix_scan(df, [], ["id"], total={"t": "id"}).collect())


def chunks(sizes, max_items, max_size):
    out, n, z, k = [], 0, 0, 0
    for x in sizes:
        if n and (n >= max_items or z + x > max_size):
            n, z, k = 0, 0, k + 1
        n, z = n + 1, z + x
        out.append((k, x > max_size))
    return out


def test_chunks_equal_the_fold(spark, small_batches):
    rnd = random.Random(7)
    units = {u: [rnd.choice([None, 0, 1, 2, 5, 9, 40]) for _ in range(rnd.choice([1, 2, 30, 200]))] for u in ["a", "b", None, "c", "d"]}
    rows = [(u, i, z) for u, zs in units.items() for i, z in enumerate(zs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "unit string, item long, size long").repartition(4)
    for max_items, max_size in ((5, 20), (1000, 7), (1000, 10_000)):
        got = sorted((tuple(r) for r in packing.sequential_chunks(df.where("unit is not null"), "unit", "item", "size", max_items, max_size).collect()), key=str)
        want = sorted(((u, i, *c) for u, zs in units.items() if u for i, c in enumerate(chunks([z or 0 for z in zs], max_items, max_size))), key=str)
        assert got == want
    named = {(r["unit"], r["chunk"]): r["id"] for r in packing.chunk_summary(packing.sequential_chunks(df, "unit", "item", "size", 1000, 10_000), "unit").collect()}
    assert named["a", 0] == "a"
    more = {r["id"] for r in packing.chunk_summary(packing.sequential_chunks(df.where("unit is not null"), "unit", "item", "size", 5, 20), "unit").collect()}
    assert "a" in more or "a#001" in more


def test_selection_equals_the_loop(spark):
    rnd = random.Random(2)
    rows = [(u, rnd.randrange(5), i, rnd.choice([None, 1, 3, 8, 30])) for u in "abc" for i in range(rnd.choice([1, 10, 60]))]
    df = spark.createDataFrame(rows, "unit string, score long, item long, size long")
    for max_items, max_size in ((4, 20), (100, 25), (1, 5), (3, 0)):
        want = []
        for u in "abc":
            n = z = 0
            for _, _, i, size in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[1], r[2])):
                fits = n < max_items and z + (size or 0) <= max_size
                want.append((u, i, "selected" if fits else "file-cap" if n >= max_items else "token-cap"))
                n, z = (n + 1, z + (size or 0)) if fits else (n, z)
        got = packing.budget_selection(df, "unit", ["-score"], "item", "size", max_items, max_size).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_selection_of_units_over_partitions_equals_the_loop(spark, small_batches):
    rnd = random.Random(5)
    rows = [(f"u{u:02d}", rnd.randrange(5), i, rnd.choice([None, 1, 3, 8, 30])) for u, n in enumerate([1, 200, 3, 4, 2, 90, 5]) for i in range(n)]
    df = spark.createDataFrame(rows, "unit string, score long, item long, size long").repartition(5)
    for max_items, max_size in ((4, 20), (100, 250), (0, 5)):
        want, place = [], {}
        for u, score, i, size in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
            n, z, missed = place.get(u, (0, 0, 0))
            fits = n < max_items and z + (size or 0) <= max_size
            want.append((u, i, "selected" if fits else "file-cap" if n >= max_items else "token-cap", score, missed))
            place[u] = (n + 1, z + (size or 0), missed) if fits else (n, z, missed + 1)
        got = packing.budget_selection(df, "unit", ["-score"], "item", "size", max_items, max_size, keep=("score",), misfits="missed").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
