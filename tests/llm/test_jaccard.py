import itertools
import random

import numpy as np
import pytest

from tallyloom.llm import jaccard
from tallyloom.llm.common import LEAST_BITS, words_of
from tallyloom.llm.jaccard import chance, depth_for, forest, one_of_each, rarest, shortened, similar_classes


def brute(rows, k=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted((rows[i][0], min(groups[top(i)]), links[i]) for i in range(len(rows)))


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice([1, 1, 2, 6, 40 if g == 3 else 3])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_odd_rows(spark, odd, nothing):
    got = {(r.doc_id, r.class_id, r.n_links) for r in similar_classes(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 6, 1), (None, None, 0), (10, 10, 0)} <= got
    kept = sorted((r.doc_id or 0, r.text or "") for r in one_of_each(odd).collect())
    assert [k for k, _ in kept] == [0, 1, 4, 5, 6, 8, 9, 10]
    assert similar_classes(nothing).collect() == [] and one_of_each(nothing).collect() == []


def test_depth_is_shortened_by_what_was_found():
    assert depth_for(0.5, 0.8, 1, 7) == 3 and depth_for(0.9999, 0.8, 24, 7) == 5
    assert shortened({}, 7) == 5  # the imagined link alone
    assert shortened({0: 1000}, 7) == 5 and shortened({19: 100_000}, 7) == 7 and shortened({19: 100_000, 0: 4000}, 7) == 6
    assert [d for d in range(7, 0, -1) if chance(0.8, d) >= 0.9999][0] == 5


@pytest.mark.parametrize("partitions", [1, 6])
def test_the_forest_connects_what_shares_a_prefix_and_nothing_else(spark, monkeypatch, partitions):
    rng, trees, depth, least = np.random.default_rng(9), 3, 4, 2
    labels = rng.integers(0, 3, (120, trees, depth))
    nodes = spark.createDataFrame([(int(i) * 7 - 300, x.astype(">u2").tobytes()) for i, x in enumerate(labels)], "short long, signature binary")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        edges = [(r.a, r.b, r.level) for r in forest(nodes, trees, depth, least).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    at = {int(i) * 7 - 300: x for i, x in enumerate(labels)}
    assert len(edges) <= trees * len(at)
    for level in range(least, depth + 1):
        for a, b, n in edges:
            assert n < level or any((at[a][t, :level] == at[b][t, :level]).all() for t in range(trees))
        up = {i: i for i in at}

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b, n in edges:
            if n >= level:
                up[top(a)] = top(b)
        for a, b in itertools.combinations(at, 2):
            if any((at[a][t, :level] == at[b][t, :level]).all() for t in range(trees)):
                assert top(a) == top(b)


def test_rarest_shingles_meet_wherever_sets_are_similar():
    rng, common = np.random.default_rng(4), np.zeros(LEAST_BITS // 8, np.uint8)
    common[rng.integers(0, len(common), len(common) // 2)] = 255
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 60)), dtype=np.uint64))
        b = a[rng.random(len(a)) > 0.12]
        if len(b) and len(b) >= 0.8 * len(a):
            assert set(rarest(a, common, 0.8).tolist()) & set(rarest(b, common, 0.8).tolist())


@pytest.mark.parametrize("whole", [1, 3])
def test_large_clusters_are_parted_without_loss(spark, monkeypatch, whole):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
    monkeypatch.setattr(jaccard, "WHOLE_BLOCKS", whole)
    rows = corpus(11)
    passage = [f"p{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(passage + [f"own{i}x{k}" for k in range(20)])) for i in range(40)]  # a passage in common, and no link
    got = sorted(map(tuple, similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_a_key_bitmap_misses_no_key(spark):
    from pyspark.sql import functions as F

    from tallyloom.llm.common import key_bitmap, with_maybe

    keys = spark.range(2000).select(F.xxhash64("id").alias("k"))
    other = spark.range(2000, 52_000).select(F.xxhash64("id").alias("k"))
    bitmap = key_bitmap(keys, "k", "test-keys")
    assert with_maybe(keys, "k", bitmap).where("not _maybe").count() == 0
    assert with_maybe(other, "k", bitmap).where("_maybe").count() < 100
    bits, at = bitmap.array(), [r.k % bitmap.bits for r in keys.collect()]
    assert all(bits[i >> 3] >> (i & 7) & 1 for i in at) and int(np.unpackbits(bits).sum()) == len(set(at))


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_facts_of_frequent_keys_are_joined_alike(spark, most):
    from tallyloom.llm.common import join_facts

    rows = [("a",)] * 50 + [("b",)] * 5 + [("c",)] + [(None,)] * 3 + [("x",)]
    facts = spark.createDataFrame([("a", 50), ("b", 5), ("c", 1), ("d", 9)], "k string, n int")
    got = join_facts(spark.createDataFrame(rows, "k string"), facts, "k", "n", most).collect()
    assert sorted((r.k or "", r.n or 0) for r in got) == [("", 0)] * 3 + [("a", 50)] * 50 + [("b", 5)] * 5 + [("c", 1), ("x", 0)]
