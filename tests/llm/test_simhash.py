"""Covering hashing against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tallyloom.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(points, radius):
    up = list(range(len(points)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(points))]


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root, least = roots(prints, 3), {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_every_choice_of_places_is_left_out_by_some_mask(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rnd = random.Random(radius)
    for _ in range(5000):
        away = sum(1 << i for i in rnd.sample(range(64), radius))
        assert any(not m & away for m in masks)


def test_tables_equal_brute_force(spark, tiny, odd, nothing):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert found(simhash.near_duplicates(docs.repartition(5))) == brute([(r.doc_id, r.text) for r in docs.collect()])
    clash = odd.selectExpr("*", "n as fp", "n as copies", "n as component_id", "n as bucket")
    assert found(simhash.near_duplicates(clash)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(nothing).count() == 0


def connected(spark, points, radius, most):
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long").repartition(4)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, radius, most).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    at = {p: i for i, p in enumerate(points)}
    up = list(range(len(points)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[top(at[a])] = top(at[b])
    return [top(i) for i in range(len(points))]


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("most", [16, 1024])
def test_links_connect_what_all_pairs_connect_also_where_buckets_are_parted(spark, most):
    rnd = random.Random(most)
    points = {0, (1 << 64) - 1}
    for centre in (rnd.getrandbits(64) for _ in range(12)):
        for _ in range(60):  # clouds with links and gaps
            p = centre
            for i in rnd.sample(range(64), rnd.randrange(0, 6)):
                p ^= 1 << i
            points.add(p)
    for _ in range(200):  # dense within few free places, so that buckets are large in every table
        points.add(0x5A5A << 40 | sum(1 << i for i in rnd.sample(range(0, 30), 5)))
    points = sorted(points)
    assert same_classes(connected(spark, points, 3, most), roots(points, 3))


def test_bits_and_slices_of_long_texts(monkeypatch):
    import tallyloom.llm.common as common

    text = " ".join(random.Random(1).choice("abc") * 3 for _ in range(3000)) + " İSTANBUL Straße \x1c x"
    want = brute_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "slices_of", lambda data: common.slices_of(data, 8))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == brute_fingerprint("one TWO") != 0
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_parts_cover_the_free_bits_once():
    for fixed in (0, simhash.covering_masks()[3], (1 << 60) - 1):
        parts = simhash.parts_of(fixed, 4)
        assert sum(parts) | fixed == (1 << 64) - 1 and sum(parts) & fixed == 0


def test_forest_spans_what_is_linked():
    far = ((1 << 50) - 1) << 10
    edges = simhash.forest(np.array([0, far, 7, 63, far ^ 15], np.uint64), 3)
    assert sorted(edges) == [(0, 2), (2, 3)]
