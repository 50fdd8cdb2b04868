"""Importance resampling against a plain version, and radix selection against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tallyloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n_max=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, n_max=1, buckets=10_000, percent=10, least=20):
    raw, goal = [0] * buckets, [0] * buckets
    found = [(i, *features(t, n_max)) for i, t in rows]
    for _, _, f in found:
        for h in f:
            raw[h % buckets] += 1
    for t in target:
        for h in features(t, n_max)[1]:
            goal[h % buckets] += 1
    s, t = sum(raw), sum(goal)
    gain = [math.floor(1000 * math.log((y + 1) * (s + buckets) / ((x + 1) * (t + buckets)))) for x, y in zip(raw, goal, strict=True)]
    out = []
    for i, n_words, f in found:
        weight = math.floor(sum(gain[h % buckets] for h in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r.append(k + 1)
    return sorted(((r[0], r[2], r[3], r[4], r[5] if len(r) > 5 else None) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("n_max", [1, 3])
def test_whole_table_equals_brute_force(spark, tiny, n_max):
    docs, goal = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in goal.collect()], n_max)
    assert rows_of(resampling.resampled(docs.repartition(5), goal, n_max)) == want


def test_odd_rows(spark, odd, nothing):
    goal = odd.where("doc_id < 4").select("text", "n")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for percent, least in ((100, 0), (50, 2), (34, 0), (10, 20)):
        got = rows_of(resampling.resampled(odd, goal, percent=percent, least_words=least))
        assert got == brute(rows, [r.text for r in goal.collect()], percent=percent, least=least)
    assert resampling.resampled(nothing, goal).count() == 0
    assert resampling.resampled(odd, nothing).count() == odd.count()


def test_repeats_are_drawn_as_far_as_there_is_room(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 5 + [(8, None)] * 3, "doc_id long, text string")
    got = resampling.resampled(docs, docs, percent=50, least_words=0)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4]
    assert got.count() == 8


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("digits", [1, 4, 7])
def test_radix_selection_finds_the_key_that_sorting_finds(spark, kind, digits):
    rnd = random.Random(digits)
    ids = [rnd.choice([rnd.randrange(-50, 50), rnd.randrange(-(1 << 31), 1 << 31), None]) for _ in range(400)]
    rows = [(i if kind != "string" or i is None else str(i), True, rnd.randrange(-3, 3)) for i in ids]
    df = spark.createDataFrame(rows, f"doc_id {kind}, eligible boolean, score long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0].encode() if isinstance(r[0], str) else r[0] or 0))
    for wanted in (0, 1, 57, 200, 399, 400):
        got = sorted((r for r in resampling.ranked(df, wanted, digits).collect() if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, wanted + 1))
        assert [(r["score"], r["doc_id"]) for r in got] == [(r[2], r[0]) for r in order[:wanted]]


def test_slices_give_the_runs_of_the_whole_text(monkeypatch):
    import tallyloom.llm.common as common

    text = "aa bb-cc  dd\n" * 50 + "x" * 300 + " end"
    whole = sorted(h for a in resampling.feature_hashes(text, 3) for h in a.tolist())
    monkeypatch.setattr(resampling, "slices_of", lambda data: common.slices_of(data, 16))
    assert sorted(h for a in resampling.feature_hashes(text, 3) for h in a.tolist()) == whole == sorted(features(text, 3)[1])
