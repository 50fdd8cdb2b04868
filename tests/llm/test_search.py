import random

import numpy as np
import pytest

from tallyloom.llm.common import words_of
from tallyloom.llm.decontamination import SAMPLE_EVERY, FMIndex, WaveletMatrix, Windows, benchmark_blocks, find_spans, search_shard, without_contaminated


def brute(text, items, window=13):
    ws, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(ws), len(hit), sorted(found)


def test_ranks():
    v = np.random.default_rng(1).integers(0, 11, 200)
    t = WaveletMatrix(v, 4)
    ends = np.arange(201)
    for s in range(11):
        assert t.rank(np.full(201, s), ends).tolist() == [int((v[:e] == s).sum()) for e in ends]
    assert t.value(np.arange(200)).tolist() == v.tolist()


def test_only_sampled_positions_are_kept():
    index = FMIndex(np.append(np.random.default_rng(6).integers(1, 9, 999), 0), 8)
    assert len(index.position) <= 1000 // SAMPLE_EVERY + 2 and not any(len(x) >= 1000 for x in vars(index).values() if isinstance(x, np.ndarray))


def test_backward_search_finds_all_places():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (30, 1, 17, 50)])
    index = FMIndex(text, 3)
    for n in (1, 2, 4):
        patterns = np.array(sorted({tuple(text[i : i + n]) for i in range(len(text) - n) if 0 not in text[i : i + n]}))
        lo, hi = index.ranges(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [("b", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), ("a", "Short item"), ("c", ""), ("d", None)]


def test_spans_equal_brute_force():
    texts = ["x " + ITEMS[0][1] + " y short, ITEM! z short item", "alpha beta gamma", "", "short item short item", (ITEMS[0][1] + " ") * 3]
    windows = Windows(ITEMS, 13)
    n_hit, spans, items = search_shard([windows.numbers(words_of(t)) for t in texts], windows)
    for t, h, s, i in zip(texts, n_hit, spans, items, strict=True):
        assert (len(words_of(t)), h, sorted(i)) == brute(t, ITEMS)
        assert sum(e - b for b, e in s) == h and all(a[1] < b[0] for a, b in zip(s, s[1:], strict=False))


@pytest.mark.parametrize("block_words", [4_000_000, 2])
def test_blocks_of_a_large_benchmark_say_the_same(spark, odd, nothing, block_words):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs far away from"), (2, "one two"), (3, None), (None, "no id here")], "item_id long, text string")
    items = [("1", "The quick brown fox jumps over the lazy dog and runs far away from"), ("2", "one two"), ("", "no id here")]
    got = sorted((r.n_words, r.n_hit, r["items"]) for r in find_spans(odd.select("doc_id", "text"), bench, block_words=block_words).collect())
    assert got == sorted(brute(r.text, items) for r in odd.collect())
    assert find_spans(nothing.select("doc_id", "text"), bench).collect() == []


def test_empty_benchmark(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_spans(odd.select("doc_id", "text"), bench).collect()} == {0}


@pytest.mark.parametrize(("shard_words", "block_words"), [(1, 4_000_000), (10_000_000, 2)])
def test_shards_of_any_size_and_clashing_columns(spark, odd, shard_words, block_words):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs far away from"), (2, "one two")], "item_id long, text string")
    items = [("1", "The quick brown fox jumps over the lazy dog and runs far away from"), ("2", "one two")]
    docs = odd.selectExpr("*", "doc_id as `n_words`", "'x' as spans", "array(1) as `items`", "-1 as N_HIT", "2 as _row", "3 as `_items`", "4 as `a b`")
    got = find_spans(docs, bench, shard_words=shard_words, block_words=block_words)
    assert got.columns == [*docs.columns, "n_words_", "n_hit_", "items_", "spans_"]
    rows = got.collect()
    assert all((r["n_words"], r["spans"], r["items"], r["N_HIT"], r["_row"], r["_items"]) == (r.doc_id, "x", [1], -1, 2, 3) for r in rows)
    assert sorted((r["n_words_"], r["n_hit_"], r["items_"]) for r in rows) == sorted(brute(r.text, items) for r in odd.collect())
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in odd.collect() if not (h := brute(r.text, items))[1] or 20 * h[1] < h[0])


def test_long_items_come_in_pieces_that_lose_no_window(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(300)}" for _ in range(900)]
    bench = spark.createDataFrame([("long", " ".join(words).upper()), ("long", " ".join(words).upper()), ("short", "one, two")], "item_id string, text string")
    blocks = list(benchmark_blocks(bench, 400, 13))
    assert len(blocks) > 1 and max(len(t.split()) for b in blocks for _, t in b) <= 40
    windows = lambda ws: {tuple(ws[i : i + 13]) for i in range(len(ws) - 12)}
    assert set().union(*(windows(t.split()) for b in blocks for i, t in b if i == "long")) == windows(words)
    assert [t for b in blocks for i, t in b if i == "short"] == ["one two"]
    docs = spark.createDataFrame([(1, " ".join(words[400:460])), (2, "so one two"), (3, "none of it")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in find_spans(docs, bench, block_words=400).collect()}
    assert got == {1: (60, ["long"]), 2: (2, ["short"]), 3: (0, [])}
