"""The inverted index against a scan of the texts."""

import random

import numpy as np
import pytest

from tallyloom.operators import search as S


def holds(query, any_of, text, tags):
    words = S.words_of(text)
    inside = lambda p: any(tuple(words[i : i + len(p)]) == p for i in range(len(words) - len(p) + 1))
    parsed = S.web_query(query)
    return (not parsed or any(all(inside(p) == yes for yes, p in clauses) for clauses in parsed)) and all(not x or set(x) & set(tags or []) for x in any_of)


def test_query_forms():
    assert S.web_query('Red -ring') == [[(True, ("red",)), (False, ("ring",))]]
    assert S.web_query('a b or "c d" -"e f" OR') == [[(True, ("a",)), (True, ("b",))], [(True, ("c", "d")), (False, ("e", "f"))]]
    assert S.web_query('or -- "" foo-bar "open end') == [[(True, ("foo", "bar")), (True, ("open", "end"))]]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = ["red", "ring", "blue", "The", "naïve", "x1", "end"]
    rows = [(rnd.choice([i, i, i // 2]), None if rnd.random() < 0.05 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(9))) + rnd.choice(["", ".", "-red"]), rnd.choice([None, [], ["p:a"], ["p:a", "p:b", None], ["k:x", "p:b"], ["k:x"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, body string, marks array<string>").repartition(5)
    root = str(tmp_path_factory.mktemp("index") / "i")
    S.write_index(df, root, "n", "body", "marks", 16)
    return rows, root


@pytest.mark.parametrize(
    ("query", "any_of"),
    [("red", []), ("red -ring", []), ("-red", []), ("", [["k:x"]]), ('"red ring"', []), ('"the red ring" or naïve x1', []), ("red or -blue", [["p:a", "p:b"], ["k:x"]]), ('blue-red -"red red"', [[]]), ("nothing", []), ("red", [["p:zzz"]]), ('"end the" end', [["p:a"]])],
)
def test_search_equals_a_scan(spark, indexed, query, any_of):
    rows, root = indexed
    want = sorted(n for n, text, tags in rows if holds(query, any_of, text, tags))
    found = S.search(spark, root, query, any_of)
    got = []
    for offset in range(0, len(want) + 1, 20):
        page = S.matched_page(spark, root, found, offset, 20).collect() if offset < 60 else []
        assert all(r["total"] == len(want) and r["next_offset"] == (offset + 20 if offset + 20 < len(want) else None) for r in page)
        got += sorted(r["id"] for r in page)
    assert got == want[: min(60, 20 * (len(want) // 20 + 1))] and found.count() == len(want)


def test_search_reads_its_terms_alone(spark, indexed, tmp_path):
    plan = S.search(spark, indexed[1], "red -ring")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    S.write_index(spark.createDataFrame([], "n long, body string"), str(tmp_path / "none"), "n", "body")
    with pytest.raises(ValueError):
        S.matched_page(spark, indexed[1], S.search(spark, indexed[1], "red"), 0, 21)


def test_postings_of_a_block_are_made_at_once(monkeypatch):
    rnd = random.Random(4)
    block = [[rnd.randrange(30) for _ in range(rnd.choice([0, 1, 5, 60]))] for _ in range(50)]
    calls = []

    def counted(values, starts, differences=S._differences):
        calls.append(1)
        return differences(values, starts)

    monkeypatch.setattr(S, "_differences", counted)
    at = [np.arange(len(words)) for words in block]
    docs, counts, places = S._postings(np.concatenate([np.array(w, np.int64) for w in block]), np.repeat(np.arange(50), [len(w) for w in block]), np.concatenate(at), 31)
    assert len(calls) == 2  # not two for each term
    for term in range(31):
        want = [(d, [i for i, w in enumerate(words) if w == term]) for d, words in enumerate(block) if term in words]
        n = np.frombuffer(counts[term].as_py(), "<u4").astype(np.int64)
        assert np.cumsum(np.frombuffer(docs[term].as_py(), "<u2")).tolist() == [d for d, _ in want] and n.tolist() == [len(p) for _, p in want]
        if want:
            assert S._restored(np.frombuffer(places[term].as_py(), "<u4").astype(np.int64), n).tolist() == [i for _, p in want for i in p]
    assert S.words_of("A_b __ c1_") == ["a", "b", "c1"]
