import gzip
import hashlib
import itertools
import random
import re

import pytest

from tallyloom.llm import licenses, warc


def test_loser_tree_merges_runs():
    rnd = random.Random(3)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.choice([0, 1, 5, 20]))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys_sort_sites_together():
    assert warc.url_key("http://www.Example.com/A?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert warc.url_key(None) == "" and warc.url_key("http://h:8080/x") == "h:8080)/x" and warc.url_key("http://[bad") == "http://[bad"


def pages(spark):
    big, tricky = "<p>é" + "x" * 1200, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" * 40
    ends = "\r\n" + "\r" * 1100 + "\n\r\n\r\n"
    rows = [(9_000_000_000_000_000_000, "far", "é\r", 1), (300_000_000_000, "http://a.com/", ends, 1), (-5, "y", ends, 1), (1, "http://a.com/", big, 1), (2, "http://b.com/", big, 1), (3, None, None, 1), (4, "u", "", 1), (5, "http://a.com/", tricky, 1), (6, "x\r\ny", tricky, 1), (7, "s", "small", 1), (8, "s", "small", 1), (None, "n", big, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset int")


def test_archives_round_trip(spark, tmp_path):
    p = pages(spark)
    folder = warc.write_archives(p, f"file://{tmp_path}/w")
    got = {(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.merged_histories(warc.capture_runs(spark, folder)).collect()}
    want = set()
    for r in p.collect():
        raw = (r.html or "").encode()
        keep = {x.page_id for x in p.collect() if x.html == r.html and x.page_id}
        revisit = len(raw) >= 1000 and r.page_id != max(keep)
        want.add((str(r.page_id or ""), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", str(max(keep)) if revisit else None))
    assert got == want
    records = [x for f in (tmp_path / "w").glob("part-*.gz") for x in warc.read_archive(f.read_bytes())]
    assert len(records) == 12
    assert all(re.fullmatch(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f"WARC-Date: {head['WARC-Date']}") for _, head, _ in records)
    data = [f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*.gz"))]
    assert [x for d in data for x in warc.read_archive(d)] and len(warc.read_archive(data[0] + data[0])) == 2 * len(warc.read_archive(data[0]))
    # The stream of lines gives the same records, places included.
    for d in data:
        text = gzip.decompress(d).decode()
        got = list(warc.records(("a", line) for line in text.split("\r\n")[:-1]))
        assert [x[1:] for x in got] == warc.read_archive(d)


def test_damaged_archives_are_errors():
    head = "WARC/1.1\r\nContent-Length: 3\r\n\r\n"
    for text in ("x\r\n", head + "ab\r\n\r\n", head + "abcd\r\n\r\n", head + "abc\r\nx\r\n", head + "abc"):
        with pytest.raises(ValueError):
            list(warc.records(("a", line) for line in text.split("\r\n")[:-1]))
    with pytest.raises(ValueError):
        list(warc.records([("a", "WARC/1.1"), ("a", "Content-Length: 3"), ("a", ""), ("b", "abc")]))


def test_histories_are_in_global_order(spark, tiny):
    runs = warc.capture_runs(spark, warc.write_archives(spark.read.parquet(f"{tiny}/pages.parquet").repartition(5)))
    rows = [(r.url_key, r.timestamp, r.page_order) for r in warc.merged_histories(runs).collect()]
    assert rows == sorted(rows) and len(rows) == spark.read.parquet(f"{tiny}/pages.parquet").count()


def test_small_runs_and_ranges_give_the_same_histories(spark, tiny, monkeypatch):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").repartition(3)
    folder = warc.write_archives(pages)
    want = [tuple(r) for r in warc.merged_histories(warc.capture_runs(spark, folder)).collect()]
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    runs = warc.capture_runs(spark, folder)
    merged = warc.merged_histories(runs)
    assert [tuple(r) for r in merged.collect()] == want and merged.rdd.getNumPartitions() > 1
    for name, rows in itertools.groupby(runs.collect(), lambda r: r.run):
        keys = [warc._key(tuple(r)[1:]) for r in rows]
        assert keys == sorted(keys) and len(keys) <= 7 or name is None


def test_runs_that_do_not_ascend_are_several_leaves():
    row = lambda k: (k, "", "", 0, "", 0, 0, "", "", None)
    lists = warc.natural_runs([("a", row("1")), ("b", row("0")), ("a", row("3")), ("a", row("2")), ("b", row("0"))])
    assert [[r[0] for r in x] for x in lists] == [["1", "3"], ["0", "0"], ["2"]]
    assert [r[0] for r in warc.LoserTree(lists, warc._key)] == ["0", "0", "1", "2", "3"]


def test_ids_that_look_like_numbers_are_in_the_order_of_their_texts(spark):
    ids = ["--5", "²", "99999999999999999999", "-7", "12", "x y", "-"]
    pages = spark.createDataFrame([(i, "http://a.example/", "<p>") for i in ids], "page_id string, url string, html string")
    got = [r["page"] for r in warc.merged_histories(warc.capture_runs(spark, warc.write_archives(pages))).collect()]
    assert [x for x in got if x not in ("-7", "12")] == sorted(set(ids) - {"-7", "12"}) and sorted(got) == sorted(ids)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder = warc.write_archives(empty)
    assert warc.merged_histories(warc.capture_runs(spark, folder)).collect() == []


def test_licences(spark, odd, nothing):
    t = licenses.Templates(licenses.TEMPLATES, 0.8)
    found = licenses.matches("Some more prose that stands here before it.\nReleased under the MIT license.\n\nlicensed under the apache license, version 2.0", t)
    assert [n for n, _ in found] == ["MIT", "Apache-2.0"]
    whole = licenses.TEMPLATES["MIT-text"]
    assert licenses.matches(whole.replace(". ", ".\n").replace("sublicense", "relicense"), t)[-1][0] == "MIT-text"
    assert licenses.matches(None, t) == []
    assert {r.licenses for r in licenses.scan_licenses(odd).collect()} == {""}
    assert licenses.scan_licenses(nothing).collect() == []


def test_licences_of_several_blocks_and_within_lines():
    t = licenses.Templates(licenses.TEMPLATES, 0.8)
    mit = licenses.TEMPLATES["MIT-text"]
    cut = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    rest = "\n\n".join(f"paragraph {k} is of other things {k} such as w{k} x{k} y{k}" for k in range(100))
    assert cut.count("\n\n") == 2
    assert licenses.matches(f"Copyright (c) 2020 Someone\n\n{cut}\n\n{rest}", t) == [("MIT-text", 1.0)]
    assert licenses.matches(f"{rest}\n\n{cut}\n\n{rest}\n{cut}", t) == [("MIT-text", 1.0)] * 2
    header = licenses.TEMPLATES["Apache-2.0-header"].replace("LICENSE-2.0 Unless", "LICENSE-2.0\n\nUnless")
    assert ("Apache-2.0-header", 1.0) in licenses.matches(f"{header}\n\n{rest}", t)
    assert licenses.matches("Copyright 2020 Someone. Released under the MIT License. See LICENSE for the whole of it.", t) == [("MIT", 1.0)]
    assert licenses.matches("Released under the MIT License.\nAnd so on, with some more words here", t) == [("MIT", 1.0)]


def brute_runs(words, templates):
    """All runs of words against each template, then the best ones that don't overlap."""

    def greedy(runs, key):
        out = []
        for r in sorted(runs, key=key):
            if all(r[4] <= o[3] or o[4] <= r[3] for o in out):
                out.append(r)
        return out

    grams, found = list(itertools.pairwise(words)), []
    for name, s in templates.sets.items():
        each = []
        for i in range(len(grams)):
            for j in range(i + 1, len(grams) + 1):
                run = set(grams[i:j])
                d = 2 * len(run & s) / (len(run) + len(s))
                trimmed = grams[i] in s and grams[j - 1] in s and grams[i:j].count(grams[i]) == 1 and grams[i:j].count(grams[j - 1]) == 1
                if trimmed and d >= templates.threshold:
                    each.append((name, d, len(run & s), i, j + 1))
        found += greedy(each, lambda m: (-m[1], m[3], m[4]))
    return greedy(found, lambda m: (-m[2], -m[1], m[0], m[3]))


def test_runs_equal_all_runs_of_words():
    rng = random.Random(8)
    templates = licenses.Templates({"a": "one two three four five", "b": "three four five six", "c": "one two one three"}, 0.6)
    hits = 0
    for _ in range(400):
        words = []
        while len(words) < 30:
            words += rng.choice([[rng.choice(["one", "two", "three", "four", "five", "six", "x"])], ["one", "two", "three", "four", "five"], ["three", "four", "five", "six"]])
        words = [w.encode() for w in words]
        got = templates.runs(words)
        assert got == brute_runs(words, templates)
        hits += len(got)
    assert hits > 400


def test_repeated_notices_take_linear_time():
    t = licenses.Templates(licenses.TEMPLATES, 0.8)
    found = licenses.matches("so Released under the MIT License. and " * 50_000, t)
    assert found == [("MIT", 1.0)] * 50_000
    for name in ("BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1-header", "MPL-2.0-header"):
        assert [n for n, _ in licenses.matches("prose here " * 50 + licenses.TEMPLATES[name] + " more of it" * 50, t)] == [name]
