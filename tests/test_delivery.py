"""Delivery of ranges against a plain sweep, and observed outputs against a plain reading."""

import hashlib
import json
import random
import re

from tallyloom.operators import delivery


def lines_of(text):
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def bounds_of(raw):
    out, at = [0], 0
    while at < len(raw):
        n = raw.find(b"\n", at)
        at = len(raw) if n < 0 else n + 1
        out.append(at)
    return out


def sweep(text, receipts, line_from, line_to, byte_from, byte_to):
    raw = (text or "").encode()
    digest = hashlib.sha256(raw).hexdigest()
    valid = [r for r in receipts if r[2] == "verified" and r[1] == digest]
    if not raw:
        return bool(valid)
    n, bounds = len(lines_of(text)), bounds_of(raw)
    first, last = line_from or 1, n if line_to is None else line_to
    if line_from is not None and line_from < 1 or last < first or last > n:
        return False
    a, b = (bounds[first - 1], bounds[last]) if byte_from is None else (byte_from, byte_to)
    if a < 0 or b < a or b > len(raw):
        return False
    spans = []
    for _, _, _, kind, s, e in valid:
        if kind == "bytes" and 0 <= s <= e <= len(raw):
            spans.append((s, e))
        if kind == "lines" and 1 <= s <= e <= n:
            spans.append((bounds[s - 1], bounds[e]))
    for s, e in sorted(spans):
        if s > a:
            break
        a = max(a, e)
    return a >= b


def test_delivery_equals_the_sweep(spark):
    rnd = random.Random(5)
    text = lambda: rnd.choice([None, "", "\n", "one", "ä\r\nb\n\nlong line here\nx" * rnd.randrange(1, 4), "".join(rnd.choice("aé\n\r ") for _ in range(rnd.randrange(60)))])
    texts = {f"s{i}": text() for i in range(60)}
    receipts, needs = [], []
    for k, t in texts.items():
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        for _ in range(rnd.randrange(6)):
            a = rnd.randrange(-1, 20)
            receipts.append((k, rnd.choice([digest] * 5 + ["old"]), rnd.choice(["verified"] * 5 + ["unknown", "error"]), rnd.choice(["lines", "bytes"]), a, a + rnd.randrange(-1, 12)))
        for _ in range(6):
            lines = rnd.choice([(None, None), (rnd.randrange(0, 6), None), (rnd.randrange(0, 4), rnd.randrange(0, 8))])
            a = rnd.randrange(-1, 15)
            needs.append((k, f"n{len(needs)}", *lines, *rnd.choice([(None, None), (a, a + rnd.randrange(-1, 12))])))
    needs.append(("missing", "none", None, None, None, None))
    src = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3)
    rec = spark.createDataFrame(receipts, "path string, source_hash string, status string, kind string, start long, stop long").repartition(4)
    want = {n: p in texts and sweep(texts[p], [r for r in receipts if r[0] == p], *rest) for p, n, *rest in needs}
    df = spark.createDataFrame(needs, "path string, need string, line_from long, line_to long, byte_from long, byte_to long").repartition(2)
    got = {r["need"]: r["delivered"] for r in delivery.delivered(src, rec, df, "path", "text", "need").collect()}
    assert got == want and 20 < sum(want.values()) < len(want) - 20


def reading(path, text, content, first, most, failed):
    raw = (text or "").encode()
    lines = lines_of(text or "")
    if failed:
        return "error", []
    try:
        c = json.loads(content)
        if c["sourceRead"] == 1 and c["path"] == path and c["sha256"] == hashlib.sha256(raw).hexdigest() and raw[c["byteStart"] : c["byteEnd"]] == c["content"].encode() and 0 <= c["byteStart"] <= c["byteEnd"] <= len(raw):
            return "verified", [("bytes", c["byteStart"], c["byteEnd"])]
    except (ValueError, KeyError, TypeError):
        pass
    start = 1 if first is None else first
    end = len(lines) if most is None else start + most - 1
    found = set()
    for line in content.split("\n"):
        m = re.fullmatch(r"\s*([0-9]+)(?:\t|→)([^\n\r\u2028\u2029]*)", line)
        if m and max(1, start) <= int(m[1]) <= min(end, len(lines)) and m[2] == lines[int(m[1]) - 1]:
            found.add(int(m[1]))
    ranges = []
    for n in sorted(found):
        if ranges and ranges[-1][2] == n - 1:
            ranges[-1] = ("lines", ranges[-1][1], n)
        else:
            ranges.append(("lines", n, n))
    return ("verified" if ranges or (not raw and re.search("empty file|file.*empty", content, re.I)) else "unknown"), ranges


def test_observed_outputs_equal_a_plain_reading(spark):
    rnd = random.Random(9)
    texts = {f"s{i}": rnd.choice([None, "", "a\nb\r\n\nd", "\n".join(rnd.choice(["x", "ö y", "", "\tz"]) for _ in range(12))]) for i in range(40)}
    rows = []
    for path, text in texts.items():
        lines, raw = lines_of(text or ""), (text or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        for _ in range(6):
            numbered = "\n".join(f"{rnd.choice(['', '  ', chr(0xA0)])}{i + 1 + (rnd.random() < 0.1)}{rnd.choice(chr(9) + '→')}{x if rnd.random() < 0.9 else x + '!'}" for i, x in enumerate(lines))
            a = rnd.randrange(4)
            b = rnd.randrange(a, 9)
            part = raw[a:b].decode("utf-8", "replace")
            slice_ = json.dumps({"sourceRead": rnd.choice([1, 1, 1, 2]), "path": path, "sha256": rnd.choice([digest] * 4 + ["x"]), "byteStart": a, "byteEnd": b, "content": part})
            content = rnd.choice([numbered, numbered, numbered, slice_, "The file is empty", "Warning: empty file", "nothing", "", "12\t", "99999999999999999999\tx"])
            rows.append((path, f"c{len(rows)}", content, rnd.choice([None, None, 0, 1, 3]), rnd.choice([None, None, 1, 4]), rnd.random() < 0.1))
    src = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(3)
    out = spark.createDataFrame(rows, "path string, call string, content string, first long, most long, failed boolean").repartition(4)
    calls, ranges = delivery.observed(src, out, "path", "text", "call")
    got = {r["call"]: [r["status"], []] for r in calls.collect()}
    for r in ranges.collect():
        got[r["call"]][1].append((r["kind"], r["start"], r["stop"]))
    want = {call: reading(path, texts[path], *rest) for path, call, *rest in rows}
    assert {c: (s, sorted(x)) for c, (s, x) in got.items()} == want
    assert {s for s, _ in want.values()} == {"verified", "unknown", "error"}
