"""The filter audit against a run of every order over every document."""

import itertools
import random
import re

from tallyloom.llm import interactions

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """(part, failed filters, doc_id) of each (doc_id, lang, text)."""
    for i, lang, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows) else set()
        yield lang or "", bad, i


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    found, out = list(fails(rows)), []
    for part in {p for p, _, _ in found}:
        mine = [(bad, i) for p, bad, i in found if p == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                redundant = sum(f in bad for bad, _ in mine) - len(gone)
                lines.append([part, "".join(order), k + 1, len(left), len(gone), redundant, sum(bad == {f} for bad, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in interactions.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_tables_equal_brute_force(spark, tiny, odd, nothing):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    told = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    for docs in (spark.read.parquet(f"{tiny}/documents.parquet"), odd):
        rows = [tuple(r) for r in docs.select("doc_id", "lang", "text").collect()]
        assert rows_of(interactions.audited(docs.repartition(3), labels)) == brute(rows, told)
    assert interactions.audited(nothing, labels).count() == 0


def test_copies_and_labels_of_all_kinds(spark):
    rnd = random.Random(3)
    texts = [None, "", "#", "AAA", "plain " * 120, " ".join(map(str, range(130))), "ÄÖ b\x0bc\x1cd"]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, "", "x", "y"]), rnd.choice(texts)) for _ in range(150)]
    labels = [(rnd.choice([None, *range(30)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(40)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, lang string, text string, mask string").repartition(4)
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(interactions.audited(docs, df)) == brute(rows, labels)
    assert rows_of(interactions.audited(docs, df.limit(0))) == brute(rows, [])
