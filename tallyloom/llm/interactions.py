"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley value.

A document is reduced to a mask, one bit for each filter that it fails, in one pass over its text. Documents of equal masks behave alike under every order, so
each part of the table becomes at most 2 ** filters cells (documents, good ones, toxic ones). All orders are visited by adjacent transpositions: two
neighbouring filters change places, so only their two steps have to be computed anew from the cells, and every other step stays as it is. The Shapley value
(the sum over all orders of what a filter removes) accumulates along that walk.

Filter E needs the whole table: a text is a copy if its SHA-256 stands under a smaller doc_id. Digests are grouped with their least id before they move, and
the digests of many rows go to all tasks, so no task gets a whole group of copies. Labels join only documents' ids and masks, and only the labels that
say good or toxic; a document that several label rows name is good or toxic if one of them says so.

Null texts are empty: they fail A, and E behind the first empty text. A null doc_id is no smaller or larger than any other and has no label. A null lang is the part ''.
Repeated rows count as often as they stand and are no copies of each other (their ids are equal). An empty table has no parts and gives no rows.
Texts of any length are read in slices. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, join_facts, slices_of, staged

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
#: Digests of copies that are sent to all tasks, at most.
HOT_DIGESTS = 10_000
_CAPITALS = bytes(range(65, 91))


def own_failures(text: str) -> tuple[int, bytes]:
    """The bits of A to D and the text's SHA-256."""
    data = text.encode("utf-8", "surrogatepass")
    n, seen, kept, signs = 0, set(), 0, False
    for piece in slices_of(data):
        words = piece.split()
        n += len(words)
        seen.update(words)
        kept += len(piece.translate(None, _CAPITALS))
        signs = signs or len(piece.translate(None, SIGNS)) < len(piece)
    mask = (n < LEAST_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * n) << 1 | (100 * (len(data) - kept) > CAPITAL_PERCENT * len(text)) << 2 | signs << 3
    return mask, hashlib.sha256(data).digest()


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [own_failures(t.as_py() or "") for t in b.column(2)]
            facts = [pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *facts], ["doc_id", "part", "own", "digest"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = staged(docs.select("doc_id", part, "text").mapInArrow(run, f"doc_id {id_type}, part string, own int, digest binary"), "masks")
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    found = join_facts(rows, copies, "digest", "copies", HOT_DIGESTS)
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those that are labelled good, and those that are labelled toxic."""
    says = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    plain = failed.select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")).groupBy("part", "mask").agg(*sums)
    # Documents without such a label needn't meet a label at all, and null ids don't move.
    told = failed.join(says.hint("merge"), "doc_id").select("part", "mask", F.lit(0).alias("n"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return plain.unionByName(told.groupBy("part", "mask").agg(*sums)).groupBy("part", "mask").agg(*sums)


def swaps(n: int) -> Iterator[int]:
    """The places i at which i and i + 1 change, so that all orders of n are visited once: the largest that can move goes on in its direction."""
    order, step = list(range(n)), [-1] * n
    while True:
        movable = [x for x in range(n) if 0 <= (j := order.index(x) + step[x]) < n and order[j] < x]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + step[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield min(i, j)


def walk(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, from its cells by mask."""
    n = len(filters)
    bits = {f: 1 << i for i, f in enumerate(filters)}
    total, evaluated = sum(c[0] for c in counts.values()), {}

    def step_of(before: str, f: str) -> tuple:
        """What filter f does behind those of `before`."""
        gone, bit = sum(bits[x] for x in before), bits[f]
        removed = redundant = good = toxic = kept = 0
        for mask, (docs, of_good, of_toxic) in counts.items():
            if mask & bit and not mask & gone:
                removed, good, toxic = removed + docs, good + of_good, toxic + of_toxic
            elif mask & bit:
                redundant += docs
            elif not mask & gone:
                kept += docs
        return kept, removed, redundant, counts.get(bit, (0, 0, 0))[0], good, toxic

    order = list(filters)
    steps = [step_of(filters[:i], f) for i, f in enumerate(filters)]
    shapley = dict.fromkeys(filters, 0)

    def visit():
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]
        assert total - sum(s[1] for s in steps) == steps[-1][0]
        evaluated["".join(order)] = list(steps)

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        steps[i] = step_of("".join(order[:i]), order[i])
        steps[i + 1] = step_of("".join(order[: i + 1]), order[i + 1])
        visit()
    for name, found in evaluated.items():
        for i, s in enumerate(found):
            yield (name, i + 1, *s, shapley[name[i]])


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step."""
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # A part's cells are one row for each mask at most, so they fit one row.
    of_part = cells(staged(masks(docs), "failed"), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(walk({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in found}))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.string(), pa.int32()] + [pa.int64()] * 7, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *columns], names)

    return of_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:]))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
