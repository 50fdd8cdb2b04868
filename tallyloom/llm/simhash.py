"""SimHash near-duplicates by covering locality-sensitive hashing, which misses no pair within the radius.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 of its three-word shingles. Rows with equal fingerprints are one node with a
count, so copies make no pairs. With radius r every bit place is given a vector of r + 1 bits, and there is a table for each vector v but zero: its mask
keeps the places whose vector has an odd product with v. The places at which two fingerprints differ are at most r, and r equations in r + 1
unknowns have a solution other than zero, so in some table none of them is kept and both fall into one bucket: for radius 3, 15 tables of about 34 bits.

Buckets are counted before anything is grouped. A bucket of two is compared in the counting itself, one of up to MOST in a task, from which only a
spanning forest of the links leaves. A larger one is parted without loss: of r + 1 parts of the bits that its nodes may still differ in, two nodes within
the radius agree in one at least, so each part's value makes a smaller bucket, and so on until few bits are left (with b bits left, a bucket has 2 ** b
nodes at most). No group of more than MOST nodes reaches a task, and links of all tables together give the connected components.

Result: a row for each document with its fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links lead to. Null, empty and
blank texts have the fingerprint zero, and are linked like any other. Repeated rows share a node; null ids don't name a component unless it has no
other id (then null). An empty table gives no rows. Texts of any length are hashed in slices. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import documents, join_facts, key_bitmap, slices_of, staged, with_maybe
from tallyloom.llm.jaccard import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a bucket that a task compares, at most; fingerprints of many rows that are sent to all tasks, at most.
MOST, HOT_FINGERPRINTS = 1024, 10_000


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 of every run of k words (of a shorter text, of all its words), slice by slice."""
    from xxhash import xxh64_intdigest

    before, hashed = [], False
    for piece in slices_of((text or "").encode("utf-8", "surrogatepass").lower()):
        words = before + piece.split()
        if len(words) < k:
            before = words
            continue
        line = b" ".join(words)
        cuts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(line)]))
        yield np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
        before, hashed = words[len(words) - k + 1 :], True
    if before and not hashed:
        yield np.array([xxh64_intdigest(b" ".join(before), seed)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        n += len(hashes)
        for i in range(0, len(hashes), 1 << 14):
            part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks, one of which leaves out any `radius` places together."""
    n = 1 << (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(bits)]  # of each bit place: all but zero, evenly
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def parts_of(fixed: int, parts: int) -> list[int]:
    """The bits outside `fixed`, dealt into so many masks."""
    free = [i for i in range(64) if not fixed >> i & 1]
    return [sum(1 << i for i in free[p::parts]) for p in range(parts)]


def bucketed(nodes: DataFrame, radius: int) -> DataFrame:
    """(bucket, fp, fixed): each node in each table; fixed are the bits in which all of a bucket agree."""
    tables = [F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket"), "fp", F.lit(_signed(m)).alias("fixed")) for i, m in enumerate(covering_masks(radius))]
    return nodes.select(F.explode(F.array(*tables)).alias("k")).select("k.*")


def refined(rows: DataFrame, radius: int) -> DataFrame:
    """Rows of buckets that are too large in smaller ones, one for each part of their free bits."""

    def run(batches):
        import xxhash

        for b in batches:
            bucket, fp, fixed = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            new: list[list] = [[], [], []]
            for f in np.unique(fixed):
                mine = fixed == f
                for p, mask in enumerate(parts_of(int(f), radius + 1)):
                    values = (fp[mine] & np.uint64(mask)).tolist()
                    new[0] += [xxhash.xxh64_intdigest(x.to_bytes(8, "little") + v.to_bytes(8, "little"), p) for x, v in zip(bucket[mine].tolist(), values, strict=True)]
                    new[1].append(fp[mine])
                    new[2].append(np.full(len(values), int(f) | mask, np.uint64))
            columns = [np.array(new[0], np.uint64), *(np.concatenate(x) if x else np.empty(0, np.uint64) for x in new[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["bucket", "fp", "fixed"])

    return rows.select("bucket", "fp", "fixed").mapInArrow(run, "bucket long, fp long, fixed long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges (places in fps) of the links among these fingerprints."""
    left, edges = np.arange(len(fps)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            new = left[near].tolist()
            edges += [(i, j) for j in new]
            reached += new
            left = left[~near]
    return edges


def compared(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning edges of each bucket's links. Rows come by bucket, in order; a bucket is as large as MOST at most, and ends with its batch or goes on."""

    def run(batches):
        kept = [np.empty(0, np.int64)] * 2

        def edges(bucket, fps):
            out: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                out += [(fps[s + i], fps[s + j]) for i, j in forest(fps[s:e].view(np.uint64), radius)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            bucket, fps = (np.concatenate((old, b.column(i).to_numpy())) for i, old in enumerate(kept))
            if len(bucket):
                end = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
                if end:
                    yield edges(bucket[:end], fps[:end])
                kept = [bucket[end:], fps[end:]]
        if len(kept[0]):
            yield edges(*kept)

    return rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): edges between the fingerprints `fp` of nodes, all distinct, that connect just what links within the radius connect."""
    rows, found = bucketed(nodes, radius), []
    while True:
        met = staged(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
        found.append(met.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        several = met.where("n > 2").select("bucket", "n")
        if several.isEmpty():
            break
        # Most nodes are alone, or one of two, in most buckets: only those whose bucket may have more of them move.
        rows = staged(with_maybe(rows, "bucket", key_bitmap(several, "bucket", "several")).where("_maybe").join(several, "bucket").select("bucket", "fp", "fixed", "n"), "several-nodes")
        found.append(staged(compared(rows.where(F.col("n") <= most), radius), "edges"))
        rows = refined(rows.where(F.col("n") > most), radius)
        if rows.isEmpty():
            break
        rows = staged(rows, "refined")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of docs. most: at least 2 ** radius, so that parting ends."""
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp"), radius, most), "near").withColumnRenamed("node", "fp")
    of_root = found.join(nodes.hint("merge"), "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = found.join(of_root.hint("merge"), "root").select("fp", "component_id")
    facts = nodes.join(linked.hint("merge"), "fp", "left").select("fp", "copies", F.coalesce("component_id", "first_id").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_facts(rows, facts, "fp", "copies", HOT_FINGERPRINTS).select("doc_id", shown, "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
