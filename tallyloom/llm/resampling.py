"""Target-distribution importance resampling: the documents that look most like a target corpus, drawn without replacement by Gumbel scores.

Features are runs of 1 to `n_max` words, hashed to buckets. Each task counts into one array; the partitions' arrays are summed by bucket, so the driver gets
`buckets` sums of either corpus at most. The log-ratios of the two smoothed distributions are one small array again, which scores the documents in a
second pass over their texts: all that is kept of a document is its id, its number of features, weight and score.

How many are drawn follows from the number of documents with enough words. The last one drawn is found by radix selection over the composite key (score
downwards, doc_id upwards) written as hexadecimal digits: a pass counts the next DIGITS digits of the keys that begin as the wanted one does, the place
within those counts gives the wanted digits, and the passes end where a single key, or a whole group of keys, is left. So no pass sorts, and the driver sees 16 ** DIGITS
counts at most. Only the drawn rows are sorted by range and ranked, by their place in a partition and the partitions' totals.

Null and empty texts have no features: weight 0, and they are not drawn. A null doc_id hashes as the empty text and stands behind all others of its score.
Ties in score go to the smaller doc_id; rows that repeat id and score are interchangeable, and as many of them are drawn as there is room. An empty table
gives no rows, an empty target only smoothed counts. Texts of any length are counted in slices. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyloom.llm.common import WORD_TABLE, documents, slices_of, staged

N_MAX, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
#: Hexadecimal digits of the key that a pass counts.
DIGITS = 4


def feature_hashes(text: str | None, n_max: int) -> Iterator[np.ndarray]:
    """The crc32 of every run of 1 to n_max words, slice by slice; the first of each n_max arrays has the single words."""
    before: list[bytes] = []
    for piece in slices_of((text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE)):
        words = piece.split()
        yield np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        joined = before + words
        for n in range(2, n_max + 1):
            new = joined[max(0, len(before) - n + 1) :]  # runs that end in this slice
            runs = [b" ".join(new[i : i + n]) for i in range(len(new) - n + 1)]
            yield np.fromiter(map(zlib.crc32, runs), np.int64, len(runs))
        before = joined[max(0, len(joined) - n_max + 1) :]


def bucket_counts(texts: DataFrame, column: str = "text", n_max: int = N_MAX, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for h in feature_hashes(t.as_py(), n_max):
                    total += np.bincount(h % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of the target's smoothed share of a bucket to the raw corpus's, rounded down."""
    k, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id, seed: str) -> int:
    """Thousandths of a Gumbel variate that follows from the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, n_max: int = N_MAX, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as many numbers as there are buckets

    def run(batches):
        gain = shared.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc_id, t in zip(ids, b.column(1), strict=True):
                n_words = n = total = 0
                for i, h in enumerate(feature_hashes(t.as_py(), n_max)):
                    n_words += len(h) if i % n_max == 0 else 0
                    n += len(h)
                    total += int(gain[h % len(gain)].sum())
                weight = total // n if n else 0
                rows.append((n_words, n, weight, weight + gumbel(doc_id, seed)))
            facts = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *facts], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def _sixteen(number) -> F.Column:
    """A long as 16 hexadecimal digits that sort as the number does."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def with_key(rows: DataFrame) -> DataFrame:
    """rows with `key`, hexadecimal digits in the order of drawing: score downwards, doc_id upwards, null ids last."""
    integral = isinstance(rows.schema["doc_id"].dataType, IntegralType)
    doc_id = F.concat(F.lit("0"), _sixteen(F.col("doc_id")) if integral else F.hex(F.col("doc_id").cast("string")))
    return rows.withColumn("key", F.concat(_sixteen(F.bitwise_not("score")), F.coalesce(doc_id, F.lit("1"))))


def last_drawn(keys: DataFrame, wanted: int, digits: int = DIGITS) -> str | None:
    """A beginning of `key`: those that begin so or stand before it are `wanted` keys, or more where keys repeat or one begins another. None if nothing is wanted."""
    if wanted <= 0:
        return None
    ends = keys.agg(F.min("key").alias("least"), F.max("key").alias("most"), F.max(F.length("key")).alias("length")).first()
    if ends["least"] is None:
        return None
    prefix = ""
    for a, b in zip(ends["least"], ends["most"], strict=False):  # what all keys begin with needs no pass
        if a != b:
            break
        prefix += a
    while len(prefix) < ends["length"]:
        digit = F.substring("key", len(prefix) + 1, digits)
        # Each task counts before anything moves; at most 16 ** digits sums come back.
        counts = sorted((r["digit"], r["n"]) for r in keys.where(F.col("key").startswith(prefix)).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
        for found, n in counts:
            if wanted <= n:
                break
            wanted -= n
        if not found:  # all that is left is one key
            break
        prefix += found
        if wanted == n:  # every key that begins so is drawn
            break
    return prefix


def ranked(rows: DataFrame, wanted: int, digits: int = DIGITS) -> DataFrame:
    """rows (doc_id, eligible, score, ...), which should be a written table, with rank: 1, 2, ... for the `wanted` first eligible ones by score and doc_id, else null."""
    keyed = with_key(rows)
    prefix = last_drawn(keyed.where("eligible").select("key"), wanted, digits)
    undrawn = F.lit(None).cast("long").alias("rank")
    if prefix is None:
        return rows.select("*", undrawn)
    drawn = F.col("eligible") & (F.substring("key", 1, len(prefix)) <= prefix)
    order = ["key", *(c for c in rows.columns if c not in ("doc_id", "eligible", "score"))]
    # The id that Spark gives has the partition in its upper bits and the place there in its lower ones.
    placed = keyed.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("part", F.expr("at div 8589934592L")).withColumn("place", F.expr("at % 8589934592L")), "drawn")
    before, starts = 0, []
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place") + 1
    selected = placed.join(offsets, "part").select(*rows.columns, F.when(rank <= wanted, rank).alias("rank"))
    return keyed.where(~drawn).select(*rows.columns, undrawn).unionByName(selected)


def resampled(docs: DataFrame, target: DataFrame, n_max: int = N_MAX, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; `percent` of the rows with `least_words` words are drawn."""
    gains = gains_of(bucket_counts(docs, "text", n_max, buckets), bucket_counts(target, "text", n_max, buckets))
    rows = staged(scored(docs, gains, n_max, seed).select("doc_id", (F.col("n_words") >= least_words).alias("eligible"), "n_features", "weight", "score"), "scored")
    wanted = percent * rows.where("eligible").count() // 100
    return ranked(rows, wanted).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
