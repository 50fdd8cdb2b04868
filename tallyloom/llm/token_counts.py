"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a hash table of the corpus's frequent units with their token counts. Every partition counts its units in bounded memory and hands on its
most frequent ones as one small blob; blobs are merged in a tree of tasks, so one blob of at most TABLE_UNITS units is left, which is broadcast.
Tier two is the cache of each worker: units that the table lacks are encoded there by the library. The table decides only how fast a count is found,
never what it is.

Units of more than KEPT characters are in neither tier; they are encoded where they stand. So the table has 10 MB at most, and a worker's cache some 100 MB.

Null and empty texts have no tokens and no bytes. A text of any length is one value of a batch, which is cut by texts; a text without white space is one unit. Special strings inside texts count as the library counts them by default. Repeated rows and null ids
are kept as they are; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tokens import KEPT, LengthCache, leading_units, small_batches, tokenizer

#: Units in the broadcast table (of KEPT characters at most, so about 1 MB and never over 10), units that a partition hands on, distinct units that its counter holds at most, and blobs merged by one task.
TABLE_UNITS, PART_UNITS, COUNTER_UNITS, FAN_IN = 32_768, 8_192, 262_144, 32


def _pack(counts: Counter, most: int) -> bytes:
    return zlib.compress(json.dumps(counts.most_common(most)).encode(), 1)


def _unpack(blob: bytes) -> Counter:
    return Counter(dict(json.loads(zlib.decompress(blob))))


def frequent_units(docs: DataFrame, vocabulary: str, text_col: str = "text") -> dict[str, int]:
    """The most frequent units over all texts with their token counts."""

    def sketch(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update([u for u in leading_units(t) if len(u) <= KEPT])
            if len(counts) > COUNTER_UNITS:  # units that are rare so far go; frequent ones gain so much more that their rank holds
                counts = Counter(dict(counts.most_common(COUNTER_UNITS // 2)))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_pack(counts, PART_UNITS)], pa.binary())], ["part", "blob"])

    def merge(batches):
        counts: Counter = Counter()
        part = 0
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update(_unpack(blob))
                part = p
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_pack(counts, TABLE_UNITS)], pa.binary())], ["part", "blob"])

    picked = docs.select(F.col(text_col).alias("text"))
    level = picked.mapInArrow(sketch, "part long, blob binary")
    size = max(1, picked.rdd.getNumPartitions())
    while size > 1:
        size = -(-size // FAN_IN)
        level = level.repartition(size).mapInArrow(merge, "part long, blob binary")
    counts: Counter = Counter()
    for r in level.collect():
        counts.update(_unpack(r.blob))
    units = [u for u, _ in counts.most_common(TABLE_UNITS)]
    return dict(zip(units, (len(e.ids) for e in tokenizer(vocabulary).encode_batch(units, add_special_tokens=False)), strict=True))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, vocabulary, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = LengthCache(vocabulary, table.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in small_batches(texts, 4_000_000):
                n = cache.counts(texts[i:j])
                size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
