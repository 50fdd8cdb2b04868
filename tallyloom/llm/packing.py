"""Packing by concatenate and cut.

The token streams of all documents, put end to end, are cut into windows of equal length. Pass one tokenizes and sums the tokens of each partition;
prefix sums over these totals give every document its place in the stream; pass two cuts the documents there and marks the boundary records, the
pieces that a window's edge has cut. No document moves to another machine, so one very long or one very common source costs no more than its tokens.

Null and empty texts are the closing id alone. Repeated rows are packed as often as they stand there. An empty table gives no rows. Other columns of
the input are not read. Only the last window can be short: it alone is padded, to a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc, staged
from tallyloom.llm.tokens import IdCache, small_batches

#: Partition totals of up to so many partitions are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_PARTITIONS = 500_000


def token_streams(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's packed ids with its partition and its place in that partition's stream, written once."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        cache, part, at = IdCache(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], cache.kind).tobytes()
        width = len(end)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in small_batches(texts, 4_000_000):
                ids = [x + end for x in cache.encode(texts[i:j])]
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(starts), pa.array(n), pa.array([width] * (j - i), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "part", "at", "n", "width", "ids"])

    return staged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, part int, at long, n long, width int, ids binary"), "streams")


def offsets(streams: DataFrame) -> DataFrame:
    """The stream with global places: prefix sums over the partitions' totals, a row for each partition."""
    totals = [(r.part, int(r.n)) for r in streams.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    base, at = [], 0
    for part, n in sorted(totals):
        base.append((part, at))
        at += n
    table = streams.sparkSession.createDataFrame(base, "part int, base long")
    return streams.join(F.broadcast(table) if len(base) <= BROADCAST_PARTITIONS else table, "part")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (packed as in `width` bytes), doc_tokens, sequence_id, offset, boundary.

    boundary: "whole", or which ends of the piece are cuts ("first", "middle", "last" piece of its document).
    """
    placed = offsets(token_streams(docs, vocabulary, end_id, id_col, text_col))
    id_type = placed.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        names = ["doc_id", "start", "length", "ids", "width", "doc_tokens", "sequence_id", "offset", "boundary"]
        for b in batches:
            n, g = b.column(1).to_numpy(), b.column(2).to_numpy() + b.column(3).to_numpy()
            first, last = g // length, (g + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + k
            lo = np.maximum(seq * length, g[row])
            hi = np.minimum((seq + 1) * length, (g + n)[row])
            start, size, ids = lo - g[row], hi - lo, b.column(5)
            width = b.column(4)[0].as_py() if len(n) else 2
            kind = np.where(pieces[row] == 1, "whole", np.where(k == 0, "first", np.where(k == pieces[row] - 1, "last", "middle")))
            for i, j in small_batches(size.tolist(), 2_000_000, int):
                cuts = [ids[int(r)].as_py()[s * width : (s + z) * width] for r, s, z in zip(row[i:j], start[i:j].tolist(), size[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[i:j])), *map(pa.array, (start[i:j], size[i:j])), pa.array(cuts, pa.binary()), pa.array(np.full(j - i, width, np.int32)), *map(pa.array, (n[row[i:j]], seq[i:j], lo[i:j] - seq[i:j] * length)), pa.array(kind[i:j].tolist(), pa.string())], names)

    return placed.select("doc_id", "n", "at", "base", "width", "ids").mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, width int, doc_tokens long, sequence_id long, offset long, boundary string")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids as unsigned little-endian 32-bit numbers in place of the ids."""
    names = [f.name for f in pieces.schema if f.name not in ("ids", "width")]
    types = ", ".join(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for b in batches:
            sums = [crc(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    return pieces.mapInArrow(run, f"{types}, ids_crc32 long")


def op1_packing(docs: DataFrame) -> DataFrame:
    return digests(pack(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary")
