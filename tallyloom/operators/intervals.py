"""Intervals: islands by running maxima, and texts in byte ranges that end at lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(ranges: DataFrame, key: str, start: str, stop: str, touch: int = 1) -> DataFrame:
    """Merged ranges of each key; ranges whose distance is at most `touch` merge (1: closed line ranges, 0: half-open byte ranges)."""
    order = W.partitionBy(key).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.select(key, start, stop).withColumn("_new", F.when(before.isNull() | (F.col(start) > before + touch), 1).otherwise(0))
    grouped = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def newline_parts(text: bytes, most: int) -> list[tuple[int, int]]:
    """Byte ranges of at most `most` bytes that end after a line end where there is one, and else before a whole UTF-8 character."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = text.rfind(b"\n", at, end)
            if cut >= at:
                end = cut + 1
            else:
                while end > at + 1 and text[end] & 0xC0 == 0x80:
                    end -= 1
        out.append((at, end))
        at = end
    return out


def partition_texts(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """The byte ranges of each text, by batches of rows."""
    import pyarrow as pa

    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            out = [(k, i, s, e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (s, e) in enumerate(newline_parts((t or "").encode("utf-8", "surrogatepass"), most))]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], [key, "part", "start", "stop"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, part long, start long, stop long")
