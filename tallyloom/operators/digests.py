"""Digests of tables that don't depend on the order or the partitioning of their rows."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _canonical(df: DataFrame) -> Column:
    """A row as JSON with its columns in order of their names; nulls are there."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def table_digest(df: DataFrame) -> DataFrame:
    """d, one row: a SHA-256 of the number of df's rows and of the sums of two independent 128-bit parts of each row's SHA-256.

    Sums are the same in whatever order rows come, are reduced before they move, and tell a row that stands twice from one that stands once. They are taken in eight words of
    32 bits each, in tasks as Python's integers over Arrow's batches and then as decimals, which don't overflow for 10 ** 28 rows.
    """

    def run(batches):
        count, sums = 0, [0] * 8
        for b in batches:
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u4").reshape(-1, 8).sum(axis=0, dtype=np.uint64)
            count, sums = count + len(b), [s + int(w) for s, w in zip(sums, words, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), *(pa.array([Decimal(s)], pa.decimal128(38, 0)) for s in sums)], ["n", *names])

    names = [f"w{i}" for i in range(8)]
    parts = df.select(F.unhex(F.sha2(_canonical(df), 256)).alias("row")).mapInArrow(run, "n long, " + ", ".join(f"{n} decimal(38,0)" for n in names))
    text = [F.coalesce(F.sum("n"), F.lit(0)).cast("string"), *(F.coalesce(F.sum(n).cast("string"), F.lit("0")) for n in names)]
    return parts.agg(F.sha2(F.concat_ws(",", *text), 256).alias("d"))


def digest_of(**tables: DataFrame) -> str:
    """One digest of several named tables: a row for each comes to the driver."""
    import hashlib

    found = [(n, table_digest(t).first()["d"]) for n, t in sorted(tables.items())]
    return hashlib.sha256("\n".join(f"{n}:{d}" for n, d in found).encode()).hexdigest()


def structural_digest(*columns: Column) -> Column:
    """A SHA-256 of nested values as one JSON list: order of lists counts, names and order of fields are those of the schema, nulls are there."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)
