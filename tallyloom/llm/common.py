"""Shared helpers of the training-data operators: staging, word splitting and stable hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII alphanumerics are word bytes, with A-Z lowered; every byte of a non-ASCII character is one too; the rest separates.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same word class for JVM and RE2 regular expressions, after A-Z were lowered.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_GAP = re.compile(rb"[ \t-\r]")
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session that the driver and all executors share, below spark.checkpoint.dir.

    Where that is unset a local master takes a temporary folder; on a cluster that would lose data, so it's an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        _roots[app] = f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _roots[app]


def release(spark: SparkSession) -> None:
    """Deletes what this session has staged; results that still read it can't be computed any more. To be called before the session stops."""
    context = spark.sparkContext
    if context._jsc is None:  # it has stopped: its folder has to be deleted by hand
        return
    root = _roots.pop(context.applicationId, None)
    if root:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it (Spark compares names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text; a null id counts as empty text (0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased alphanumeric words as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: A key bitmap has 16 bits a key or more, but from 512 KiB to 32 MiB whatever the input.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28


class KeyBitmap(NamedTuple):
    """`bits` bits (a power of two) in rows (_bucket, _bits) of 4 KiB."""

    rows: DataFrame
    bits: int

    def array(self) -> np.ndarray:
        """All of it on the driver, for a broadcast: MOST_BITS / 8 bytes at most."""
        out = np.zeros(self.bits // 8, np.uint8)
        for r in self.rows.collect():
            out[r["_bucket"] * 4096 : r["_bucket"] * 4096 + len(r["_bits"])] = np.frombuffer(r["_bits"], np.uint8)
        return out


def key_bitmap(keys: DataFrame, column: str, name: str) -> KeyBitmap:
    """A bit for each key (a well-mixed long)."""
    keys = staged(keys.select(F.col(column).alias("key")), f"{name}-listed")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    at = F.pmod("key", F.lit(bits))
    places = keys.select(F.expr(f"pmod(key, {bits}L) div 32768").alias("_bucket"), (at % 32768).cast("long").alias("_at"))
    return KeyBitmap(staged(places.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), name), bits)


def with_maybe(df: DataFrame, column: str, bitmap: KeyBitmap) -> DataFrame:
    """df with _maybe: false only where the key isn't in the bitmap. So rows that need no exact join don't move; a full bitmap moves all, and nothing else changes."""
    at = f"pmod({column}, {bitmap.bits}L)"
    out = df.withColumn("_bucket", F.expr(f"{at} div 32768")).join(F.broadcast(bitmap.rows), "_bucket", "left")
    byte = f"cast(conv(hex(substr(_bits, cast(({at} % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1")
    return out.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_bits")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """rows left join facts, one row of which a key has; `weight` tells how many rows have it.

    The keys with more than a most-th of the whole weight, fewer than `most`, go to all tasks, so no task gets more than such a share of the rows; rows with
    a null key are joined with nothing and don't move. The others are joined by sorting at any size.
    """
    facts = staged(facts, f"facts-by-{key}")
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot, cold = F.broadcast(facts.where(F.col(weight) * most > total)), facts.where(F.col(weight) * most <= total)
    none, some = rows.where(F.col(key).isNull()), rows.where(F.col(key).isNotNull())
    for f in facts.schema:
        if f.name != key:
            none = none.withColumn(f.name, F.lit(None).cast(f.dataType))
    others = some.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key, "left")
    return some.join(hot, key).unionByName(others).unionByName(none)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, unless the session has a setting of its own: texts can be long, and a batch is held whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """`data` in pieces of about `size` bytes that begin and end at white space, so that no word is cut and a very long text is never held as words at once."""
    at = 0
    while at < len(data):
        end = len(data)
        if at + size < end and (gap := _GAP.search(data, at + size)):
            end = gap.start()
        yield data[at:end]
        at = end
