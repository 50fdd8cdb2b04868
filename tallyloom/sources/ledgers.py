"""JSON-lines ledgers: a streaming sink that appends each batch once, a reader of what was committed, and recovery of a ledger whose end is torn.

The sink's tasks write their lines aside, each to a file of its own; the batch then becomes part of the ledger by one manifest, which names the files with
their digests and is put in place by a rename. A batch that runs again (its commit was lost on the way) finds its manifest and drops its own files, so
every row is there once, and files that no manifest names are never read. The root folder has to be visible under one path from all machines.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from tallyloom.functions import scalars as S
from tallyloom.sources.trees import local


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    sha256: str


def _settle(path: str, data: bytes) -> None:
    """A file in place at once, or not at all."""
    aside = f"{path}.{uuid.uuid4().hex}.aside"
    with open(aside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)


class LedgerWriter(DataSourceStreamWriter):
    def __init__(self, options):
        self.root = os.path.abspath(local(options["path"]))

    def manifest(self, batch: int) -> str:
        return f"{self.root}/manifests/{batch:016d}.json"

    def write(self, rows):
        os.makedirs(f"{self.root}/data", exist_ok=True)
        name, n, digest = f"part-{uuid.uuid4().hex}.jsonl", 0, hashlib.sha256()
        with open(f"{self.root}/data/{name}", "wb") as f:
            for r in rows:
                line = json.dumps(r.asDict(recursive=True), separators=(",", ":"), ensure_ascii=False, default=str).encode() + b"\n"
                f.write(line)
                digest.update(line)
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(name, n, digest.hexdigest())

    def named(self, batch: int) -> set[str]:
        """The files that the batch's manifest names; none if it has no manifest."""
        try:
            with open(self.manifest(batch), "rb") as f:
                return {x["name"] for x in json.load(f)["files"]}
        except FileNotFoundError:
            return set()

    def commit(self, messages, batchId):
        files = [m for m in messages if m is not None]
        if not os.path.exists(self.manifest(batchId)):
            os.makedirs(f"{self.root}/manifests", exist_ok=True)
            _settle(self.manifest(batchId), json.dumps({"batch": batchId, "files": [vars(m) for m in files if m.rows]}).encode() + b"\n")
        self._drop(files, batchId)

    def abort(self, messages, batchId):
        self._drop([m for m in messages if m is not None], batchId)

    def _drop(self, files, batch):
        """Away with what the batch's manifest doesn't name."""
        kept = self.named(batch)
        for m in files:
            if m.name not in kept and os.path.exists(f"{self.root}/data/{m.name}"):
                os.unlink(f"{self.root}/data/{m.name}")


class LedgerSink(DataSource):
    """writeStream.format("ledger").option("path", root)."""

    @classmethod
    def name(cls):
        return "ledger"

    def streamWriter(self, schema, overwrite):
        return LedgerWriter(self.options)


def appended(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """_batch and the columns of schema of every committed row. An empty ledger gives no rows."""
    where = local(root)
    if not os.path.isdir(f"{where}/manifests"):
        return spark.createDataFrame([], f"_batch long, {schema}")
    named = spark.read.schema("batch long, files array<struct<name:string,rows:long,sha256:string>>").json(f"file://{where}/manifests").select(F.col("batch").alias("_batch"), F.explode("files.name").alias("_name"))
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(f"file://{where}/data").select("value", F.col("_metadata.file_name").alias("_name"))
    return lines.join(named, "_name").select("_batch", F.from_json("value", schema).alias("_row")).select("_batch", "_row.*")


def damage(spark: SparkSession, root: str) -> DataFrame:
    """name and problem (missing, rows, digest) of each committed file that isn't as its manifest says."""
    where = local(root)
    named = spark.read.schema("batch long, files array<struct<name:string,rows:long,sha256:string>>").json(f"file://{where}/manifests").select(F.explode("files").alias("f")).select("f.*")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"file://{where}/data").select(F.col("_metadata.file_name").alias("name"), F.sha2("content", 256).alias("now"))
    return named.join(found, "name", "left").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("name", F.when(F.col("now").isNull(), "missing").otherwise("digest").alias("problem"))


def ledger_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, at (which orders a file's lines), row and state of each line that isn't blank: good, torn or bad.

    A line that is no JSON is torn if it is the last of its file and no line end follows it: an append that broke off, which readers pass over. Any other such
    line is bad, and a strict reader refuses its file. Lines are read in splits, so a file of any size will do: whether its end is open follows from its size
    and the bytes of its lines, and its last line from the splits' order.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    ends = lines.groupBy("file", "_size").agg(F.max("at").alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes")).select("file", "_last", (F.col("_bytes") > F.col("_size")).alias("_open"))
    said = lines.where(F.trim("value") != "").join(ends, "file")
    state = F.when(S.valid_json(F.col("value")), "good").when(F.col("_open") & (F.col("at") == F.col("_last")), "torn").otherwise("bad")
    return said.select("file", "at", F.from_json("value", schema).alias("row"), state.alias("state"))


def recovered(lines: DataFrame, pending: DataFrame, seq: str) -> DataFrame:
    """A ledger after its pending batches were replayed: file, seq, body and problem.

    lines: file, seq, body (canonical text) of the good lines, seq from 1 without gaps. pending: the same of the batches that were written ahead. A pending row
    that the ledger has is dropped if it is equal, else a conflict; a new one has to follow without a gap.
    """
    have = lines.select("file", F.col(seq).alias("seq"), "body")
    ahead = pending.groupBy("file", F.col(seq).alias("seq")).agg(F.min("body").alias("new"), F.countDistinct("body").alias("_n"))
    both = have.join(ahead, ["file", "seq"], "full")
    count = both.groupBy("file").agg(F.count("*").alias("_rows"), F.max("seq").alias("_most"))
    # A gap lies before every new row behind the first missing number: rows up to the end of what has no gap are as many as the greatest number.
    gap = F.col("_rows") < F.col("_most")
    problem = F.when((F.col("_n") > 1) | (F.col("body") != F.col("new")), "conflict").when(F.col("body").isNull() & gap, "gap")
    return both.join(count, "file").select("file", "seq", F.coalesce("body", "new").alias("body"), problem.alias("problem"))
