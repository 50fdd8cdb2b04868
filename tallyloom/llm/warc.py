"""WARC archives and capture histories by an external index merge.

Pages become WARC/1.1 records in archive files that Spark's text writer puts into the shared folder (a record is one line of it, ended by the CRLF that a
record ends with, so the files are plain concatenated records, gzip-compressed). Of records with equal payloads of at least MIN_REVISIT bytes the one
with the largest page_id is the response and the others are revisits that refer to it; payloads move between machines only where a bitmap of the copied
digests says that they may be copies, and those of the most frequent digests not at all. Reading streams each archive line by line, a record in memory at a
time, and checks each payload's digest. It gives capture runs: RUN_ROWS captures, sorted by URL key, timestamp and page, written to the shared folder. Runs
are dealt by ranges of the key, as many as keep a range near RANGE_ROWS captures (also those of one URL are split), and each range merges the slices of
its runs, which arrive in order, with a loser tree that has a leaf for each slice. That gives globally ordered capture histories.

Null and empty html is an empty payload. A null url has the empty URL key. Pages without an id, and repeated rows, get records of their own; of copies a
null id is never the response unless all are null, and repeated rows with the largest id are all responses. Equal keys are ordered by page and then by
archive and place (the byte in the uncompressed archive). A page's time is its id in seconds after EPOCH, modulo DATES. An empty table gives no rows. Other
columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import join_facts, key_bitmap, shared_dir, staged, with_maybe

MIN_REVISIT = 1000
#: Records in an archive file, at most; captures that a task sorts at once; captures in a range, in expectation; digests that are sent to all, at most.
ARCHIVE_RECORDS, RUN_ROWS, RANGE_ROWS, HOT_DIGESTS = 4000, 20_000, 20_000, 10_000
#: Captures without a date of their own: this time and the page's id as seconds after it, within so many that the year has four digits.
EPOCH, DATES = "2024-01-01T00:00:00Z", 200_000_000_000
CRLF = "\r\n"


def url_key(url: str | None) -> str:
    """Host parts in reverse order, then path and sorted query, lower-cased: neighbours of a site sort together."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").removeprefix("www."), p.port
    except ValueError:
        return url.lower()
    query = "&".join(sorted(p.query.split("&"))) if p.query else ""
    port_part = f":{port}" if port and port not in (80, 443) else ""
    return (",".join(reversed(host.split("."))) + port_part + ")" + (p.path or "/") + (f"?{query}" if query else "")).lower()


def archive_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to: what is written for each page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # Counted before it is joined: of a payload with many copies one row for each task moves.
    large = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keepers = staged(large.select(F.xxhash64("digest").alias("key"), F.col("digest").alias("copied"), "keeper", "n"), "keepers")
    marked = with_maybe(rows.withColumn("key", F.xxhash64("digest")), "key", key_bitmap(keepers, "key", "keeper-keys"))
    copied = F.when(F.col("_maybe") & (F.col("size") >= MIN_REVISIT), F.col("digest")).alias("copied")  # null: certainly no copy, and the row doesn't move
    joined = join_facts(marked.select("page_id", "url", "payload", "digest", "size", copied), keepers.drop("key"), "copied", "n", HOT_DIGESTS)
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def record_text(rows: DataFrame) -> DataFrame:
    """One WARC record for each row as text, but for its last CRLF, which the writer adds."""
    revisit = F.col("record_type") == "revisit"
    safe = lambda c: F.translate(F.coalesce(c.cast("string"), F.lit("")), "\r\n\0", "")  # noqa: E731  a header must not break its line
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    headers = [
        F.concat(F.lit("WARC/1.1"), F.lit(CRLF), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), safe(F.col("page_id")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.expr(f"timestamp_seconds(unix_seconds(timestamp'{EPOCH}') + pmod(coalesce(try_cast(page_id as bigint), 0L), {DATES}L))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), safe(F.col("refers_to")), F.lit(">"), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Payload-Length: "), F.col("size").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws(CRLF, *headers), F.lit(CRLF + CRLF), block, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Writes the archives and gives their folder."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    record_text(archive_rows(pages)).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)
    return path


def parse(data: bytes):
    """(offset, headers, block) of each record of an uncompressed archive; what isn't a record is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode("utf-8", "surrogatepass").split(CRLF) if ": " in line)
        size = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} doesn't end there")
        at += 4


_RUN = "url_key string, timestamp string, page string, page_order long, archive string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
_NAMES = [f.split()[0] for f in _RUN.split(", ")]
#: What runs are sorted by: URL key, timestamp, page, archive, place.
_KEY = [0, 1, 3, 2, 4, 5]
_NUMBER = re.compile(r"-?[0-9]{1,18}")


def _name(head: dict, field: str) -> str | None:
    value = head.get(field)
    return value.removeprefix("<urn:page:").removesuffix(">") if value is not None else None


def records(lines):
    """(archive, offset, headers, block) of each record, from (archive, line) in order; what isn't a record is an error."""
    lines = iter(lines)
    now, at = None, 0
    for archive, line in lines:
        if archive != now:
            now, at = archive, 0
        if line != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at} of {archive}")
        begun, at, head = at, at + 10, {}
        for _, line in lines:
            at += len(line.encode()) + 2
            if not line:
                break
            field, _, value = line.partition(": ")
            head[field] = value
        size, parts, got = int(head["Content-Length"]), [], -2
        while got < size:  # a block's own line ends have split it
            archive, line = next(lines, (None, ""))
            if archive != now:
                raise ValueError(f"the record at byte {begun} of {now} has no end")
            parts.append(line.encode())
            got += len(parts[-1]) + 2
        if got != size or next(lines, (None, None)) != (now, ""):
            raise ValueError(f"the record at byte {begun} of {now} doesn't end where it says")
        at += size + 4
        yield now, begun, head, b"\r\n".join(parts)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of the captures in all archives, each with its run's name, written once; every payload is checked against its digest."""

    def run(batches):
        part, k, rows = TaskContext.get().partitionId(), 0, []

        def flush():
            rows.sort(key=_key)
            return _batch([(f"{part}-{k}", *r) for r in rows], ["run", *_NAMES], [pa.string(), *_TYPES])

        lines = ((a, t) for b in batches for a, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for archive, offset, head, block in records(lines):
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                raise ValueError(f"{archive} at {offset}: the payload isn't what its digest says")
            page = _name(head, "WARC-Record-ID")
            order = int(page) if page and _NUMBER.fullmatch(page) else -1  # ids that are no numbers of 64 bits are in the order of their texts
            size = len(block) if kind == "response" else int(head["WARC-Payload-Length"])
            rows.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], page, order, archive, offset, size, digest, kind, _name(head, "WARC-Refers-To")))
            if len(rows) == RUN_ROWS:
                yield flush()
                rows, k = [], k + 1
        if rows:
            yield flush()

    # A compressed archive is one split, so its lines come in order.
    lines = spark.read.option("lineSep", CRLF).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.gz").text(path)
    return staged(lines.select(F.col("_metadata.file_name").alias("archive"), "value").mapInArrow(run, f"run string, {_RUN}"), "capture-runs")


def _key(row: tuple) -> tuple:
    return tuple(row[i] for i in _KEY)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next least row costs one path from leaf to root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.keys = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._enter(leaf)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _enter(self, leaf: int) -> None:
        """While the tree is built, the first to come to a node waits there for its opponent."""
        winner, node = leaf, (leaf + self.k) // 2
        while node >= 1:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.k:
            return
        while True:
            w = self.losers[0]
            if self.keys[w] is None:
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node >= 1:
                if self._less(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.losers[0] = w


def natural_runs(rows) -> list[list[tuple]]:
    """(run, row) dealt to lists that ascend: a run's rows as they come, and a further list where a run doesn't go on upwards (it was read in two parts)."""
    out, now = [], {}
    for run, row in rows:
        if run in now and _key(now[run][-1]) <= _key(row):
            now[run].append(row)
        else:
            now[run] = [row]
            out.append(now[run])
    return out


def merged_histories(runs: DataFrame) -> DataFrame:
    """All captures in the order of URL key, timestamp and page: partitions are ranges of it, each merged from the slices of its runs."""

    def run(batches):
        out: list = []
        for row in LoserTree(natural_runs((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), _key):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out, _NAMES, _TYPES)
                out = []
        if out:
            yield _batch(out, _NAMES, _TYPES)

    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, "url_key", "timestamp", "page_order", "page", "archive", "offset").mapInArrow(run, _RUN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    id_type = pages.schema["page_id"].dataType.simpleString()
    history = merged_histories(capture_runs(spark, write_archives(pages)))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return history.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def read_archive(data: bytes) -> list[tuple[int, dict, bytes]]:
    """The records of one archive file, compressed (in any number of members) or not."""
    return list(parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
