"""Media columns by content-defined chunking.

A text's payload (UTF-8, padded with 255 to whole blocks) is cut where a rolling gear hash of the last bytes has its low bits clear, so equal passages
give equal chunks wherever they stand. A chunk is stored as its length and its 8-bit samples. Chunk digests are counted in Spark: a chunk that occurs once
is stored with its document, one that occurs more often is stored once for all, in a table by digest. A document is a header and an ordered list of
chunk digests; reading joins the chunks back by digest, checks each, and computes features of the samples that were read. Its stored form is the header
and its stored chunks, in order and as they lie in the store. Documents with one and the same list are read once.

Which chunks occur more than once is told to the scans by a bitmap sized by their number: a false hit stores a single chunk in the shared table, which
changes where it lies and nothing else. So payload bytes move between machines only for shared chunks, once for each task that has them; chunks that very
many lists ask for, and lists that very many documents have, go to all tasks instead of one.

Null and empty texts are one block of 255. Repeated rows and null ids are kept as they stand; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc, join_facts, key_bitmap, mix64, staged, with_maybe

BLOCK, PAD = 576, b"\xff"
#: Bytes of a chunk at least and at most; a cut where this many low bits are clear (2 KiB between cuts).
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: Chunks (16 MiB) and lists that go to all tasks, at most: those with more than such a part of what is asked for.
HOT_CHUNKS, HOT_LISTS = 1000, 10_000
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and its bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return raw + PAD * (size - len(raw)), len(raw)


def cuts_of(payload: bytes) -> list[int]:
    """Chunk ends. The gear hash h = 2 * h + gear[byte], kept to 16 bits, is a sum over the last 16 bytes; it is taken by doubling."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step) if len(h) > step else 0
        h = more
    # The upper bits see all 16 bytes; low ones see few.
    places = np.flatnonzero((h >> np.uint16(16 - CUT_BITS)) == 0) + 1
    ends, last = [], 0
    for p in places.tolist():
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST:
            ends.append(p)
            last = p
    while len(payload) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(payload):
        ends.append(len(payload))
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    out, at = [], 0
    for e in cuts_of(payload):
        out.append(payload[at:e])
        at = e
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def header_of(n_chunks: int) -> bytes:
    return b"TLMC" + struct.pack("<I", n_chunks)


def stored_chunk(samples: bytes) -> bytes:
    """As a chunk lies in the store: its length and its 8-bit samples."""
    return struct.pack("<I", len(samples)) + samples


def feature_of(samples: np.ndarray, n_chunks: int) -> str:
    """Whole numbers only: chunks, samples, sum, sum of squares, sum of absolute steps and a histogram of 16 bins."""
    s = samples.astype(np.int64)
    bins = np.bincount(samples >> 4, minlength=16)
    return f"chunks={n_chunks};n={len(s)};sum={int(s.sum())};sq={int((s * s).sum())};steps={int(np.abs(np.diff(s)).sum())};hist=" + ",".join(map(str, bins.tolist()))


def _key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "big")


class Media(NamedTuple):
    """documents: doc_id, row, n_bytes, payload_bytes, header, digests (ordered) and own (the chunks that are stored here); chunks: digest, bytes of all others."""

    documents: DataFrame
    chunks: DataFrame


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Media:
    """Writes the media tables. The text is cut anew in each of three scans, which is cheaper than to keep every copy of a chunk in between."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def digests(batches):
        for b in batches:
            lists = [[digest_of(c) for c in chunks_of(payload_of(t)[0])] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.binary()))], ["digests"])

    met = rows.select("text").mapInArrow(digests, "digests array<binary>").select(F.explode("digests").alias("digest"))
    often = met.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.expr("cast(conv(hex(substr(digest, 1, 7)), 16, 10) as bigint)").alias("key"))
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(often, "key", "shared-chunks").array())

    def shared(digest: bytes) -> int:
        at = _key_of(digest) & (8 * len(bitmap.value) - 1)
        return bitmap.value[at >> 3] >> (at & 7) & 1

    def lend(batches):
        seen = set()  # digests of this task's shared chunks
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                for c in chunks_of(payload_of(t)[0]):
                    d = digest_of(c)
                    if shared(d) and d not in seen:
                        seen.add(d)
                        found.append((d, stored_chunk(c)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["digest", "bytes"])

    lent = rows.select("text").mapInArrow(lend, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    chunks = staged(lent, "media-chunks")
    chunk_type = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
    names = ["doc_id", "row", "n_bytes", "payload_bytes", "header", "digests", "own"]

    def keep(batches):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes, lists, own = [], [], []
            for t in b.column(1).to_pylist():
                payload, n = payload_of(t)
                cut = [(digest_of(c), c) for c in chunks_of(payload)]
                sizes.append((n, len(payload)))
                lists.append([d for d, _ in cut])
                own.append([{"digest": d, "bytes": stored_chunk(c)} for d, c in cut if not shared(d)])
            keys = pa.array([(part << 40) | (row + i) for i in range(len(sizes))], pa.int64())
            row += len(sizes)
            longs = [pa.array([x[k] for x in sizes], pa.int64()) for k in (0, 1)]
            headers = pa.array([header_of(len(x)) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), keys, *longs, headers, pa.array(lists, pa.list_(pa.binary())), pa.array(own, chunk_type)], names)

    schema = f"doc_id {id_type}, row long, n_bytes long, payload_bytes long, header binary, digests array<binary>, own array<struct<digest:binary,bytes:binary>>"
    return Media(staged(rows.mapInArrow(keep, schema), "media-documents"), chunks)


_FACTS = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _facts(header: bytes, digests: list[bytes], chunks: dict[bytes, bytes]) -> tuple:
    """From the stored header and the stored chunks of a document."""
    ordered, form = [], [header]
    for d in digests:
        stored = chunks.get(d)
        if stored is None or stored[:4] != struct.pack("<I", len(stored) - 4) or digest_of(stored[4:]) != d:
            raise ValueError(f"chunk {d.hex()} is missing from the media store or damaged")
        ordered.append(stored[4:])
        form.append(stored)
    if header != header_of(len(digests)):
        raise ValueError("the header isn't that of its list")
    payload, media = b"".join(ordered), b"".join(form)
    return hashlib.sha256(payload).hexdigest(), crc(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(np.frombuffer(payload, np.uint8), len(ordered))


def _fact_arrays(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]


def read_media(media: Media) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the facts of what was read back, for each document."""
    docs = media.documents
    id_type = docs.schema["doc_id"].dataType.simpleString()
    whole = F.size("own") == F.size("digests")
    names = [f.split()[0] for f in _FACTS.split(", ")]

    # Documents that hold all their chunks themselves need no other machine.
    def alone(batches):
        for b in batches:
            rows = [_facts(h, d, {c["digest"]: c["bytes"] for c in own}) for h, d, own in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *_fact_arrays(rows)], ["doc_id", "n_bytes", "payload_bytes", *names])

    first = docs.where(whole).select("doc_id", "n_bytes", "payload_bytes", "header", "digests", "own").mapInArrow(alone, f"doc_id {id_type}, n_bytes long, payload_bytes long, {_FACTS}")

    # The others: one row for each distinct list fetches its chunks. A bitmap of those rows finds them in the scan; a false hit reads a list once more.
    rest = docs.where(~whole).withColumn("list", F.expr("sha2(array_join(transform(digests, d -> hex(d)), ''), 256)")).withColumn("row_key", F.xxhash64("row"))
    lists = rest.groupBy("list").agg(F.min("row").alias("row"), F.count("*").alias("n")).select("list", "n", F.xxhash64("row").alias("row_key"))
    lists = staged(lists, "media-lists")
    chosen = with_maybe(rest, "row_key", key_bitmap(lists, "row_key", "media-readers")).where("_maybe")
    asked = staged(chosen.select("row_key", F.explode(F.array_except("digests", F.transform("own", lambda c: c["digest"]))).alias("digest")), "media-asked")
    wanted = media.chunks.join(asked.groupBy("digest").agg(F.count("*").alias("asked")).hint("merge"), "digest")
    fetched = join_facts(asked, wanted, "digest", "asked", HOT_CHUNKS).groupBy("row_key").agg(F.collect_list(F.struct("digest", "bytes")).alias("lent"))
    gathered = chosen.select("row_key", "list", "header", "digests", "own").join(fetched.hint("merge"), "row_key")

    def together(batches):
        for b in batches:
            rows = [_facts(h, d, {c["digest"]: c["bytes"] for c in own + lent}) for h, d, own, lent in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *_fact_arrays(rows)], ["list", *names])

    found = gathered.select("list", "header", "digests", "own", "lent").mapInArrow(together, f"list string, {_FACTS}")
    facts = found.groupBy("list").agg(*(F.first(n).alias(n) for n in names)).join(lists.select("list", "n").hint("merge"), "list")
    second = join_facts(rest.select("doc_id", "n_bytes", "payload_bytes", "list"), facts, "list", "n", HOT_LISTS).drop("list", "n")
    return first.unionByName(second)


def op3_media(docs: DataFrame) -> DataFrame:
    return read_media(store(docs))
