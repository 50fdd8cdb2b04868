"""What of a source was delivered: receipts of line and byte ranges against needed ranges, and observed outputs against the source's own lines.

Line numbers become byte places through a table of line starts, (source, line, offset), of which only the lines that someone asks for are joined. Ranges are
merged to islands by a running maximum and met by the needs in one order of places (an as-of merge): a need is covered if the island that began
last at or before its first byte reaches its last one. Neither a source's ranges nor its needs have to fit a task.

Texts are UTF-8; a null text is empty. A line ends with LF; a CR before it isn't part of the line. What stands behind the last LF is a line unless it is empty.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graphs import cut
from tallyloom.operators.scans import prefix_scan

#: White space of a script engine, and the characters that its dot doesn't match.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NUMBERED = rf"^{SPACE}*([0-9]+)(?:\t|→)([^\n\r\u2028\u2029]*)\z"


def source_facts(sources: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest (SHA-256), total_bytes and total_lines of each source."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)
    return sources.select(key, F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("total_bytes"), lines.cast("long").alias("total_lines"))


def line_offsets(sources: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, offset: the byte behind line `line`, for 0 (the start) to the number of lines."""

    def rows(b):
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            offsets = [0, *ends.tolist()] + ([len(data)] if data and not data.endswith(b"\n") else [])
            yield from ((k, i, o) for i, o in enumerate(offsets))

    def run(batches):
        for b in batches:
            found = rows(b)
            while part := list(islice(found, 50_000)):
                keys, line, offset = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(line, pa.int64()), pa.array(offset, pa.int64())], [key, "line", "offset"])

    return sources.select(key, text).mapInArrow(run, f"{key} {dict(sources.dtypes)[key]}, line long, offset long")


def in_bytes(spans: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """spans with line_from and line_to (1 and up, closed) gets byte_from and byte_to (half open); null where the source has no such lines."""
    at = lambda name: offsets.select(key, F.col("line").alias(f"_{name}"), F.col("offset").alias(name))
    asked = spans.withColumn("_byte_from", F.col("line_from") - 1).withColumn("_byte_to", F.col("line_to"))
    return asked.join(at("byte_from"), [key, "_byte_from"], "left").join(at("byte_to"), [key, "_byte_to"], "left").drop("_byte_from", "_byte_to")


def merged(ranges: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """key, start, stop: islands of half-open ranges; ranges that touch merge."""
    seen = prefix_scan(ranges.select(key, F.col(start).cast("long").alias("_start"), F.col(stop).cast("long").alias("_stop")), [key], ["_start", "_stop"], most={"_reach": "_stop"}, name="reach")
    new = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach")), 1).otherwise(0)
    numbered = prefix_scan(seen.withColumn("_new", new), [key], ["_start", "_stop"], total={"_island": "_new"}, name="islands").withColumn("_island", F.col("_island") + F.col("_new"))
    return numbered.groupBy(key, "_island").agg(F.min("_start").alias("start"), F.max("_stop").alias("stop")).drop("_island")


def delivered(sources: DataFrame, receipts: DataFrame, needs: DataFrame, key: str, text: str, need: str) -> DataFrame:
    """needs with `delivered`: whether the sweep over what was verified of this very text gets from the first needed byte to the last without a gap.

    receipts: key, source_hash, status, kind (lines: closed, from 1; bytes: half open, from 0), start, stop. needs: key, a name of its own in column `need`, line_from, line_to
    (null: the first, the last line), byte_from and byte_to (both null: of the lines). Only receipts with status verified and the source's present
    SHA-256 count. An empty source is delivered by any such receipt. Needs and receipts outside the source's lines and bytes count as not met and as
    nothing; so do needs of a source that isn't there.
    """
    facts = cut(source_facts(sources, key, text), "facts")
    valid = receipts.where("status = 'verified'").join(facts, key).where("source_hash = digest")
    by_byte = valid.where("kind = 'bytes' and start >= 0 and stop >= start and stop <= total_bytes").select(key, F.lit(None).cast("string").alias("_need"), F.col("start").alias("_from"), F.col("stop").alias("_to"))
    by_line = valid.where("kind = 'lines' and start >= 1 and stop >= start and stop <= total_lines").select(key, F.lit(None).cast("string").alias("_need"), F.col("start").alias("line_from"), F.col("stop").alias("line_to"))
    asked = needs.join(facts, key, "left").withColumn("line_from", F.coalesce("line_from", F.lit(1))).withColumn("line_to", F.coalesce("line_to", "total_lines"))
    asked = cut(asked.withColumn("_fits", F.coalesce((F.col("line_from") >= 1) & (F.col("line_to") >= F.col("line_from")) & (F.col("line_to") <= F.col("total_lines")), F.lit(False))), "asked")
    spans = by_line.unionByName(asked.where("_fits").select(key, F.col(need).cast("string").alias("_need"), F.col("line_from").cast("long"), F.col("line_to").cast("long")))
    placed = cut(in_bytes(spans, line_offsets(sources, key, text), key), "placed")
    ranges = placed.where("_need is null").select(key, F.col("byte_from").alias("_from"), F.col("byte_to").alias("_to")).unionByName(by_byte.drop("_need"))
    islands = merged(ranges, key, "_from", "_to")
    of_need = placed.where("_need is not null").select(key, "_need", F.col("byte_from").alias("_line_from"), F.col("byte_to").alias("_line_to"))
    wanted = asked.withColumn("_need", F.col(need).cast("string")).join(of_need, [key, "_need"], "left")
    wanted = wanted.withColumn("_from", F.coalesce("byte_from", "_line_from")).withColumn("_to", F.coalesce("byte_to", "_line_to"))
    wanted = wanted.withColumn("_fits", F.coalesce(F.col("_fits") & (F.col("_from") >= 0) & (F.col("_to") >= F.col("_from")) & (F.col("_to") <= F.col("total_bytes")), F.lit(False)))
    marks = islands.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit("").alias("_need"), F.col("stop").alias("_reach"))
    probes = wanted.where("_fits").select(key, F.col("_from").alias("_at"), F.lit(1).alias("_kind"), "_need", F.lit(None).cast("long").alias("_reach"), "_to")
    met = prefix_scan(marks.unionByName(probes, allowMissingColumns=True), [key], ["_at", "_kind", "_need"], last={"_reached": "_reach"}, name="as-of").where("_kind = 1")
    covered = met.select(key, "_need", ((F.col("_to") <= F.col("_at")) | F.coalesce(F.col("_reached") >= F.col("_to"), F.lit(False))).alias("_covered"))
    any_valid = valid.where("total_bytes = 0").groupBy(key).agg(F.lit(True).alias("_any"))
    out = wanted.join(covered, [key, "_need"], "left").join(any_valid, key, "left")
    ok = F.when(F.col("total_bytes") == 0, F.coalesce("_any", F.lit(False))).otherwise(F.coalesce("_covered", F.lit(False)))
    return out.select(*(c for c in needs.columns if c not in ("line_from", "line_to")), ok.alias("delivered"))


def observed(sources: DataFrame, outputs: DataFrame, key: str, text: str, call: str) -> tuple[DataFrame, DataFrame]:
    """What reading tools put out, held against the source: (calls, ranges).

    outputs: key, `call` (its own name), content, first and most (the lines that were asked for; null: from 1, to the last), failed. An output is either a JSON envelope of a
    byte slice (sourceRead 1, path, sha256, byteStart, byteEnd, content), which must equal the source's bytes there, or lines of a number, a tab or an
    arrow, and a text, which count where source line and text are equal and the number was asked for.
    calls: call, source_hash, output_hash, total_bytes, total_lines and status: error, verified (a range is confirmed, or an empty source was called empty) or unknown. ranges: call, kind, start,
    stop, as delivered() takes them; lines that follow each other are one range. An output moves once, with its source's text.
    """
    facts = source_facts(sources, key, text)
    both = outputs.join(sources.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key).join(facts, key)
    envelope = F.from_json("content", "sourceRead double, path string, sha256 string, byteStart long, byteEnd long, content string")
    content = F.coalesce("content", F.lit(""))
    j = both.withColumn("content", content).withColumn("_j", envelope).withColumn("_raw", F.encode("_text", "UTF-8"))
    slice_ = F.expr("substring(_raw, cast(_j.byteStart + 1 as int), cast(_j.byteEnd - _j.byteStart as int))")
    fits = (F.col("_j.sourceRead") == 1) & (F.col("_j.path") == F.col(key).cast("string")) & (F.col("_j.sha256") == F.col("digest")) & (F.col("_j.byteStart") >= 0) & (F.col("_j.byteEnd") >= F.col("_j.byteStart")) & (F.col("_j.byteEnd") <= F.col("total_bytes"))
    sliced = F.coalesce(~F.col("failed") & fits & (slice_ == F.encode("_j.content", "UTF-8")), F.lit(False))
    first = F.coalesce("first", F.lit(1)).cast("long")
    last = F.when(F.col("most").isNull(), F.col("total_lines")).otherwise(first + F.col("most") - 1)
    j = j.withColumn("_sliced", sliced).withColumn("_first", F.greatest(first, F.lit(1))).withColumn("_last", F.least(last, F.col("total_lines")))
    lines = F.transform(F.split("_text", "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    said = F.transform(F.split("content", "\n"), lambda x: F.struct(F.expr("1").alias("one"), F.regexp_extract(x, NUMBERED, 1).alias("n"), F.regexp_extract(x, NUMBERED, 2).alias("t")))
    j = j.withColumn("_lines", lines).withColumn("_said", F.filter(said, lambda x: (x["n"] != "") & (F.length(x["n"]) < 18)))
    good = F.expr("transform(filter(_said, x -> cast(x.n as bigint) between _first and _last and element_at(_lines, cast(cast(x.n as bigint) as int)) = x.t), x -> cast(x.n as bigint))")
    held = cut(
        j.withColumn("_good", F.when(F.col("failed") | F.col("_sliced"), F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(F.when(F.size("_said") > 0, good).otherwise(F.array().cast("array<bigint>"))))))
        .select(key, call, "failed", "digest", "total_bytes", "total_lines", "_sliced", F.col("_j.byteStart").alias("_a"), F.col("_j.byteEnd").alias("_b"), F.sha2("content", 256).alias("output_hash"), "_good", F.col("content").rlike(r"(?i)empty file|file[^\n\r\u2028\u2029]*empty").alias("_empty")),
        "observed",
    )
    status = F.when(F.col("failed"), "error").when(F.col("_sliced") | (F.size("_good") > 0) | ((F.col("total_bytes") == 0) & F.col("_empty")), "verified").otherwise("unknown")
    calls = held.select(key, call, F.col("digest").alias("source_hash"), "output_hash", "total_bytes", "total_lines", status.alias("status"))
    runs = held.select(key, call, F.posexplode("_good").alias("_i", "_n")).groupBy(key, call, (F.col("_n") - F.col("_i")).alias("_run")).agg(F.min("_n").alias("start"), F.max("_n").alias("stop"))
    ranges = runs.select(key, call, F.lit("lines").alias("kind"), "start", "stop").unionByName(held.where("_sliced").select(key, call, F.lit("bytes").alias("kind"), F.col("_a").alias("start"), F.col("_b").alias("stop")))
    return calls, ranges
