"""Packing of ordered items: chunks by successor pointers and selections by folds and rounds, without a list of a unit's items anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import scans
from tallyloom.operators.graphs import cut
from tallyloom.operators.scans import prefix_scan


def sequential_chunks(rows: DataFrame, unit: str, item: str, size: str, max_items: int, max_size: int) -> DataFrame:
    """unit, item, chunk (0, 1, ...) and oversized: the items of each unit in order, a chunk closing before the item that would overflow it.

    An item over max_size is alone in its chunk (what follows it would overflow, however small) and is marked. Sizes are not negative; a null size is 0.

    Prefix sums give each item its place and the sizes up to it. If a chunk began there, the next one would begin at the first place whose sum is over
    the limit, which is as many places on as sums are within it: items and limits are sorted together and the items counted. Those successor pointers
    are doubled from each unit's first item: with pointers of 2 ** k chunks, what is reached grows from 2 ** k chunks to twice that. So the rounds are
    the logarithm of the longest unit's number of chunks, and a unit of any size is rows of a table throughout.
    """
    sized = rows.select(unit, item, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_z"), F.lit(1).cast("long").alias("_one"))
    placed = prefix_scan(sized, [unit], [item], total={"_at": "_one", "_sum": "_z"}, name="places")
    marks = placed.select(unit, "_at", (F.col("_sum") + F.col("_z")).alias("_value"), F.lit(0).alias("_kind"), "_one")
    limits = placed.select(unit, "_at", (F.col("_sum") + max_size).alias("_value"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_one"))
    counted = prefix_scan(marks.unionByName(limits), [unit], ["_value", "_kind", "_at"], total={"_within": "_one"}, name="limits")
    pointer = F.greatest(F.col("_at") + 1, F.least(F.col("_at") + max_items, F.col("_within")))
    jump = cut(counted.where("_kind = 1").select(unit, "_at", pointer.alias("_to")), "pointers")
    begun = cut(jump.where("_at = 0").select(unit, "_at"), "begun")
    while True:
        reached = begun.join(jump, [unit, "_at"]).select(unit, F.col("_to").alias("_at")).join(placed.select(unit, "_at"), [unit, "_at"], "left_semi")
        new = cut(reached, "reached")
        if new.isEmpty():
            break
        begun = begun.unionByName(new)  # one table more in each round
        onward = jump.select(unit, F.col("_at").alias("_to"), F.col("_to").alias("_beyond"))
        jump = cut(jump.join(onward, [unit, "_to"]).select(unit, "_at", F.col("_beyond").alias("_to")), "pointers")
    marked = placed.select(unit, item, "_at", "_z").join(begun.withColumn("_begins", F.lit(1).cast("long")), [unit, "_at"], "left")
    numbered = prefix_scan(marked, [unit], ["_at"], total={"_before": "_begins"}, name="chunks")
    chunk = F.col("_before") + F.coalesce("_begins", F.lit(0)) - 1
    return numbered.select(unit, item, chunk.alias("chunk"), (F.col("_z") > max_size).alias("oversized"))


def chunk_summary(chunks: DataFrame, unit: str, size: DataFrame | None = None) -> DataFrame:
    """unit, chunk, its id (the unit's own where the unit is one chunk, else with a number of three digits or more), items and oversized items."""
    of_chunk = chunks.groupBy(unit, "chunk").agg(F.count("*").alias("items"), F.count(F.when(F.col("oversized"), 1)).alias("oversized"))
    last = chunks.groupBy(unit).agg(F.max("chunk").alias("_last"))
    number = (F.col("chunk") + 1).cast("string")
    named = F.when(F.col("_last") == 0, F.col(unit).cast("string")).otherwise(F.concat(F.col(unit).cast("string"), F.lit("#"), F.lpad(number, 3, "0") if size is None else number))
    return of_chunk.join(last, unit).select(unit, "chunk", named.alias("id"), "items", "oversized")


def budget_selection(candidates: DataFrame, unit: str, order: list[str], item: str, size: str, max_items: int, max_size: int, keep: tuple[str, ...] = (), misfits: str | None = None) -> DataFrame:
    """unit, item, outcome: candidates of each unit by rank; one is taken if both caps hold, and misfits are passed over.

    outcome: selected, file-cap (as many as allowed were taken before it) or token-cap (its size is over what is left at its turn). Null sizes are 0; candidates without a
    unit are left out. keep: columns that come along; misfits: a column more, the number of candidates of the unit before this one that weren't taken.

    Candidates are sorted by unit and rank over all machines and each partition folds its own, once; only units that go on from one partition in the next (a row
    for each partition tells which) are selected by rounds. So most candidates move and are written once, and a unit of any size is rows of a table throughout.
    """
    ranks = [f"_o{k}" for k in range(len(order))]
    rows = candidates.where(F.col(unit).isNotNull()).select(unit, item, *keep, *(F.expr(o).alias(r) for o, r in zip(order, ranks, strict=True)), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_z"))
    by, sizes = [unit, *ranks, item], len(rows.columns) - 1
    own = [T.StructField("_outcome", T.StringType()), T.StructField("_misfits", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("_place", T.LongType())]

    def run(batches):
        part, place, key, n, left, missed = TaskContext.get().partitionId(), 0, None, 0, max_size, 0
        for b in batches:
            if not len(b):
                continue
            units = b.column(0)
            new = [key is None or units[0] != key, *scans.changes([units]).tolist()]
            outcomes, before = [], []
            for fresh, z in zip(new, b.column(sizes).to_pylist(), strict=True):
                if fresh:
                    n, left, missed = 0, max_size, 0
                before.append(missed)
                if n < max_items and z <= left:
                    n, left = n + 1, left - z
                    outcomes.append("selected")
                else:
                    missed += 1
                    outcomes.append("token-cap" if n < max_items else "file-cap")
            key = units[-1]
            found = [pa.array(outcomes, pa.string()), pa.array(before, pa.int64()), pa.array(np.full(len(b), part, np.int64)), pa.array(np.arange(place, place + len(b)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*b.schema.names, *(f.name for f in own)])
            place += len(b)

    done = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, T.StructType([*rows.schema.fields, *own])), "selection")
    ends = sorted(done.groupBy("_part").agg(F.min_by(unit, "_place").alias("first"), F.max_by(unit, "_place").alias("last")).collect())  # a row for each partition
    across = {b["first"] for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}
    out = [unit, item, F.col("_outcome").alias("outcome"), *keep, *([F.col("_misfits").alias(misfits)] if misfits else [])]
    if not across:
        return done.select(*out)
    split = F.broadcast(done.sparkSession.createDataFrame([(u,) for u in sorted(across)], T.StructType([T.StructField(unit, rows.schema[unit].dataType)])))  # fewer than partitions
    again = _selection_by_rounds(done.join(split, unit, "left_semi").drop(*(f.name for f in own)), unit, ranks, item, max_items, max_size)
    return done.join(split, unit, "left_anti").select(*out).unionByName(again.select(*out))


def _selection_by_rounds(rows: DataFrame, unit: str, ranks: list[str], item: str, max_items: int, max_size: int) -> DataFrame:
    """rows with _outcome and _misfits, for units that may fill many partitions.

    What doesn't fit what is left now never will. So in a round the candidates behind the last one taken that fit by themselves are summed in their order, and all up to the
    first whose sum is over what is left are taken; that one is then larger than what is left. Every round takes one of a unit at least, so there are max_items rounds at
    most and usually few, and a unit's candidates are never in one place.
    """
    ranked = cut(rows.withColumns({"_rank": F.struct(*ranks, F.col(item).alias("i")), "_one": F.lit(1).cast("long")}), "ranked")
    state = cut(ranked.select(unit).distinct().select(unit, F.lit(0).cast("long").alias("_n"), F.lit(max_size).cast("long").alias("_left"), F.lit(None).cast(ranked.schema["_rank"].dataType).alias("_last")), "state")
    taken = None
    while True:
        fits = ranked.select(unit, "_rank", "_z", "_one").join(state, unit).where((F.col("_n") < max_items) & (F.col("_z") <= F.col("_left")) & (F.col("_last").isNull() | (F.col("_rank") > F.col("_last"))))
        summed = prefix_scan(fits, [unit], ["_rank"], total={"_before": "_one", "_sum": "_z"}, name="sums")
        new = cut(summed.where((F.col("_n") + F.col("_before") < max_items) & (F.col("_sum") + F.col("_z") <= F.col("_left"))).select(unit, "_rank", "_z"), "taken")
        if new.isEmpty():
            break
        taken = new if taken is None else taken.unionByName(new)
        step = new.groupBy(unit).agg(F.count("*").alias("_more"), F.sum("_z").alias("_size"), F.max("_rank").alias("_new"))
        state = cut(state.join(step, unit, "left").select(unit, (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("_n"), (F.col("_left") - F.coalesce("_size", F.lit(0))).alias("_left"), F.coalesce("_new", "_last").alias("_last")), "state")
    picked = (ranked.limit(0) if taken is None else taken).select(unit, F.col("_rank.i").alias(item), F.lit(True).alias("_taken"))
    full = (F.col("_n") >= max_items) & (F.col("_last").isNull() | (F.col("_rank") > F.col("_last")))
    outcome = F.when(F.col("_taken"), "selected").when(full, "file-cap").otherwise("token-cap")
    told = ranked.join(state, unit).join(picked, [unit, item], "left").withColumn("_outcome", outcome).drop("_n", "_left", "_last", "_taken")
    told = told.withColumn("_missed", F.when(F.col("_outcome") == "selected", 0).otherwise(1))
    return prefix_scan(told, [unit], ["_rank"], total={"_misfits": "_missed"}, name="misfits").drop("_missed", "_rank", "_one")
