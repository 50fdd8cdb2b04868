"""Ordered scans over keyed rows, in which no key has to fit a task.

What a row needs to know of the rows before it is a fold of values that compose: the last value, a sum, the greatest value. So the rows are sorted by key and
order over all machines, each partition folds its own part of a key, and the few folds at the partitions' ends (a row for each partition) are composed in
order and handed to the partitions that a key goes on in. A key with a third of all rows is spread over as many partitions as its rows fill.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.graphs import cut

_NOTHING = -(1 << 63)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For each place but the first, whether some column differs from the place before it; nulls equal each other."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool) if columns else np.zeros(0, bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, pc.fill_null(pc.equal(a, b), False))
        out |= ~np.asarray(same)
    return out


class _Fold:
    """The folds of the key that a partition is in, carried from batch to batch."""

    def __init__(self, last: dict[str, int], total: dict[str, int], most: dict[str, int]):
        self.last, self.total, self.most = last, total, most
        self.key: list[pa.Array] | None = None
        self.values: dict = {}
        self.segments = 0

    def step(self, b: pa.RecordBatch, keys: list[int]) -> tuple[list[pa.Array], np.ndarray]:
        """The folds before each row, and whether the row's key is the first of the partition."""
        n = len(b)
        own = [b.column(i) for i in keys]
        new = np.ones(n, bool)
        new[1:] = changes(own) if keys else False
        if self.key is not None:
            new[0] = bool(changes([pa.concat_arrays([k, o.slice(0, 1)]) for k, o in zip(self.key, own, strict=True)])[0]) if keys else False
        starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        segment = self.segments + np.cumsum(new)
        out = []
        for name, i in self.last.items():
            v = b.column(i)
            at = np.maximum.accumulate(np.where(np.asarray(v.is_valid()), np.arange(n), -1))
            before = np.concatenate(([-1], at[:-1]))
            both = pa.concat_arrays([self.values.get(name, pa.nulls(1, v.type)), v])
            # Place 0 is what came over from the last batch; it counts only for rows whose key came over too.
            out.append(both.take(pa.array(before + 1, pa.int64(), mask=before < starts)))
            self.values[name] = both.take(pa.array(np.array([at[-1] + 1]), pa.int64(), mask=np.array([at[-1] < starts[-1]])))
        for name, i in self.total.items():
            x = np.asarray(pc.fill_null(b.column(i), 0))
            upto = np.cumsum(x)
            before = upto - x
            fold = before - np.where(starts >= 0, before[starts], 0) + np.where(starts < 0, self.values.get(name, 0), 0)
            out.append(pa.array(fold, b.column(i).type))
            self.values[name] = fold[-1] + x[-1]
        for name, i in self.most.items():
            x = pd.Series(np.asarray(pc.fill_null(b.column(i), _NOTHING), np.int64))
            running = x.groupby(segment).cummax().to_numpy()
            came = np.where(starts < 0, self.values.get(name, _NOTHING), _NOTHING)
            before = np.where(new, _NOTHING, np.concatenate(([_NOTHING], running[:-1])))
            fold = np.maximum(before, came)
            out.append(pa.array(fold, pa.int64(), mask=fold == _NOTHING))
            self.values[name] = max(fold[-1], x.iloc[-1])
        first = segment == 1
        self.segments, self.key = int(segment[-1]), [o.slice(n - 1, 1) for o in own]
        return out, first


def _composed(parts: list, last: dict, total: dict, most: dict) -> list[tuple]:
    """For each partition that goes on with the key before it: its number and the folds that it begins with."""
    out, before = [], None
    for r in sorted(parts, key=lambda r: r["_scan_part"]):
        came = before[1] if before is not None and before[0] == r["first"] else None
        if came is not None:
            out.append((r["_scan_part"], *(came[n] for n in (*last, *total, *most))))
        now = {n: r[f"now_{n}"]["v"] for n in (*last, *total, *most)}
        if came is not None and r["single"]:
            now |= {n: came[n] for n in last if now[n] is None}
            now |= {n: now[n] + came[n] for n in total}
            now |= {n: max((x for x in (now[n], came[n]) if x is not None), default=None) for n in most}
        before = (r["last"], now)
    return out


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], last: dict[str, str] | None = None, total: dict[str, str] | None = None, most: dict[str, str] | None = None, name: str = "scan") -> DataFrame:
    """rows with folds over the rows of its key that stand before it, by `order`, which should tell the rows of a key apart.

    last: new column to the column whose last value that isn't null is wanted; total: to the column (long, int or double) to be summed, nulls as 0; most: to the
    long column whose greatest value is wanted. Without rows before it, a row has null, and 0 for sums. Null keys are a key of their own. Names that
    begin with _scan_ are taken. The result is a written table, and so is sure to be the same at each use.
    """
    last, total, most = last or {}, total or {}, most or {}
    if total:  # sums of one width
        kinds = dict(rows.dtypes)
        rows = rows.withColumns({c: F.col(c).cast("double" if kinds[c] in ("double", "float") else "long") for c in set(total.values())})
    names = rows.columns
    at = lambda of: {n: names.index(c) for n, c in of.items()}
    places, key_places = (at(last), at(total), at(most)), [names.index(k) for k in keys]
    kind = {f.name: f.dataType for f in rows.schema}
    added = [T.StructField(n, kind[c]) for n, c in {**last, **total}.items()] + [T.StructField(n, T.LongType()) for n in most]
    own = [T.StructField("_scan_part", T.LongType()), T.StructField("_scan_place", T.LongType()), T.StructField("_scan_first", T.BooleanType()), T.StructField("_scan_end", T.BooleanType())]
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema] + added + own

    def run(batches):
        part, place, fold, held = TaskContext.get().partitionId(), 0, _Fold(*places), None
        for b in batches:
            if not len(b):
                continue
            found, first = fold.step(b, key_places)
            facts = [pa.array(np.full(len(b), part, np.int64)), pa.array(np.arange(place, place + len(b))), pa.array(first), pa.array(np.zeros(len(b), bool))]
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*b.columns, *found, *facts], [f.name for f in fields])
            place += len(b)
        if held is not None:  # the last batch, whose last row is marked
            yield held.set_column(held.num_columns - 1, "_scan_end", pa.array(np.arange(len(held)) == len(held) - 1))

    by = [*keys, *order]
    done = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, T.StructType(fields)), name)
    now = {n: F.coalesce(c, n) for n, c in last.items()} | {n: F.col(n) + F.coalesce(c, F.lit(0)) for n, c in total.items()} | {n: F.greatest(n, c) for n, c in most.items()}
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    ends = [F.min_by(key, "_scan_place").alias("first"), F.max_by(key, "_scan_place").alias("last"), F.max_by("_scan_first", "_scan_place").alias("single")]
    folds = [F.max_by(F.struct(v.alias("v")), "_scan_place").alias(f"now_{n}") for n, v in now.items()]
    carried = _composed(done.where("_scan_end or _scan_place = 0").groupBy("_scan_part").agg(*ends, *folds).collect(), last, total, most)  # a row for each partition
    out = done
    if carried:
        schema = T.StructType([own[0], *(T.StructField(f"_scan_came_{f.name}", f.dataType) for f in added)])
        out = done.join(F.broadcast(done.sparkSession.createDataFrame(carried, schema)), "_scan_part", "left")
        came = lambda n: F.when(F.col("_scan_first"), F.col(f"_scan_came_{n}"))
        folded = {n: F.coalesce(n, came(n)) for n in last} | {n: F.col(n) + F.coalesce(came(n), F.lit(0)) for n in total} | {n: F.greatest(F.col(n), came(n)) for n in most}
        out = out.withColumns(folded)
    return out.select(*names, *(f.name for f in added))
