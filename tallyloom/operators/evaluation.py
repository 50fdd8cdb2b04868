"""Quality evaluation: rates with and without denominators, gates, and a clustered bootstrap whose generator is sequential by definition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S


def _n(c) -> F.Column:
    return F.count(F.when(c, 1))


def confusion(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of decided against truth; null where a denominator is 0."""
    g = rows.groupBy(*(keys or [])).agg(_n((F.col("decided") == 1) & (F.col("truth") == 1)).alias("tp"), _n((F.col("decided") == 1) & (F.col("truth") == 0)).alias("fp"), _n((F.col("decided") == 0) & (F.col("truth") == 1)).alias("fn"))
    g = g.withColumn("precision", S.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", S.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


class Xorshift32:
    """A 32-bit xorshift generator; next() is in [0, 1)."""

    def __init__(self, seed: int):
        self.state = (seed & 0xFFFFFFFF) or 1

    def next(self) -> float:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self.state = x
        return x / 4294967296


def percentile(ordered: list[float], p: float) -> float:
    """The value at floor(p * n), within the list; not interpolated."""
    return ordered[min(len(ordered) - 1, max(0, math.floor(p * len(ordered))))]


def bootstrap(values: list[float], samples: int, alpha: float, seed: int) -> tuple[float, float, float]:
    """Mean and interval of resampled case means; draws are one after the other, so results repeat."""
    if not values:
        return 0.0, 0.0, 0.0
    rng, n = Xorshift32(seed), len(values)
    means = sorted(sum(values[int(rng.next() * n)] for _ in range(n)) / n for _ in range(samples))
    return sum(values) / n, percentile(means, alpha / 2), percentile(means, 1 - alpha / 2)


def _step(x: int) -> int:
    x ^= (x << 13) & 0xFFFFFFFF
    x ^= x >> 17
    return x ^ ((x << 5) & 0xFFFFFFFF)


def _apply(columns: list[int], x: int) -> int:
    out = 0
    for i in range(32):
        if x >> i & 1:
            out ^= columns[i]
    return out


def jump(steps: int) -> list[int]:
    """So many steps of the generator at once: it is linear over bits, so this is a power of its matrix, given by its columns."""
    out, power = [1 << i for i in range(32)], [_step(1 << i) for i in range(32)]
    while steps:
        if steps & 1:
            out = [_apply(power, c) for c in out]
        power = [_apply(power, c) for c in power]
        steps >>= 1
    return out


def sample_means(values: list[float], seed: int, first: int, count: int) -> list[float]:
    """The means of samples first, first + 1, ... of `bootstrap`, each from where its draws begin in the one sequence."""
    import numpy as np

    n, at = len(values), (seed & 0xFFFFFFFF) or 1
    at, onward, starts = _apply(jump(first * n), at), jump(n), []
    for _ in range(count):
        starts.append(at)
        at = _apply(onward, at)
    x, v, total = np.array(starts, np.uint32), np.array(values), np.zeros(count)
    for _ in range(n):
        x ^= x << np.uint32(13)
        x ^= x >> np.uint32(17)
        x ^= x << np.uint32(5)
        total += v[(x / 4294967296 * n).astype(np.int64)]
    return (total / n).tolist()


def bootstrap_by(rows: DataFrame, key: str, value: str, order: str, samples: int, alpha: float, seed: int | str, block: int = 500) -> DataFrame:
    """(key, mean, low, high): one interval for each key over its cases, as `bootstrap` draws it in one sequence. seed: a number, or an expression over the key's column.

    Samples are dealt into blocks of `block`, and a task jumps to where its block's draws begin, so tasks follow the number of samples and not of keys. What
    a task holds is one comparison's case means, one number for each case; an end is the sample mean at its place among `samples`.
    """
    import pyarrow as pa

    kind = dict(rows.dtypes)[key]
    of_key = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("vs"))
    seeded = of_key.withColumn("seed", (F.lit(seed) if isinstance(seed, int) else F.expr(seed)).cast("long"))
    blocks = seeded.select(key, "vs", "seed", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(block))).alias("first")).repartition(key, "first")

    def run(batches):
        for b in batches:
            for k, vs, s, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                means = sample_means(vs, s, first, min(block, samples - first))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(means), b.schema.field(0).type), pa.array(means, pa.float64())], [key, "m"])

    drawn = blocks.mapInArrow(run, f"{key} {kind}, m double").groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    place = lambda p: min(samples - 1, max(0, math.floor(p * samples)))
    ends = drawn.select(key, F.col("ms")[place(alpha / 2)].alias("low"), F.col("ms")[place(1 - alpha / 2)].alias("high"))
    mean = F.aggregate("vs", F.lit(0.0), lambda a, x: a + x) / F.size("vs")
    return of_key.select(key, mean.alias("mean")).join(ends, key)


def paired_cases(observations: DataFrame, keys: list[str], candidate: str, baseline: str, least: int, metrics: dict[str, str], fails: F.Column) -> DataFrame:
    """A row for each case (keys) with `least` repetitions that both arms have: pairs, the mean difference of each metric, and the hard-gate failures of the two arms
    in those repetitions alone. metrics: new name to column; fails: whether an observation fails a hard gate."""
    arm = lambda a, c: F.avg(F.when(F.col("arm") == a, F.col(c)))
    failures = lambda a: F.count(F.when((F.col("arm") == a) & fails, 1))
    there = lambda a: F.count(F.when(F.col("arm") == a, 1)) > 0
    pairs = observations.where(F.col("arm").isin(candidate, baseline)).groupBy(*keys, "repetition").agg(
        *((arm(candidate, c) - arm(baseline, c)).alias(m) for m, c in metrics.items()), failures(baseline).alias("baseline_failures"), failures(candidate).alias("candidate_failures"), (there(candidate) & there(baseline)).alias("both"),
    )
    sums = [F.sum(c).alias(c) for c in ("baseline_failures", "candidate_failures")]
    return pairs.where("both").groupBy(*keys).agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in metrics), *sums).where(F.col("pairs") >= least)


#: What is added to the seed of a capability's place for each of the three intervals (fixed values).
SEED_OFFSETS = {"primary": 1, "evidence": 18, "false_positive": 32}


def compared_arms(cases: DataFrame, capability: str, declared: list[str], samples: int, seed: int, family_alpha: float, evidence_margin: float, false_positive_margin: float, least_cases: int) -> DataFrame:
    """The claim for each declared capability from paired_cases with metrics primary, evidence and false_positive and a column `case` that orders them. A capability without
    cases gets intervals of 0. The family's alpha is shared by all declared capabilities and their three contrasts."""
    spark, alpha = cases.sparkSession, family_alpha / (3 * len(declared))
    place = "case " + " ".join(f"when {capability} = '{c}' then {i}" for i, c in enumerate(declared)) + " end"
    out = spark.createDataFrame([(c,) for c in declared], f"{capability} string")
    totals = cases.groupBy(capability).agg(F.count("*").alias("cases"), F.sum("pairs").alias("pairs"), F.sum("baseline_failures").alias("baseline_failures"), F.sum("candidate_failures").alias("candidate_failures"))
    out = out.join(totals, capability, "left").fillna(0)
    known = cases.where(F.col(capability).isin(*declared))
    for metric, offset in SEED_OFFSETS.items():
        ends = bootstrap_by(known, capability, metric, "case", samples, alpha, f"{seed} + {place} + {offset}")
        out = out.join(ends.select(capability, *(F.col(c).alias(f"{metric}_{c}") for c in ("mean", "low", "high"))), capability, "left").fillna(0)
    return claim(out, evidence_margin, false_positive_margin, least_cases)


def claim(rows: DataFrame, evidence_margin: float, false_positive_margin: float, least_cases: int) -> DataFrame:
    """decision for each row with cases, baseline_failures, candidate_failures (hard gates) and low and high ends of primary, evidence and false_positive.

    A baseline that fails a hard gate or too few cases leave it open; a candidate that fails one is inferior. Superior needs a primary gain beyond doubt
    and neither evidence nor false positives worse by their margin; inferior follows from any of the three being worse beyond doubt.
    """
    end = lambda metric, which: F.col(f"{metric}_{which}")
    no_worse = (end("evidence", "low") >= -evidence_margin) & (end("false_positive", "high") <= false_positive_margin)
    worse = (end("evidence", "high") < -evidence_margin) | (end("false_positive", "low") > false_positive_margin) | (end("primary", "high") < 0)
    decision = (
        F.when(F.col("baseline_failures") > 0, "inconclusive").when(F.col("candidate_failures") > 0, "inferior").when(F.col("cases") < least_cases, "inconclusive")
        .when(no_worse & (end("primary", "low") > 0), "superior").when(worse, "inferior").when(no_worse, "non-inferior").otherwise("inconclusive")
    )
    return rows.withColumn("decision", decision)


def shuffled_by(rows: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """(key, place, value): the distinct values of each key, a bounded few, in an order drawn from the seed and the key."""
    import pandas as pd

    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[key].iloc[0]
        order = shuffled(sorted(pdf[value]), seed + int(k))
        return pd.DataFrame({key: [k] * len(order), "place": range(len(order)), value: order})

    return rows.select(key, value).distinct().groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, place int, {value} {kinds[value]}")


def shuffled(items: list, seed: int) -> list:
    """Fisher-Yates from the end, by the same generator."""
    rng, out = Xorshift32(seed), list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(rng.next() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out
