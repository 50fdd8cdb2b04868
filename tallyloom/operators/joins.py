"""Join operators beyond plain equality: prefixes, suffixes, as-of, ranges, merges. Theta conditions are turned into equality joins on exploded keys, so
they hash instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.graphs import cut


def owned_once(files: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Files with no owner or several, with the number of owners."""
    n = owners.groupBy(key).agg(F.count("*").alias("owners"))
    return files.join(n, key, "left").select(key, F.coalesce("owners", F.lit(0)).cast("long").alias("owners")).where("owners <> 1")


def merge_ledgers(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full join; the right side's truthy fields win; rows of the right side alone are appended."""
    r = right.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return left.select(key, *fields).join(r, key, "full").select(key, *(S.first_truthy(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields))


def ancestors(path: Column) -> Column:
    """A path's directories from the nearest to the first, and the root '.'."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>")), F.array(F.lit(".")))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The nearest root above each path; '.' where there is none. A path has as many candidates as it has directories."""
    up = files.select(path, F.posexplode(ancestors(F.col(path))).alias("d", root))
    # A semi-join, so that no task ever holds the exploded paths, which look small when they are compressed: only roots can be its table.
    hit = up.join(roots.select(root).distinct(), root, "left_semi").groupBy(path).agg(F.min_by(root, "d").alias(root))
    return files.select(path).join(hit, path, "left").select(path, F.coalesce(root, F.lit(".")).alias(root))


def prefix_covers(units: DataFrame, audits: DataFrame) -> DataFrame:
    """(unit, audit) where one is the other or lies in it: two equality joins, each over one side's ancestors."""
    u, a = units.select("unit").distinct(), audits.select("audit").distinct()
    down = u.select("unit", F.explode(F.array_union(F.array("unit"), ancestors(F.col("unit")))).alias("audit")).join(a, "audit").select("unit", "audit")
    up = a.select("audit", F.explode(F.array_union(F.array("audit"), ancestors(F.col("audit")))).alias("unit")).join(u, "unit").select("unit", "audit")
    return down.unionByName(up).distinct()


def first_candidate(rows: DataFrame, candidates: Column, known: DataFrame, key: str, target: str) -> DataFrame:
    """The first of a row's candidates, in order, that is known."""
    each = rows.select(key, F.posexplode(candidates).alias("rank", target))
    return each.join(known.select(F.col(target)).distinct(), target).groupBy(key).agg(F.min_by(target, "rank").alias(target))


def as_of(versions: DataFrame, key: str, pin: int, order: list[str]) -> DataFrame:
    """Each key's greatest version at or below the pin: an aggregate, so a key with many versions is reduced before it moves."""
    rest = [c for c in versions.columns if c != key]
    best = versions.where(F.col("revision") <= pin).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, stop: str, bin_width: int = 64) -> DataFrame:
    """Points within ranges of the same key, both dealt to bins, so a key with many of either is no nested loop."""
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(stop) / bin_width))))
    return points.withColumn("_bin", F.floor(F.col(at) / bin_width)).join(r, [key, "_bin"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_bin")


def unique_suffix(names: DataFrame, full: DataFrame) -> DataFrame:
    """name -> id that ends in .name or is it, if just one does."""
    suffixes = full.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("id", "\\."))), lambda n: F.array_join(F.slice(F.split(F.col("id"), "\\."), -n, n), "."))).alias("name"))
    hit = names.select("name").distinct().join(suffixes, "name").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return names.select("name").distinct().join(hit.where("n = 1").select("name", "id"), "name", "left")


def paired(observations: DataFrame, candidate: str, baseline: str, least: int, metric: str = "value") -> DataFrame:
    """Mean difference of candidate and baseline for each case with `least` paired repetitions: pairs meet in one aggregate, not in a join."""
    value = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col(metric)))
    pairs = observations.where(F.col("arm").isin(candidate, baseline)).groupBy("case_id", "repetition").agg((value(candidate) - value(baseline)).alias("difference")).where("difference is not null")
    return pairs.groupBy("case_id").agg(F.count("*").alias("pairs"), F.avg("difference").alias("difference")).where(F.col("pairs") >= least)


def page(rows: DataFrame, order: list, offset: int, limit: int = 5) -> DataFrame:
    """A page of 1 to 20 rows with the total and the next offset."""
    if not 1 <= limit <= 20 or offset < 0:
        raise ValueError("limit must be 1 to 20 and offset 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset(offset).limit(limit)
    return shown.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))  # total is one row


def latest(rows: DataFrame, key: list[str], order: Column, value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def top_k(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their place in the whole order, from 1: each range partition numbers its own rows, from the sum of the counts of those before it."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("before"))  # one row a partition
    number = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_number", number).join(F.broadcast(before), "_range").withColumn("place", F.col("before") + F.col("_number")).drop("_range", "_number", "before")
