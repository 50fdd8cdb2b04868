"""Ordered-log state: folds of run events, idempotent appends, leases and an outbox, as batch folds and as streams with the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMINAL = "purchase"


def replay(events: DataFrame) -> DataFrame:
    """Each run's snapshot from its ordered events: events after the first terminal one count as rejected.

    The fold needs the order only for the place of the terminal event, so it is an aggregate with partial sums, not a task for each run.
    """
    end = events.where(F.col("type") == TERMINAL).groupBy("run_id").agg(F.min("seq").alias("ended_at"))
    e = events.join(end, "run_id", "left").withColumn("late", F.coalesce(F.col("seq") > F.col("ended_at"), F.lit(False)))
    live = ~F.col("late")
    return e.groupBy("run_id").agg(
        F.count(F.when(live, 1)).alias("applied"), F.count(F.when(F.col("late"), 1)).alias("rejected"), F.round(F.sum(F.when(live, F.col("value")).otherwise(0)), 4).alias("cost"),
        F.max(F.when(live, F.col("seq"))).alias("last_seq"), F.when(F.bool_or(live & (F.col("type") == TERMINAL)), "completed").otherwise("running").alias("status"),
    )


def append_outcomes(incoming: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """For each id its first body; how many repeats agree (no-ops) and how many differ (conflicts)."""
    first = incoming.groupBy(key).agg(F.min_by(body, order).alias("kept"), F.count("*").alias("n"))
    same = incoming.groupBy(key, body).agg(F.count("*").alias("m"))
    j = first.join(same.withColumnRenamed(body, "kept"), [key, "kept"])
    return j.select(key, F.col("kept"), (F.col("m") - 1).alias("repeats"), (F.col("n") - F.col("m")).alias("conflicts"))


def leases(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """Acquisitions with their fencing number: a lease goes to a new holder only once the last one has run out."""
    order = W.partitionBy("run_id").orderBy("ts", "seq")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(order)
    fresh = events.withColumn("fresh", F.when(gap.isNull() | (gap > ttl_seconds), 1).otherwise(0))
    return fresh.withColumn("fencing", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def outbox_status(events: DataFrame, most_attempts: int) -> DataFrame:
    """Each message's status as of its last event."""
    n = lambda t: F.count(F.when(F.col("type") == t, 1))
    return events.groupBy("run_id", "phase").agg(
        n("click").alias("claims"), F.when(n("purchase") > 0, "delivered").when(n("click") >= most_attempts, "dead").when(n("click") > n("error"), "claimed").otherwise("queued").alias("status"),
    )


def counts_stream(spark, path: str, schema, checkpoint: str, out: str):
    """The same snapshot counters as a stream: events are deduplicated within the watermark and counted by run and hour."""
    stream = spark.readStream.schema(schema).parquet(path)
    agg = (
        stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    )
    flat = agg.select(F.col("window.start").alias("start"), "event_type", "n", "value")
    return flat.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def upsert_stream(spark, path: str, schema, checkpoint: str, key: str, order: str, read_state, write_state):
    """A keyed latest-wins sink by foreachBatch; a batch that comes again writes the same state, so the sink is idempotent. One writer is assumed."""

    def merge(batch: DataFrame, _: int) -> None:
        state = read_state()
        both = batch if state is None else state.unionByName(batch)
        rest = [c for c in both.columns if c != key]
        write_state(both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in rest)))

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
