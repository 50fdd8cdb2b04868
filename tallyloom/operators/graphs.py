"""Graph operators: semi-naive loops of joins over tables in the shared folder, never driver-side graphs."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share; a local master may do without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _temporary.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='rounds-')}")
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a round's rows to the shared folder and reads them back."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, hops) from the starts along src -> dst, the least hops; each round joins only what the last one found."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    seen = cut(starts.select(F.col("node"), F.lit(0).alias("hops")).distinct(), "seen")
    new, k = seen, 0
    while (depth is None or k < depth) and not new.isEmpty():
        k += 1
        found = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = cut(found.join(seen, "node", "left_anti").select("node", F.lit(k).alias("hops")), "new")
        seen = seen.unionByName(new)
        if k % 16 == 0:  # what was found is written once more only now and then, so that the plan stays short
            seen = cut(seen, "seen")
    return seen


def follow(links: DataFrame) -> DataFrame:
    """(node, end): where each chain of node -> next ends; null where it runs into a cycle. Pointers double, so the rounds are the logarithm of the longest chain.

    Only chains that go on are doubled again. A chain has no more links than there are nodes, so what goes on after as many rounds as double that far runs in a cycle.
    """
    links = cut(links.select("node", F.col("next").alias("end")).distinct(), "links")
    step, done, reach, nodes = links, None, 1, links.count()
    while reach <= 4 * nodes:  # the last pointer reaches its end one round before it is known to have ended
        further = step if done is None else step.unionByName(done)
        nxt = cut(step.join(further.select(F.col("node").alias("m"), F.col("end").alias("beyond")), F.col("end") == F.col("m"), "left").select("node", F.coalesce("beyond", "end").alias("end"), F.col("beyond").isNull().alias("ended")), "links")
        ended, step = nxt.where("ended").drop("ended"), nxt.where("not ended").drop("ended")
        done = ended if done is None else done.unionByName(ended)
        if step.isEmpty():
            return done
        reach *= 2
        if reach % 1024 == 0:  # so that the plan stays short
            done = cut(done, "ends")
    return done.unionByName(step.select("node", F.lit(None).cast(links.schema["end"].dataType).alias("end")))


def first_paths(edges: DataFrame, starts: DataFrame, sinks: DataFrame, nodes: int = 8) -> DataFrame:
    """(path): breadth first from each start, targets in ascending order; a node is passed once a start, a sink is reached by each edge and passed by none.

    Paths have at most so many nodes before the sink. In each round a start's first path to a new node is the least of its paths, which is the queue's order: the
    paths of a start have one length, so they are numbered, and the least number of each pair of start and node is an aggregate that is reduced before it moves.
    A start's rows lie together, and of the edges only those that go on from a round's nodes are joined. Paths are made only for sinks and for new nodes.
    """
    ends = sinks.select(F.col("node").alias("dst"), F.lit(True).alias("is_sink")).distinct()
    edges = cut(edges.select("src", "dst").distinct().join(ends, "dst", "left").select("src", "dst", F.coalesce("is_sink", F.lit(False)).alias("is_sink")), "edges")

    def numbered(paths: DataFrame) -> DataFrame:
        return cut(paths.withColumn("at", F.row_number().over(W.partitionBy("start").orderBy("path"))), "paths")

    open_ = numbered(starts.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path")).distinct())
    seen, done = open_.select("start", F.col("last").alias("dst")), None
    for _ in range(nodes):
        on = cut(edges.join(open_.select(F.col("last").alias("src")).distinct(), "src", "left_semi"), "on")
        step = open_.join(on, F.col("last") == F.col("src")).where("dst <> start")
        hit = cut(step.where("is_sink").select(F.concat("path", F.array("dst")).alias("path")), "hits")
        done = hit if done is None else done.unionByName(hit)
        least = step.where("not is_sink").groupBy("start", "dst").agg(F.min("at").alias("at")).join(seen, ["start", "dst"], "left_anti")
        open_ = numbered(least.join(open_.select("start", "at", "path"), ["start", "at"]).select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path")))
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_.select("start", F.col("last").alias("dst")))
    return done


def terminals(edges: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(path, hops): each path of a start without a node twice, to where nothing goes on: no edge, only nodes that it has been through, or depth edges.

    hops is twice the path's edges, as the reference counts it. The number of paths grows with the degree to the power of depth, so this is for sparse graphs.
    """
    edges = cut(edges.groupBy("src").agg(F.collect_set("dst").alias("next")), "edges")
    open_ = cut(starts.select(F.array("node").alias("path"), F.col("node").alias("last")).distinct(), "paths")
    done = None
    for _ in range(depth):
        step = open_.join(edges, F.col("last") == F.col("src"), "left").select("path", F.array_except(F.coalesce("next", F.array().cast(edges.schema["next"].dataType)), "path").alias("on"))
        step = cut(step, "steps")
        ended = step.where("size(on) = 0").select("path")
        done = ended if done is None else done.unionByName(ended)
        open_ = cut(step.select("path", F.explode("on").alias("last")).select(F.concat("path", F.array("last")).alias("path"), "last"), "paths")
    return done.unionByName(open_.select("path")).select("path", (2 * (F.size("path") - 1)).cast("long").alias("hops"))


def peel(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): Kahn's levels; nodes on or behind a cycle have none (null)."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    left = cut(nodes.select("node").distinct(), "left")
    out, k = None, 0
    while True:
        blocked = edges.join(left.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        free = cut(left.join(blocked, "node", "left_anti").select("node", F.lit(k).alias("level")), "free")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = cut(left.join(free, "node", "left_anti"), "left")
        k += 1
    rest = left.select("node", F.lit(None).cast("int").alias("level"))
    return rest if out is None else out.unionByName(rest)


def propagate_labels(table, sweeps: int = 5) -> dict:
    """Asynchronous label propagation in node order; a node takes its neighbours' most common label, of ties the one met first.

    Order-dependent by definition, so it runs over one bounded group at a time: table has node and neighbours (imports, then importers).
    """
    label = {n: n for n in table}
    for _ in range(sweeps):
        changed = False
        for n in table:
            seen: dict = {}
            for m in table[n]:
                if m in label:
                    seen[label[m]] = seen.get(label[m], 0) + 1
            if seen:
                best = max(seen.values())
                new = next(x for x in seen if seen[x] == best)
                changed |= new != label[n]
                label[n] = new
        if not changed:
            break
    return label


def communities(edges: DataFrame, group: str, sweeps: int = 5) -> DataFrame:
    """(group, node, label): propagate_labels within each group, with the same labels, but as joins, so no group has to fit a task.

    In a sweep a node sees the new labels of the nodes before it and the old ones of itself and those behind it. So the votes of the latter are counted once for
    a sweep. What is before what has no cycle, so there is just one such labelling. Only nodes with a node behind them can change another one's label in a
    sweep: their labels are reached by computing them anew from the last guess until nothing changes, and all others follow once from those.
    """
    e = edges.select(group, "src", "dst").distinct()
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("m"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("node"), F.col("src").alias("m"), F.lit(1).alias("side"))))
    e = cut(e, "edges").select(group, ends.alias("e")).select(group, "e.*")
    before = e.where("m < node")
    led = cut(before.select(group, F.col("m").alias("node")).distinct(), "led")
    old = cut(e.select(group, "node").distinct().withColumn("label", F.col("node")), "labels")
    inner = cut(before.join(led, [group, "node"], "left_semi"), "inner")
    # The rows of a node lie together, so its votes are counted before they move; a node with very many is split.
    outer = cut(before.join(led, [group, "node"], "left_anti").hint("rebalance", group, "node"), "outer")
    behind = cut(e.where("m >= node").hint("rebalance", group, "m"), "behind")

    def votes(near: DataFrame, labels: DataFrame) -> DataFrame:
        met = near.join(labels.withColumnRenamed("node", "m"), [group, "m"])
        firsts = (F.min(F.when(F.col("side") == k, F.col("m"))).alias(f"m{k}") for k in (0, 1))  # plain columns, which are hashed; structs are sorted
        return met.groupBy(group, "node", "label").agg(F.count("*").alias("n"), *firsts)

    def chosen(*parts: DataFrame) -> DataFrame:
        """The most common label of each node, of ties the one met first: imports, then importers."""
        every = reduce(DataFrame.unionByName, parts).groupBy(group, "node", "label").agg(F.sum("n").alias("n"), F.min("m0").alias("m0"), F.min("m1").alias("m1"))
        rank = F.struct(-F.col("n"), F.col("m0").isNull(), F.coalesce("m0", "m1"))
        return every.groupBy(group, "node").agg(F.min_by("label", rank).alias("label"))

    differs = lambda a, b: not a.join(b.withColumnRenamed("label", "other"), [group, "node"]).where("label <> other").isEmpty()
    for _ in range(sweeps):
        fixed = cut(votes(behind, old), "fixed")
        of_led = cut(fixed.join(led, [group, "node"], "left_semi"), "fixed")
        guess = cut(old.join(led, [group, "node"], "left_semi"), "labels")
        while True:
            new = cut(chosen(of_led, votes(inner, guess)), "labels")
            settled = not differs(new, guess)
            guess = new
            if settled:
                break
        rest = chosen(fixed.join(led, [group, "node"], "left_anti"), votes(outer, guess))
        new = cut(guess.unionByName(rest), "labels")
        settled = not differs(new, old)
        old = new
        if settled:
            break
    return old
