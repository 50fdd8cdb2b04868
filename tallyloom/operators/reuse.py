"""What of an earlier analysis still holds after the sources have changed: affected files, and tasks whose result can be taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.digests import structural_digest
from tallyloom.operators.graphs import reach
from tallyloom.operators.revisions import change_kind

REUSABLE = ("identical", "supported-format-only")


def source_changes(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind, reuse_analysis, reuse_tools): each file in scope between two snapshots.

    before and after (path, text, mode, symlink) have a path once, files (path) is the scope. A file that wasn't there, or whose mode or type is another, is
    analysis-relevant whatever its text; one that is in scope but not in the new snapshot, or whose text can't be judged, is unknown. Null paths are left out.
    """
    old = before.select("path", F.col("text").alias("old_text"), F.struct("mode", "symlink").alias("old_type"), F.lit(True).alias("was"))
    new = after.select("path", F.col("text").alias("new_text"), F.struct("mode", "symlink").alias("new_type"), F.lit(True).alias("is"))
    both = files.select("path").where("path is not null").distinct().join(old, "path", "left").join(new, "path", "left")
    retyped = F.col("was") & F.col("is") & ~F.col("old_type").eqNullSafe(F.col("new_type"))
    kind = F.when(F.col("was").isNull() | retyped, "analysis-relevant").otherwise(change_kind(F.col("path"), F.col("old_text"), F.col("new_text")))
    return both.select("path", kind.alias("kind")).select("path", "kind", F.col("kind").isin(*REUSABLE).alias("reuse_analysis"), (F.col("kind") == "identical").alias("reuse_tools"))


def affected_files(changes: DataFrame, before: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(path, hops): the files that changed or left the scope (0), and all that depend on them by the edges src -> dst of either revision.

    The closure starts from what changed and in each round joins only what the last one found, so its work is that of the affected part of the graph, whose
    edges of both revisions are taken once. Edges with a null end and null paths affect nothing.
    """
    left = before.select("path").where("path is not null").distinct().join(changes.select("path"), "path", "left_anti")
    first = changes.where("not reuse_analysis").select("path").unionByName(left).withColumnRenamed("path", "node")
    edges = old_edges.select("src", "dst").unionByName(new_edges.select("src", "dst")).where("src is not null and dst is not null")
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), first).withColumnRenamed("node", "path")


def logical_offset(text: Column, offset: Column) -> Column:
    """A byte place in a text as it would be with CRLF as LF: less the CRLFs that stand whole before it."""
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character for each byte
    return offset - (F.size(F.split(F.left(raw, offset), "\r\n")) - 1)


def _identities(tasks: DataFrame, texts: DataFrame, keep: list, affected: DataFrame | None = None) -> DataFrame:
    """task_id and what is kept of tasks, with `identity`: a digest of kind, ranges in logical places in their order, and flows; null where a file isn't in texts.
    owned_hit: whether the files of a task with an identity have one of affected (path).

    A range is looked up once, by its file and both of its byte places. Only places come back to its task, of which a digest stands for the rest.
    """
    ranges = tasks.select("task_id", F.posexplode("owned").alias("i", "r")).select("task_id", "i", "r.path", "r.byte_from", "r.byte_to")
    key = ["path", "byte_from", "byte_to"]
    text = texts.select("path", "text")
    if affected is not None:
        text = text.join(affected.select("path", F.lit(True).alias("hit")), "path", "left")
    else:
        text = text.withColumn("hit", F.lit(None).cast("boolean"))
    place = lambda byte: logical_offset(F.col("text"), F.col(byte)).cast("string")
    end = F.when(F.col("byte_to") == F.octet_length("text"), F.lit("EOF")).otherwise(place("byte_to"))
    asked = ranges.select(*key).where("path is not null and byte_from is not null and byte_to is not null").distinct()
    places = asked.join(text, "path").select(*key, place("byte_from").alias("from"), end.alias("to"), "hit")
    one = F.struct("i", "from", "to", "hit")
    lists = ranges.join(places, key, "left").groupBy("task_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    rest = F.transform("owned", lambda r: F.struct(*(r[c].alias(c) for c in ("path", "line_from", "line_to"))))
    out = tasks.select("task_id", F.unhex(structural_digest(F.col("kind"), rest, F.col("flows"))).alias("said"), *keep).join(lists, "task_id", "left")
    known = F.forall("all", lambda x: x["from"].isNotNull() & x["to"].isNotNull())
    digest = F.when(known, F.unhex(structural_digest(F.col("said"), F.transform("all", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))))))
    return out.withColumns({"identity": digest, "owned_hit": F.coalesce(F.exists("all", lambda x: x["hit"]), F.lit(False))}).drop("all", "said")


def reusable_tasks(old: DataFrame, new: DataFrame, before: DataFrame, after: DataFrame, sealed: DataFrame, attempts: DataFrame, affected: DataFrame) -> DataFrame:
    """(task_id, status, prior): whether a new task's result can be taken from an old one, and from which.

    old and new (ord, task_id, kind, owned, flows, obligations; new also dependencies) have a task_id once; owned is an array of (path, line_from, line_to,
    byte_from, byte_to), flows and obligations are arrays of anything. sealed (task_id, owned) is what was closed of the old run, attempts (ord, task_id,
    status, superseded, observed) its runs with the files that they read, before and after (path, text) the snapshots, affected (path) the affected files.

    The prior is the first old task of the same kind, ranges and flows, where a byte place counts as it would with CRLF as LF, or is the file's end. status is
    the first that holds of: not-source (another kind or no ranges), no-match, unsealed (the prior isn't sealed with those ranges), affected (a range's
    file or a dependency), obligations (others), unfinished (no completed attempt that isn't superseded), observed (the first such read an affected file),
    reuse. A list of a task's ranges is as long as a task is; files, flows and attempts of any number are joins by key. Null lists count as empty.
    """
    empty = lambda df, *names: df.withColumns({n: F.coalesce(n, F.array().cast(df.schema[n].dataType)) for n in names})
    hit = affected.select("path").distinct()
    seals = sealed.select("task_id", F.unhex(structural_digest(F.col("owned"))).alias("seal")).groupBy("task_id").agg(F.collect_set("seal").alias("seals"))
    done = attempts.where("status = 'completed' and not coalesce(superseded, false)").groupBy("task_id").agg(F.min_by(F.coalesce("observed", F.array().cast("array<string>")), "ord").alias("observed"))
    read = done.select("task_id", F.explode("observed").alias("path")).join(hit, "path").select("task_id").distinct().withColumn("read", F.lit(True))
    # What is known of an old task meets it by its id, before it is looked for; so its ranges don't move on.
    seal = F.unhex(structural_digest(F.col("owned")))
    o = _identities(empty(old, "owned", "flows", "obligations"), before, ["ord", "obligations", seal.alias("seal")]).join(seals, "task_id", "left").join(done.select("task_id", F.lit(True).alias("done")), "task_id", "left").join(read, "task_id", "left")
    closed = F.coalesce(F.array_contains("seals", F.col("seal")), F.lit(False))
    prior = o.where("identity is not null").select("identity", "ord", "task_id", "obligations", closed.alias("closed"), "done", "read")
    prior = prior.groupBy("identity").agg(F.min_by(F.struct("task_id", "obligations", "closed", "done", "read"), F.struct("ord", "task_id")).alias("o"))
    new = empty(new, "owned", "flows", "obligations", "dependencies")
    needs = new.select("task_id", F.explode(F.array_distinct("dependencies")).alias("path")).join(hit, "path").select("task_id").distinct().withColumn("needs_hit", F.lit(True))
    other = F.coalesce(F.col("kind") != "source", F.lit(True)) | (F.size("owned") == 0)
    n = _identities(new, after, [other.alias("other"), "obligations"], hit).join(needs, "task_id", "left").select("task_id", "other", "obligations", "identity", (F.col("owned_hit") | F.col("needs_hit").isNotNull()).alias("touched"))
    status = (
        F.when(F.col("other"), "not-source").when(F.col("o").isNull(), "no-match").when(~F.col("o.closed"), "unsealed").when(F.col("touched"), "affected")
        .when(structural_digest(F.col("obligations")) != structural_digest(F.col("o.obligations")), "obligations").when(F.col("o.done").isNull(), "unfinished").when(F.col("o.read"), "observed").otherwise("reuse")
    )
    return n.join(prior, "identity", "left").select("task_id", status.alias("status"), F.when(status == "reuse", F.col("o.task_id")).alias("prior"))
