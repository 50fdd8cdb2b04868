"""Source revisions: what has changed, what a snapshot still holds, and where cited lines are now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.delivery import SPACE


def plain(text: Column) -> Column:
    """Line ends as line feeds, and none behind the last line."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\\z", "")


def change_kind(path: Column, before: Column, after: Column) -> Column:
    """identical by bytes; supported-format-only where line ends or the last line's end are all that differs and both sides are valid JSON (.json); else analysis-relevant.

    unknown: a side is missing, a byte-order mark, a lone CR, a raw literal or a line continuation stands in either, or there is no profile of the file's
    language: script files (.js, .mjs, .cjs, .ts) would need a parser, which isn't at hand, and other endings have none.
    """
    unclear = F.concat(before, F.lit("\n"), after).rlike("\ufeff|\r(?!\n)|`|\\\\\r?\n")
    kind = F.when(before.isNull() | after.isNull(), "unknown").when(before == after, "identical").when(plain(before) != plain(after), "analysis-relevant")
    valid = F.lower(path).endswith(".json") & path.rlike(r"[^/]\.[^./]*\z") & S.valid_json(before) & S.valid_json(after)
    return kind.when(unclear | ~F.coalesce(valid, F.lit(False)), "unknown").otherwise("supported-format-only")


def snapshot_diff(snapshot: DataFrame, workspace: DataFrame, key: str) -> DataFrame:
    """(key, kind) from two manifests (key, bytes, digest): same, changed, missing (from the workspace) or added; one full join."""
    now = workspace.select(F.col(key).alias("_key"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    both = snapshot.join(now, F.col(key) == F.col("_key"), "full")
    same = F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("digest").eqNullSafe(F.col("_digest"))
    kind = F.when(F.col("_key").isNull(), "missing").when(F.col(key).isNull(), "added").when(same, "same").otherwise("changed")
    return both.select(F.coalesce(key, "_key").alias(key), kind.alias("kind"))


def logical_lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def cited(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last as one text."""
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n")


def evidence_status(rows: DataFrame, whole: bool = True) -> DataFrame:
    """rows (text, quote, line_from, line_to, in_scope) with status: reversed, outside (the scope), beyond (the text's end), holds or differs.

    whole: the quote is all of the cited lines, white space at its ends (that of a script engine) aside; otherwise it need only stand in them. A missing text or quote differs.
    """
    bare = lambda c: F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")
    lines = logical_lines(F.col("text"))
    seen = cited(lines, F.col("line_from"), F.col("line_to"))
    holds = bare(seen) == bare(F.col("quote")) if whole else seen.contains(F.col("quote"))
    status = (
        F.when(F.col("line_to") < F.col("line_from"), "reversed").when(~F.col("in_scope"), "outside").when((F.col("line_from") < 1) | (F.col("line_to") > F.size(lines)), "beyond")
        .when(F.coalesce(holds, F.lit(False)), "holds").otherwise("differs")
    )
    return rows.withColumn("status", status)


def remapped_lines(rows: DataFrame) -> DataFrame:
    """rows (before, after, line_from, line_to) with byte spans of the cited lines in both revisions; null unless every cited line is the same in both.

    Lines are compared once CRLF is LF, but places are those of the texts as they are, in which a CR is a byte of its line. A citation beyond the end of either text, or that
    ends before it begins, has no place.
    """
    lines = lambda c: F.split(F.replace(F.col(c), F.lit("\r\n"), F.lit("\n")), "\n")
    out = rows.withColumn("_old", lines("before")).withColumn("_new", lines("after")).withColumn("_old_raw", F.split("before", "\n")).withColumn("_new_raw", F.split("after", "\n"))
    n = F.col("line_to") - F.col("line_from") + 1
    inside = (F.col("line_from") >= 1) & (n >= 1) & (F.col("line_to") <= F.size("_old")) & (F.col("line_to") <= F.size("_new"))
    cited = lambda c: F.slice(c, F.greatest(F.col("line_from"), F.lit(1)).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    holds = F.coalesce(inside & (cited("_old") == cited("_new")), F.lit(False))
    for name, c in (("previous", "_old_raw"), ("current", "_new_raw")):
        before = F.slice(c, F.lit(1), F.greatest(F.col("line_from") - 1, F.lit(0)).cast("int"))
        start = F.octet_length(F.array_join(before, "")) + F.col("line_from") - 1
        out = out.withColumn(f"{name}_from", F.when(holds, start).cast("long"))
        out = out.withColumn(f"{name}_to", F.when(holds, start + F.octet_length(F.array_join(cited(c), "\n"))).cast("long"))
    return out.drop("_old", "_new", "_old_raw", "_new_raw")
