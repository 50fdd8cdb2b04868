"""Interval (IV) and packing (PK) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import delivery as D
from tallyloom.operators import intervals as I
from tallyloom.operators import packing as P
from tallyloom.operators import revisions as V
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query


def _islands(touch: int) -> str:
    return f"{cte('ranges')}, m as (select *, max(stop) over (partition by path order by start, stop rows between unbounded preceding and 1 preceding) as b from ranges), g as (select *, sum(case when b is null or start > b + {touch} then 1 else 0 end) over (partition by path order by start, stop rows between unbounded preceding and current row) as k from m), islands as (select path, k, min(start) as start, max(stop) as stop from g group by 1, 2)"


@query("iv01_merged_ranges", f"with {_islands(1)} select path, start, stop from islands")
def iv01(spark, d):
    return I.islands(view(spark, d, "ranges"), "path", "start", "stop", 1)


_RECEIPTS = {
    "doc_id": "l_orderkey", "kind": "case when l_partkey % 3 = 0 then 'bytes' else 'lines' end", "fresh": "l_suppkey % 8 > 0", "status": "case l_returnflag when 'N' then 'verified' when 'R' then 'verified' else 'unknown' end",
    "start": "case when l_partkey % 3 = 0 then cast(l_linenumber - 1 as bigint) * 40 else cast(l_linenumber - 1 as bigint) * 3 + l_suppkey % 3 end",
    "stop": "case when l_partkey % 3 = 0 then cast(l_linenumber - 1 as bigint) * 40 + cast(l_quantity as bigint) * 4 else cast(l_linenumber - 1 as bigint) * 3 + l_suppkey % 3 + cast(l_quantity as bigint) % 7 end",
}
#: What is needed of each document: all of it, some lines, some bytes, lines that are not there.
_NEEDS = (("whole", "null", "null", "null", "null"), ("head", "null", "1 + doc_id % 3", "null", "null"), ("lines", "1 + doc_id % 4", "2 + doc_id % 5", "null", "null"), ("bytes", "null", "null", "doc_id % 30", "doc_id % 30 + 25"), ("none", "null", "n_chars + 2", "null", "null"))


def _needs() -> str:
    return " union all ".join(f"select doc_id, '{n}' as need, cast({a} as bigint) as line_from, cast({b} as bigint) as line_to, cast({c} as bigint) as byte_from, cast({e} as bigint) as byte_to from documents" for n, a, b, c, e in _NEEDS)


def receipts(spark, d):
    """Lineitems as receipts of documents; every eighth is of another text."""
    rows = table(spark, d, "lineitem").selectExpr(*(f"{e} as {c}" for c, e in _RECEIPTS.items()))
    digest = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.join(digest, "doc_id").select("doc_id", F.when(F.col("fresh"), F.col("digest")).otherwise("stale").alias("source_hash"), "status", "kind", "start", "stop")


@query("iv02_delivered", f"""with n as ({_needs()}), s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as p, strlen(coalesce(text, '')) as size from documents),
    o as (select doc_id, size, case when p[len(p)] = '' then len(p) - 1 else len(p) end as lines, list_prepend(0, list_transform(range(1, len(p) + 1), lambda i: least(size, strlen(array_to_string(p[1:i], chr(10))) + 1))) as ends from s),
    r as (select {", ".join(f"{e} as {c}" for c, e in _RECEIPTS.items())} from lineitem), v as (select r.*, o.size, o.lines, o.ends from r join o using (doc_id) where fresh and status = 'verified'),
    b as (select doc_id, case kind when 'bytes' then start else ends[start] end as start, case kind when 'bytes' then stop else ends[stop + 1] end as stop from v
        where stop >= start and case kind when 'bytes' then start >= 0 and stop <= size else start >= 1 and stop <= lines end),
    m as (select *, max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from b),
    g as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by doc_id order by start, stop rows between unbounded preceding and current row) as k from m),
    i as (select doc_id, k, min(start) as start, max(stop) as stop from g group by 1, 2),
    w as (select n.doc_id, need, size, coalesce(line_from, 1) as lf, coalesce(line_to, lines) as lt, lines, ends, byte_from, byte_to from n join o using (doc_id)),
    f as (select *, lf >= 1 and lt >= lf and lt <= lines as fits, coalesce(byte_from, case when lf between 1 and lines then ends[lf] end) as a, coalesce(byte_to, case when lt between 1 and lines then ends[lt + 1] end) as b from w)
    select doc_id, need, case when size = 0 then exists (select 1 from v where v.doc_id = f.doc_id)
        else coalesce(fits and a >= 0 and b >= a and b <= size and (a = b or coalesce((select bool_or(start <= a and stop >= b) from i where i.doc_id = f.doc_id), false)), false) end as delivered from f""")
def iv02(spark, d):
    docs = table(spark, d, "documents")
    needs = None
    for n, a, b, c, e in _NEEDS:
        one = docs.selectExpr("doc_id", f"'{n}' as need", *(f"cast({x} as bigint) as {y}" for x, y in ((a, "line_from"), (b, "line_to"), (c, "byte_from"), (e, "byte_to"))))
        needs = one if needs is None else needs.unionByName(one)
    return D.delivered(docs, receipts(spark, d), needs, "doc_id", "text", "need").select("doc_id", "need", "delivered")


#: Each document as a reading tool may have shown it: numbered from 1 (every 7th: from 2), every 5th with a changed letter, every 13th nothing, every 11th failed; the lines asked for differ.
_SHOWN = "case when doc_id % 5 = 0 then replace(text, 'a', 'o') else text end"
_ASKED = {"first": "case when doc_id % 3 = 0 then null else 1 + doc_id % 3 end", "most": "case when doc_id % 4 = 0 then null else 5 + doc_id % 4 end", "failed": "doc_id % 11 = 0"}


@query("iv03_observed_delivery", f"""with o as (select doc_id, string_split({_SHOWN}, chr(10)) as shown, string_split(text, chr(10)) as own, {", ".join(f"{e} as {c}" for c, e in _ASKED.items())} from documents where text is not null),
    s as (select *, case when own[len(own)] = '' then len(own) - 1 else len(own) end as lines from o),
    l as (select doc_id, failed, lines, own, unnest(range(1, len(shown) + 1)) as i, unnest(shown) as t, coalesce(first, 1) as a, case when most is null then lines else coalesce(first, 1) + most - 1 end as b from s),
    n as (select *, i + case when doc_id % 7 = 0 then 1 else 0 end as n from l where doc_id % 13 > 0 and not failed),
    h as (select doc_id, n, n - row_number() over (partition by doc_id order by n) as run from n where n between greatest(a, 1) and least(b, lines) and regexp_replace(own[n], '\r$', '') = t and not contains(t, chr(13))),
    r as (select doc_id, run, min(n) as start, max(n) as stop from h group by 1, 2),
    k as (select doc_id, string_agg(start || '-' || stop, ',' order by start) as ranges from r group by 1)
    select doc_id, sha256(text) as source_hash, strlen(text) as total_bytes, cast(lines as bigint) as total_lines, case when doc_id % 11 = 0 then 'error' when ranges is not null then 'verified' else 'unknown' end as status,
        coalesce(ranges, '') as ranges from documents join s using (doc_id) left join k using (doc_id)""")
def iv03(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    numbered = F.transform(F.split(F.expr(_SHOWN), "\n"), lambda x, i: F.concat((i + 1 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string"), F.lit("\t"), x))
    content = F.when(F.col("doc_id") % 13 == 0, "nothing").otherwise(F.array_join(numbered, "\n"))
    outputs = docs.select("doc_id", F.col("doc_id").alias("call"), content.alias("content"), *(F.expr(e).alias(c) for c, e in _ASKED.items()))
    calls, ranges = D.observed(docs, outputs, "doc_id", "text", "call")
    # One output's ranges: no more than its lines.
    of_call = ranges.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("l")).select("call", F.array_join(F.transform("l", lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("ranges"))
    return calls.join(of_call, "call", "left").select("doc_id", "source_hash", "total_bytes", "total_lines", "status", F.coalesce("ranges", F.lit("")).alias("ranges"))


@query("iv04_line_remap", f"""with {cte('revised')}, s as (select *, string_split(replace(before, chr(13) || chr(10), chr(10)), chr(10)) as o, string_split(replace(after, chr(13) || chr(10), chr(10)), chr(10)) as n,
        string_split(before, chr(10)) as ro, string_split(after, chr(10)) as rn from revised),
    h as (select *, coalesce(line_to <= len(o) and line_to <= len(n) and o[line_from:line_to] = n[line_from:line_to], false) as holds,
        strlen(array_to_string(ro[1:line_from - 1], '')) + line_from - 1 as x, strlen(array_to_string(rn[1:line_from - 1], '')) + line_from - 1 as y,
        strlen(array_to_string(ro[line_from:line_to], chr(10))) as xs, strlen(array_to_string(rn[line_from:line_to], chr(10))) as ys from s)
    select doc_id, line_from, line_to, case when holds then x end as previous_from, case when holds then x + xs end as previous_to, case when holds then y end as current_from, case when holds then y + ys end as current_to from h""")
def iv04(spark, d):
    return V.remapped_lines(view(spark, d, "revised")).select("doc_id", "line_from", "line_to", "previous_from", "previous_to", "current_from", "current_to")


def _chunks(max_items: int, max_size: int, size: str, more: str = "") -> str:
    return f"""with recursive {cte('files')}, o as (select unit, file_id, {size} as z, row_number() over (partition by unit order by file_id) as rn from files),
        w as (select unit, file_id, rn, 1 as n, z as total, 0 as chunk from o where rn = 1
        union all select o.unit, o.file_id, o.rn, case when w.n + 1 > {max_items} or w.total + o.z > {max_size} then 1 else w.n + 1 end, case when w.n + 1 > {max_items} or w.total + o.z > {max_size} then o.z else w.total + o.z end,
        case when w.n + 1 > {max_items} or w.total + o.z > {max_size} then w.chunk + 1 else w.chunk end from w join o on o.unit = w.unit and o.rn = w.rn + 1)
        select unit, file_id, cast(chunk as bigint) as chunk{more} from w"""


@query("pk01_chunks_by_loc", _chunks(8, 2500, "loc"))
def pk01(spark, d):
    return P.sequential_chunks(view(spark, d, "files"), "unit", "file_id", "loc", 8, 2500).drop("oversized")


@query("pk02_chunks_by_tokens", _chunks(12, 9000, "cast(ceil(bytes / 4.0) as bigint)", ", (select z > 9000 from o where o.file_id = w.file_id) as oversized"))
def pk02(spark, d):
    return P.sequential_chunks(view(spark, d, "files").withColumn("tokens", F.ceil(F.col("bytes") / 4).cast("long")), "unit", "file_id", "tokens", 12, 9000)


@query("pk03_budget_selection", f"""with recursive {cte('files')}, o as (select unit, file_id, bytes as z, row_number() over (partition by unit order by loc desc, file_id) as rn from files),
    w as (select unit, file_id, rn, case when z > 90000 then 0 else 1 end as n, case when z > 90000 then 0 else z end as total, case when z > 90000 then 'token-cap' else 'selected' end as outcome from o where rn = 1
    union all select o.unit, o.file_id, o.rn, case when w.n + 1 > 6 or w.total + o.z > 90000 then w.n else w.n + 1 end, case when w.n + 1 > 6 or w.total + o.z > 90000 then w.total else w.total + o.z end,
    case when w.n + 1 > 6 then 'file-cap' when w.total + o.z > 90000 then 'token-cap' else 'selected' end from w join o on o.unit = w.unit and o.rn = w.rn + 1)
    select unit, file_id, outcome from w""")
def pk03(spark, d):
    return P.budget_selection(view(spark, d, "files"), "unit", ["-loc"], "file_id", "bytes", 6, 90000)


@query("pk04_text_parts")
def pk04(spark, d):
    return I.partition_texts(table(spark, d, "documents"), "doc_id", "text", 1000)


@query("pk05_path_batches", _chunks(128, 600, "cast(length(path) as bigint)"))
def pk05(spark, d):
    return P.sequential_chunks(view(spark, d, "files").withColumn("n", F.length("path").cast("long")), "unit", "file_id", "n", 128, 600).drop("oversized")
