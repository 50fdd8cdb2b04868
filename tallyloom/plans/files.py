"""Source and sink queries (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import joins as J
from tallyloom.operators import revisions as V
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query
from tallyloom.sources import files as R


@query("s01_source_scan", f"with {cte('files')} select path, bytes from files where regexp_matches(path, '\\.(ts|py|go|rs|js)$') and not starts_with(path, 'promo/')")
def s01(spark, d):
    return view(spark, d, "files").where(F.col("path").rlike(r"\.(ts|py|go|rs|js)$") & ~F.col("path").startswith("promo/")).select("path", "bytes")


@query("s02_dependency_scan", f"with {cte('files')} select path from files where ends_with(path, '.lock')")
def s02(spark, d):
    return view(spark, d, "files").where(F.col("path").endswith(".lock")).select("path")


@query("s04_subproject_roots", f"with {cte('files')} select distinct regexp_extract(path, '^(.*)/[^/]+$', 1) as root from files where ends_with(path, '.lock')")
def s04(spark, d):
    return view(spark, d, "files").where(F.col("path").endswith(".lock")).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("root")).distinct()


@query("s05_manifest", "select doc_id, strlen(text) as bytes, sha256(text) as sha256, case when text = '' then 0 else cast(len(string_split_regex(text, '\\r\\n|\\r|\\n')) as bigint) - case when regexp_matches(text, '[\\r\\n]$') then 1 else 0 end end as loc from documents")
def s05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), S.line_count(F.col("text")).alias("loc"))


@query("s06_snapshot_recheck", f"""with {cte('revised')}, a as (select doc_id, strlen(before) as bytes, sha256(before) as digest from revised where doc_id % 11 <> 0),
    b as (select doc_id, strlen(after) as bytes, sha256(after) as digest from revised where doc_id % 13 <> 0)
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'missing' when a.doc_id is null then 'added'
        when a.bytes is not distinct from b.bytes and a.digest is not distinct from b.digest then 'same' else 'changed' end as kind from a full join b on a.doc_id = b.doc_id""")
def s06(spark, d):
    """A snapshot's manifest against the workspace's: files have gone (every 13th), come (every 11th) and changed."""
    manifest = lambda c: view(spark, d, "revised").select("doc_id", F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("digest"))
    return V.snapshot_diff(manifest("before").where("doc_id % 11 <> 0"), manifest("after").where("doc_id % 13 <> 0"), "doc_id")


@query("s07_iac_manifest", f"with {cte('files')} select case when ends_with(path, '.tf') then 'terraform' when ends_with(path, '.lock') then 'dependency' else 'none' end as class, count(*) as n from files group by 1")
def s07(spark, d):
    return view(spark, d, "files").groupBy(F.when(F.col("path").endswith(".tf"), "terraform").when(F.col("path").endswith(".lock"), "dependency").otherwise("none").alias("class")).agg(F.count("*").alias("n"))


@query("s08_structured_reader", "select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events")
def s08(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s11_union_last_wins", f"with {cte('candidates', 'classifications')}, u as (select candidate_id, status, 1 as src from candidates union all select candidate_id, status, 2 from classifications) select candidate_id, arg_max(coalesce(status, ''), src) as status from u group by 1")
def s11(spark, d):
    u = view(spark, d, "candidates").select("candidate_id", "status", F.lit(1).alias("src")).union(view(spark, d, "classifications").select("candidate_id", "status", F.lit(2)))
    return u.groupBy("candidate_id").agg(F.max_by(F.coalesce("status", F.lit("")), "src").alias("status"))


@query("s12_record_receipts", "select page_id, strlen(html) as bytes, sha256(html) as sha256 from pages")
def s12(spark, d):
    return table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))


@query("s13_upsert_latest", "select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def s13(spark, d):
    return J.latest(table(spark, d, "events"), ["user_id"], F.col("event_id"), "event_type").join(table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id")), "user_id")


@query("s14_promotion_conflicts", f"with {cte('candidates', 'classifications')} select c.candidate_id from candidates c join classifications k on c.candidate_id = k.candidate_id where c.status is distinct from k.status")
def s14(spark, d):
    return R.conflicts(view(spark, d, "candidates"), view(spark, d, "classifications"), "candidate_id", "status")


@query("s15_insert_if_absent", f"with {cte('candidates', 'classifications')} select candidate_id from classifications where candidate_id not in (select candidate_id from candidates)")
def s15(spark, d):
    return R.insert_if_absent(view(spark, d, "candidates"), view(spark, d, "classifications"), ["candidate_id"]).select("candidate_id")


@query("s17_advisory_import", f"with {cte('revisions')}, n as (select * from revisions where revision >= 14000 and sha256(cast(revision as varchar)) not in (select sha256(cast(revision as varchar)) from revisions where revision < 14500)) select cve_id, revision from n")
def s17(spark, d):
    r = view(spark, d, "revisions").withColumn("digest", F.sha2(F.col("revision").cast("string"), 256))
    return R.insert_if_absent(r.where("revision < 14500"), r.where("revision >= 14000"), ["digest"]).select("cve_id", "revision")


@query("s18_content_addressed", "select sha256(text) as uri, count(*) as puts from documents group by 1")
def s18(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("uri")).agg(F.count("*").alias("puts"))


@query("s20_telemetry", "select event_type as kind, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2")
def s20(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


@query("s21_analyzer_import", "select event_id, user_id, event_type from events where event_type in ('error', 'view') order by user_id, event_id limit 200")
def s21(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "view")).select("event_id", "user_id", "event_type").orderBy("user_id", "event_id").limit(200)


@query("s23_knowledge_scan", f"with {cte('run_events')} select phase, string_agg(distinct type, ',' order by type) as kinds from run_events where attempt = 0 or phase = 'p1' group by 1")
def s23(spark, d):
    return view(spark, d, "run_events").where("attempt = 0 or phase = 'p1'").groupBy("phase").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("kinds"))


@query("s24_ordered_events", f"with {cte('run_events')} select run_id, seq, type from run_events")
def s24(spark, d):
    return view(spark, d, "run_events").select("run_id", "seq", "type").orderBy("run_id", "seq")


@query("s26_scope_rejects", "select count(*) filter (l_partkey in (select p_partkey from part where p_size > 10)) as kept, count(*) filter (l_partkey not in (select p_partkey from part where p_size > 10)) as rejected from lineitem")
def s26(spark, d):
    own = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("own"))
    j = table(spark, d, "lineitem").select("l_partkey").join(own, "l_partkey", "left")
    return j.agg(F.count("own").alias("kept"), F.count(F.when(F.col("own").isNull(), 1)).alias("rejected"))
