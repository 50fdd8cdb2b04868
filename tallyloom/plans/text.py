"""Scalar and text queries (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.functions import text as X
from tallyloom.plans.bindings import cte, table, view
from tallyloom.plans.registry import query


def simple(name: str, source: str, key: str, sql: str, column, alias: str = "out"):
    """A query of one scalar over a view or table: its key and the result."""
    from tallyloom.plans.bindings import VIEWS

    is_view = source in VIEWS

    def f(spark, d):
        rows = view(spark, d, source) if is_view else table(spark, d, source)
        return rows.select(key, column().alias(alias))

    if not sql:
        query(name)(f)
        return
    query(name, f"with {cte(source)} select {key}, {sql} as {alias} from {source}" if is_view else f"select {key}, {sql} as {alias} from {source}")(f)


c = F.col
simple("x01_token", "candidates", "candidate_id", "upper(regexp_replace(trim(status), '[\\s-]+', '_', 'g'))", lambda: S.token(c("status")))
simple("x02_severity", "candidates", "candidate_id", "case upper(trim(severity)) when 'STRUCTURAL' then 'STRUCTURAL_WEAKNESS' when 'CRITICAL' then 'CRITICAL' when 'HIGH' then 'HIGH' when 'MEDIUM' then 'MEDIUM' when 'LOW' then 'LOW' else 'INFO' end", lambda: S.severity(c("severity")))
simple("x03_analyzer_severity", "events", "event_id", "case upper(event_type) when 'ERROR' then 'HIGH' when 'WARNING' then 'MEDIUM' when 'INFO' then 'LOW' else upper(event_type) end", lambda: S.analyzer_severity(c("event_type")))
simple("x04_cwe", "customer", "c_custkey", "array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('cwe-' || cast(c_custkey % 9 as varchar) || ' CWE-' || cast(c_nationkey as varchar), '[0-9]+'), lambda n: 'CWE-' || n))), ',')", lambda: F.array_join(F.array_sort(X.cwes(F.concat(F.lit("cwe-"), (c("c_custkey") % 9).cast("string"), F.lit(" CWE-"), c("c_nationkey").cast("string")))), ","))
simple("x05_normal_path", "files", "file_id", "path || '/x'", lambda: S.normal_path(F.concat(F.lit("./"), F.replace(c("path"), F.lit("/"), F.lit("\\")), F.lit("\\x/"))))
simple("x06_safe_path", "pages", "page_id", "len(list_filter(string_split(regexp_replace(url, '^http://', ''), '/'), lambda s: s in ('', '.', '..'))) = 0", lambda: S.safe_relative(F.regexp_replace("url", "^http://", "")))
simple("x07_glob", "files", "file_id", "regexp_full_match(path, 'economy/.*/[^/]*\\.ts')", lambda: c("path").rlike(r"^economy/.*/[^/]*\.ts$"))
simple("x09_package", "files", "file_id", "case when file_id % 2 = 0 then '@' || regexp_extract(path, '^([^/]+/[^/]+)', 1) else regexp_extract(path, '^([^/]+)', 1) end", lambda: X.package_of(F.when(c("file_id") % 2 == 0, F.concat(F.lit("@"), c("path"))).otherwise(c("path"))))
simple("x13_display_id", "candidates", "candidate_id", "'F-' || lpad(cast(cast('0x' || substr(sha256(candidate_id), 1, 15) as bigint) % 1000000000000 as varchar), 12, '0')", lambda: S.display_id(F.sha2("candidate_id", 256)))
simple("x14_record_name", "candidates", "candidate_id", "sha256(candidate_id || chr(0) || coalesce(status, '') || chr(0) || cast(ord as varchar))", lambda: S.record_name(c("candidate_id"), c("status"), c("ord")))
simple("x15_version", "customer", "c_custkey", "c_nationkey > 3 or (c_nationkey = 3 and c_custkey % 10 >= 4)", lambda: S.version_at_least(F.concat_ws(".", c("c_nationkey").cast("string"), (c("c_custkey") % 10).cast("string"), F.lit("0")), (3, 4, 0)))
simple("x18_packet_id", "candidates", "candidate_id", "substr(sha256('salt:run:' || candidate_id || ':' || coalesce(target, '')), 1, 24)", lambda: F.substring(F.sha2(F.concat(F.lit("salt:run:"), c("candidate_id"), F.lit(":"), F.coalesce("target", F.lit(""))), 256), 1, 24))
simple("x19_callee_match", "files", "file_id", "path like '%.ts' or ends_with(path, '/none')", lambda: c("path").endswith(".ts") | c("path").endswith("/none"))
simple("x22_tainted_overlap", "part", "p_partkey", "len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'steel'])) > 0", lambda: F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("steel"))))
simple("x23_source_patterns", "documents", "doc_id", f"regexp_matches(text, '{'|'.join(X.SOURCE_EXPRESSIONS)}')", lambda: X.is_source_expression(c("text")))
simple("x25_path_line", "files", "file_id", "path || ':' || cast(loc as varchar)", lambda: F.concat_ws(":", F.regexp_extract(F.concat(c("path"), F.lit(":"), c("loc").cast("string"), F.lit(" x")), "^(.*):([0-9]+) ", 1), F.regexp_extract(F.concat(c("path"), F.lit(":"), c("loc").cast("string"), F.lit(" x")), "^(.*):([0-9]+) ", 2)))
simple("x28_signature_seen", "documents", "doc_id", "contains(text, 'License')", lambda: c("text").contains("License"))
simple("x30_redaction", "documents", "doc_id", "sha256(regexp_replace(regexp_replace(text, '(AKIA|ASIA)[A-Z0-9]{16}', '[REDACTED]', 'g'), '(?i)(password[ \\t\\n]*[=:][ \\t\\n]*)[^ \\t\\n\\r\\f\\v]+', '\\1[REDACTED]', 'g'))", lambda: F.sha2(X.redacted(c("text")), 256))
simple("x31_numeric_parse", "events", "event_id", "try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as double)", lambda: F.expr("try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as double)"))
simple("x32_line_count", "documents", "doc_id", "case when text = '' then 0 else cast(len(string_split_regex(text, '\\r\\n|\\r|\\n')) as bigint) - case when regexp_matches(text, '[\\r\\n]$') then 1 else 0 end end", lambda: S.line_count(c("text")))
simple("x33_token_estimate", "files", "file_id", "cast(ceil(bytes / 4e0) as bigint)", lambda: S.estimated_tokens(c("bytes")))
_TIME = "'2024-0' || cast(o_orderkey % 4 as varchar) || '-' || cast(26 + o_orderkey % 7 as varchar) || case o_orderkey % 3 when 0 then 'T' else ' ' end || cast(18 + o_orderkey % 8 as varchar) || ':30:00' || case o_orderkey % 5 when 0 then '' when 1 then 'Z' when 2 then '.25+02:00' when 3 then '-05:30' else '+99:00' end"
_TIME_IS = f"case when regexp_matches(t, '{X.RECORD_TIME}') and try_cast(substr(t, 1, 10) as date) is not null and not ends_with(t, '+99:00') then case when regexp_matches(t, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then t else t || 'Z' end end"


@query("x34_dates", f"with t as (select o_orderkey, {_TIME} as t from orders) select o_orderkey, {_TIME_IS} as out from t")
def x34(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.record_time(F.expr(_TIME.replace("varchar", "string"))).alias("out"))


_FAILURE = "case event_id % 9 when 0 then 'HTTP 429' when 1 then 'Rate limit reached' when 2 then 'socket hang up' when 3 then 'stream failed: disconnect' when 4 then '401 from proxy, network' when 5 then 'Permission denied' when 6 then 'EMFILE' when 7 then null else event_type end"
_CODE = "case when event_id % 11 = 0 then 503 when event_id % 11 = 1 then 500 else null end"


@query("x35_retry", f"""with t as (select event_id, {_FAILURE} as m, {_CODE} as s, case when event_id % 4 = 0 then cast(event_id % 13 as varchar) when event_id % 4 = 1 then 'soon' else null end as h from events),
    p as (select *, coalesce(s in (429, 503, 529), false) or coalesce(regexp_matches(m, '{X.PRESSURE}'), false) as pressure from t)
    select event_id, pressure, not coalesce(regexp_matches(m, '{X.FORBIDDEN}'), false) and (pressure or coalesce(regexp_matches(m, '{X.TRANSIENT}'), false)) as retryable, try_cast(h as double) * 1000 as delay_ms from p""")
def x35(spark, d):
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 13).cast("string")).when(F.col("event_id") % 4 == 1, "soon")
    status, message = F.expr(_CODE), F.expr(_FAILURE)
    return table(spark, d, "events").select("event_id", X.pressure(status, message).alias("pressure"), X.retryable(status, message).alias("retryable"), X.retry_delay(header, F.col("ts").cast("timestamp")).alias("delay_ms"))


simple("x38_text_search", "part", "p_partkey", "list_contains(string_split(p_name, ' '), 'red') and not list_contains(string_split(p_name, ' '), 'ring')", lambda: X.matches_query(X.search_tokens(c("p_name")), c("p_name"), "red -ring"))
simple("x39_substring_search", "documents", "doc_id", "contains(lower(text), 'license')", lambda: F.lower("text").contains("license"))
simple("x40_dropped_fields", "candidates", "candidate_id", "substr(coalesce(reason, ''), 1, 6)", lambda: F.left(F.coalesce("reason", F.lit("")), F.lit(6)))
simple("x41_text_slice", "documents", "doc_id", "sha256(substr(text, 101, 200))", lambda: F.sha2(F.substring("text", 101, 200), 256))
simple("x42_sections", "documents", "doc_id", "len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''))", lambda: F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")).cast("long"))
simple("x11_normal_forms", "documents", "doc_id", "", lambda: X.nfkc_lower(c("text")))
simple("x16_canonical_json", "events", "event_id", "replace(props, ' ', '')", lambda: X.canonical_json(c("props")))


@query("x36_backoff", f"with {cte('run_events')} select seq, cast(floor(250 * power(2e0, attempt - 1)) as bigint) as delay from run_events")
def x36(spark, d):
    return view(spark, d, "run_events").select("seq", S.backoff(250, F.col("attempt")).alias("delay"))


@query("x43_blind_columns", "select o_orderkey, o_orderdate, o_totalprice from orders")
def x43(spark, d):
    return table(spark, d, "orders").drop("o_custkey", "o_orderstatus", "o_orderpriority")


@query("x46_phase_markers", f"with {cte('run_events')} select run_id, bool_or(type = 'click') as a, bool_or(type = 'signup') as b, bool_or(type = 'purchase') as c, bool_or(type = 'error') as e from run_events group by 1")
def x46(spark, d):
    has = lambda t: F.bool_or(F.col("type") == t)
    return view(spark, d, "run_events").groupBy("run_id").agg(has("click").alias("a"), has("signup").alias("b"), has("purchase").alias("c"), has("error").alias("e"))
