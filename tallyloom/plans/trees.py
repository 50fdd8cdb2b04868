"""Queries of file trees and ledgers (S01, S02, S03, S07 to S10): documents are written as a tree of files, conversations as ledgers, and read by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators.graphs import shared_folder
from tallyloom.plans.bindings import table
from tallyloom.plans.registry import query
from tallyloom.sources import ledgers as L
from tallyloom.sources import trees as T

_cases = lambda of, values, other=None: f"case {of} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + (f" else {other}" if other else "") + " end"
_quoted = lambda *values: [f"'{v}'" for v in values]

_TOP = _cases("doc_id % 10", _quoted("src/", "lib/core/", "node_modules/x/", "k8s/", "docs/", "tests/unit/", ".github/workflows/", "infra/templates/", "dist/", "app/roles/web/tasks/"))
_EXT = _cases("doc_id % 13", _quoted(".ts", ".py", ".go", ".md", ".yaml", ".yml", ".json", ".tf", ".js", ".png", ".lock", ".sh", ".txt"))
_NAME = _cases("doc_id % 17", _quoted("package.json", "Dockerfile", "App.csproj", "Chart.yaml", ".env.local", "docker-compose.yml", "x.test.js", "registry.json", "compose.prod.yaml"), f"'f' || {_EXT}")
_PATH = f"{_TOP} || 'd' || cast(doc_id as string) || '/' || {_NAME}"
_NL = "chr(10)"
_KEYS = f"case doc_id % 6 when 0 then 'apiVersion: v1' || {_NL} || 'kind: Pod' || {_NL} when 2 then 'hosts: all' || {_NL} || 'tasks: []' || {_NL} else '' end"
_YAML = f"case when doc_id % 7 = 0 then 'k: [1' else {_KEYS} || 'k: ' || cast(doc_id as string) || {_NL} || 't:' || {_NL} || '  - a' || {_NL} end"
_JSON = "case when doc_id % 7 = 0 then '{\"k\": ' else '{' || case doc_id % 6 when 1 then '\"Type\": \"AWS::S3\", ' when 3 then '\"apiVersion\": \"v1\", \"kind\": \"Pod\", ' else '' end || '\"k\": ' || cast(doc_id as string) || '}' end"
_FILES = f"(select doc_id, path, case when ends_with(path, '.json') then {_JSON} when ends_with(path, '.yaml') or ends_with(path, '.yml') then {_YAML} else coalesce(text, '') end as content from (select *, {_PATH} as path from documents) as p)"
_SKIP = "regexp_matches(path, '(^|/)(node_modules|dist)/')"
_roots: dict[tuple[str, str], str] = {}


def written(spark, d) -> str:
    """The root of the documents' tree, written once a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _roots:
        root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex[:12]}"
        docs = table(spark, d, "documents").withColumn("path", F.expr(_PATH))
        content = F.expr(f"case when endswith(path, '.json') then {_JSON} when endswith(path, '.yaml') or endswith(path, '.yml') then {_YAML} else coalesce(text, '') end")
        T.write_tree(docs.select("path", F.encode(content, "UTF-8").alias("content")), root)
        _roots[at] = root
    return _roots[at]


_EXTENSIONS = (".ts", ".py", ".go", ".js")


@query("s01_tree_sources", f"with f as {_FILES} select path from f where not {_SKIP} and regexp_matches(path, '[^/]\\.(ts|py|go|js)$')")
def s01_tree(spark, d):
    return T.source_files(T.tree(spark, written(spark, d)), _EXTENSIONS)


@query("s02_tree_dependencies", f"with f as {_FILES} select path from f where not {_SKIP} and regexp_matches(path, '(/package\\.json|\\.csproj)$')")
def s02_tree(spark, d):
    return T.dependency_files(T.tree(spark, written(spark, d)))


@query("s03_tree_inventory", f"""with f as {_FILES}, k as (select path, case when regexp_matches(path, '(/package\\.json|\\.csproj)$') then 'dependency-manifest' when regexp_matches(path, '[^/]\\.(ts|py|go|js)$') then 'source'
        when regexp_matches(path, '(?i)/(dockerfile|(docker-)?compose(\\..+)?\\.ya?ml|\\.env\\.[a-z]+|[^/]+\\.(sh|tf))$') then 'security-resource' when ends_with(path, '/registry.json') then 'generated-runtime-resource'
        when regexp_matches(path, '(^|/)\\.github/(.*/)?workflows/.*\\.ya?ml$') then 'security-resource' when starts_with(path, 'tests/') then 'test' when regexp_matches(path, '[^/]\\.(md|txt)$') then 'documentation' when ends_with(path, '.png') then 'asset' else 'other' end as classification
        from f where not {_SKIP})
    select path, classification, case classification when 'dependency-manifest' then 'analyze-dependency' when 'source' then 'analyze-source' when 'security-resource' then 'analyze-security-resource'
        when 'generated-runtime-resource' then 'analyze-security-resource' else 'inventory-only' end as disposition from k""")
def s03_tree(spark, d):
    return T.inventory(T.tree(spark, written(spark, d)), _EXTENSIONS)


@query("s07_tree_iac", f"""with f as {_FILES}, h as (select path, content, left(content, 65536) as head, lower(path) as low from f where not {_SKIP}),
    k as (select path, content, case when ends_with(low, '/dockerfile') then 'container' when starts_with(low, '.github/workflows/') then 'ci-cd' when ends_with(low, '.tf') then 'terraform'
        when contains(head, 'AWSTemplateFormatVersion') or regexp_matches(head, '"Type"\\s*:\\s*"AWS::') then 'cloudformation' when ends_with(low, '/chart.yaml') or (contains(low, '/templates/') and regexp_matches(low, '\\.ya?ml$')) then 'helm'
        when regexp_matches(low, '\\.ya?ml$') and (starts_with(low, 'k8s/') or (contains(head, 'apiVersion:') and contains(head, 'kind:'))) then 'kubernetes'
        when ends_with(low, '.json') and contains(head, '"apiVersion":') and contains(head, '"kind":') then 'kubernetes'
        when regexp_matches(low, '\\.ya?ml$') and (contains(low, '/roles/web/tasks/') or (contains(head, 'hosts:') and contains(head, 'tasks:'))) then 'ansible'
        when regexp_matches(low, '/(docker-)?compose(\\.[^.]+)?\\.ya?ml$') then 'deployment' end as classification from h)
    select path, classification, strlen(content) as bytes, sha256(content) as sha256 from k where classification is not null""")
def s07_tree(spark, d):
    return T.iac_manifest(spark, written(spark, d))[0]


@query("s07_tree_excluded", f"with f as {_FILES}, x as (select distinct regexp_extract(path, '^(.*?(node_modules|dist))/', 1) as path from f where {_SKIP}) select path, 'excluded-directory' as reason from x")
def s07_excluded(spark, d):
    """What the scan passed over."""
    return T.iac_manifest(spark, written(spark, d))[1]


@query("s08_tree_structured", f"""with f as {_FILES} select path, case when ends_with(path, '.json') then 'json' else 'yaml' end as format,
    case when doc_id % 7 = 0 then null when ends_with(path, '.json') then '{{' || case doc_id % 6 when 1 then '"Type":"AWS::S3",' when 3 then '"apiVersion":"v1",' else '' end || '"k":' || doc_id || case doc_id % 6 when 3 then ',"kind":"Pod"' else '' end || '}}'
        else '{{' || case doc_id % 6 when 0 then '"apiVersion":"v1",' when 2 then '"hosts":"all",' else '' end || '"k":' || doc_id || case doc_id % 6 when 0 then ',"kind":"Pod"' else '' end || ',"t":["a"]' || case doc_id % 6 when 2 then ',"tasks":[]' else '' end || '}}' end as value,
    doc_id % 7 = 0 as bad from f where not {_SKIP} and regexp_matches(path, '\\.(json|ya?ml)$')""")
def s08_tree(spark, d):
    documents = T.tree(spark, written(spark, d), "whole").where(T.extension().isin(".json", ".yaml", ".yml"))
    return T.read_structured(documents).select("path", "format", "value", F.col("error").isNotNull().alias("bad"))


@query("s09_torn_ledgers", "with n as (select conv_id, count(*) as turns from conversations group by 1) select 'c' || conv_id || '.jsonl' as file, turns - case when conv_id % 3 = 0 then 1 else 0 end as good, case when conv_id % 3 = 0 then 1 else 0 end as torn, cast(0 as bigint) as bad from n")
def s09_torn(spark, d):
    """Each conversation as a ledger of its turns; every third one ends within its last line."""
    root = f"{shared_folder(spark)}/ledgers-{uuid.uuid4().hex[:12]}"
    line = F.to_json(F.struct("turn", "role", "text"))
    # One conversation's turns are one file, so they are one row here.
    whole = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    files = table(spark, d, "conversations").groupBy("conv_id").agg(whole.alias("whole"))
    cut = F.when(F.col("conv_id") % 3 == 0, F.expr("substring(whole, 1, length(whole) - 4)")).otherwise(F.col("whole"))
    T.write_tree(files.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("path"), F.encode(cut, "UTF-8").alias("content")), root)
    found = L.ledger_lines(spark, root, "turn long, role string, text string")
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return found.groupBy(F.regexp_extract("file", r"([^/]*)\z", 1).alias("file")).agg(n("good"), n("torn"), n("bad"))


@query("s10_appended_batches", "select conv_id, turn, role, text from conversations")
def s10_appended(spark, d):
    """Conversations appended to a ledger by a stream, a batch a file, and read back by its manifests."""
    base = f"{shared_folder(spark)}/appends-{uuid.uuid4().hex[:12]}"
    turns = table(spark, d, "conversations")
    turns.repartition(4, "conv_id").write.parquet(f"{base}/in")
    spark.dataSource.register(L.LedgerSink)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    stream.writeStream.format("ledger").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return L.appended(spark, f"{base}/out", "conv_id long, turn long, role string, text string").drop("_batch")
