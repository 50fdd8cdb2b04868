"""Views of the driver's tables as the relations that the operators work on.

Each view's expressions are SQL that Spark and DuckDB read alike, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "candidates": (
        "events",
        {
            "candidate_id": "cast(event_id as string)",
            "ord": "event_id",
            "remediation_key": "case when event_id % 7 = 0 then '' else 'k' || regexp_extract(props, '([0-9]+)', 1) end",
            "root_cause_location": "case when event_id % 5 = 0 then null else 'u' || cast(user_id as string) end",
            "status": "case event_type when 'click' then 'CONFIRMED' when 'signup' then ' pending-external' when 'purchase' then 'downgraded' when 'error' then 'false positive' else null end",
            "severity": "case when value >= 60 then 'critical' when value >= 30 then 'High' when value >= 15 then ' medium' when value >= 5 then 'LOW' when value >= 2 then 'structural' else '' end",
            "score_included": "case when event_id % 11 = 0 then false when event_id % 13 = 0 then null else true end",
            "evidence": "case when event_id % 3 = 0 then '' else 'e' || cast(event_id as string) end",
            "reason": "case when event_id % 4 = 0 then '  ' when event_id % 4 = 1 then 'because' else null end",
            "folded_into": "case when event_id % 17 = 0 then cast(event_id - 1 as string) else null end",
            "target": "case when event_id % 10 = 0 then null else 't' || cast(event_id % 97 as string) end",
            "route": "case when event_id % 6 = 0 then null else 'r' || cast(event_id % 53 as string) end",
            "needs_test": "event_id % 2 = 0",
            "cvss": "least(value, 100) / 10",
        },
    ),
    "classifications": (
        "events",
        {
            "candidate_id": "cast(event_id * 2 as string)",
            "status": "case when event_id % 3 = 0 then 'CONFIRMED' when event_id % 3 = 1 then '' else null end",
            "severity": "case when event_id % 4 = 0 then 'LOW' else null end",
            "evidence": "case when event_id % 5 = 0 then 'c' || cast(event_id as string) else '' end",
        },
    ),
    "run_events": (
        "events",
        {
            "run_id": "user_id",
            "seq": "event_id",
            "ts": "ts",
            "type": "event_type",
            "value": "value",
            "attempt": "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 5",
            "phase": "'p' || cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 7 as string)",
        },
    ),
    "files": (
        "part",
        {
            "path": "lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as string) || case p_size % 8 when 0 then '.ts' when 1 then '.py' when 2 then '.go' when 3 then '.rs' when 4 then '.md' when 5 then '.lock' when 6 then '.tf' else '.js' end",
            "unit": "p_brand",
            "bytes": "cast(p_size as bigint) * 997 + p_partkey",
            "loc": "cast(p_size as bigint) * 13",
            "file_id": "p_partkey",
        },
    ),
    "ranges": ("lineitem", {"path": "l_orderkey", "start": "cast(l_linenumber as bigint) * 12", "stop": "cast(l_linenumber as bigint) * 12 + cast(l_quantity as bigint)", "part": "l_partkey"}),
    "edges": ("lineitem", {"src": "l_suppkey", "dst": "l_partkey % 100", "flag": "l_returnflag", "ord": "l_orderkey * 10 + l_linenumber"}),
    "revisions": ("orders", {"cve_id": "o_custkey", "revision": "o_orderkey", "modified": "o_orderdate", "state": "o_orderstatus", "title": "o_orderpriority", "amount": "o_totalprice"}),
    "observations": (
        "lineitem",
        {"case_id": "l_partkey % 200", "repetition": "l_orderkey % 5", "arm": "l_returnflag", "value": "l_discount", "fpr": "l_tax", "gate": "l_linenumber % 7", "corpus": "l_suppkey % 3", "evidence": "1 - l_tax / 2"},
    ),
    "revised": (
        "documents",
        {
            "doc_id": "doc_id",
            "before": "text",
            "after": "case doc_id % 5 when 0 then text when 1 then replace(text, chr(10), chr(13) || chr(10)) when 2 then text || chr(10) when 3 then replace(text, 'e', 'o') else substr(text, 1, 400) end",
            "line_from": "1 + doc_id % 3",
            "line_to": "1 + doc_id % 3 + doc_id % 2",
        },
    ),
    "predictions": (
        "labels",
        {"prediction_id": "doc_id", "truth": "toxic", "decided": "case when doc_id % 9 = 0 then 1 - toxic else toxic end", "severity": "cast(quality as int) + cast(doc_id % 3 as int)", "expected": "cast(quality as int) + 1", "valid": "doc_id % 10 <> 0"},
    ),
}


#: Whose turn it is of the four languages: keys that differ by a multiple of twelve have the same one, and the same repository.
_TURN = "cast(floor(p_partkey / 3) as bigint) % 4"
_SIXTY = "cast(floor(p_partkey / 60) as bigint)"


def _place(n: int, between: str = "/") -> str:
    """Folder and name of the source n keys further on."""
    return f"'d' || cast((p_partkey + {n}) % 5 as string) || '{between}m' || cast(p_partkey + {n} as string)"


def _source_path() -> str:
    last = lambda rest, one, other: f"case when p_partkey % 10 = {rest} then '{one}' else '{other}' end"
    return f"""case when p_partkey in (3, 4) then 'pkg/__init__.py' when {_TURN} = 0 then 'src/' || {_place(0)} || {last(0, "/index.js", ".ts")}
      when {_TURN} = 1 then 'pkg/' || {_place(0)} || {last(1, "/__init__.py", ".py")} when {_TURN} = 2 then 'src/' || {_place(0)} || {last(2, "/mod.rs", ".rs")}
      else 'svc/p' || cast({_SIXTY} as string) || '/m' || cast(p_partkey as string) || {last(3, "_test.go", ".go")} end"""


def _source_text() -> str:
    script = f"""'import {{ a,' || chr(10) || ' b }} from "../' || {_place(12)} || '";' || chr(10) || 'const c = require( "./m' || cast(p_partkey + 60 as string) || '" );' || chr(10)
      || 'const d = import("@lib/' || {_place(24)} || '");' || chr(10) || 'export * from "kit/' || {_place(60)} || '";' || chr(10)
      || 'import "left-pad"; import k from "kit"; import l from "kit/built"; require("left-pad")'"""
    python = f"""'from ..' || {_place(12, ".")} || ' import f' || chr(10) || '  import pkg.' || {_place(60, ".")} || chr(10) || 'import os'"""
    rust = f"""'use crate::' || {_place(12, "::")} || '::Thing;' || chr(10) || 'use super::{{m' || cast(p_partkey + 60 as string) || ' as z, nothing}};' || chr(10)
      || 'use std::fmt;' || chr(10) || '  mod m' || cast(p_partkey + 60 as string) || ' ;'"""
    go = f"""'import (' || chr(10) || ' "fmt"' || chr(10) || ' z "example.com/r/svc/p' || cast({_SIXTY} + 1 as string) || '"' || chr(10) || ')' || chr(10) || 'import root "example.com/r"'"""
    return f"case {_TURN} when 0 then {script} when 1 then {python} when 2 then {rust} else {go} end"


#: Parts as source files of three repositories in four languages, which import one another.
VIEWS["sources"] = ("part", {"repo": "'r' || cast(p_partkey % 3 as string)", "k": "p_partkey", "path": _source_path(), "text": _source_text()})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} as `{c}`" for c, e in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """The views as common table expressions."""
    return ", ".join(f"{n} as (select {', '.join(f'{e} as {c}' for c, e in VIEWS[n][1].items())} from {VIEWS[n][0]})" for n in names)
