"""Queries against their SQL, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tallyloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tiny, name):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = c.execute(ORACLE_SQL[name]).fetchdf()
    got = QUERIES[name](spark, tiny).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_pipeline_stages(spark, tiny):
    from tallyloom.llm.common import documents, staged

    docs = documents(spark, tiny)
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, tiny), name)
        assert docs.columns == names
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now.keys() <= before.keys() and len(now) == docs.count() > 0
        if name != "pseudonyms":
            assert all(before[k] == t for k, t in now.items())
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert {p.doc_id for p in packed} == before.keys()


def test_pipeline_of_odd_rows(spark, tiny, odd, nothing):
    names = ["items", "spans", "n_words", "n_hit", "kinds", "n_pii", "score", "class_id", "n_links", "first", "node", "toxic", "_row_a", "_maybe", "_bucket"]
    docs = odd.selectExpr("*", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == columns
    assert all(r[n] == (f"{n}{r.doc_id}" if r.doc_id else None) for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() >= 8
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0
