"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal

import pytest

from scriptorium.plans import registry


def cell(x):
    if x is None or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    return repr(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["build_prompt", "context_assembly", "fuzzy_verify", "rerank"])
def test_hits_are_found_once_and_shuffle_no_texts(name, spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")  # less than the documents
    try:
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
