"""Every registered query of the reference's operators against its SQL."""

from __future__ import annotations

import os
from collections import Counter
from contextlib import nullcontext

import duckdb
import pytest

import __spark_entry__
from cinderlake import plans

LISTED = plans.oracle_sql()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(LISTED))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(LISTED[name])
    columns = [c[0] for c in want.description]
    got = plans.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(map(plain, r)) for r in want.fetchall()) == Counter(tuple(map(plain, r)) for r in got.select(columns).collect())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["vec_id", "label", "distance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_survive_a_missing_dependency(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "cinderlake.llm.queries", None)
    monkeypatch.setitem(sys.modules, "cinderlake.llm", None)
    with pytest.warns(UserWarning) if __spark_entry__.has_training_data() else nullcontext():
        assert set(__spark_entry__.queries()) == set(plans.queries())


def test_embedding_is_of_unit_length(spark, sf_dir):
    rows = plans.queries()["embed_documents"](spark, sf_dir).collect()
    assert {r["dimensions"] for r in rows} == {768} and {r["length"] for r in rows} <= {0.0, 1.0}
