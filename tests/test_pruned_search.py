"""Exact search over pages that bounds skip, and requests over projects, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderlake.operators import pruned_search, retrieval

SCHEMA = "id long, e array<double>"


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        if q is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        found = []
        for i, x in rows:
            if i is None or x is None or len(x) != len(v) or any(y is None or not np.isfinite(y) for y in x):
                continue
            scale = np.linalg.norm(x) * np.linalg.norm(v)
            found.append((round(1.0 if scale == 0 else 1 - float(np.dot(x, v)) / scale, 9), i))
        out |= {(q, rank, i, round(d, 4) + 0.0) for rank, (d, i) in enumerate(sorted(found)[:k], 1)}
    return out


def clustered(n, d=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = centres[r.integers(0, 12, n)] + r.normal(size=(n, d)) * 0.05
    return [(k * 3, [float(y) for y in v]) for k, v in enumerate(x)]


@pytest.fixture(scope="module")
def rows():
    found = clustered(3000)
    found += [(9001, found[0][1]), (9000, found[0][1])]  # ties
    found += [(9002, [0.0] * 8), (9003, [0.0] * 8), (9004, None), (None, found[1][1]), (9005, [1.0] * 3), (9006, [float("nan")] * 8), (9007, [None] + [1.0] * 7)]
    return found


@pytest.mark.parametrize("k", [1, 4, 300])
def test_same_as_brute_force(spark, rows, k):
    queries = [(i, v) for i, v in rows[::150]] + [(50_001, [-x for x in rows[5][1]]), (50_002, rows[0][1]), (50_003, [0.0] * 8), (50_004, None), (None, rows[1][1]), (50_005, [1.0] * 3), (50_006, [float("inf")] * 8)]
    paged = pruned_search.page_vectors(spark.createDataFrame(rows, SCHEMA), "id", "e", page_rows=16)
    found, read = pruned_search.search_pages(paged, spark.createDataFrame(queries, "q long, e array<double>"), "q", k, "e")
    want = brute(rows, [q for q in queries if q[0] not in (50_005,)], k)
    assert {(r["q"], r["rank"], r["id"], r["distance"]) for r in found.collect()} == want
    n_read = {r["q"]: r["n_read"] for r in read.collect()}
    assert n_read[50_003] == 0 and paged.n_rows == 3004
    if k < 10:  # a twelfth of the rows is in reach of a query, and pages skip most of these
        near = [n for q, n in n_read.items() if q < 50_000]
        assert np.mean(near) < 0.15 * paged.n_rows


def test_searches_without_rows_or_queries(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "q long, e array<double>")
    found, read = pruned_search.search_pages(pruned_search.page_vectors(none, "id", "e"), queries, "q", 4, "e")
    assert found.collect() == [] and read.collect() == []
    found, read = pruned_search.search_pages(pruned_search.page_vectors(spark.createDataFrame(rows[:40], SCHEMA), "id", "e"), queries.limit(0), "q", 4, "e")
    assert found.collect() == [] and read.collect() == []
    zeros = spark.createDataFrame([(k, [0.0] * 8) for k in (5, 3, 9)], SCHEMA)
    found, _ = pruned_search.search_pages(pruned_search.page_vectors(zeros, "id", "e"), queries, "q", 2, "e")
    assert [(r["rank"], r["id"], r["distance"]) for r in found.orderBy("rank").collect()] == [(1, 3, 1.0), (2, 5, 1.0)]


def test_one_vector_for_a_third_of_the_rows(spark):
    rows = clustered(400, seed=2) + [(10_000 + k, [1.0] + [0.0] * 7) for k in range(200)]
    queries = [(k, [1.0, 0.001 * k] + [0.0] * 6) for k in range(30)]
    paged = pruned_search.page_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "e", page_rows=16)
    found, _ = pruned_search.search_pages(paged, spark.createDataFrame(queries, "q long, e array<double>"), "q", 5, "e")
    assert {(r["q"], r["rank"], r["id"], r["distance"]) for r in found.collect()} == brute(rows, queries, 5)


def test_nulls_take_no_part_in_searches_of_many_queries(spark, rows):
    queries = [(1, rows[0][1]), (2, None), (None, rows[1][1]), (3, [1.0] * 3), (4, [None] * 8)]
    found = retrieval.search_many(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "q long, e array<double>"), "id", "q", 3, "e", block=2)
    assert {(r["q"], r["rank"], r["id"], r["distance"]) for r in found.collect()} == brute(rows, queries, 3)


def test_requests_over_projects(spark):
    chunks = [(p, p * 10 + k, f"f{k}.py", k, k + 1, "Function", f"text {p} {k}", [1.0, float(k)]) for p in (1, 2) for k in range(6)]
    table = spark.createDataFrame(chunks, "project_id long, chunk_key long, filepath string, start_line int, end_line int, symbol_type string, text string, embedding array<double>")
    requests = [(7, 1, "q"), (8, 2, None), (9, 3, "none there"), (None, 1, "q"), (10, None, "q")]
    asked = []

    def embedder(texts):
        if "none there" in texts:
            raise AssertionError("embedded for a project without chunks")
        return np.array([[1.0, 3.0] if t else [1.0, 0.0] for t in texts])

    out = retrieval.retrieve_many(table, spark.createDataFrame(requests, "request_id long, project_id long, query string"), embedder, k=2)
    got = {r["request_id"]: r["context"] for r in out.collect()}
    assert got[7] == retrieval.retrieve_text(table, 1, "q", embedder, k=2) == got[None] and "text 1 3" in got[7]
    assert got[8] == retrieval.retrieve_text(table, 2, "", embedder, k=2) and got[9] == got[10] == "" and not asked
    assert out.filter(F.col("request_id") == 7).count() == 1


@pytest.mark.parametrize("first", [True, False])
def test_visits_are_sent_in_bounded_frames(monkeypatch, first):
    monkeypatch.setattr(pruned_search, "SENT_VISITS", 7, raising=False)
    n = 20
    catalogue = pruned_search._Catalogue(np.arange(n) + 100, np.zeros(n, np.int32), np.zeros(n), np.full(n, 3.0), np.full(n, 5), np.eye(1, 4))
    asked = pd.DataFrame({"query": range(9), "e": [np.eye(4)[k % 4].tobytes() for k in range(9)], "worst": 3.2})
    sent = list(pruned_search._to_pages(catalogue, 4, first)(iter([asked, asked.iloc[:0]])))
    assert max(map(len, sent)) <= 7
    every = pd.concat(sent)
    assert len(every.drop_duplicates(["page", "query"])) == len(every) == 9 * (1 if first else n - 1)
    assert all(e == asked["e"][q] for q, e in zip(every["query"], every["e"], strict=True))
