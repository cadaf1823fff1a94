"""Contains-search by an index against the scan."""

from __future__ import annotations

from collections import Counter

import pytest

from cinderlake.operators import relational, trigram_search

ROWS = [
    (1, "Alpha ring", "Brand#12", 0), (2, "alpharing beta", None, 0), (3, None, "BRAND#13", 0), (3, "ring", "brand#13", 1), (None, "Ring of null keys", "brand#1", 0),
    (None, "nothing", "", 0), (4, "", "", 0), (5, "ri", "ng", 0), (6, "rin ing gri", "and#1 bra", 0), (7, "ähnlich Ünger ring", "x", 0), (8, "x" * 5000 + "ring" + "y" * 5000, "brand#1", 0), (8, "x" * 5000 + "ring" + "y" * 5000, "brand#1", 0),
]


@pytest.mark.parametrize("terms", ["ring", "RING brand#1", "ri", "ring ri", "", "  ", "ünger", "absent", "brand#13 zz", "xxxxxring", "ring ring", "aaa bbb"])
def test_index_finds_what_the_scan_finds(spark, terms):
    rows = spark.createDataFrame(ROWS, "id long, name string, brand string, key int").repartition(3)  # a column named as the index's own
    index = trigram_search.build_index(rows, "id", "name", "brand")
    got = trigram_search.search_indexed(rows, index, terms)
    assert got.columns == rows.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, relational.search(rows, terms, "name", "brand").collect()))


def test_index_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "id long, name string")
    assert trigram_search.search_indexed(rows, trigram_search.build_index(rows, "id", "name"), "ring").count() == 0


def test_few_rows_are_read_for_a_rare_term(spark):
    rows = spark.range(5_000).selectExpr("id", "concat('item number ', id, if(id % 500 = 7, ' with zirconia', '')) as name")
    index = trigram_search.build_index(rows, "id", "name")
    read, found = trigram_search.candidates(rows, index, "item zirconia"), trigram_search.search_indexed(rows, index, "item zirconia")
    assert read.count() == found.count() == 10
    assert trigram_search.candidates(rows, index, "number 7").count() == 5_000  # a short term rules nothing out


def test_texts_are_read_once_for_an_index(spark):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = spark.range(0, 600, 1, 3).selectExpr("id", "concat('item number ', id) as name").mapInPandas(count, "id long, name string")
    trigram_search.build_index(rows, "id", "name")
    assert read.value == 600
