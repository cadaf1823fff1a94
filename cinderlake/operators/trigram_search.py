"""Contains-search by an index: rows are looked up by rare runs of three characters and only those found are read for terms.

Postings are rows (gram, key), one for each distinct gram of a row of the table, dealt by hashes of gram and of a
share of the keys, so that rows are read once (ranges would take a sample of them first): a gram that most rows hold lies
in SHARES files, which are in the order of grams, and a lookup skips the row groups and pages of other grams. A gram is
its 64-bit hash, which sorts faster than text; grams of one hash only make more candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .relational import search

GRAM = 3
#: Files that a gram may lie in.
SHARES = 64
#: Grams that are looked up for a term, the rarest ones; and in all, as each has a bit of a long.
PER_TERM, MOST = 3, 60


@dataclass
class TrigramIndex:
    postings: DataFrame  # gram (hash), key
    frequencies: DataFrame  # gram (hash), n
    key: str
    columns: tuple[str, ...]


def grams(value: Column) -> Column:
    """The distinct runs of three characters of the lower-cased value; shorter and null values have none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(value), F.lit("")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))  # one pass, whatever the length


def build_index(rows: DataFrame, key: str, *columns: str) -> TrigramIndex:
    """An index of the columns, written to the shared folder.

    Rows with one key are looked up together, null keys too. Null and short values have no grams.
    """
    each = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*(grams(F.col(c)) for c in columns))))).alias("gram"))
    hashed = each.select(F.xxhash64("gram").alias("gram"), "key")
    postings = materialize(hashed.repartition("gram", F.pmod(F.xxhash64("key"), F.lit(SHARES))).sortWithinPartitions("gram"), "postings")
    return TrigramIndex(postings, materialize(postings.groupBy("gram").agg(F.count("*").alias("n")), "frequencies"), key, columns)


def _looked_up(index: TrigramIndex, terms: list[str]) -> list[int] | None:
    """The grams to look up, as hashes, or None if one of the terms' grams is in no row."""
    of_term = [{t[k : k + GRAM] for k in range(len(t) - GRAM + 1)} for t in terms]
    every = sorted(set().union(*of_term))
    hashes = index.postings.sparkSession.range(1).select(F.array(*(F.xxhash64(F.lit(g)) for g in every))).first()[0]
    hash_of = dict(zip(every, hashes, strict=True))
    of_term = [{hash_of[g] for g in grams} for grams in of_term]
    wanted = sorted(set().union(*of_term))
    n = {r["gram"]: r["n"] for r in index.frequencies.filter(F.col("gram").isin(wanted)).collect()}  # no more than the terms have
    if len(n) < len(wanted):
        return None
    rare = lambda found: sorted(found, key=lambda g: (n[g], g))
    return rare(set().union(*(rare(g)[:PER_TERM] for g in of_term)))[:MOST]


def candidates(rows: DataFrame, index: TrigramIndex, terms: str) -> DataFrame:
    """The rows that may hold every term: those whose key has the rarest grams of all terms.

    Terms shorter than a gram rule nothing out; where all are, these are all rows.
    """
    long = [t for t in terms.lower().split() if len(t) >= GRAM]
    if not long:
        return rows
    chosen = _looked_up(index, long)
    if chosen is None:
        return rows.limit(0)
    bit = reduce(lambda c, k: c.when(F.col("gram") == chosen[k], F.lit(1 << k)), range(1, len(chosen)), F.when(F.col("gram") == chosen[0], F.lit(1)))
    seen = index.postings.filter(F.col("gram").isin(chosen)).groupBy("key").agg(F.bit_or(bit.cast("long")).alias("bits"))
    keys = seen.filter(F.col("bits") == (1 << len(chosen)) - 1).select(F.col("key").alias("__key"))
    return rows.join(keys, rows[index.key].eqNullSafe(F.col("__key")), "left_semi")


def search_indexed(rows: DataFrame, index: TrigramIndex, terms: str) -> DataFrame:
    """The rows that ``search`` finds over the index's columns; only candidates are read for the terms."""
    return search(candidates(rows, index, terms), terms, *index.columns)
