"""SimHash near-dedup at a similarity that no short radius of fingerprints reaches: Jaccard 4/5 of word shingles.

A document becomes its set of shingles, the set's SimHash fingerprint and a table of the fingerprint's
distances to pivots. Documents with equal sets collapse to one class. Blocks of bits cannot hold a radius
as wide as this similarity needs, so pairs meet at rare shingles instead: shingles are ordered from rare to
common by a table of counters of fixed size, and a pair with similarity of 4/5 or more shares a shingle
among the first n - ceil(4n/5) + 1 of its larger set and the first n - ceil(8n/9) + 1 of its smaller one. So only
the latter are an index, that larger sets look into: a shingle that texts of one template share is in no
index once they have a few of their own. Where a pair meets, its sizes and places bound what else it can
share, its pivot distances and then its fingerprints may not differ by more than RADIUS, and what survives
is verified on the whole sets, as 64-bit hashes of shingles.

At 4/5 a bit of two fingerprints differs with a probability of about 0.15, so that more than RADIUS of 512 bits
do for less than one pair in a million; sets under SMALL shingles, where majorities are less even, are not
held to it.

The first rounds compare each row only with the first row of its shingle, and then with its neighbour in a
hashed order too, which joins large groups in a number of comparisons that grows with their rows; then every
pair that still lies in two components is compared, those with the nearest fingerprints first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .simhash import SEED, components, majority

SHINGLE_WORDS = 5
#: Counters of shingles, and the rows they are added up in.
CELLS, RANGES = 1 << 18, 64
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 20
#: Longs of a fingerprint, bits that those of a pair may differ in, and the size of a set below which they are not asked.
LONGS, RADIUS, SMALL = 8, 120, 64
N_PIVOTS = 16
#: Rounds against neighbours, and radii in which pairs of different components are compared one after the other.
TURNS, RADII = 2, (84, RADIUS)
#: Up to so many ids (16 bytes each) are sent to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 5)
        return h


def shingle_set(text: str, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased text; fewer words than a shingle has make one."""
    words = text.encode().split()  # at the blanks of WORD, which are those of ASCII
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE_WORDS + 1) if words else 0
    key = np.full(n, 1, np.uint64)
    for k in range(min(SHINGLE_WORDS, len(words))):
        key = key * np.uint64(0x9E3779B97F4A7C15) + found[k : k + n]
        key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def wide_fingerprint(keys: np.ndarray) -> np.ndarray:
    """SimHash of LONGS * 64 bits of a set of shingle hashes, each long by another mix of them."""
    out = np.empty(LONGS, np.uint64)
    for k in range(LONGS):
        mixed = (keys ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = majority(mixed ^ mixed >> np.uint64(32))
    return out


def _pivots() -> np.ndarray:
    """Reference fingerprints: the words of a fixed random sequence."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (N_PIVOTS, LONGS), np.uint64, endpoint=False)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(46)).astype(np.int64)


def _frequencies(rows: DataFrame) -> np.ndarray:
    """For each cell a coarse logarithm of how many documents' shingles fall there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Hashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, _cell(shingle_set(text, hashes)), 1)
        parts = [p.tobytes() for p in counts.reshape(RANGES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["range", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame({"range": frame["range"].iloc[:1], "counts": [total.tobytes()]})

    found = rows.select("text").mapInArrow(count, "range int, counts binary").groupBy("range").applyInPandas(add, "range int, counts binary")
    total = np.zeros((RANGES, CELLS // RANGES), np.int64)
    for r in found.collect():  # CELLS counters on any corpus
        total[r["range"]] = np.frombuffer(r["counts"], np.int64)
    return np.floor(16 * np.log2(total.ravel() + 1.0)).astype(np.uint16)


def _prefixes(rows: DataFrame, frequency: np.ndarray) -> DataFrame:
    """id, n (shingles), set_key (hash of all shingles), fp (SimHash), pivot distances, prefix (the rarest shingles, in order) of rows (id, text)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, references = _Hashes(), _pivots()
        for batch in batches:
            sizes, keys, firsts, fps = [], [], [], []
            for text in batch.column("text").to_pylist():
                keys_ = shingle_set(text, hashes)
                n = len(keys_)
                order = np.argsort(frequency[_cell(keys_)], kind="stable")[: n - -(-4 * n // 5) + 1]
                sizes.append(n)
                keys.append(xxhash.xxh128_digest(keys_.tobytes()))
                firsts.append(keys_[order].view(np.int64))
                fps.append(wide_fingerprint(keys_))
            fp = np.array(fps, np.uint64).reshape(-1, LONGS)
            table = np.bitwise_count(fp[:, None, :] ^ references[None]).sum(axis=2, dtype=np.int16)
            rows_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), rows_of(fp.view(np.int64)), rows_of(table), lists], names=["id", "n", "set_key", "fp", "distances", "prefix"])

    return rows.mapInArrow(prefixes, "id long, n int, set_key binary, fp array<long>, distances array<smallint>, prefix array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = [shingle_set(t, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(sets, "id long, shingles binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(9 * both >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be sent to whatever they are joined to if their checked number allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) with similarity of 4/5 or more, by the sets of rows (id, text)."""
    ids = materialize(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "wanted")
    sets = materialize(_sets(rows.join(_few(ids), "id", "left_semi")), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialize(found.mapInArrow(_similar, "a long, b long"), "similar")


def _can_be_similar(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether sets of these sizes, that meet first at these places, can have similarity of 4/5 or more."""
    sizes = (5 * F.least(n, other_n)) >= 4 * F.greatest(n, other_n)
    return sizes & (9 * F.least(n - pos, other_n - other_pos) >= 4 * (n + other_n))


def _indexed(n: Column, pos: Column) -> Column:
    """Whether a place is among the first that a set shares one of with every set as large or larger that is similar to it."""
    return pos <= n - F.ceil(8 * n / 9)


def _near(fp: Column, distances: Column, n: Column, other_fp: Column, other_distances: Column, other_n: Column, radius: int) -> Column:
    """Whether neither a pivot nor the fingerprints themselves tell a pair apart by more than radius."""
    by_pivots = F.forall(F.zip_with(distances, other_distances, lambda x, y: F.abs(x - y)), lambda d: d <= radius)
    bits = [F.bit_count(F.get(fp, F.lit(k)).bitwiseXOR(F.get(other_fp, F.lit(k)))) for k in range(LONGS)]
    return ((F.least(n, other_n) < SMALL) & F.lit(radius == RADIUS)) | ((sum(bits[1:], bits[0]) <= radius) & by_pivots)


_ROW = ("id", "n", "pos", "root", "fp", "distances")


def _survives(other: str, radius: int = RADIUS) -> Column:
    """Whether a row and the other, whose columns have this prefix, may be similar."""
    o = {c: F.col(f"{other}{c}") for c in _ROW}
    return _can_be_similar(F.col("n"), F.col("pos"), o["n"], o["pos"]) & _near(F.col("fp"), F.col("distances"), F.col("n"), o["fp"], o["distances"], o["n"], radius)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()


def _neighbours(rows: DataFrame, *order: Column, before: bool = True) -> DataFrame:
    """Pairs of each row with the first row of its shingle, and with the row before it, if those are in other components."""
    by = Window.partitionBy("token").orderBy(*order)
    me = F.struct(*_ROW)
    others = F.array(F.first(me).over(by), *([F.lag(me).over(by)] if before else []))
    near = rows.select(*_ROW, others.alias("others")).select(*_ROW, F.explode("others").alias("o")).filter("o is not null and o.root <> root")
    return _pairs(near.filter(_survives("o.")).withColumn("other", F.col("o.id")), "id", "other")


def _rooted(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of shared at shingles where more than one component meets, with their components."""
    roots = materialize(components(links), "roots")
    rows = shared.join(roots, shared["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    rows = materialize(rows, "rooted")
    several = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    return materialize(rows.join(several, "token", "left_semi"), "open")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) for every id of docs that reaches a smaller one over pairs with similarity of 4/5 or more.

    Null texts count as empty, and texts without words are alike. Rows with null ids take no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("text")).filter("id is not null")
    marked = materialize(_prefixes(rows, _frequencies(rows)), "prefixes")
    classes = materialize(marked.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "classes")
    copies = materialize(marked.select("id", "set_key").join(classes, "set_key").filter("id <> rep").distinct(), "copies")
    links = copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = marked.join(_few(copies.select("id", "set_key")), ["id", "set_key"], "left_anti")
    spread = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    by = Window.partitionBy("token").orderBy("id")
    met = spread.withColumns({"before": F.lag("id").over(by), "after": F.lead("id").over(by)}).filter("before is not null or after is not null")
    met = materialize(met.select("token", "id", "n", "pos"), "met")
    shared = met.join(met.filter(_indexed(F.col("n"), F.col("pos"))).select("token").distinct(), "token", "left_semi")
    shared = materialize(shared.join(reps.select("id", "fp", "distances").dropDuplicates(["id", "fp"]), "id"), "shared")

    tried = materialize(_neighbours(shared.withColumn("root", F.col("id")), F.element_at("distances", 1), F.col("id"), before=False), "pairs")
    links = links.union(_verified(tried, rows))
    for turn in range(TURNS):  # in one order for all shingles, so that the same rows are neighbours at most of those they share
        more = _neighbours(_rooted(shared, links), F.xxhash64("id", F.lit(turn)), F.col("id"))
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = links.union(_verified(more, rows)), tried.union(more)
    for radius in RADII:  # the nearest first: what they join is not compared again
        left = _rooted(shared, links)
        right = left.select("token", *(F.col(c).alias(f"other_{c}") for c in _ROW))
        smaller = F.struct("n", "id") < F.struct("other_n", "other_id")
        meet = left.filter(_indexed(F.col("n"), F.col("pos"))).join(right, "token").filter(smaller & (F.col("root") != F.col("other_root")) & _survives("other_", radius))
        more = materialize(_pairs(meet, "id", "other_id").join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = links.union(_verified(more, rows)), tried.union(more)
    return components(links)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all columns.

    Rows with null ids, which cannot be told apart, all stay. Repeated rows with the id that stays all
    stay, as they are the same document.
    """
    gone = similar_components(docs, id_col, text_col).filter("root < node").select(F.col("node").alias("gone_id"))
    return docs.join(_few(materialize(gone, "near-copies")), F.col(id_col) == F.col("gone_id"), "left_anti")
