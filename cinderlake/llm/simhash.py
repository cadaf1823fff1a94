"""SimHash near-dedup with pivot distance tables.

Documents become 64-bit fingerprints; equal fingerprints collapse to one class first, so copies cost
nothing later. Two fingerprints within d bits agree on at least B - d of B blocks of bits, so each
class goes to one bucket for every choice of B - d blocks, and every linked pair meets in a bucket.
Inside a bucket the Hamming distances to many reference fingerprints are tabulated, rows are sorted by
the first of them, and a pair goes only as far as its coordinates allow: by the triangle inequality no
coordinate of a linked pair differs by more than d. Survivors are verified by their own distance.

Buckets above a limit are split again, by the same choice among the bits that are left: a linked pair
of a bucket still meets in one of its parts. After three levels at most 15 bits are left, so no bucket
holds more than 32,768 classes, whatever the data; no pair is dropped. A bucket gives a spanning forest
of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, materialize, read_table, shuffle_partitions

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: A bucket with more classes is split by its other bits.
SPLIT_ABOVE = 2_000
BLOCKS, LEVELS = 5, 3
N_PIVOTS = 24
#: Hashes of a text are counted in slices of so many.
SLICE = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of lower-cased text over word shingles, each counted as often as it occurs.

    A bit is 1 if set in over half of the shingles' XXH64. Fewer words than a shingle has make one
    shingle; no words give 0.
    """
    words = _WORDS(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    if n == 1:
        shingles: Iterator[str] = iter([" ".join(words)])
    else:
        shingles = map(" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False))
    return majority(np.fromiter((_HASH(s, SEED) for s in shingles), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), SLICE):
        some = np.ascontiguousarray(hashes[start : start + SLICE])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


_WORDS = regex.compile(WORD).findall
_HASH = xxhash.xxh64_intdigest


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id (long), fp (the fingerprint's 64 bits as a long). Null texts count as empty."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t or "", shingle_words) for t in batch.column("text").to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    return rows.mapInArrow(batches_of, "id long, fp long")


# --- buckets ---------------------------------------------------------------------------------


def _masks(bits: list[int]) -> list[int]:
    """The bits each bucket of a level shares: every choice of blocks that a linked pair may agree on."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - MAX_BITS)]


def _expand(fps: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, mask) of each bucket one level below the mask that a row shares so far."""
    rows, masks = [], []
    for mask in np.unique(shared):
        at = np.flatnonzero(shared == mask)
        for extra in _masks([b for b in range(64) if not int(mask) >> b & 1]):
            rows.append(at)
            masks.append(np.full(len(at), int(mask) | extra, np.uint64))
    return np.concatenate(rows), np.concatenate(masks)


def _deal(classes: DataFrame) -> DataFrame:
    """classes (fp, rep, mask) to one row for each bucket of the next level: fp, rep, mask, key."""

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            fps, shared = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("fp", "mask"))
            rows, masks = _expand(fps, shared)
            yield pd.DataFrame({"fp": fps[rows].view(np.int64), "rep": frame["rep"].to_numpy()[rows], "mask": masks.view(np.int64), "key": (fps[rows] & masks).view(np.int64)})

    return classes.mapInPandas(expand, "fp long, rep long, mask long, key long")


def pivots() -> np.ndarray:
    """Reference fingerprints: the words of a fixed random sequence."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, N_PIVOTS, np.uint64, endpoint=False)


def _forest(bucket: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest (from, to the smallest rep reached) within each bucket.

    bucket numbers the buckets of the rows.
    """
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], bucket))
    bucket, fps, reps, table = bucket[order], fps[order], reps[order], table[order]
    by_rep = np.argsort(reps, kind="stable")
    place = np.empty(len(reps), np.int64)
    place[by_rep] = np.arange(len(reps))
    root, here, step = np.arange(len(reps)), np.arange(len(reps)), 1  # root: by place in the order of reps
    while True:
        here = here[here + step < len(fps)]
        there = here + step
        here = here[(bucket[here] == bucket[there]) & (table[there, 0] - table[here, 0] <= MAX_BITS)]
        if not len(here):  # rows are sorted: a row out of reach stays out of reach
            break
        alive = here[root[place[here]] != root[place[here + step]]]
        for k in range(1, N_PIVOTS):
            alive = alive[np.abs(table[alive, k] - table[alive + step, k]) <= MAX_BITS]
        linked = alive[np.bitwise_count(fps[alive] ^ fps[alive + step]) <= MAX_BITS]
        if len(linked):
            root = _joined(root, place[linked], place[linked + step])
        step += 1
    moved = np.flatnonzero(root != np.arange(len(reps)))
    return reps[by_rep[moved]], reps[by_rep[root[moved]]]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after the links a-b: each component points to its first member."""
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _link_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within the buckets of a partition that is sorted by bucket; the last bucket is held back."""
    held = pd.DataFrame()

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        fps, mask, key = (frame[c].to_numpy(np.int64) for c in ("fp", "mask", "key"))
        new = np.ones(len(frame), np.int64)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        bucket = np.cumsum(new)
        shared = np.bincount(bucket)[bucket] > 1
        a, b = _forest(bucket[shared], fps[shared].view(np.uint64), frame["rep"].to_numpy(np.int64)[shared])
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for frame in frames:
        frame = pd.concat([held, frame], ignore_index=True)
        last = (frame["mask"] == frame["mask"].iloc[-1]) & (frame["key"] == frame["key"].iloc[-1]) if len(frame) else []
        if len(frame) and not last.all():
            yield links(frame[~last])
            frame = frame[last]
        held = frame
    if len(held):
        yield links(held)


def linked_classes(classes: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links (a, b with a > b) between classes (fp, rep) within MAX_BITS bits, as spanning forests of buckets."""
    spark = classes.sparkSession
    found: DataFrame | None = None
    rows = classes.select("fp", "rep", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        dealt = _deal(rows)
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialize(sizes.select("mask", "key", (F.col("n") > split_above if level + 1 < LEVELS else F.lit(False)).alias("large")), "buckets")
        shared = materialize(dealt.join(sizes, ["mask", "key"]).select("fp", "rep", "mask", "key", "large"), "dealt")
        small = shared.filter("not large").select("fp", "rep", "mask", "key")
        # Buckets are bounded by split_above, or by the bits left after the last level.
        small = small.repartition(shuffle_partitions(spark), "mask", "key").sortWithinPartitions("mask", "key")
        links = small.mapInPandas(_link_buckets, "a long, b long")
        found = links if found is None else found.unionByName(links)
        rows = shared.filter("large").select("fp", "rep", "mask")
        if rows.isEmpty():
            break
    return found.distinct()


# --- components ------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that reaches a smaller one: the smallest it reaches.

    Large-star and small-star rounds: links move to ever smaller neighbours until every component is
    a star around its smallest node. A round's links are written to the shared folder. Minima are pre-aggregated, and
    the joins that follow read two exchanges, so that a node with very many neighbours is split.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _signature(links)
    while before[0]:
        both = links.union(links.select("b", "a"))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = materialize(large.distinct(), "large-star")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        joined = large.join(lowest, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        links = materialize(small.filter("a <> b").distinct(), "small-star")
        if (after := _signature(links)) == before:
            break
        before = after
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id_col, fp (long), component_id (the smallest id reachable, its own included).

    Fingerprints with MAX_BITS or fewer differing bits are linked. Null texts count as empty, and texts
    without words share fingerprint 0, which links like any other. Rows with null ids link like any others
    but never name a component; one of null ids only has component_id null. Repeated rows get equal
    results; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("id").alias("lowest")), "classes")
    roots = materialize(components(linked_classes(classes.select("fp", F.col("fp").alias("rep")))), "roots")
    rooted = materialize(classes.join(roots, classes["fp"] == roots["node"], "left").select(F.col("fp").alias("class_fp"), "lowest", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = materialize(rooted.join(lowest, "root").select("class_fp", "component_id"), "named-classes")
    out = marked.join(named, marked["fp"] == named["class_fp"])
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all columns.

    Rows with null ids, which cannot be told apart, all stay. Repeated rows with the id that stays all
    stay, as they are the same document.
    """
    found = near_copies(docs, id_col, text_col, shingle_words)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct()
    return docs.join(materialize(gone, "near-copies"), F.col(id_col) == F.col("gone_id"), "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of documents. Null and empty texts have fingerprint zero; see near_copies."""
    out = near_copies(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
