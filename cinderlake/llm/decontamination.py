"""Benchmark decontamination in DataFrame functions only.

Windows of benchmark words become a set of 64-bit hashes that is broadcast to the documents, which look up their
own windows as they are scanned; a hit is verified word by word in the same place. Where a window starts at
any word, a shorter one that it holds starts at a multiple of STRIDE, so these are looked up first, and the
whole windows around them only where they are in the set too. Only hits are shuffled. A set beyond BLOCK_BYTES is cut into blocks by hash, each sent in a scan of its own, so no
broadcast grows with the benchmark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, read_table
from .line_dedup import _let, _without

WINDOW_WORDS = 10
#: Bytes of windows, with their words and the ids of their items, that one broadcast holds.
BLOCK_BYTES = 48 << 20
#: What separates words, in text that is not lower-cased yet.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: str) -> Column:
    """The words as they are written."""
    return F.array_remove(F.split(text, _GAP + "+", -1), "")


def _window(words: str | Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _hash(window: Column) -> Column:
    """The same for all cases of a letter, so only windows that are found have to be lower-cased as is asked for."""
    return F.xxhash64(F.lower(window))


def _stride(size: int) -> int:
    """Steps of the first look; the shorter windows have size - stride + 1 words, so each window holds one that starts at a step."""
    return max(1, size // 2)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and row, a hash of the text: rows that share both have the same hits."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.withColumn("row", F.xxhash64("text"))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW_WORDS) -> DataFrame:
    """The distinct windows of all items: window (words, space-joined), size (words), h (hash of them), items (sorted ids).

    An item of fewer than n words, but not none, is one window. Null texts have no words; items without an
    id give windows but are not listed.
    """
    words = items.select(F.col(id_col).alias("item"), _words(text_col).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("size", F.least(F.size("words"), F.lit(n)))
    at = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    found = words.select("item", "size", F.explode(F.transform(at, lambda i: _window("words", i, F.col("size")))).alias("window"))
    found = found.select("item", "size", ascii_lower("window").alias("window"), _hash(F.col("window")).alias("h"))
    return found.groupBy("window", "size", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, row (hash of the text), hit (positions of hit words, ascending), items (sorted ids) of docs that hold a window.

    windows as from benchmark_windows. A null text has no words. Rows with the same id and text are one here.
    """
    windows = materialize(windows, "windows")
    entry = F.octet_length("window") + 8 * F.size("items") + 64 + 32 * F.col("size")
    facts = windows.agg(F.sum(entry).alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")).first()  # sizes: at most as many as a window has words
    n_blocks = max(1, -(-(facts["bytes"] or 0) // block_bytes))
    rows = _rows(docs, id_col, text_col)

    def scan(size: int, block: int) -> DataFrame:
        stride = _stride(size)
        short = size - stride + 1
        wanted = windows.filter(F.col("size") == size)
        if n_blocks > 1:
            wanted = wanted.filter(F.pmod("h", F.lit(n_blocks)) == block)
        own = F.split("window", " ")
        seeds = wanted.select(F.explode(F.array(*(_hash(_window(own, k, short)) for k in range(1, stride + 1)))).alias("seed")).distinct()
        wanted = wanted.select(F.col("h").alias("wanted"), "window", "items")

        def first_look(w: Column) -> Column:
            last = F.size(w) - short + 1
            found = F.transform(F.sequence(F.lit(1), last, F.lit(stride)), lambda i: _hash(_window(w, i, short)))
            return F.struct(w.alias("words"), F.when(last > 0, found).alias("hashes"))

        # Hashes come before their generator: one with a lambda in it is not compiled, and would copy all words to each of its rows.
        # The outer generators' empty rows find no partner; a filter inferred from inner ones would compute all hashes once more.
        looked = rows.select("id", "row", _let(_words("text"), first_look).alias("scan"))
        looked = looked.select("id", "row", "scan", F.posexplode_outer("scan.hashes").alias("step", "seed")).join(F.broadcast(seeds), "seed", "left_semi")
        starts = [F.col("step") * stride + 2 - k for k in range(1, stride + 1)]  # of the windows that hold this shorter one, from 1
        around = F.array(*(F.when((at > 0) & (at + size - 1 <= F.size("scan.words")), _hash(_window("scan.words", at, size))) for at in starts))
        spread = looked.select("id", "row", "scan", "step", around.alias("around")).select("id", "row", "scan", "step", F.posexplode_outer("around").alias("k", "h"))
        pos = F.col("step") * stride - F.col("k")
        # Texts that start with each other are equal; written as an equality this would be a join key, and be put together for every window.
        mine, theirs = ascii_lower(_window("scan.words", pos + 1, size)), F.col("window")
        same = (F.col("h") == F.col("wanted")) & F.startswith(mine, theirs) & F.startswith(theirs, mine)
        return spread.join(F.broadcast(wanted), same).select("id", "row", F.sequence(pos, pos + size - 1).alias("span"), "items")

    scans = [scan(size, block) for size in facts["sizes"] for block in range(n_blocks)]
    if not scans:
        return rows.limit(0).select("id", "row", F.array().cast("array<int>").alias("hit"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    hits = reduce(DataFrame.unionByName, scans)
    every = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))
    return hits.groupBy("id", "row").agg(every("span").alias("hit"), every("items").alias("items"))


def _joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"), "hit", "items")
    return docs.join(hits, docs["id"].eqNullSafe(F.col("hit_id")) & (docs["row"] == F.col("hit_row")), "left")


def remove_spans(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and kept_text, the text without hit words and what separates each from the next word.

    Texts without hits stay as they are; null stays empty.
    """
    joined = _joined(_rows(docs, id_col, text_col), find_hits(docs, windows, id_col, text_col))
    pieces = F.regexp_extract_all("text", F.lit(f"{_WORD}+{_GAP}*"), F.lit(0))
    cut = F.concat(F.regexp_extract("text", f"^{_GAP}*", 0), F.array_join(_without(pieces, F.col("hit")), ""))
    return joined.select(F.col("id").alias(id_col), F.when(F.col("hit").isNull(), F.col("text")).otherwise(cut).alias("kept_text"))


def remove_documents(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window, with all columns."""
    hits = find_hits(docs, windows, id_col, text_col).select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"))
    here = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(hits, docs[id_col].eqNullSafe(F.col("hit_id")) & (here == F.col("hit_row")), "left_anti")


def mark_hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit (words in windows), items (sorted ids of items with windows there), contaminated.

    Repeated rows are marked alike; null and empty texts have no words; other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col).select("id", "row", F.size(_words("text")).cast("long").alias("n_words"))
    joined = _joined(rows, find_hits(docs, windows, id_col, text_col))
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array()).alias("items"), F.col("hit").isNotNull().alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against the windows of ten words of benchmark. Items without an id hit words, but are not counted or listed; see mark_hits."""
    marked = mark_hits(read_table(spark, sf_dir, "documents"), benchmark_windows(read_table(spark, sf_dir, "benchmark")))
    named = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(named, "UTF-8"), 256).alias("items_sha256"), "contaminated"
    )


OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT item_id, words, least(len(words), 10) AS size
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0
), item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM (SELECT item_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM item)
), sizes AS (SELECT DISTINCT size FROM item_window), doc_window AS (
  SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc, sizes WHERE len(words) >= size)
), hits AS (SELECT r, i, d.size, item_id FROM doc_window d JOIN item_window USING (size, w)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)
"""
