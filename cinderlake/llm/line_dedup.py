"""Line dedup in DataFrame functions only.

Normalised lines are exploded and hashed, the distinct documents of each hash are counted, and lines
over the threshold are dropped everywhere but in the document with the smallest id. Only hashes and
positions are exploded: whole texts are shuffled once, to meet the positions they lose, and a line
that a third of all documents share is a skewed join key that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, materialize, read_table

MIN_CHARS = 10
MIN_DOCS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body, which may use it in inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(lines: Column, drop: Column) -> Column:
    """The lines at positions that the sorted array drop does not name, in order."""

    def kept(v: Column) -> Column:
        at = lambda i: F.get(v["bounds"], i)
        gaps = F.transform(F.sequence(F.lit(0), F.size(v["bounds"]) - 2), lambda i: F.slice(v["lines"], at(i) + 2, at(i + 1) - at(i) - 1))
        return F.flatten(gaps)

    whole = _let(F.struct(lines.alias("lines")), lambda v: F.struct(v["lines"].alias("lines"), F.concat(F.array(F.lit(-1)), drop, F.array(F.size(v["lines"]))).alias("bounds")))
    return _let(whole, kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of docs: id_col, kept_text, n_lines, n_dropped.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least min_chars
    code points found in at least min_docs documents lose all their lines, except in the document of
    the smallest id that holds them. A null or empty text is one empty line. Rows with the same id
    count as one document, each with its own positions; identical rows get identical results. A null
    id is one document that is never the smallest. Columns other than the two named are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("text"))
    lines = docs.select("id", "row", F.posexplode(F.split(ascii_lower("text"), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).filter(F.length("key") >= min_chars)
    lines = lines.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))

    # Two levels, so that a key of many documents is counted where its documents are spread.
    one_each = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    n_docs = F.count("*").alias("n_docs")
    common = one_each.groupBy("h1", "h2").agg(n_docs, F.min("id").alias("first_id")).filter(F.col("n_docs") >= min_docs)
    common = materialize(common.select("h1", "h2", "first_id"), "common-lines")

    dropped = lines.join(common, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("first_id")))
    dropped = dropped.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    dropped = dropped.select(F.col("id").alias("drop_id"), F.col("row").alias("drop_row"), "drop")

    joined = docs.join(dropped, docs["id"].eqNullSafe(F.col("drop_id")) & (docs["row"] == F.col("drop_row")), "left")
    lines_of = _lines(F.col("text"))
    cut = F.array_join(_without(lines_of, F.col("drop")), "\n")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(cut).alias("kept_text"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the lines that others hold first. A null or empty text is one empty line; see dedup_lines."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT key, min(doc_id) AS first_id FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id <> c.first_id AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
