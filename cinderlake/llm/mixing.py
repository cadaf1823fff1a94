"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the characters wanted over the characters it has.
Each document gets a Poisson count with that mean, from inverting the distribution at a uniform number
that a keyed hash of seed and id gives, so a run repeats itself and no draw depends on any other. Rows are
exploded by their counts and shuffled globally: a hash of seed, id and copy deals them to partitions
and orders them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, shuffle_partitions

SEED = 42
#: Target weights of the registered queries: a source that is not named has weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
#: Characters wanted, as a multiple of those there are.
EPOCHS = 1.0
#: A larger mean is drawn in parts no larger than this, whose sum has the same distribution.
MAX_MEAN = 16.0
#: Tables of rates with more sources than this (700 bytes each) are not broadcast.
BROADCAST_SOURCES = 20_000
#: P(count > this) is below 1e-20 for a mean of MAX_MEAN.
MAX_COUNT = 80


def source_rates(docs: DataFrame, weights: dict[str, float], epochs: float = EPOCHS, source_col: str = "source", text_col: str = "text", default_weight: float = 1.0) -> DataFrame:
    """mix_source, rate: the mean repetition of each source's documents. A null source counts as ''."""
    named = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.try_element_at(F.create_map(*named), F.col("mix_source")), F.lit(default_weight)) if named else F.lit(default_weight)
    chars = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    mass = chars.groupBy("mix_source").agg(F.sum("n").alias("mass")).withColumn("weight", weight)
    totals = mass.filter("mass > 0").agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("mass") > 0, F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass")).otherwise(F.lit(0.0))
    return mass.crossJoin(F.broadcast(totals)).select("mix_source", rate.alias("rate"))  # totals is one row


def _cumulative(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... of a Poisson distribution."""
    ks = F.sequence(F.lit(1), F.lit(MAX_COUNT))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"))
    return F.aggregate(ks, start, step, lambda acc: acc["cdf"])


def uniform(*key: Column) -> Column:
    """A number from 0 up to 1 that depends on the key only: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(" ", *key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _identity(id_col: str, text_col: str) -> Column:
    """What draws and places hang on: the id, or for a null id the whole text."""
    by_text = F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return F.when(F.col(id_col).isNull(), by_text).otherwise(F.col(id_col).cast("string"))


def draw_counts(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs with a column mix_count, the document's Poisson count at its source's rate.

    A count is a function of seed, id and rate, for a null id of seed, text and rate: repeated rows get
    equal counts.
    Up to BROADCAST_SOURCES sources go to the documents. More are joined by a shuffle on the source,
    whose two sides come straight from files, so that adaptive execution can split a hot one.
    """
    parts = F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1))
    tables = rates.withColumn("parts", parts.cast("int")).withColumn("cdf", _cumulative(F.col("rate") / parts))
    tables = materialize(tables.select(F.col("mix_source").alias("rate_source"), "parts", "cdf"), "rates")
    if tables.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    key = _identity(id_col, text_col)
    tagged = docs.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    joined = tagged.join(tables, F.col("mix_source") == F.col("rate_source"), "left")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: uniform(F.lit(str(seed)), key, k.cast("string")))
    below = F.transform(draws, lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    count = F.aggregate(below, F.lit(0), lambda a, b: a + b)
    return joined.withColumn("mix_count", F.coalesce(count, F.lit(0))).drop("mix_source", "rate_source", "parts", "cdf")


def replicate(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Rows of docs, each as often as it was drawn, shuffled globally, with columns mix_copy (from 1) and mix_order.

    mix_order is the hash that orders the shuffle: rows are dealt to partitions by it and sorted by it
    there. A document drawn 0 times goes. Columns of docs with the names of those added are replaced.
    """
    docs = docs.drop("mix_copy", "mix_order", "mix_count", "mix_source", "rate_source", "parts", "cdf")
    drawn = draw_counts(docs, rates, id_col, source_col, text_col, seed).filter("mix_count > 0")
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count")))).drop("mix_count")
    key = F.concat_ws(" ", F.lit(f"order {seed}"), _identity(id_col, text_col), F.col("mix_copy").cast("string"))
    ordered = copies.withColumn("mix_order", F.md5(key))
    return ordered.repartition(shuffle_partitions(docs.sparkSession), "mix_order").sortWithinPartitions("mix_order")


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, epochs: float = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs replicated so that each source has its target share of the characters, in expectation.

    Weights are relative; sources that are not named have weight 1 and null counts as the source ''. A
    source without characters is left out. See replicate for the columns and the order. An empty table
    gives an empty table.
    """
    return replicate(docs, source_rates(docs, weights, epochs, source_col, text_col), id_col, source_col, text_col, seed)


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to WEIGHTS, one row a copy. A null source counts as ''; see mix and draw_counts for the other cases."""
    docs = read_table(spark, sf_dir, "documents")
    out = mix(docs)
    return out.select("doc_id", F.col("mix_copy").cast("long").alias("copy"), F.col("mix_order").alias("order_key"), "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


OP5_SQL = f"""
WITH RECURSIVE weights(source, weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}),
mass AS (
  SELECT coalesce(d.source, '') AS source, sum(coalesce(length(text), 0)) AS mass, coalesce(max(w.weight), 1.0) AS weight
  FROM documents d LEFT JOIN weights w ON w.source = d.source GROUP BY 1
), rates AS (
  SELECT source, CASE WHEN mass > 0 THEN {EPOCHS}::DOUBLE * weight / sum(weight) FILTER (WHERE mass > 0) OVER ()
                      * sum(mass) OVER () / mass ELSE 0 END AS rate FROM mass
), parts AS (SELECT source, greatest(ceil(rate / {MAX_MEAN}), 1)::INT AS parts, rate / greatest(ceil(rate / {MAX_MEAN}), 1) AS mean FROM rates),
cdf(source, k, p, c) AS (
  SELECT source, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT cdf.source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf JOIN parts USING (source) WHERE k < {MAX_COUNT}
), draws AS (
  SELECT d.doc_id, coalesce(d.source, '') AS s, d.source, d.text,
         ('0x' || substr(md5('{SEED} ' || d.doc_id || ' ' || part), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u, part
  FROM documents d JOIN parts p ON p.source = coalesce(d.source, ''), unnest(range(1, p.parts + 1)) AS t(part)
), counts AS (
  SELECT doc_id, any_value(source) AS source, any_value(text) AS text, sum((SELECT count(*) FROM cdf WHERE cdf.source = s AND c <= u)) AS n
  FROM draws GROUP BY doc_id
)
SELECT doc_id, copy, md5('order {SEED} ' || doc_id || ' ' || copy) AS order_key, source, sha256(coalesce(text, '')) AS text_sha256
FROM counts, unnest(range(1, n::BIGINT + 1)) AS t(copy)
"""
