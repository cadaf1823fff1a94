"""Phrases whose words go together, mined from position bitmaps in the manner of SPAM.

Texts become shards of tokens with a gap after each piece. A shard keeps a bitmap of positions for each word that is
frequent in the whole corpus, compressed to its nonzero 64-bit blocks. A phrase's bitmap marks where it ends: it is
extended by shifting it one position and ANDing it with the bitmaps of words, and the popcount of the result is
the longer phrase's count in the shard; gaps belong to no word, so nothing crosses them. Many bitmaps are shifted and
ANDed side by side: the lowest bit left in a block names a word, whose own block takes from it all bits it shares.

Counts are summed over shards, a round for each length. A shard sends its phrases and their counts to ranges of
hashes; a range adds up what all shards bring and answers which phrases are frequent, in the order asked. A shard
goes down from runs of first words, depth first, over phrases that were found frequent, and adds a word only where
the words after the first are frequent too. No list of phrases is held anywhere but in ranges, and a frequent
phrase brings one entry a shard, so no range is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, shared_path, shuffle_partitions
from .suffix_tree_lm import _integers, _longer, _pack, _planes, _unpack

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A longer phrase with so many percent of a shorter one's count stands for it.
COVERED = 80
#: Tokens of a shard, and of the corpus for each range of hashes.
SHARD_TOKENS, RANGE_TOKENS = 2_000_000, 2_000_000
#: Blocks of bitmaps that a run of first words has.
RUN_BLOCKS = 1 << 19
UNKNOWN_LANG = "und"

_GAPS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_SHARDS = "shard long, langs array<string>, words array<string>, counts array<long>, places binary, n_tokens long"


class _Places(dict):
    """Numbers the words of a language as they come, with those of other languages in named."""

    def __init__(self, lang: str, named: list[tuple[str, bytes]]) -> None:
        self.lang, self.named = lang, named

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.named)
        self.named.append((self.lang, word))
        return n


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the texts of a partition: distinct words with their languages, and each token's place among them, -1 in gaps."""
    part, n_shards = TaskContext.get().partitionId(), 0
    named: list[tuple[str, bytes]] = []
    by_lang: dict[str, _Places] = {}
    texts: list[np.ndarray] = []
    n = 0

    def packed() -> pa.RecordBatch:
        tokens = np.concatenate(texts)
        counts = np.bincount(tokens[tokens >= 0], minlength=len(named))
        row = [(part << 32) + n_shards, [lang for lang, _ in named], [w.decode() for _, w in named], counts, _pack(tokens), len(tokens)]
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _SHARDS.split(", ")])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in by_lang:
                by_lang[lang] = _Places(lang, named)
            place, found = by_lang[lang].__getitem__, []
            for piece in text.lower().translate(_GAPS).split(b"\n"):  # bytes know the capitals of ASCII only, as is wanted here
                found += map(place, piece.split())
                found.append(-1)
            texts.append(np.array(found, np.int32))
            n += len(found)
            if n >= SHARD_TOKENS:
                yield packed()
                named, by_lang, texts, n, n_shards = [], {}, [], 0, n_shards + 1
    if texts:
        yield packed()


def _numbered(words: DataFrame) -> DataFrame:
    """words with an int id each, without gaps, by the partitions they are written in."""
    words = materialize(words.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "frequent-words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = words.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a partition
    return words.join(F.broadcast(starts), "part").select("lang", "word", "f", (F.col("start") + F.col("nth")).cast("int").alias("id"))


def _with_ids(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A shard's tokens by the ids of frequent words, -1 for others and in gaps."""
    if not len(left):
        return pd.DataFrame({"shard": [], "tokens": []})
    places = _unpack(left["places"].iloc[0])
    ids = np.full(int(places.max(initial=-1)) + 2, -1, np.int32)
    ids[right["place"].to_numpy(np.int64)] = right["id"].to_numpy(np.int32)
    return pd.DataFrame({"shard": left["shard"], "tokens": [_pack(ids[places])]})  # place -1 is the last entry


@dataclass
class Bitmaps:
    """Compressed bitmaps side by side: phrase k of words[k] has the 64-bit blocks of its owner number k."""

    words: np.ndarray  # phrases x length, as the shard's numbers of words
    owner: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def popcounts(self) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.bits), len(self.words)).astype(np.int64)

    def only(self, bits: np.ndarray) -> Bitmaps:
        """The same phrases with other bits, without empty blocks."""
        some = bits != 0
        return Bitmaps(self.words, self.owner[some], self.block[some], bits[some])


class Shard:
    """The bitmaps of a shard's words. tokens: ids by position, -1 where no frequent word is."""

    def __init__(self, tokens: np.ndarray) -> None:
        at = np.flatnonzero(tokens >= 0)
        self.ids, word = np.unique(tokens[at], return_inverse=True)
        order = np.argsort(word, kind="stable")
        pos, word = at[order], word[order].astype(np.int32)
        block = (pos >> 6).astype(np.int32)
        new = np.ones(len(pos), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        firsts = np.flatnonzero(new)
        bit = np.uint64(1) << (pos & 63).astype(np.uint64)
        self.n_blocks = (len(tokens) >> 6) + 2
        self.word, self.block = word[firsts], block[firsts]
        self.bits = np.bitwise_or.reduceat(bit, firsts) if len(firsts) else bit
        self.block_at = np.zeros(self.n_blocks << 6, np.int32)  # by position, the block that has its bit among those of all words
        self.block_at[pos] = np.cumsum(new) - 1
        self.every = self.mark([Bitmaps(self.ids[:, None], self.word, self.block, self.bits)])

    def mark(self, found: list[Bitmaps]) -> np.ndarray:
        """One uncompressed bitmap of all positions in found."""
        out = np.zeros(self.n_blocks, np.uint64)
        for maps in found:
            np.bitwise_or.at(out, maps.block, maps.bits)
        return out

    def runs(self) -> Iterator[Bitmaps]:
        """The words' bitmaps, in runs of words."""
        ends = np.searchsorted(self.word, np.arange(len(self.ids) + 1))
        start = 0
        while start < len(self.ids):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + RUN_BLOCKS, "right")) - 1)
            of = slice(ends[start], ends[stop])
            yield Bitmaps(np.arange(start, stop, dtype=np.int32)[:, None], self.word[of] - start, self.block[of], self.bits[of])
            start = stop

    def extended(self, maps: Bitmaps, ends: np.ndarray) -> Bitmaps:
        """The phrases of one word more that end in ends, ordered by phrase and word."""
        carried = np.flatnonzero(maps.bits >> np.uint64(63))
        owner = np.concatenate([maps.owner, maps.owner[carried]])
        block = np.concatenate([maps.block, maps.block[carried] + 1])
        bits = np.concatenate([maps.bits << np.uint64(1), np.ones(len(carried), np.uint64)]) & ends[block]
        parts = []
        while True:
            some = np.flatnonzero(bits)
            if not len(some):
                break
            owner, block, bits = owner[some], block[some], bits[some]
            lowest = np.bitwise_count((bits & -bits) - np.uint64(1))
            own = self.block_at[(block << 6) + lowest]
            both = bits & self.bits[own]
            parts.append((owner.astype(np.int64) * len(self.ids) + self.word[own], block, both))
            bits = bits ^ both
        if not parts:
            return Bitmaps(np.zeros((0, maps.words.shape[1] + 1), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64))
        key, block, both = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        phrases = key[new]
        words = np.column_stack([maps.words[phrases // len(self.ids)], (phrases % len(self.ids)).astype(np.int32)])
        return Bitmaps(words, (np.cumsum(new) - 1).astype(np.int32), block[order], both[order])


def _ranges(ids: np.ndarray, n_ranges: int) -> np.ndarray:
    key = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        key = _longer(key, column.astype(np.uint64) + np.uint64(1))
    return ((key >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


_ASKED = "range long, shard long, keys binary, n binary, ends binary"
_ANSWER = "range long, shard long, open binary, ends binary, ids array<array<int>>, counts array<long>"


def _asking(length: int, n_ranges: int):
    """What a shard asks of phrases of a length, when the answers to the round before and where shorter open phrases end are there."""
    columns = ["range", "shard", "keys", "n", "ends"]

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        number, shard = int(left["shard"].iloc[0]), Shard(_unpack(left["tokens"].iloc[0]))
        rows = right.sort_values(["depth", "range"])
        ends = [shard.every, *(np.frombuffer(x, np.uint64) for x in rows["ends"] if x is not None)]  # of words, pairs, ...
        answers = [np.frombuffer(x, bool) for x in rows["open"] if x is not None]
        runs, out = list(shard.runs()), []
        if not runs:
            return pd.DataFrame(out, columns=columns)
        if length > 2:  # first the phrases that were asked for last, and which of them are open
            deeper = []
            for maps in runs:
                for k in range(1, len(ends)):
                    maps = shard.extended(maps, ends[k - 1])
                    maps = maps.only(maps.bits & ends[k][maps.block])
                deeper.append(shard.extended(maps, ends[-1]))
            sizes = np.cumsum([len(m.words) for m in deeper])
            of = _ranges(np.concatenate([shard.ids[m.words] for m in deeper]), n_ranges)
            flags = np.zeros(len(of), bool)
            if answers:
                flags[np.argsort(of, kind="stable")] = np.concatenate(answers)
            runs = [m.only(np.where(f[m.owner], m.bits, np.uint64(0))) for m, f in zip(deeper, np.split(flags, sizes[:-1]), strict=True)]
            ends.append(shard.mark(runs))
            out.append((-1 - number, number, None, None, ends[-1].tobytes()))
        found = [shard.extended(maps, ends[-1]) for maps in runs]
        ids, n = np.concatenate([shard.ids[m.words] for m in found]), np.concatenate([m.popcounts() for m in found])
        of = _ranges(ids, n_ranges)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(n_ranges + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[k] : cuts[k + 1]]
            out.append((k, number, _planes(ids[mine].T.ravel().astype(np.uint64)), _planes(n[mine].astype(np.uint64)), None))
        return pd.DataFrame(out, columns=columns)

    return ask


def _answering(length: int, min_count: int):
    """Which of a range's phrases are frequent over all shards: to each shard in the order it asked, and once with their counts."""
    columns = ["range", "shard", "open", "ends", "ids", "counts"]

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["range"].iloc[0] < 0:
            return frame.assign(open=None, ids=None, counts=None)[columns]
        frame = frame.sort_values("shard")
        parts = [_integers(x).astype(np.int64).reshape(length, -1) for x in frame["keys"]]
        keys, n = np.concatenate(parts, axis=1), np.concatenate([_integers(x).astype(np.int64) for x in frame["n"]])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        new = np.ones(keys.shape[1], bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        flags = np.empty(len(n), bool)
        flags[order] = (total >= min_count)[np.cumsum(new) - 1]
        own = np.split(flags, np.cumsum([p.shape[1] for p in parts])[:-1])
        k = int(frame["range"].iloc[0])
        rows = [(k, s, f.tobytes(), None, None, None) for s, f in zip(frame["shard"], own, strict=True)]
        often = total >= min_count
        rows.append((k, None, None, None, keys[:, new][:, often].T.tolist(), total[often].tolist()))
        return pd.DataFrame(rows, columns=columns).astype({"shard": "Int64"})

    return answer


def _bucketed(df: DataFrame, name: str) -> str:
    """df as a table bucketed by shard, so that what comes to shards is shuffled and they are not; the table's name."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(df.sparkSession), "shard").option("compression", "zstd").option("path", shared_path(df.sparkSession, name)).saveAsTable(table)
    return table


def _mined(docs: DataFrame, lang_col: str, text_col: str, min_count: int, max_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (lang, word, f, id) of frequent words, and (ids, a) of frequent phrases."""
    spark, tables = docs.sparkSession, []
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    try:
        tables.append(_bucketed(rows.mapInArrow(_shards, _SHARDS), "shards"))
        shards = spark.table(tables[-1])
        spread = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "w"))
        spread = spread.select("shard", "place", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        sizes = materialize(spread.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
        words = _numbered(spread.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))
        words = materialize(words, "words")
        ids = spread.select("shard", "place", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "place", "id")
        numbered = shards.select("shard", "places").groupBy("shard").cogroup(ids.groupBy("of")).applyInPandas(_with_ids, "shard long, tokens binary")
        tables.append(_bucketed(numbered, "numbered"))
        numbered = spark.table(tables[-1])
        n_ranges = max(shuffle_partitions(spark), int(-(-(shards.agg(F.sum("n_tokens")).first()[0] or 0) // RANGE_TOKENS)))
        answers: list[DataFrame] = []
        for length in range(2, max_words + 1):
            known = [a.filter("shard is not null and range < 0").select("shard", "range", F.lit(d).alias("depth"), F.lit(None).cast("binary").alias("open"), "ends") for d, a in enumerate(answers, 2)]
            if answers:
                known.append(answers[-1].filter("shard is not null and range >= 0").select("shard", "range", F.lit(length - 1).alias("depth"), "open", F.lit(None).cast("binary").alias("ends")))
            else:
                known.append(spark.createDataFrame([], "shard long, range long, depth int, open binary, ends binary"))
            asked = numbered.groupBy("shard").cogroup(reduce(DataFrame.unionByName, known).groupBy("shard")).applyInPandas(_asking(length, n_ranges), _ASKED)
            answers.append(materialize(asked.groupBy("range").applyInPandas(_answering(length, min_count), _ANSWER), "phrases"))
    finally:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    found = [a.filter("shard is null").select(F.explode(F.arrays_zip("ids", "counts")).alias("p")).select(F.col("p.ids").alias("ids"), F.col("p.counts").alias("a")) for a in answers]
    return sizes, words, reduce(DataFrame.unionByName, found)


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of 2 to max_words words that occur min_count times or more in their language.

    A-Z are lower-cased, pieces end at marks and line ends, and words are what stands between spaces and tabs. a counts
    the phrase within pieces, overlaps included; cut after its first words, l and r count its two parts, and the cut
    with the lowest floor(2000000 * a / (l + r)) counts, of equals that with the fewest words in front. n counts all
    words of the language. A phrase within a longer one that has covered percent of its count or more is left out. A
    null language is 'und'; null and empty texts have no words; repeated rows count each; other columns are ignored.
    """
    sizes, words, phrases = _mined(docs, lang_col, text_col, min_count, max_words)
    phrases = materialize(phrases, "phrases")
    named = phrases
    for k in range(1, max_words + 1):
        word = words.select(F.col("id").alias(f"id{k}"), F.struct("word", "f", "lang").alias(f"w{k}"))
        named = named.join(word, F.get("ids", F.lit(k - 1)) == F.col(f"id{k}"), "left").drop(f"id{k}")
    spelled = F.filter(F.array(*(F.col(f"w{k}") for k in range(1, max_words + 1))), lambda w: w.isNotNull())
    named = named.select("ids", "a", spelled.alias("w")).select("ids", "a", F.col("w")[0]["lang"].alias("lang"), F.array_join(F.col("w.word"), " ").alias("phrase"), F.col("w.f").alias("f"))
    named = materialize(named, "named")

    size = F.size("ids")
    cuts = named.select("ids", "a", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    part = lambda side: phrases.select(F.col("ids").alias(side), F.col("a").alias(f"n_{side}"))
    cuts = cuts.join(part("first"), "first", "left").join(part("rest"), "rest", "left")
    cuts = cuts.withColumns({"l": F.coalesce("n_first", F.element_at("f", 1)), "r": F.coalesce("n_rest", F.element_at("f", -1))})
    score = F.expr("(cast(a as decimal(25, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = cuts.select("ids", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("ids").agg(F.min("cut").alias("cut"))

    scored = named.join(lowest, "ids")
    for long in range(3, max_words + 1):
        parts = F.array(*(F.slice("ids", start, short) for short in range(2, long) for start in range(1, long - short + 2)))
        longer = named.filter(size == long).select(F.explode(parts).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
        scored = scored.join(longer, "ids", "left").filter(f"longer is null or cast(longer as decimal(38, 0)) * 100 < cast(a as decimal(38, 0)) * {covered}").drop("longer")
    out = scored.join(sizes, "lang")
    return out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def top_phrases(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first rows of each lang by score and a, descending, and phrase, with their rank from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(phrases.sparkSession)))
    best = phrases.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents; see mine_phrases."""
    return top_phrases(mine_phrases(read_table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents
), total AS (SELECT lang, sum(len(ws)) AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, m, phrase, count(*) AS a FROM (
    SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM piece, range(1, 5) t(m) WHERE len(ws) >= m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30
), cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM gram WHERE m > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, f.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (f.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN gram f ON f.lang = c.lang AND f.phrase = array_to_string(ws[1:k], ' ')
  JOIN gram r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:c.m], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM (SELECT lang, a, ws, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, 4) t(s) WHERE s < m))
  GROUP BY lang, phrase
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score
FROM best b JOIN total t USING (lang) LEFT JOIN sub USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
