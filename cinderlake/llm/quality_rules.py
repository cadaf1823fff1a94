"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. For each cell (language and source), each language
and the whole table, the minimum covariance determinant estimate is searched for by concentration steps:
distances by the last estimate, then mean and covariance of the ALPHA share of vectors that are nearest,
until the determinant stops falling. Starts are the median with the median absolute deviation, and many
small random subsets. A cell of more than BLOCK_ROWS vectors takes its starts from blocks of that size and
its concentration steps from all its vectors, which are counted into fine bins of distance.

A cell's estimate shrinks towards its language's as if that were SHRINK_ROWS rows of the cell, and a
language's towards the table's, so small cells need no rule of their own. Rows are rejected whose
Mahalanobis distance is beyond the chi-square limit, which is stretched where a cell's own distances
spread more than those of a normal population do.

Equal vectors are one observation: a text that is copied thousandfold does not shape its cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, gamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, WORD, bound_batches, materialize, read_table

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
ALPHA = 0.55
#: Share of a normal population that stays inside the limit.
QUANTILE = 1 - 1e-6
#: Rows of the wider estimate that a cell's own estimate is mixed with.
SHRINK_ROWS = 100
#: Variance that is added so that a matrix has an inverse, as a share of the statistic's variance in the table.
FLOOR = 1e-3
#: Words of average text that are added before shares are taken, so that short texts scatter less.
PRIOR = 20
#: Random starts, those of them that are followed to the end, and a guard on their steps.
STARTS, FOLLOWED, MOST_STEPS = 20, 4, 200
#: Vectors that are searched in one piece, the blocks of a larger cell that are searched for starts, and the starts it takes.
BLOCK_ROWS, START_BLOCKS, BEST_STARTS = 10_000, 8, 2
#: Bins of distance in an octave, in concentration steps and for quantiles.
BINS = 64
#: Parts that a cell is dealt to for joins.
SALTS = 32
SEED = 42
STATISTICS = ("word_length", "capitals", "marks", "variety", "line_length", "short_words")

_P = len(STATISTICS)
_X = [f"x{k}" for k in range(_P)]
_WORDS = regex.compile(WORD).findall
_SYMBOLS = regex.compile(r"[#*$%&|<>]")
_CAPITALS = regex.compile(r"\p{Lu}")
_MARKS = regex.compile(r"[^\p{L}\p{N}\s]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_types", "n_short")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, its first place included."""
    if len(words) <= window:
        return 0
    numbers: dict[str, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < window:  # exact: equal ranks are equal runs of width words
        step = min(width, window - width)
        rank = np.unique(rank[: len(rank) - step] * (rank.max() + 1) + rank[step:], return_inverse=True)[1]
        width += step
    at = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def text_counts(text: str) -> tuple[int, ...]:
    """The numbers named in _COUNTS, over the whole text."""
    words, lines, seen, dup, filled = _WORDS(text), text.split("\n"), set(), 0, 0
    for line in lines:
        if line.strip(BLANKS):
            filled += 1
            dup += line in seen
            seen.add(line)
    sizes = list(map(len, words))
    types, short = len(set(text.lower().translate(_TO_SPACE).split(" ")) - {""}), sum(n <= 3 for n in sizes)
    return len(words), sum(sizes), len(_SYMBOLS.findall(text)), dup, repeat_words(words), filled, len(_CAPITALS.findall(text)), len(_MARKS.findall(text)), types, short


_TO_SPACE = str.maketrans(dict.fromkeys(BLANKS, " "))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of each row's text; null counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), batch.column("source"), *map(pa.array, found.T)], names=["id", "lang", "source", *_COUNTS])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    return rows.mapInArrow(count, schema)


def vectors(counts: DataFrame, passed: str = "not base_failed") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """counts with the transformed statistics x0, x1, ..., their means and their variances, over the rows that passed."""
    sums = counts.filter(passed).agg(*(F.sum(c).cast("double").alias(c) for c in _COUNTS)).first()
    rate = lambda a, b: (sums[a] or 0.0) / max(sums[b] or 0.0, 1.0)
    n = F.col("n_words") + PRIOR
    chars = PRIOR * rate("word_chars", "n_words")
    shrunk = lambda c, base: F.col(c) + PRIOR * rate(c, base)
    by_char = lambda c: F.sqrt((F.col(c) + chars * rate(c, "word_chars")) / (F.col("word_chars") + chars + 1e-9))
    found = {
        "word_length": F.log((F.col("word_chars") + chars + 1e-9) / n),
        "capitals": by_char("n_capitals"),
        "marks": by_char("n_marks"),
        "variety": F.log((F.col("n_types") + PRIOR) / n) / F.log(n),
        "line_length": F.log(n / (shrunk("n_lines", "n_words") + 1e-9)),
        "short_words": F.sqrt(shrunk("n_short", "n_words") / n),
    }
    rows = counts.select("*", *(found[name].alias(x) for name, x in zip(STATISTICS, _X, strict=True)))
    row = rows.filter(passed).agg(*(f(x) for x in _X for f in (F.avg, F.var_pop))).first()
    moments = np.array([v or 0.0 for v in row], float).reshape(_P, 2)
    return rows, moments[:, 0], np.maximum(moments[:, 1], 1e-9)


# --- estimates in one piece --------------------------------------------------------------------


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    z = x - mean
    return np.einsum("ij,ij->i", z @ np.linalg.inv(cov), z)


def minimum_determinant(x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and covariance of the ALPHA share of rows with the least determinant found, its logarithm, and the farthest of their distances.

    floor is added to variances. The order of the rows does not matter.
    """
    x = x[np.lexsort(x.T)]
    n, p = x.shape
    h = max(1, int(np.ceil(ALPHA * n)))
    added = np.diag(floor)

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        d = distances(x, mean, cov)
        near = np.argpartition(d, h - 1)[:h]
        mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + added
        return float(np.linalg.slogdet(cov)[1]), mean, cov, float(d[near].max())

    middle = np.median(x, axis=0)
    spread = np.median(np.abs(x - middle), axis=0) * 1.4826
    starts, rng = [(middle, np.diag(spread**2) + added)], np.random.default_rng(SEED)
    for _ in range(STARTS):
        some = x[rng.choice(n, min(n, p + 1), replace=False)]
        starts.append((some.mean(axis=0), np.cov(some.T, bias=True) + added))
    found = sorted((step(*step(*s)[1:3]) for s in starts), key=lambda f: f[0])
    best = None
    for at in found[:FOLLOWED]:
        for _ in range(MOST_STEPS):
            then = step(*at[1:3])
            done, at = at[0] - then[0] < 1e-9, then
            if done:
                break
        if best is None or at[0] < best[0]:
            best = at
    return best[1], best[2], best[0], best[3]


_KEY = ["level", "lang", "source"]
_CELL = "level int, lang string, source string"
_FOUND = f"{_CELL}, start int, n long, m array<double>, c array<double>, log_det double, radius double"


# --- estimates of any size ---------------------------------------------------------------------


def _distance() -> Column:
    """Squared Mahalanobis distance of x from mean m by the inverse v, both columns of the row."""
    z = [F.col(f"x{i}") - F.element_at("m", i + 1) for i in range(_P)]
    terms = [z[i] * z[j] * F.element_at("v", i * _P + j + 1) * (1 if i == j else 2) for i in range(_P) for j in range(i, _P)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """The vectors of a block as one row."""
    return frame[[*_KEY, "block", "blocks"]].iloc[:1].assign(x=[np.ascontiguousarray(frame[_X].to_numpy(float)).tobytes()])


def _vectors_of(x: bytes) -> np.ndarray:
    return np.frombuffer(x, float).reshape(-1, _P)


def _searched(floor: np.ndarray):
    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The estimate of each block alone."""
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x = _vectors_of(row.x)
                mean, cov, log_det, radius = minimum_determinant(x, floor)
                out.append((row.level, row.lang, row.source, row.block, len(x), mean.tolist(), cov.ravel().tolist(), log_det, max(radius, 1e-12)))
            yield pd.DataFrame(out, columns=[*_KEY, "start", "n", "m", "c", "log_det", "radius"])

    return searched


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = [*(f"s{i}" for i in range(_P)), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vectors of each block, counted into bins of distance from an estimate, with their moments."""
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            x = _vectors_of(row.x)
            d = distances(x, np.array(row.m), np.reshape(row.c, (_P, _P)))
            at = np.floor(np.clip(np.log2((d + 1e-12) / row.radius), -2, 2) * BINS).astype(int)
            low = at.min()
            moments = np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in _PAIRS)])
            sums = np.column_stack([np.bincount(at - low, moments[:, k]) for k in range(moments.shape[1])])
            some = np.flatnonzero(sums[:, 0])
            found = pd.DataFrame(sums[some], columns=["bin_n", *_SUMS]).astype({"bin_n": "int64"})
            out.append(found.assign(**{k: getattr(row, k) for k in (*_KEY, "start", "radius")}, bin=(some + low).astype("int32")))
        if out:
            yield pd.concat(out, ignore_index=True)[[*_KEY, "start", "radius", "bin", "bin_n", *_SUMS]]


def _concentrated(floor: np.ndarray):
    def concentrated(frame: pd.DataFrame) -> pd.DataFrame:
        """The next estimate of one cell and start, from the moments of its bins of distance."""
        frame = frame.sort_values("bin")
        n = frame["bin_n"].to_numpy(float)
        half, ends = np.ceil(ALPHA * n.sum()), np.cumsum(n)
        last = int(np.searchsorted(ends, half))
        part = (half - (ends[last] - n[last])) / n[last]  # of the bin where the share ends
        share = np.where(np.arange(len(n)) < last, 1.0, 0.0)
        share[last] = part
        added = lambda c: float(share @ frame[c].to_numpy(float)) / half
        mean = np.array([added(f"s{i}") for i in range(_P)])
        cov = np.diag(floor)
        for i, j in _PAIRS:
            shared = added(f"s{i}_{j}") - mean[i] * mean[j]
            cov[i, j] += shared
            cov[j, i] += shared if i != j else 0.0
        row = frame.iloc[0]
        radius = float(row["radius"] * 2.0 ** ((frame["bin"].iloc[last] + part) / BINS))
        return pd.DataFrame([{**{k: row[k] for k in _KEY}, "start": row["start"], "n": int(n.sum()), "m": mean.tolist(), "c": cov.ravel().tolist(), "log_det": float(np.linalg.slogdet(cov)[1]), "radius": radius}])

    return concentrated


def _settled(blocks: DataFrame, starts: DataFrame, floor: np.ndarray) -> DataFrame:
    """Estimates of cells in several blocks, by concentration steps over all their vectors from each of their starts."""
    estimates = starts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    blocks = blocks.withColumn("salt", F.col("block") % SALTS)
    schema = f"{_CELL}, start int, radius double, bin int, bin_n long, {', '.join(f'{c} double' for c in _SUMS)}"
    for step in range(MOST_STEPS):
        placed = blocks.join(estimates.select(*_KEY, "start", "m", "c", "radius", salts), [*_KEY, "salt"])
        bins = placed.mapInPandas(_binned, schema).groupBy(*_KEY, "start", "radius", "bin").agg(*(F.sum(c).alias(c) for c in ("bin_n", *_SUMS)))
        before = estimates.select(*_KEY, "start", F.col("log_det").alias("last"))
        estimates = materialize(bins.groupBy(*_KEY, "start").applyInPandas(_concentrated(floor), _FOUND), "estimates")
        falling = estimates.join(before, [*_KEY, "start"]).filter(F.col("last") - F.col("log_det") > 1e-3)
        if step and falling.isEmpty():  # the first determinants are those of blocks
            break
    return estimates


def robust_estimates(rows: DataFrame, floor: np.ndarray) -> DataFrame:
    """Minimum covariance determinant estimates of cells: level, lang, source, n, m, c, from rows of those keys and x0, x1, ....

    The rows of a cell are to be distinct. They are dealt to blocks by a hash.
    """
    bound_batches(rows.sparkSession)
    sizes = materialize(rows.groupBy(*_KEY).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS)), "cells")
    row_hash = F.xxhash64(*_X)
    salted = rows.withColumn("salt", F.pmod(row_hash, F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = salted.join(sizes.select(*_KEY, "blocks", salts), [*_KEY, "salt"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), row_hash), F.col("blocks")).cast("int"))
    blocks = materialize(dealt.groupBy(*_KEY, "block").applyInPandas(_packed, f"{_CELL}, block int, blocks long, x binary"), "blocks")
    found = materialize(blocks.filter(F.col("block") < START_BLOCKS).mapInPandas(_searched(floor), _FOUND), "found")
    several = sizes.filter("blocks > 1").select(*_KEY)
    if several.isEmpty():
        return found.select(*_KEY, "n", "m", "c")
    by = Window.partitionBy(*_KEY).orderBy("log_det", "start")  # START_BLOCKS rows a cell at most
    starts = found.join(several, _KEY, "left_semi").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= BEST_STARTS)
    last = _settled(blocks.filter("blocks > 1"), materialize(starts.drop("place"), "starts"), floor)
    best = last.groupBy(*_KEY).agg(F.first("n").alias("n"), F.min_by(F.struct("m", "c"), F.struct("log_det", "start")).alias("best"))
    return found.join(several, _KEY, "left_anti").select(*_KEY, "n", "m", "c").union(best.select(*_KEY, "n", "best.m", "best.c"))


# --- limits ------------------------------------------------------------------------------------


def chi2_cdf(x: float, df: int) -> float:
    """The chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= half / k
        total += term
    return total * half**a * exp(-half) / gamma(a)


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < q else (low, middle)
    return high


def consistency() -> float:
    """By how much the nearest ALPHA of a normal population understate its covariance."""
    return ALPHA / chi2_cdf(chi2_quantile(ALPHA, _P), _P + 2)


def mixed(n: float, own: tuple[np.ndarray, np.ndarray], wide: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows of own and SHRINK_ROWS of wide."""
    w = n / (n + SHRINK_ROWS)
    apart = own[0] - wide[0]
    return w * own[0] + (1 - w) * wide[0], w * own[1] + (1 - w) * wide[1] + w * (1 - w) * np.outer(apart, apart)


def _levels(lang: str = "lang", source: str = "source") -> Column:
    """A row's cell, language and table."""
    one = lambda level, *key: F.struct(F.lit(level).alias("level"), *(k.alias(c) for k, c in zip(key, ("lang", "source"), strict=True)))
    return F.explode(F.array(one(0, F.col(lang), F.col(source)), one(1, F.col(lang), F.lit("")), one(2, F.lit(""), F.lit("")))).alias("cell")


def _chained(found: DataFrame) -> DataFrame:
    """Each cell beside its language and the table: lang, source, and own, of_lang, of_all with the other columns of found."""
    rest = [c for c in found.columns if c not in _KEY]
    cell = lambda level, name: found.filter(F.col("level") == level).select("lang", "source", F.struct(*rest).alias(name))
    return cell(0, "own").join(cell(1, "of_lang").drop("source"), "lang").crossJoin(F.broadcast(cell(2, "of_all").select("of_all")))  # of_all is one row


def _shrunk(pooled: tuple[np.ndarray, np.ndarray]):
    def shrunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = consistency()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                at = pooled
                for e in (row.of_all, row.of_lang, row.own):
                    at = mixed(e["n"], (np.array(e["m"]), np.reshape(e["c"], (_P, _P)) * factor), at)
                out.append((row.lang, row.source, at[0].tolist(), np.linalg.inv(at[1]).ravel().tolist()))
            yield pd.DataFrame(out, columns=["lang", "source", "m", "v"])

    return shrunk


def _quartile_and_median(frame: pd.DataFrame) -> pd.DataFrame:
    """Logarithms of the lower quartile and the median of the distances of one cell, from its bins."""
    frame = frame.sort_values("bin")
    ends = np.cumsum(frame["bin_n"].to_numpy(np.int64))
    at = [frame["bin"].iloc[int(np.searchsorted(ends, share * ends[-1]))] for share in (0.25, 0.5)]
    low, middle = ((b + 0.5) / BINS * log(2) for b in at)
    return pd.DataFrame([{**{k: frame[k].iloc[0] for k in _KEY}, "n": int(ends[-1]), "low": float(low), "middle": float(middle)}])


def limit(chain: list[tuple[float, float, float]], quantile: float) -> float:
    """The largest distance that is kept, from (rows, lower quartile, median) of the table, the language and the cell, as logarithms.

    For a normal population it is the chi-square quantile; a wider spread below the median moves it out.
    """
    low, middle, top = (log(chi2_quantile(q, _P)) for q in (0.25, 0.5, quantile))
    at, stretch = middle, 1.0
    for n, own_low, own_middle in chain:
        w = n / (n + SHRINK_ROWS)
        at, stretch = w * own_middle + (1 - w) * at, w * (own_middle - own_low) / (middle - low) + (1 - w) * stretch
    return exp(at + max(1.0, stretch) * (top - middle))


def _limits(quantile: float):
    def limits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(r.lang, r.source, limit([(e["n"], e["low"], e["middle"]) for e in (r.of_all, r.of_lang, r.own)], quantile)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["lang", "source", "most"])

    return limits


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: id_col, the counts, base_failed, distance (squared), most, kept.

    Fixed limits come first: too few words, or too many in repeated windows. Rows that pass them shape
    the estimates and are kept if their distance is at most ``most``, the limit of their cell. Null
    texts count as empty, null languages and sources as ''. Repeated rows are judged each, and equal
    vectors are one observation. A cell of which no row passes has distance and most null. An empty
    table gives an empty table; other columns are ignored.
    """
    rows = counted(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = materialize(rows.withColumn("base_failed", failed), "counts")
    rows, means, variances = vectors(counts)
    floor = FLOOR * variances
    once = materialize(rows.filter("not base_failed").groupBy("lang", "source", *_X).agg(F.lit(1).alias("one")).drop("one"), "vectors")
    wider = once.select(_levels(), *_X).select("cell.*", *_X).distinct()
    found = materialize(robust_estimates(wider, floor), "estimates")
    estimates = materialize(_chained(found).mapInPandas(_shrunk((means, np.diag(variances))), "lang string, source string, m array<double>, v array<double>"), "shrunk")
    placed = once.join(estimates, ["lang", "source"]).withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BINS).cast("int"))
    bins = materialize(placed.groupBy("lang", "source", "bin").agg(F.count("*").alias("bin_n")), "bins")
    wide_bins = bins.select(_levels(), "bin", "bin_n").select("cell.*", "bin", "bin_n").groupBy(*_KEY, "bin").agg(F.sum("bin_n").alias("bin_n"))
    spreads = materialize(wide_bins.groupBy(*_KEY).applyInPandas(_quartile_and_median, "level int, lang string, source string, n long, low double, middle double"), "spreads")
    limits = materialize(_chained(spreads).mapInPandas(_limits(quantile), "lang string, source string, most double"), "limits")
    out = rows.join(materialize(estimates.join(limits, ["lang", "source"]), "cells"), ["lang", "source"], "left").withColumn("distance", F.when(F.col("m").isNotNull(), _distance()))
    inside = F.coalesce(F.col("distance") <= F.col("most"), F.lit(True))
    return out.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "distance", "most", (~F.col("base_failed") & inside).alias("kept"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of judge on documents. Null texts count as empty; see judge for the other cases."""
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
