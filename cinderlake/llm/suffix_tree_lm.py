"""Language-model scores from a probabilistic suffix tree.

A context is a sequence of words that was read before. Contexts grow by a word to the left, one depth a
round. One is tested if it occurs LEAST times in training, if the context it extends is in the tree and
if its own words but the last were asked for; it stays if its next words diverge from those of the
context it extends: if, leaving out each occurrence in turn, they are worth MIN_GAIN nats more in all.
There is no limit on depth or number. Where a context predicts nearly as well as a longer one could,
longer ones fail the test, so rounds end by themselves, with the first in which no context stays. A
context's distribution is smoothed by that of the context it extends, which counts for STRENGTH words, down
to add-one word frequencies. A token is scored in the longest context of the tree that ends before it.

Texts are read once, into batches of tokens: the batch's words as 64-bit hashes and each token's place
among them. In each round (the first has words and pairs of them) a batch asks for the corpus counts of its distinct (context, word) pairs and
brings what it knows of the last round's test, packed by ranges of hashes; a range adds up what its
batches bring and answers each in the order it asked. A frequent word or context brings one entry a
batch, so no range is hot, and no list of contexts exists anywhere but in pieces. The batches are
bucketed by their number, so that answers come to them and they are not shuffled. In each round a batch
walks its tokens again from the answers of all before, until few of its contexts are tested: these
tokens it then takes along, with the sums of all others, and reads no more than the last answers. Batches and ranges
both grow with the square root of a large corpus, so messages between them grow in number with it and
not with its square.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, read_table, shared_path, shuffle_partitions

#: Nats that a context's next words must be worth beyond the context it extends, over all its occurrences.
MIN_GAIN = 4.0
#: Words that the shorter context's distribution counts for, by depth; the last holds for all depths below.
STRENGTH = (300.0, 40.0, 3.0)
#: A context that occurs once has nothing left to be tested by when it is left out.
LEAST = 2
#: Tokens of a batch, and of the corpus for each range of hashes; of a corpus beyond LINEAR_TOKENS both are more.
BATCH_TOKENS, RANGE_TOKENS, LINEAR_TOKENS = 600_000, 8_000_000, 8_000_000_000
#: Bytes that a token takes, for a guess at the size of the corpus.
TOKEN_BYTES = 6
#: A batch takes its tokens along once so few of them, 1 in OPEN_SHARE, are tested: more would be more disk than the walk is worth.
OPEN_SHARE = 64
FOLDS, HELD_OUT = 7, 2
#: No word holds a line end.
END = b"\n"

_TOKENS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("flags", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_train", T.LongType())])


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of sequences that are one word longer."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of uint64 in order, and each one's number among them, by a sort of values with their places in the low bits."""
    low = np.uint64((1 << max(len(x) - 1, 1).bit_length()) - 1)
    order = (np.sort(x & ~low | np.arange(len(x), dtype=np.uint64)) & low).astype(np.intp)
    y = x[order]
    if (y[1:] < y[:-1]).any():  # some differ in the low bits only
        y, number = np.unique(x, return_inverse=True)
        return y, number.astype(np.int32)
    fresh = np.ones(len(x), bool)
    np.not_equal(y[1:], y[:-1], out=fresh[1:])
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return y[fresh], number


# --- batches of tokens -------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    """int32 as planes of bytes, which compress well: places are numbered by frequency."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Flags of a text: it is learned from, it has no id.
_TRAIN, _NAMELESS = 1, 2


def _tokenize(batch_tokens: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_batches = TaskContext.get().partitionId(), 0
        words, ids, flags, texts, n = _Places(), [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal words, ids, flags, texts, n, n_batches
            places, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
            order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(_hash, words), np.uint64, len(words))[order]
            marks = np.array(flags, np.uint8)
            row = [(part << 32) + n_batches, np.array(ids, np.int64).tobytes(), sizes.astype(np.int32).tobytes(), marks.tobytes(), hashes.tobytes(), _pack(rank[places]), len(places), int(sizes[marks & _TRAIN > 0].sum())]
            words, ids, flags, texts, n, n_batches = _Places(), [], [], [], 0, n_batches + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW, strict=True)], names=_TOKENS.names)

        for batch in batches:
            for doc_id, text, use in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "train")), strict=True):
                found = (text or b"").lower().split()  # bytes know the capitals and blanks of ASCII only, as is wanted here
                found.append(END)
                texts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id or 0)
                flags.append(_TRAIN * use + _NAMELESS * (doc_id is None))
                n += len(found)
                if n >= batch_tokens:
                    yield packed()
        if texts:
            yield packed()

    return tokenize


_ARROW = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


@dataclass
class _Level:
    """The tokens of a batch whose context of one depth is asked for."""

    at: np.ndarray  # the tokens
    context: np.ndarray  # their contexts, as numbers of keys one level above
    keys: np.ndarray  # the distinct (context, word) keys in order
    key: np.ndarray  # each token's key, as a number


class _Batch:
    """The tokens of one batch."""

    def __init__(self, row: dict) -> None:
        self.ids, self.flags = row["ids"], row["flags"]
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        places = _unpack(row["places"])
        self.n = len(places)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(np.frombuffer(self.flags, np.uint8) & _TRAIN > 0, self.sizes)
        self.offset = np.arange(self.n, dtype=np.int32) - np.repeat(self.starts, self.sizes).astype(np.int32)
        hashes = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        every = np.arange(self.n, dtype=np.int32)
        self.levels = [_Level(every, np.zeros(self.n, np.int32), hashes[order], rank[places])]

    def deepen(self, totals: np.ndarray | None, open_: np.ndarray) -> None:
        """Adds the next level. totals: of the last level's keys, None for the first ones; open_: whether a token's shorter contexts stayed."""
        last, depth = self.levels[-1], len(self.levels)
        at, key = last.at[1:], last.key[:-1]  # tokens, and the keys of those before them where these are asked for too
        fine = np.flatnonzero((np.diff(last.at) == 1) & (self.offset[at] >= depth) & open_[at])
        if totals is not None:
            fine = fine[totals[key[fine]] >= LEAST]
        at, context = at[fine], key[fine]
        word = self.levels[0]
        self.levels.append(_Level(at, context, *_numbered(_longer(last.keys[context], word.keys[word.key[at]]))))


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(len(batch)):
        yield {c: batch.column(c)[k].as_py() for c in ("batch", "ids", "sizes", "flags", "words", "places")}


class _Chain:
    """Probabilities of a batch's tokens along the contexts that stayed, as far as the answers go.

    p is each token's probability in its deepest context so far, q the same with the token left out of
    the counts, deep the depth of that context.
    """

    def __init__(self, batch: _Batch, sizes: tuple[int, int], strength: tuple[float, ...], totals: list[np.ndarray]) -> None:
        n, v = sizes
        self.batch, self.strength, self.totals = batch, strength, totals
        c = totals[0][batch.levels[0].key].astype(float)
        self.p, self.q, self.deep = (c + 1) / (n + v + 1), np.maximum(c, 1) / max(n + v, 1), np.zeros(batch.n, np.int16)

    def tested(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose context of this depth is to be tested, its number one level above, and that of their key."""
        level = self.batch.levels[depth]
        mine = np.flatnonzero((self.deep[level.at] >= depth - 1) & (self.totals[depth - 1][level.context] >= LEAST))
        return level.at[mine], level.context[mine], level.key[mine]

    def within(self, depth: int, at: np.ndarray, context: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p and q of tokens within their contexts of this depth."""
        return _within(self.totals[depth][key], self.totals[depth - 1][context], _strength(self.strength, depth), self.p[at], self.q[at])

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The tested contexts of this depth, as numbers one level above, and what they gain in the batch's training tokens."""
        at, context, key = self.tested(depth)
        own = self.batch.train[at]
        at, own_context = at[own], context[own]
        _, q = self.within(depth, at, own_context, key[own])
        return _gained(context, own_context, np.log(q / self.q[at]), len(self.batch.levels[depth - 1].keys))

    def follow(self, depth: int, stays: np.ndarray) -> None:
        """Moves tokens to their contexts of this depth; stays: of its tested contexts in order, whether they stay."""
        at, context, key = self.tested(depth)
        flags = np.zeros(len(self.batch.levels[depth - 1].keys), bool)
        there = np.zeros(len(flags), bool)
        there[context] = True
        flags[np.flatnonzero(there)] = stays
        here = flags[context]
        at = at[here]
        self.p[at], self.q[at] = self.within(depth, at, context[here], key[here])
        self.deep[at] = depth


def _strength(strength: tuple[float, ...], depth: int) -> float:
    return strength[min(depth, len(strength)) - 1]


def _within(c: np.ndarray, n: np.ndarray, m: float, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of words found c times after contexts found n times, with each left out in turn too; p and q: in the shorter contexts."""
    c, n = c.astype(float), n.astype(float)
    return (c + m * p) / (n + m), (np.maximum(c - 1, 0) + m * q) / (n - 1 + m)


def _gained(context: np.ndarray, own: np.ndarray, nats: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts of n, and the sums of nats over those of training tokens."""
    there = np.zeros(n, bool)
    there[context] = True
    found = np.flatnonzero(there)
    return found, np.bincount(own, nats, minlength=n)[found].astype(np.float32)


def _walk(batch: _Batch, sizes: tuple[int, int], strength: tuple[float, ...], totals: list[np.ndarray], stays: list[np.ndarray]) -> _Chain:
    """The batch's levels and probabilities, from totals of depths 0, 1, ... and the verdicts on contexts of depths 1, 2, ...."""
    chain = _Chain(batch, sizes, strength, totals)
    for depth in range(1, len(totals)):
        batch.deepen(totals[depth - 1] if depth > 1 else None, chain.deep >= depth - 2)
        if depth <= len(stays):
            chain.follow(depth, stays[depth - 1])
    return chain


# --- corpus counts -----------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of as many bytes as the largest needs, with that number in front."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _integers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = planes[0].astype(np.uint64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_integers(data), dtype=np.uint64)


#: Rows with a range below 0 hold a batch's scores by the verdicts so far, and the tokens it takes along once they are few.
_ASKED = "range long, batch long, keys binary, n binary, contexts binary, gains binary, ids binary, flags binary, sizes binary, scores binary, rest binary"
_SCORED = ["ids", "flags", "sizes", "scores", "rest"]
_ANSWER = "range long, batch long, totals binary, stays binary, known long, staying long, ids binary, flags binary, sizes binary, scores binary, rest binary"


def _messages(number: int, train: np.ndarray, level: _Level, context_keys: np.ndarray, gains: np.ndarray, n_ranges: int) -> pd.DataFrame:
    """Keys of a level with their counts in training (train: whether its tokens are), and tested contexts with their gains: a row for each range that has any."""
    n = np.bincount(level.key[train], minlength=len(level.keys))
    edges = np.array([-(-(k << 32) // n_ranges) for k in range(1, n_ranges)], np.uint64)
    cut = lambda keys: np.concatenate([[0], np.searchsorted(keys >> np.uint64(32), edges), [len(keys)]])
    a, b = cut(level.keys), cut(context_keys)
    some = np.flatnonzero((a[:-1] < a[1:]) | (b[:-1] < b[1:])).tolist()
    rows = [(k, number, _steps(level.keys[a[k] : a[k + 1]]), _planes(n[a[k] : a[k + 1]]), _steps(context_keys[b[k] : b[k + 1]]), gains[b[k] : b[k + 1]].tobytes()) for k in some]
    return pd.DataFrame(rows, columns=["range", "batch", "keys", "n", "contexts", "gains"]).assign(**dict.fromkeys(_SCORED))


def _first_questions(tokens: DataFrame, n_ranges: int) -> DataFrame:
    """The words of each batch, and its pairs of words, which have the ranges from n_ranges on."""
    schema = pa.schema([("range", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("keys", "n", "contexts", "gains", *_SCORED))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _read(batch):
                read = _Batch(row)
                read.deepen(None, np.ones(read.n, bool))
                for depth, level in enumerate(read.levels):
                    out = _messages(row["batch"], read.train[level.at], level, np.zeros(0, np.uint64), np.zeros(0, np.float32), n_ranges)
                    out["range"] += depth * n_ranges
                    yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return tokens.mapInArrow(ask, _ASKED)


def _answers(asked: DataFrame, min_gain: float) -> DataFrame:
    """For each row asked the corpus counts of its keys and the verdicts on its contexts, in its order.

    Each range adds a row with batch null: how many of its keys occur in training, and how many contexts stay.
    """

    def merged(parts: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums of the values by key, and each part's keys, which ascend, as numbers."""
        every = np.sort(np.concatenate(parts))
        distinct = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
        places = [np.searchsorted(distinct, part) for part in parts]
        total = np.zeros(len(distinct))
        for place, value in zip(places, values, strict=True):  # a key occurs once in a part
            total[place] += value
        return total, places

    columns = ["range", "batch", "totals", "stays", "known", "staying", *_SCORED]

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["range"].iloc[0] < 0:
            return frame.assign(totals=None, stays=None, known=None, staying=None)[columns]
        frame = frame.sort_values("batch")
        total, places = merged([_keys(x) for x in frame["keys"]], [_integers(x) for x in frame["n"]])
        gain, marks = merged([_keys(x) for x in frame["contexts"]], [np.frombuffer(x, np.float32) for x in frame["gains"]])
        total, stays = total.astype(np.uint64), gain >= min_gain
        rows = [(b, _planes(total[at]), stays[mark].tobytes(), None, None) for b, at, mark in zip(frame["batch"], places, marks, strict=True)]
        rows.append((None, None, None, int((total > 0).sum()), int(stays.sum())))
        out = pd.DataFrame(rows, columns=["batch", "totals", "stays", "known", "staying"]).astype({"batch": "Int64", "known": "Int64", "staying": "Int64"})
        out.insert(0, "range", int(frame["range"].iloc[0]))
        return out.assign(**dict.fromkeys(_SCORED))[columns]

    return asked.groupBy("range").applyInPandas(answer, _ANSWER)


def _with_answers(tokens: DataFrame, answers: list[DataFrame], use, schema: str) -> DataFrame:
    """use(batch number, batch, totals of each depth, verdicts on each depth) for each batch of tokens."""
    rows = [a.filter("batch is not null and range >= 0").select("batch", F.lit(depth).alias("depth"), "range", "totals", "stays") for depth, a in enumerate(answers)]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    n_depths = len(answers)

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        totals: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(n_depths)]
        stays: list[list[np.ndarray]] = [[np.zeros(0, bool)] for _ in range(n_depths)]
        for depth, total, stay in right.sort_values(["depth", "range"])[["depth", "totals", "stays"]].itertuples(index=False):
            totals[depth].append(_integers(total).astype(np.int64))
            stays[depth].append(np.frombuffer(stay, bool))
        return use(int(left["batch"].iloc[0]), _Batch(left.iloc[0]), [np.concatenate(x) for x in totals], [np.concatenate(x) for x in stays[2:]])

    return tokens.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(together, schema)


# --- rounds ------------------------------------------------------------------------------------


@dataclass
class _Rest:
    """The tokens of a batch whose contexts of the last depth are tested, and the level that was asked for after them."""

    at: np.ndarray  # the tokens
    place: np.ndarray  # their contexts, as numbers of those tested
    p: np.ndarray  # p and q without these contexts
    q: np.ndarray
    longer_p: np.ndarray  # and with them
    longer_q: np.ndarray
    level: _Level  # its contexts are numbers of context_keys
    context_keys: np.ndarray
    context_totals: np.ndarray
    words: np.ndarray  # the hashes of the level's tokens, their places in texts, and whether they are learned from
    offset: np.ndarray
    train: np.ndarray
    closed: np.ndarray  # known words, base scores and scores of all other tokens, by text

    def packed(self) -> bytes:
        return zstandard.compress(pickle.dumps(self), 1)


def _rest(chain: _Chain, depth: int, found: np.ndarray, sums: np.ndarray, log_p: np.ndarray, open_share: int) -> _Rest | None:
    """What the batch takes along when the level of a depth has been asked for; None if it is much. sums: by text, with all tokens' log_p."""
    batch, level = chain.batch, chain.batch.levels[depth]
    at, context, key = chain.tested(depth - 1)
    if len(at) * open_share > batch.n:
        return None
    closed = log_p.copy()
    closed[at] = 0
    contexts, number = np.unique(level.context, return_inverse=True)
    own = _Level(level.at, number.astype(np.int32), level.keys, level.key)
    word = batch.levels[0]
    return _Rest(
        at, np.searchsorted(found, context), chain.p[at], chain.q[at], *chain.within(depth - 1, at, context, key), own, batch.levels[depth - 1].keys[contexts],
        chain.totals[depth - 1][contexts], word.keys[word.key[level.at]], batch.offset[level.at], batch.train[level.at], np.stack([sums[0], sums[1], np.add.reduceat(closed, batch.starts)]),
    )


def _go_on(rest: _Rest, depth: int, strength: tuple[float, ...], totals: np.ndarray, stays: np.ndarray, starts: np.ndarray) -> tuple[_Rest, np.ndarray, np.ndarray, np.ndarray]:
    """The next round's rest, tested contexts' keys and gains, and scores, from the answers to the level of depth - 1."""
    here = stays[rest.place]
    p, q = np.where(here, rest.longer_p, rest.p), np.where(here, rest.longer_q, rest.q)
    by_text = lambda at, x: np.bincount(np.searchsorted(starts, at, "right") - 1, x, minlength=len(starts))
    scores = np.stack([rest.closed[0], rest.closed[1], rest.closed[2] + by_text(rest.at, np.log10(p))])
    # Tokens of the level are among those that were tested.
    level, among = rest.level, np.searchsorted(rest.at, rest.level.at)
    open_ = here[among]
    at, context, mine = level.at[open_], level.context[open_], among[open_]
    longer_p, longer_q = _within(totals[level.key[open_]], rest.context_totals[context], _strength(strength, depth - 1), p[mine], q[mine])
    own = rest.train[open_]
    found, gains = _gained(context, context[own], np.log(longer_q[own] / q[mine][own]), len(rest.context_keys))
    left = np.ones(len(rest.at), bool)
    left[mine] = False
    closed = np.stack([*rest.closed[:2], rest.closed[2] + by_text(rest.at[left], np.log10(p[left]))])
    follows = np.flatnonzero((np.diff(level.at) == 1) & (rest.offset[1:] >= depth) & open_[1:] & (totals[level.key[:-1]] >= LEAST)) + 1
    contexts, number = np.unique(level.key[follows - 1], return_inverse=True)
    deeper = _Level(level.at[follows], number.astype(np.int32), *_numbered(_longer(level.keys[level.key[follows - 1]], rest.words[follows])))
    new = _Rest(at, np.searchsorted(found, context), p[mine], q[mine], longer_p, longer_q, deeper, level.keys[contexts], totals[contexts], rest.words[follows], rest.offset[follows], rest.train[follows], closed)
    return new, rest.context_keys[found], gains, scores


def _own_row(number: int, ids: bytes, flags: bytes, sizes: bytes, scores: np.ndarray, rest: _Rest | None) -> pd.DataFrame:
    return pd.DataFrame([{"range": -1 - number, "batch": number, "ids": ids, "flags": flags, "sizes": sizes, "scores": scores.tobytes(), "rest": rest and rest.packed()}])


def _questions(depth: int, sizes: tuple[int, int], strength: tuple[float, ...], n_ranges: int, open_share: int):
    """What a batch asks in the round of a depth, when the answers to all rounds before are there, and its scores by them."""

    def ask(number: int, batch: _Batch, totals: list[np.ndarray], stays: list[np.ndarray]) -> pd.DataFrame:
        chain = _walk(batch, sizes, strength, totals, stays)
        found, gains = chain.contexts(depth - 1)
        context_keys = batch.levels[depth - 2].keys[found]
        batch.deepen(totals[depth - 1], chain.deep >= depth - 2)
        level = batch.levels[depth]
        out = _messages(number, batch.train[level.at], level, context_keys, gains, n_ranges)
        add = lambda x: np.add.reduceat(x, batch.starts)
        word = batch.levels[0]
        by_word = lambda x: add(x[word.key])
        base = np.log10((totals[0] + 1) / (sizes[0] + sizes[1] + 1))
        log_p = base[word.key]
        at = np.flatnonzero(chain.deep)
        log_p[at] = np.log10(chain.p[at])
        scores = np.stack([by_word((totals[0] > 0).astype(float)), by_word(base), add(log_p)])
        own = _own_row(number, batch.ids, batch.flags, batch.sizes.tobytes(), scores, _rest(chain, depth, found, scores, log_p, open_share))
        return pd.concat([out, own], ignore_index=True)[out.columns]

    return ask


def _rest_questions(rests: DataFrame, answers: DataFrame, depth: int, strength: tuple[float, ...], n_ranges: int) -> DataFrame:
    """_questions of batches that have taken their tokens along; they need the last answers only."""

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, right = left.iloc[0], right.sort_values("range")
        totals = np.concatenate([np.zeros(0, np.int64), *(_integers(x).astype(np.int64) for x in right["totals"])])
        stays = np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool) for x in right["stays"])])
        ends, number = np.cumsum(np.frombuffer(row["sizes"], np.int32)), int(row["batch"])
        starts = np.concatenate([[0], ends[:-1]])
        rest, context_keys, gains, scores = _go_on(pickle.loads(zstandard.decompress(row["rest"])), depth, strength, totals, stays, starts)
        out = _messages(number, rest.train, rest.level, context_keys, gains, n_ranges)
        return pd.concat([out, _own_row(number, row["ids"], row["flags"], row["sizes"], scores, rest)], ignore_index=True)[out.columns]

    found = answers.filter("batch is not null and range >= 0").select(F.col("batch").alias("batch"), "range", "totals", "stays")
    return rests.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(together, _ASKED)


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text from the scores of batches."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            flags = np.frombuffer(row.flags, np.uint8)
            ids = pd.array(np.frombuffer(row.ids, np.int64), "Int64")
            ids[flags & _NAMELESS > 0] = pd.NA
            known, base, score = np.frombuffer(row.scores, float).reshape(3, -1)
            yield pd.DataFrame({"id": ids, "train": flags & _TRAIN > 0, "n_tokens": np.frombuffer(row.sizes, np.int32).astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": score})


_SCORES = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", min_gain: float = MIN_GAIN, strength: tuple[float, ...] = STRENGTH) -> DataFrame:
    """One row per row of docs: id_col, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a SQL condition on docs that picks the rows to learn from; a null verdict is false.
    A-Z are lower-cased, words are what stands between blanks, and an end follows the last word. A null
    or empty text is one end. Without training rows every probability is 1 in the base and the score.
    n_known counts tokens that occur in training. Scores are sums of log10 probabilities. Repeated rows
    count and are scored each; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    guess = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / TOKEN_BYTES
    growth = max(1.0, (guess / LINEAR_TOKENS) ** 0.5)
    name, n_buckets = f"tokens_{uuid.uuid4().hex}", shuffle_partitions(spark)
    tokens = rows.mapInArrow(_tokenize(int(BATCH_TOKENS * growth)), _TOKENS)
    tokens.write.bucketBy(n_buckets, "batch").option("compression", "zstd").option("path", shared_path(spark, "tokens")).saveAsTable(name)
    try:
        tokens = spark.table(name)
        counts = tokens.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train"), F.count("*").alias("batches")).first()
        n_ranges = max(n_buckets, int(-(-(counts["all"] or 0) // (RANGE_TOKENS * growth))))
        first = materialize(_answers(_first_questions(tokens, n_ranges), min_gain), "answers")
        answers = [first.filter(F.col("range") < n_ranges), first.filter(F.col("range") >= n_ranges)]
        sizes, staying = (counts["train"] or 0, answers[0].agg(F.sum("known")).first()[0] or 0), 1
        while staying:  # contexts of one word less than is asked for are tested; if none stays, the scores without them stand
            depth = len(answers)
            rests = answers[-1].filter("range < 0 and rest is not null").select(F.col("batch").alias("batch"), "ids", "flags", "sizes", "rest")
            few, asked, some = rests.count(), None, F.broadcast(rests.select(F.col("batch").alias("of")))
            if not few or few < counts["batches"]:  # an empty table has no batches
                without = (lambda df: df.join(some, F.col("batch") == F.col("of"), "left_anti")) if few else lambda df: df
                asked = _with_answers(without(tokens), [without(a) for a in answers], _questions(depth, sizes, strength, n_ranges, OPEN_SHARE), _ASKED)
            if few:
                last = answers[-1].join(some, F.col("batch") == F.col("of"), "left_semi")
                more = _rest_questions(rests, last, depth, strength, n_ranges)
                asked = asked.unionByName(more) if asked else more
            answers.append(materialize(_answers(asked, min_gain), "answers"))
            staying = answers[-1].agg(F.sum("staying")).first()[0]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scored = answers[-1].filter("range < 0").select("ids", "flags", "sizes", "scores").mapInPandas(_unpacked, _SCORES)
    return scored.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(sizes[0]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents, learned from those outside the held-out fold; a null id is in fold 0. See score_texts."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    out = score_texts(docs, train="not held_out")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
