"""Encoding and decoding with a SentencePiece BPE model, with seeded merge-dropout.

Symbols merge in the model's order, the best score first and then from the left. Each candidate that
comes up is skipped if a hash keyed by seed, document, unit and candidate falls under the dropout rate;
it comes up again only when one of its two symbols has changed. So the segmentation of a word varies
from place to place, and any of them decodes to the text.

No piece holds a blank after another character, so merges stay inside units of blanks and a word. A
task runs the agendas of many units side by side: a row of an array for each, one candidate of every
row at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read_table

MODEL = "piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 42
#: Units of up to so many characters share an array; longer ones have an agenda of their own.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32)
#: Rows of an array, and characters of the texts that are encoded together.
ROWS, CHARS = 16_384, 1 << 19
_NEVER = np.int32(2**31 - 1)
#: Fills a row; a character c without a piece is -1 - c.
_FILL = np.int32(-1 - 0x110000)
_ODD, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of an array of uint64."""
    x = (x ^ x >> np.uint64(30)) * _MIX_1
    x = (x ^ x >> np.uint64(27)) * _MIX_2
    return x ^ x >> np.uint64(31)


def _without(table: np.ndarray, at: np.ndarray, fill: int) -> np.ndarray:
    """table with the column after at taken out of each row; a row whose at is the width stays."""
    moved = np.empty_like(table)
    moved[:, :-1], moved[:, -1] = table[:, 1:], fill
    return np.where(np.arange(table.shape[1]) <= at[:, None], table, moved)


class _Pairs:
    """What two symbols merge into, in a table of hashed pairs, and how early."""

    BITS = 20

    def __init__(self, id_of: dict[str, int], rank: np.ndarray) -> None:
        found = [(id_of[t[:k]], id_of[t[k:]], i) for t, i in id_of.items() for k in range(1, len(t)) if t[:k] in id_of and t[k:] in id_of]
        left, right, merged = np.array(found, np.int64).T
        key = left << 32 | right
        self.keys, self.merged, self.rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int32), np.append(rank, _NEVER)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.merged[slot[free]] = key[free], merged[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = self._next(slot[todo])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _ODD >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.BITS) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the merged piece, -1 where there is none. Symbols below 0 merge with nothing."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        met = self.keys[slot]
        out = np.where(met == key, self.merged[slot], np.int32(-1))
        more = (met != key) & (met >= 0) & (key >= 0)
        if more.any():
            key, slot, rest = key[more], slot[more], np.full(np.count_nonzero(more), -1, np.int32)
            todo = np.arange(len(key))
            while len(todo):
                slot[todo] = self._next(slot[todo])
                met = self.keys[slot[todo]]
                hit = met == key[todo]
                rest[todo[hit]] = self.merged[slot[todo[hit]]]
                todo = todo[~hit & (met >= 0)]
            out[more] = rest
        return out


class PieceCoder:
    """Encodes and decodes with the pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str, dropout: float, seed: int) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(model))
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        # The model writes a blank as U+2581. Here pieces have the blank itself, and U+2581 in a text is a character like any other.
        text_of = {i: model.id_to_piece(i).replace("\u2581", " ") for i in plain}
        self.id_of = {t: i for i, t in text_of.items()}
        if any(" " in t.lstrip(" ") or "\n" in t for t in text_of.values()):
            raise ValueError(f"{path}: pieces that reach over a blank or a line end")
        rank = np.full(len(model), _NEVER, np.int32)
        for t, i in self.id_of.items():
            if len(t) > 1:
                rank[i] = -model.get_score(i)
        self.pairs = _Pairs(self.id_of, rank)
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = [text_of[i].encode() if i in text_of else b"" for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        #: By code point the piece of one character, or below 0 one that has none.
        self.id_of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for t, i in self.id_of.items():
            if len(t) == 1:
                self.id_of_char[ord(t)] = i
        self.under, self.seed = np.uint64(int(dropout * (1 << 64))), seed

    def skipped(self, base: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k-th candidates (from 0) of units are passed over."""
        return _mixed(base + (k.astype(np.uint64) + np.uint64(1)) * _ODD) < self.under

    def _merge_rows(self, symbols: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Runs the agenda of each row; what is left of a row comes first, then _FILL."""
        rank_of, out, rows, n = self.pairs.rank, symbols.copy(), np.arange(len(symbols)), 0
        merged = self.pairs(symbols[:, :-1], symbols[:, 1:])
        ranks = rank_of[merged]
        width = symbols.shape[1]
        while len(rows):
            best = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), best] != _NEVER
            if np.count_nonzero(live) < 0.85 * len(rows):
                out[rows[~live]] = symbols[~live]
                symbols, ranks, merged, rows, base, best = (x[live] for x in (symbols, ranks, merged, rows, base, best))
                live = np.ones(len(rows), bool)
            skip = self.skipped(base, np.full(len(rows), n)) & live
            n += 1
            ranks[skip, best[skip]] = _NEVER
            go = np.flatnonzero(live & ~skip)
            at = np.full(len(rows), width)
            at[go] = best[go]
            symbols[go, at[go]] = merged[go, at[go]]
            symbols, ranks, merged = _without(symbols, at, _FILL), _without(ranks, at, _NEVER), _without(merged, at, -1)
            for shift, row in ((0, go[at[go] < width - 1]), (1, go[at[go] > 0])):
                pair = at[row] - shift
                new = self.pairs(symbols[row, pair], symbols[row, pair + 1])
                merged[row, pair], ranks[row, pair] = new, rank_of[new]
        return out

    def merge_one(self, symbols: list[int], skip: Callable[[int], bool]) -> list[int]:
        """The agenda of one unit, in n log n: the candidate of the lowest rank next, skip(k) says whether the k-th is passed over."""
        after, before, agenda = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], []

        def propose(places: list[int]) -> None:
            left = np.array([i for i in places if i >= 0 and after[i] >= 0], np.int64)
            a, b = (np.array([symbols[i] for i in x], np.int32) for x in (left, [after[i] for i in left]))
            for i, x, y, new in zip(left.tolist(), a.tolist(), b.tolist(), self.pairs(a, b).tolist(), strict=True):
                if new >= 0:
                    heapq.heappush(agenda, (int(self.pairs.rank[new]), i, x, y, new))

        propose(list(range(len(symbols))))
        gone, n = object(), 0
        while agenda:
            _, i, left, right, new = heapq.heappop(agenda)
            if symbols[i] != left or (j := after[i]) < 0 or symbols[j] != right:
                continue  # one of the two has merged meanwhile
            n += 1
            if skip(n - 1):
                continue
            symbols[i], symbols[j], after[i] = new, gone, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose([before[i], i])
        return [s for s in symbols if s is not gone]

    def encode(self, texts: list[str], keys: list) -> list[np.ndarray]:
        """Ids of each text. Its key tells a text's draws from those of others. An empty text has no ids."""
        marked = [" " + t if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in marked], np.int64)
        ends = np.cumsum(sizes)
        blank, line = points == 32, points == 10
        new = line | (blank & ~np.append(False, blank[:-1])) | np.append(False, line[:-1])
        new[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(points)))
        first_unit = np.searchsorted(start, ends - sizes)
        text_of_unit = np.repeat(np.arange(len(texts)), np.diff(np.append(first_unit, len(start))))
        seeds = np.array([xxhash.xxh64_intdigest(f"{self.seed} {k}") for k in keys], np.uint64)
        base = _mixed(seeds[text_of_unit] + (np.arange(len(start)) - first_unit[text_of_unit] + 1).astype(np.uint64) * _ODD)
        symbols, stays = self.id_of_char[points], np.ones(len(points), bool)
        for low, high in zip((1, *WIDTHS), WIDTHS, strict=False):
            units = np.flatnonzero((length > low) & (length <= high))
            for k in range(0, len(units), ROWS):
                at = units[k : k + ROWS]
                place = start[at, None] + np.arange(high)
                inside = np.arange(high) < length[at, None]
                left = self._merge_rows(np.where(inside, symbols[np.minimum(place, len(points) - 1)], _FILL), base[at])
                symbols[place[inside]], stays[place[inside]] = left[inside], (left != _FILL)[inside]
        for u in np.flatnonzero(length > WIDTHS[-1]):
            a, b = start[u], start[u] + length[u]
            left = self.merge_one(symbols[a:b].tolist(), lambda k, u=u: bool(self.skipped(base[u : u + 1], np.array([k]))[0]))
            symbols[a : a + len(left)], stays[a + len(left) : b] = left, False
        return self._cut(symbols[stays], np.append(0, np.cumsum(stays))[np.append(0, ends)])

    def _cut(self, symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, characters without a piece as the pieces of their bytes."""
        bare = np.flatnonzero(symbols < 0)
        if not len(bare):
            return [symbols[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        as_bytes = [self.byte_ids[list(chr(-1 - s).encode())] for s in symbols[bare].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[bare] = [len(b) for b in as_bytes]
        spread = np.repeat(symbols, width)
        spread[spread < 0] = np.concatenate(as_bytes)
        ends = np.append(0, np.cumsum(width))[ends]
        return [spread[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8, which no encoded text has, become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(2)
def _coder(path: str, dropout: float, seed: int) -> PieceCoder:
    return PieceCoder(path, dropout, seed)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, text_col, the columns to keep, piece_ids array<int>.

    Draws are keyed by seed and id, so a run repeats them and rows of one id and text agree; null ids
    share one key. Without dropout the ids are the library's own, but for U+2581 in a text, which is
    kept apart from blanks as bytes. Null and empty texts have no ids. ``model`` is a path that every
    executor can open, by default the installed piece_bpe_32k.model. Other columns than those named are
    ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model or public_tokenizers.path(MODEL), dropout, seed)
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy()
            group = (np.cumsum(chars) - chars) // CHARS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)] if len(batch) else []
            for a, b in zip(cuts, cuts[1:], strict=False):  # a group has CHARS characters, and the rest of its last text
                part = batch.slice(a, b - a)
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()], part.column("id").to_pylist())
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    kept = F.struct(*(docs[c] for c in keep)) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), kept.alias("kept"))
    schema = T.StructType([*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(encode, schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col("kept")[c].alias(c) for c in keep), "piece_ids")


def decode_pieces(rows: DataFrame, ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """rows with a column decoded appended: the text of ids_col, empty for null or no ids."""

    @F.pandas_udf("string")
    def decoded(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(model or public_tokenizers.path(MODEL), 0.0, 0)
        for frame in frames:
            yield frame.map(lambda ids: "" if ids is None else coder.decode(np.asarray(ids)))

    return rows.withColumn("decoded", decoded(ids_col))


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents and whether they decode to the text. Null and empty texts have none; see encode_pieces."""
    bound_batches(spark)
    out = decode_pieces(encode_pieces(read_table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )
