"""Exact byte-level BPE token counts at every prefix of a text.

Dynamic programming over a piece of text: the encoding of its first i bytes ends in the one token t
for which the encoding before t ends in a token that may stand next to t, so the count at i is the
count before t plus one. Two tokens may stand next to each other if merging their joined bytes gives
just these two. The counts of all prefixes answer truncation and budget questions without encoding
anything again.

Spark deals the texts out; a task keeps a bounded table of the pieces it has met.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: A task keeps two generations of so many pieces at most, and never longer ones.
KNOWN_PIECES, KNOWN_CHARS = 400_000, 40
_SPLIT_CONTRACTION = ("'re", "'ve", "'ll")


def _byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of a byte-level BPE vocabulary in the tokenizers JSON format.

    Tokens are numbered by the order of their merges, single bytes first.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_bytes = _byte_of_char()
        to_bytes = lambda token: bytes(as_bytes[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        number = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.whole: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            left, right = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            k = number.setdefault(left + right, len(self.halves))
            self.whole[number[left], number[right]] = k
            if k == len(self.halves):
                self.halves.append((number[left], number[right]))
        #: From a token's last byte back to its first; None leads to the number of the token that ends there.
        self.backwards: dict = {}
        for token, k in number.items():
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = k
        self.joins = lru_cache(1 << 18)(self._joins)
        self.known: dict[str, bytes] = _Known(self)

    def _joins(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when the bytes of both are merged from scratch.

        Undoes the merges of both sides next to the border, the latest first. If what then touches could
        merge before the merge just undone, that merge would never have come about.
        """
        undone = 1 << 40
        while True:
            if self.whole.get((left, right), undone) < undone:
                return False
            if left > right:
                if left < 256:
                    return True
                undone, left = left, self.halves[left][1]
            else:
                if right < 256:
                    return True
                undone, right = right + 1, self.halves[right][0]  # of equal merges, the one further left comes first

    def piece_counts(self, piece: str) -> bytes:
        """Tokens of piece[:1], piece[:2], ... as if each stood alone, as the bytes of an int32 array."""
        data, backwards, joins = piece.encode(), self.backwards, self.joins
        last, count = [-1], [0]
        for end, byte in enumerate(data):
            node, start, ending = backwards[byte], end, []
            while node:
                if None in node:
                    ending.append((start, node[None]))
                if not start:
                    break
                start -= 1
                node = node.get(data[start])
            for start, token in reversed(ending):
                if not start or joins(last[start], token):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        if piece in _SPLIT_CONTRACTION:
            count[2] = 2  # without its last letter it is no contraction: an apostrophe and a letter
        if len(data) == len(piece):
            return array("i", count[1:]).tobytes()
        return array("i", [n for n, b in zip(count[1:], (*data[1:], 0), strict=True) if not 0x80 <= b < 0xC0]).tobytes()

    def plain_prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:1], text[:2], ... for a text without special tokens."""
        pieces = self.pieces.findall(text)
        if not pieces:
            return np.zeros(0, np.int32)
        within = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32)
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        totals = within[np.cumsum(sizes) - 1]
        out = within + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, sizes)
        # A prefix that ends in white space has all of that run as one piece, which the whole text splits.
        for run in _BLANK_RUN.finditer(text):
            a, b = run.span()
            out[b - 1] = (out[a - 1] if a else 0) + np.frombuffer(self.known[run[0]], np.int32)[-1]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text[:]: one number more than text has code points."""
        parts = self.special.split(text) if self.special else [text]
        out, base = [np.zeros(1, np.int32)], 0
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            counts = self.plain_prefix_counts(parts[k] + special[:-1])  # a cut special token is plain text
            out.append(base + counts)
            base += int(counts[len(parts[k]) - 1]) if parts[k] else 0
            if special:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)


_BLANK_RUN = regex.compile(r"\s{2,}(?=\S)")


class _Known(dict):
    """Counts of the pieces met so far: two generations within bounds, so that what is met often stays."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter, self.older = counter, {}

    def __missing__(self, piece: str) -> bytes:
        if (counts := self.older.get(piece)) is None:
            counts = self.counter.piece_counts(piece)
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = counts
        return counts


@lru_cache(1)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, text_col, prefix_tokens.

    prefix_tokens[i] (from 0) is the exact token count of the first i code points, so its last element
    is the text's own. A null text counts as empty and gives [0]. Strings of special tokens inside a
    text count as that one token, as the library does by default. ``vocabulary`` is the path of a
    byte-level BPE in the tokenizers JSON format that every executor can open; by default the installed
    byte_bpe_50k.json. Repeated rows give repeated rows; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            for row in range(len(batch)):  # one text at a time: its counts take four bytes a character
                one = batch.slice(row, 1)
                counts = counter.prefix_counts(one.column("text")[0].as_py() or "")
                lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([one.column("id"), one.column("text"), lists], names=["id", "text", "prefix_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(count, schema).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "prefix_tokens")


def chars_within(prefix_tokens: str | Column, budget: int | Column) -> Column:
    """The most code points, from the start of the text, that take at most budget tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i).otherwise(F.lit(-1)))
    return F.array_max(fits)


def tokens_within(prefix_tokens: str | Column, chars: int | Column) -> Column:
    """The token count of the first chars code points; beyond the text, that of all of it."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents. A null text counts as empty, with no tokens; see prefix_token_counts."""
    out = prefix_token_counts(read_table(spark, sf_dir, "documents"))
    n_tokens = F.element_at("prefix_tokens", -1).cast("long")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), n_tokens.alias("n_tokens"), (n_tokens > MAX_TOKENS).alias("over_limit"))
