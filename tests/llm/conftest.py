"""Small document tables with the odd cases every operator has to take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strong potions for every quiet village near old mill".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    rows = [(k, prose(k, 40 + k), "en" if k % 3 else None, f"src{k % 3}" if k % 4 else None, 7) for k in range(40)]
    rows += [
        (100, None, "en", "src0", None),
        (101, "", None, None, 0),
        (102, " \t\n\n  \x0b", "en", "src1", 6),
        (103, prose(3, 43), "en", "src0", 5),  # a copy of 3
        (104, prose(3, 43).upper(), "en", "src0", 5),
        (104, prose(3, 43).upper(), "en", "src0", 5),  # a row twice
        (105, prose(5, 60_000), "en", "src0", 5),  # very long
        (None, prose(7, 47), "en", "src1", 5),  # without an id, a copy of 7
        (106, "ünï 日本語 ▁▁ é   x <|endoftext|> y\r\n\r\n   z", "ja", "src2", 5),
        (107, "one\none\nshared line of text\n\none", "en", "src2", 5),
        (108, "SHARED line of text \nanother\n", "en", "src2", 5),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with more columns of names that operators use inside."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.selectExpr("*", "1 as id", "'x' as prefix", "2 as rep", "3 as mask", "'y' as key", "4 as cell", "5 as n_words", "6 as rate", "7 as batch", "8 as pos", "9 as line", "0.5D as quality_score", "'k' as kept", "'t' as train", "10 as fp", "11 as n", "'z' as row", "12 as component_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
