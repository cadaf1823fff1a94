"""Phrase mining, vector codes and decontamination against plain versions of themselves and their SQL."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.llm import collocations, decontamination, queries, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_phrases", "op12_vector_codes", "op13_decontamination"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(want.fetchall()) == Counter(tuple(r) for r in got.select(columns).collect())


# --- phrases -----------------------------------------------------------------------------------


def plain_phrases(rows, min_count, max_words, covered):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(a, inside.get((lang, p[i : i + m]), 0))
    out = set()
    for (lang, p), a in often.items():
        if 100 * inside.get((lang, p), 0) >= covered * a and (lang, p) in inside:
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.add((lang, " ".join(p), a, left, right, n[lang], score))
    return out


def phrase_rows():
    r = random.Random(3)
    words = "a b c d é 日本 in the of END".split()
    rows = [(k, " ".join(r.choice(words) + r.choice(["", "", "", ".", "\n", ",", "\t"]) for _ in range(r.randrange(200))), r.choice(["en", "de", None, "und"])) for k in range(60)]
    rows += [(None, None, "en"), (70, "", None), (71, "x " * 5000, "fr"), (71, "x " * 5000, "fr"), (72, " \t . ! ", "es"), (73, "a" * 70_000 + " b", "en"), (74, "the\x00of the\x00of " * 9, "de")]
    return rows


@pytest.mark.parametrize(("min_count", "max_words", "parts"), [(3, 4, 5), (8, 3, 1), (5, 2, 2)])
def test_phrases(spark, monkeypatch, min_count, max_words, parts):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts).selectExpr("*", "1 as shard", "'z' as word", "2 as a", "3 as ids", "4 as n")
    found = collocations.mine_phrases(docs, min_count=min_count, max_words=max_words)
    assert {tuple(r) for r in found.collect()} == plain_phrases(rows, min_count, max_words, collocations.COVERED)


def test_first_phrases_are_ranked_by_score_count_and_bytes(spark):
    rows = [("en", "b a", 3, 9), ("en", "a b", 3, 9), ("en", "é a", 3, 9), ("en", "z z", 4, 9), ("en", "low x", 9, 1), ("de", "q r", 1, 1)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, a long, score long").selectExpr("*", "0L as l", "0L as r", "0L as n")
    got = [(r["lang"], r["rank"], r["phrase"]) for r in collocations.top_phrases(phrases, 4).orderBy("lang", "rank").collect()]
    assert got == [("de", 1, "q r"), ("en", 1, "z z"), ("en", 2, "a b"), ("en", 3, "b a"), ("en", 4, "é a")]


def test_no_phrases(spark, empty):
    assert collocations.mine_phrases(empty).collect() == []
    assert collocations.mine_phrases(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).collect() == []


def test_bitmaps_are_words_positions():
    tokens = np.array([5, 5, -1, 7, 5] * 40, np.int32)
    shard = collocations.Shard(tokens)
    (run,) = shard.runs()
    assert run.popcounts().tolist() == [120, 40] and np.bitwise_count(shard.every).sum() == 160
    pairs = shard.extended(run, shard.every)  # runs of three 5s meet at the ends of records
    assert {tuple(shard.ids[w]): n for w, n in zip(pairs.words, pairs.popcounts(), strict=True)} == {(5, 5): 79, (7, 5): 40}


# --- vector codes ------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    first = {}
    for i, x in kept:
        first[i] = min(first[i], tuple(x)) if i in first else tuple(x)
    ids = sorted((i for i in first if i is not None))[:entries]
    if None in first and len(ids) < entries:
        ids.append(None)
    x = np.array([v for _, v in kept]).reshape(len(kept), parts, -1)
    books = np.array([first[i] for i in ids]).reshape(len(ids), parts, -1)
    for turn in range(rounds + 1):
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        near = d.argmin(axis=1)
        if turn < rounds:
            for p in range(parts):
                for e in range(len(ids)):
                    own = x[near[:, p] == e, p]
                    if len(own):
                        books[e, p] = own.sum(axis=0) // len(own)
    error = d.min(axis=1).sum(axis=1)
    return Counter((i, "".join(f"{e:02x}" for e in n), int(err)) for (i, _), n, err in zip(kept, near, error, strict=True)), books.swapaxes(0, 1)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (2, 64, 5), (8, 3, 0), (4, 1, 2)])
def test_vector_codes(spark, parts, entries, rounds):
    r = np.random.default_rng(parts)
    rows = [(k * 3, [float(x) for x in np.round(r.normal(size=8), 1 + k % 2).astype(np.float32)]) for k in range(1500)]
    rows += [rows[0], rows[9], (None, rows[4][1]), (None, rows[5][1]), (6, [0.5] * 8), (3, [-9.0] * 8)]
    bad = [(-1, None), (-2, [1.0, None] * 4), (-3, [float("nan")] * 8), (-4, [float("inf")] + [0.0] * 7), (5000, [1.0] * 4), (5001, [])]
    shown = [(i, v, None if i is None or i % 4 == 0 else "odd") for i, v in rows + bad]
    table = spark.createDataFrame(shown, "vec_id long, embedding array<float>, label string").repartition(3).selectExpr("*", "1 as id", "2 as x", "'c' as code", "4 as error", "5 as v", "6 as start")
    codes, books = vector_codes.encode_vectors(table, parts=parts, entries=entries, rounds=rounds)
    want, want_books = plain_codes(rows, parts, entries, rounds)
    assert (books == want_books).all()
    assert Counter((c["vec_id"], c["code"], c["error"]) for c in codes.collect()) == want
    back = vector_codes.decode_codes(codes.limit(5), books).collect()
    for c in back:
        assert c["decoded"] == [x / 256 for p, e in enumerate(bytes.fromhex(c["code"])) for x in books[p][e].tolist()]


def test_heaps_pop_only_what_the_drift_has_used_up():
    x = np.array([[0, 0], [100, 0], [49, 0], [1, 1]])
    books = np.array([[[0, 0], [100, 0]]])
    near, keys = vector_codes._pushed(x, books[0], np.zeros(2))
    heaps = [[int(k) << vector_codes.BLOCK_BITS | i for i, k in enumerate(keys) if near[i] == e] for e in range(2)]
    for heap in heaps:
        heap.sort()
    moved = np.array([[[0, 0], [97, 0]]])
    popped, before = vector_codes._settle(x, near, heaps, moved[0], vector_codes._drifted(books, moved)[0])
    assert popped.tolist() == [2] and before.tolist() == [0] and near.tolist() == [0, 1, 1, 0]


def test_vectors_without_rows_or_beyond_the_range(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, books = vector_codes.encode_vectors(spark.createDataFrame([], schema))
    assert codes.collect() == [] and books.size == 0
    assert vector_codes.encode_vectors(spark.createDataFrame([(1, None, 1), (2, [], 2)], schema))[0].collect() == []
    with pytest.raises(Exception, match="do not fit"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))[0].collect()
    with pytest.raises(ValueError, match="no 16 equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 17, 1)], schema))


# --- decontamination ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_hits(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc_id, len(w), sorted(hit), sorted(x for x in found if x is not None)))
    return out


def leak_tables():
    r = random.Random(5)
    pool = [f"w{k}" for k in range(40)] + ["É", "é", "日本", "K", "2x"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(k, text(r.randrange(1, 40))) for k in range(30)]
    items += [(40, None), (41, "--- !"), (None, text(15)), (42, items[3][1]), (3, text(14)), (43, "Kelvin K sign İ one two three four five six"), (44, "six w1 w2")]
    docs = [(k, text(r.randrange(0, 120))) for k in range(60)]
    for k in range(40):
        w = words(items[k % len(items)][1])
        at = r.randrange(0, len(w) + 1)
        docs.append((100 + k, text(r.randrange(5)) + "; " + "\n".join(w[at : at + r.randrange(5, 30)]).upper() + "!" + text(r.randrange(9))))
    docs += [(200, None), (201, ""), (202, "\x00\x7f"), (203, docs[60][1]), (None, docs[60][1]), (204, docs[61][1]), (204, docs[61][1]), (205, text(30_000)), (206, "kelvin k sign i̇ one two three four five six"), (207, "Kelvin K SIGN İ one two three four five six"), (208, "Kelvin K sign İ one two three four five six")]
    return docs, items


@pytest.fixture(scope="module")
def leaks(spark):
    docs, items = leak_tables()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as id", "2 as row", "'h' as hit", "3 as h", "4 as words", "5 as items", "6 as window").cache()
    return docs, items, table, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 as item", "8 as size", "9 as words")


def test_hits(leaks):
    docs, items, table, bench = leaks
    marked = decontamination.mark_hits(table, decontamination.benchmark_windows(bench)).collect()
    want = Counter((i, n, len(hit), tuple(ids), bool(hit)) for i, n, hit, ids in plain_hits(docs, items))
    assert Counter((m["doc_id"], m["n_words"], m["n_hit"], tuple(m["items"]), m["contaminated"]) for m in marked) == want
    by_id = {i: len(hit) for i, _, hit, _ in plain_hits(docs, items)}
    assert by_id[208] > by_id[206]  # other letters that only full lower-casing makes equal are no hits


def test_a_set_in_blocks_finds_the_same(leaks):
    docs, items, table, bench = leaks
    hits = decontamination.find_hits(table, decontamination.benchmark_windows(bench), block_bytes=60_000)
    want = {(i, tuple(hit), tuple(ids)) for i, _, hit, ids in plain_hits(docs, items) if hit}
    assert {(h["id"], tuple(h["hit"]), tuple(h["items"])) for h in hits.collect()} == want


def test_removal(leaks):
    docs, items, table, bench = leaks
    windows = decontamination.benchmark_windows(bench)
    hits = {(i, t): set(hit) for (i, t), (_, _, hit, _) in zip(docs, plain_hits(docs, items), strict=True)}
    kept = {(r["doc_id"], r["kept_text"]) for r in decontamination.remove_spans(table, windows).collect()}
    piece = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*")

    def cut(text, hit):
        pieces, text = piece.findall(text or ""), text or ""
        return text if not hit else text[: len(text) - len("".join(pieces))] + "".join(p for k, p in enumerate(pieces) if k not in hit)

    assert kept == {(i, cut(t, hit)) for (i, t), hit in hits.items()}
    left = decontamination.remove_documents(table, windows)
    assert left.columns == table.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, t) for i, t in docs if not hits[i, t])


def test_without_items_or_documents(spark, leaks, empty):
    _, _, table, bench = leaks
    none = decontamination.mark_hits(table, decontamination.benchmark_windows(bench.limit(0))).filter(F.col("contaminated") | (F.size("items") > 0))
    assert none.collect() == []
    assert decontamination.mark_hits(empty, decontamination.benchmark_windows(bench)).collect() == []
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0]
