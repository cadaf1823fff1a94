"""Folds and sweeps over files of any size, against plain passes over whole files."""

from __future__ import annotations

import pickle
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cinderlake.config import ChunkingConfig
from cinderlake.operators import blocks, folds, packing

CONFIG = ChunkingConfig()
SCHEMA = "filepath string, symbol_type string, start_line int, end_line int, pos int, n_tokens int, code string"


def plain_packs(rows):
    """(path, pos) -> (place, pack) by one pass over each file."""
    files, out = {}, {}
    for r in rows:
        files.setdefault(r[0] or "", []).append(r)
    for path, own in files.items():
        classes = [r for r in own if r[1] == "Class"]
        if len(classes) == 1 and len(own) > 1 and classes[0][5] <= CONFIG.ceiling:
            own = classes
        elif len(classes) < len(own):
            own = [r for r in own if r[1] != "Class"]
        own.sort(key=lambda r: (r[2], -r[3], r[4]))
        pack, current, is_open = -1, 0, False
        for place, r in enumerate(own):
            large = r[5] > CONFIG.oversized_tokens
            if is_open and not large and CONFIG.absorbs(current, r[5]):
                current += r[5]
            else:
                pack, current = pack + 1, r[5]
            is_open = not large
            out[path, r[4]] = place, pack
    return out


def file_rows(seed, n_large=3000):
    r = random.Random(seed)
    rows = []
    for path, n in [("large.py", n_large), *((f"f{k}.py", r.randrange(1, 30)) for k in range(60)), (None, 7), ("", 3)]:
        base = 1000 if path == "" else 0  # '' and null are one file
        for k in range(n):
            start = r.randrange(1, 3 * n)
            kind = r.choices(["Function", "Class", "Method", None], [8, 0 if n < 10 and k else 1, 2, 0.2])[0]
            rows.append((path, kind, start, start + r.choice([0, 1, 2, 5, 40]), base + k, r.choice([0, 1, 20, 100, 250, 300, 349, 400, 700, 750, 751, 1300, 2000]), f"class C{k} {{" if k % 3 else " \n"))
    return rows


@pytest.mark.parametrize(("seed", "piece_rows"), [(1, 4096), (2, 7)])
def test_packs_over_partitions(spark, seed, piece_rows):
    rows = file_rows(seed)
    made = packing.assign_packs(spark.createDataFrame(rows, SCHEMA), piece_rows=piece_rows)
    got = {(r["filepath"] or "", r["pos"]): (r["place"], r["pack"]) for r in made.collect()}
    assert got == plain_packs(rows)


def plain_enclosing(rows):
    files, out = {}, {}
    for r in rows:
        files.setdefault(r[0] or "", []).append(r)
    for path, own in files.items():
        classes = sorted((r[2], -r[3], r[6]) for r in own if r[1] == "Class" and r[6].strip())
        for r in own:
            out[path, r[4]] = next((c[2] for c in classes if c[0] <= r[2] and -c[1] >= r[3]), "")
    return out


@pytest.mark.parametrize(("seed", "piece_rows"), [(3, 4096), (4, 5)])
def test_outermost_classes_over_partitions(spark, seed, piece_rows):
    rows = file_rows(seed, 1500)
    got = {(r["filepath"] or "", r["pos"]): r["enclosing"] for r in blocks.enclosing_classes(spark.createDataFrame(rows, SCHEMA), piece_rows).collect()}
    assert got == plain_enclosing(rows)


def test_no_task_has_a_whole_file(spark):
    one = spark.range(40_000).selectExpr("'a.py' as filepath", "'Function' as symbol_type", "cast(id as int) as start_line", "cast(id as int) as end_line", "cast(id as int) as pos", "cast(id % 97 * 8 as int) as n_tokens")
    cut = one.withColumn("__file", F.lit("a.py")).withColumn("single_class", F.lit(False)).repartitionByRange(4, "start_line").sortWithinPartitions("start_line")
    fold = folds.PackFold(CONFIG)
    pieces = cut.mapInArrow(folds._pieces(fold, ["n_tokens", "single_class"], 1000), "file string, part int, before binary, end binary, rows array<struct<n_tokens:int,single_class:boolean>>").collect()
    held = Counter()
    for p in pieces:
        held[p["part"]] += len(p["rows"])
    assert len(held) == 4 and max(held.values()) < 15_000
    packs = {r["pos"]: r["pack"] for r in packing.assign_packs(one).select("pos", "pack").collect()}
    state, want = fold.start(), []
    for k in range(0, 40_000, 1000):
        n = [i % 97 * 8 for i in range(k, k + 1000)]
        state, (_, own, _) = fold.step(state, n, [False] * 1000)
        want += own
    assert [packs[k] for k in range(40_000)] == want


@pytest.mark.parametrize("seed", range(5))
def test_summaries_hold_for_every_beginning(seed):
    r, fold = random.Random(seed), folds.PackFold(CONFIG)
    tokens = [r.choice([0, 3, 90, 200, 340, 700, 750, 751, 1300]) for _ in range(r.randrange(40))]
    single = [False] * len(tokens)
    for head in ([], [5], [249], [250, 101], [700, 30], [2000], [1, 2, 750]):
        state, _ = fold.step(fold.start(), head, [False] * len(head))
        summary = fold.unknown()
        for k in range(0, len(tokens), 7):
            summary = fold.summarise(summary, tokens[k : k + 7], single[k : k + 7])
        assert fold.after(pickle.loads(pickle.dumps(summary)), state) == fold.step(state, tokens, single)[0]
    assert len(summary["ways"]) < 20 or len(tokens) < 10


def test_blocks_without_a_path_are_packed(spark):
    rows = [(None, "Function", 1, 2, "a b c", 0), ("", "Function", 3, 4, "d", 1), ("x.py", "Function", 1, 1, None, 0), (None, "Class", 1, 9, "class K:", 2)]
    made = packing.pack_chunks(spark.createDataFrame(rows, "filepath string, symbol_type string, start_line int, end_line int, code string, pos int"))
    got = {(r["filepath"], r["chunk_no"], r["start_line"], r["end_line"], r["text"].split("-" * 40 + "\n")[1]) for r in made.collect()}
    assert got == {("", 1, 1, 9, "class K:"), ("x.py", 1, 1, 1, "")}
    empty = spark.createDataFrame([], "filepath string, symbol_type string, start_line int, end_line int, code string, pos int")
    assert packing.pack_chunks(empty).collect() == [] and blocks.enclosing_classes(empty).collect() == []
