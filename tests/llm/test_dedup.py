"""Exact dedup, line dedup and near-dedup against plain versions of themselves."""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlake.llm import exact_dedup, line_dedup, simhash

from .conftest import SCHEMA, odd_rows, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def same(rows, want):
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


# --- exact dedup ------------------------------------------------------------------------------


def plain_copies(rows, keep):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        done = False
        for i in ids:
            out.append((i, best, len(ids), i == best and not done, hashlib.sha256(text.encode()).hexdigest()))
            done |= i == best
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_of_odd_rows(odd, keep):
    same(exact_dedup.label_copies(odd, keep=keep).collect(), plain_copies(odd_rows(), keep))


def test_a_group_of_copies_over_many_partitions(spark):
    rows = [(k, "Same text" if k % 3 else f"text {k // 9}", "en", "s", 1) for k in range(3_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    same(exact_dedup.label_copies(docs, keep="largest").collect(), plain_copies(rows, "largest"))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _, _, kept, _ in plain_copies(rows, "smallest") if kept)


def test_small_batches_do_not_cut_runs(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [(k, f"text {k // 5}", "en", "s", 1) for k in range(60)]
        docs = spark.createDataFrame(rows, SCHEMA)
        same(exact_dedup.label_copies(docs).collect(), plain_copies(rows, "smallest"))
        assert exact_dedup.drop_copies(docs).count() == 12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_drop_copies_keeps_columns_and_rows_whole(odd):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    want = {i for i, _, _, kept, _ in plain_copies(odd_rows(), "smallest") if kept}
    assert set(got) == want
    assert len(got[105]) == len(prose(5, 60_000))


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.label_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


# --- line dedup -------------------------------------------------------------------------------


def plain_lines(rows):
    docs_of = defaultdict(set)
    norm = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            docs_of[norm(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(norm(x)) >= 10 and len(docs_of[norm(x)]) >= 2 and doc_id != min((d for d in docs_of[norm(x)] if d is not None), default=None) for x in lines]
        out.append((doc_id, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


def test_lines_of_odd_rows(odd):
    same(line_dedup.dedup_lines(odd).collect(), plain_lines(odd_rows()))


def test_line_that_most_documents_share(spark):
    rows = [(k, f"own line number {k}\nTHE common footer\nshort\n  the COMMON footer\t", "en", "s", 1) for k in range(300)]
    same(line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect(), plain_lines(rows))


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_stays_out_of_python(odd):
    plan = line_dedup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- near-dedup -------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes):
    """nodes: (id, fingerprint). The smallest id each reaches."""
    fps = sorted({fp for _, fp in nodes})
    arr = np.array(fps, np.uint64)
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[k + 1 :] ^ arr[k]) <= 3):
            root[find(fp)] = find(fps[k + 1 + j])
    low = {}
    for i, fp in nodes:
        if i is not None:
            low[find(fp)] = min(low.get(find(fp), i), i)
    return [low.get(find(fp)) for _, fp in nodes]


def test_fingerprints_and_components_of_odd_rows(odd):
    rows = odd_rows()
    nodes = [(r[0], plain_fingerprint(r[1])) for r in rows]
    got = simhash.near_copies(odd).collect()
    same([(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got], [(i, fp, c) for (i, fp), c in zip(nodes, plain_components(nodes), strict=True)])


@pytest.mark.parametrize("split_above", [2_000, 8])
def test_links_between_many_close_fingerprints(spark, split_above, monkeypatch):
    """A dense cloud of fingerprints, so that buckets are split at every level, and scattered chains."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(700)}
    for start in rng.integers(0, 1 << 63, 60).tolist():
        for _ in range(5):
            fps.add(start)
            start ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
    fps |= {0, (1 << 64) - 1}
    nodes = [(int(i), fp) for i, fp in zip(rng.permutation(len(fps)), sorted(fps), strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(fp), i) for i, fp in nodes], "fp long, rep long")
    links = simhash.linked_classes(classes, split_above)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i, _ in nodes] == plain_components(nodes)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 400)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {k: 0 for k in range(1, 401)} | {1001: 1000}


def test_near_dedup_keeps_one_of_each_group_whole(odd):
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    rows = odd_rows()
    comps = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    want = [(r[0],) for r, c in zip(rows, comps, strict=True) if r[0] is None or r[0] == c]
    same(left.select("doc_id").collect(), want)


def test_a_row_without_an_id_links_those_beside_it(spark, monkeypatch):
    fps = {"a": 0, "bridge": 0b111, "b": 0b111111, "far": (1 << 40) - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("doc_id as id", "n_chars as fp"))
    rows = [(1, "", "en", "s", fps["a"]), (None, "", "en", "s", fps["bridge"]), (3, "", "en", "s", fps["b"]), (4, "", "en", "s", fps["far"]), (None, "", "en", "s", fps["far"] ^ 1 << 50), (None, "", "en", "s", 0b1 << 60 | 0b11111 << 50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same([(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_copies(docs).collect()], [(i, fp, c) for (i, _, _, _, fp), c in zip(rows, plain_components([(r[0], r[4]) for r in rows]), strict=True)])
    same(simhash.drop_near_copies(docs).select("doc_id").collect(), [(1,), (None,), (4,), (None,), (None,)])


def test_near_dedup_of_nothing(empty):
    assert simhash.near_copies(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.translate(LOWER)) == plain_fingerprint(text)


def test_query_on_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    nodes = [(i, plain_fingerprint(t)) for i, t in rows]
    got = simhash.op9_simhash(spark, sf_dir).orderBy("doc_id").collect()
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(nodes, plain_components(nodes), strict=True))
    assert [tuple(r) for r in got] == want


# --- near-dedup by shingles --------------------------------------------------------------------


def plain_similar(rows):
    """The smallest id that each id reaches over pairs with a five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for i, text in rows:
        words = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def varied(text, seed, changes):
    import random

    r, words = random.Random(seed), text.split()
    for at in r.sample(range(len(words)), changes):
        words[at] = f"changed{seed}x{at}"
    return " ".join(words)


def test_pipeline_drops_every_near_copy(spark):
    import corpus_pipeline

    rows = [(k, prose(900 + k % 20, 150 + k % 7), k // 20) for k in range(160)]
    rows = [(k, varied(text, k, changes)) for k, text, changes in rows]  # 0 to 7 changed words, about 0.8
    rows += [(1000 + k, varied(prose(77, 120), k, 1 + k % 3)) for k in range(150)]  # one large group
    rows += [(2000 + k, f"{prose(5, 30)} {prose(3000 + k, 60)}") for k in range(60)]  # one passage, other words
    rows += [(3000, None), (3001, " \n"), (3002, "Two words"), (3003, "two  words"), (3004, "two other"), (3005, prose(1, 9).upper()), (3006, prose(1, 9))]
    want = plain_similar(rows)
    docs = spark.createDataFrame([(*r, "en", "src0", 5) for r in rows], SCHEMA).repartition(7)
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == {i for i, low in want.items() if i == low}
    assert 0 < sum(want[k] != k for k in range(160)) < 140


@pytest.mark.parametrize("broadcast", [0, 10])
def test_near_copies_by_a_shuffle_and_rows_that_repeat(spark, broadcast, monkeypatch):
    from cinderlake.llm import shingle_join

    monkeypatch.setattr(shingle_join, "BROADCAST_IDS", broadcast)
    rows = [(k, varied(prose(k // 6, 100), k, k % 3)) for k in range(60)] + [(3, varied(prose(0, 100), 3, 0)), (60, prose(0, 100)), (60, prose(0, 100))]
    docs = spark.createDataFrame([(*r, "en", "src0", 5) for r in rows] + [(None, prose(0, 100), "en", "s", 5)], SCHEMA)
    want = plain_similar(rows)
    left = [r["doc_id"] for r in shingle_join.drop_similar(docs).collect()]
    assert sorted(i for i in left if i is not None) == sorted(i for i, _ in rows if want[i] == i) and left.count(None) == 1
    assert shingle_join.drop_similar(docs.limit(0)).count() == 0


def test_fingerprints_of_pairs_at_the_similarity_stay_within_the_radius():
    from cinderlake.llm import shingle_join

    rng = np.random.default_rng(2)
    for n in (64, 90, 300):
        for _ in range(300):
            keys = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
            other = np.concatenate([keys[: -(-8 * n // 9)], rng.integers(0, 1 << 64, n // 9, np.uint64, endpoint=False)])
            assert np.bitwise_count(shingle_join.wide_fingerprint(keys) ^ shingle_join.wide_fingerprint(other)).sum() <= shingle_join.RADIUS


def test_pairs_of_uneven_sizes_and_templates_are_all_found(spark):
    """Near copies from 0.7 to 1 in similarity, also cut or lengthened, among texts of one template, against all pairs."""
    import random

    from cinderlake.llm import shingle_join

    r, texts = random.Random(9), []
    head, tail = [f"t{k}" for k in range(20)], [f"u{k}" for k in range(20)]
    texts += [" ".join(head + [f"x{r.randrange(10**9)}" for _ in range(6)] + tail) for _ in range(150)]
    for n in (5, 9, 30, 44, 80, 200):
        for _ in range(12):
            base = [f"w{r.randrange(4000)}" for _ in range(n)]
            more = list(base)
            for _ in range(r.randrange(0, max(2, n // 25))):
                more[r.randrange(n)] = f"y{r.randrange(10**9)}"
            texts += [" ".join(base), " ".join(more), " ".join(base[: n - r.randrange(0, max(1, n // 4))]), " ".join(base + [f"z{r.randrange(10**9)}" for _ in range(r.randrange(0, max(1, n // 3)))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [frozenset(shingle_join.shingle_set(t, shingle_join._Hashes()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n_links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                n_links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {k: find(k) for k in range(len(texts)) if find(k) < k}
    got = {x["node"]: x["root"] for x in shingle_join.similar_components(docs).filter("root < node").collect()}
    assert n_links > 100 and got == want
