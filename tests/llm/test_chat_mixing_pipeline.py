"""Preference formatting, Poisson mixing, the registered SQL, and the whole pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from math import exp

import duckdb
import pytest

import corpus_pipeline
from cinderlake.llm import mixing, piece_bpe, preference_format, quality_classifier, queries

from .conftest import SCHEMA, odd_rows, prose
from .test_dedup import plain_copies, plain_similar

TURNS = "conv_id long, turn long, role string, text string"
NONE = [("user", "hi"), ("assistant", "a")]


# --- preference formatting --------------------------------------------------------------------


def plain_format(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    broken = lambda s: s.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    head = lambda t: "<|im_start|>" + broken(t[0]) + "\n"
    body = lambda t: broken(t[1]) + "<|im_end|>\n"
    out = [n, "".join(head(t) + body(t) for t in chosen[:n])]
    for side in (chosen[n:], rejected[n:]):
        text, spans = "", []
        for t in side:
            text += head(t)
            start = len(text)
            text += body(t)
            if t[0] == "assistant":
                spans.append((start, len(text)))
        out += [text, spans]
    return tuple(out)


@pytest.mark.parametrize(
    ("chosen", "rejected"),
    [
        (NONE, NONE),
        (NONE, [("user", "hi"), ("assistant", "b")]),
        (NONE, [("user", "other")]),
        (NONE, [("user", "hi")]),
        ([], NONE),
        (None, NONE),
        (None, None),
        ([("system", "x"), ("user", "é日<|im_start|>"), ("assistant", "r1"), ("user", ""), ("assistant", "<|im_end|>")], [("system", "x"), ("user", "é日<|im_start|>"), ("assistant", "r2")]),
    ],
)
def test_pairs(spark, chosen, rejected):
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, chosen, rejected, "old")], f"k int, chosen {kind}, rejected {kind}, prompt string")
    r = preference_format.format_preferences(pairs).first()
    got = (r["n_prompt_turns"], r["prompt"], r["chosen_completion"], [tuple(s) for s in r["chosen_mask"]], r["rejected_completion"], [tuple(s) for s in r["rejected_mask"]])
    assert got == plain_format(chosen or [], rejected or [])


def test_odd_turns(spark):
    rows = [(1, 2, "assistant", "late"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "late"), (None, 1, "user", "x"), (None, 2, "user", "y"), (2, 1, "assistant", "only")]
    convs = preference_format.conversations(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as turns", "2 as chosen", "3 as replies"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in convs.collect()}
    assert {k: t for k, t in got.items() if k} == {1: [("", "first"), ("user", ""), ("assistant", "late"), ("assistant", "late")], 2: [("assistant", "only")]}
    same = lambda rows: sorted(map(repr, rows))
    assert same([tuple(t) for t in r["turns"]] for r in convs.filter("conv_id is null").collect()) == same([[("user", "x")], [("user", "y")]])
    out = {r["conv_id"]: r for r in preference_format.format_preferences(preference_format.with_stale_reply(convs)).collect()}
    assert out[2]["rejected_completion"] == "<|im_start|>assistant\n<|im_end|>\n" and out[2]["n_prompt_turns"] == 0
    assert out[1]["n_prompt_turns"] == 4 and out[None]["chosen_completion"] == ""
    none = preference_format.conversations(spark.createDataFrame([], TURNS))
    assert none.count() == 0 and preference_format.format_preferences(preference_format.with_stale_reply(none)).count() == 0


def test_very_long_and_empty_turns(spark, tmp_path):
    long = prose(1, 60_000)
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (1, 3, "assistant", ""), (2, 1, "user", "")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in preference_format.op2_preference_format(spark, str(tmp_path)).collect()}
    assert got[1]["prompt"] == f"<|im_start|>user\n{long}<|im_end|>\n<|im_start|>assistant\n{long}<|im_end|>\n"
    assert got[1]["rejected_completion"] == f"<|im_start|>assistant\n{long}<|im_end|>\n" and got[1]["chosen_mask"] == "22-33"
    assert got[2]["n_prompt_turns"] == 1 and got[2]["chosen_completion"] == got[2]["rejected_mask"] == ""


# --- mixing -----------------------------------------------------------------------------------


def plain_mix(rows, weights, epochs, seed):
    mass = defaultdict(int)
    for _, text, _, source, _ in rows:
        mass[source or ""] += len(text or "")
    total, weight = sum(mass.values()), sum(weights.get(s, 1.0) for s, m in mass.items() if m)
    out = []
    for doc_id, text, _, source, _ in rows:
        s = source or ""
        rate = epochs * weights.get(s, 1.0) / weight * total / mass[s] if mass[s] else 0.0
        parts = max(1, -(-rate // 16))
        n = 0
        for k in range(1, int(parts) + 1):
            key = doc_id if doc_id is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
            u = int(hashlib.md5(f"{seed} {key} {k}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = cdf = exp(-rate / parts)
            j = 0
            while cdf <= u and j < 80:
                j += 1
                p *= rate / parts / j
                cdf += p
                n += 1
        out += [(doc_id, c) for c in range(1, n + 1)]
    return Counter(out)


@pytest.mark.parametrize(("weights", "epochs", "broadcast"), [({}, 1.0, 9), ({"src0": 4.0, "src1": 0.0, "nowhere": 9.0}, 2.0, 0), ({"src2": 900.0}, 40.0, 9)])
def test_mix_of_odd_rows(odd, weights, epochs, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    out = mixing.mix(odd, weights, epochs)
    assert set(odd.columns) <= set(out.columns)
    assert Counter((r["doc_id"], r["mix_copy"]) for r in out.collect()) == plain_mix(odd_rows(), weights, epochs, 42)


def test_shares_come_near_their_targets(spark):
    rows = [(k, prose(k, 20), "en", "src0" if k % 3 else f"src{k % 5}", 1) for k in range(4_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {"src0": 1.0, "src1": 3.0, "src2": 2.0, "src3": 1.0, "src4": 1.0}
    got = {r["source"]: r["n"] for r in mixing.mix(docs, weights).groupBy("source").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "n").collect()}
    total = sum(got.values())
    for s, w in weights.items():
        assert abs(got[s] / total - w / 8) < 0.03
    again = mixing.mix(docs.repartition(5), weights)
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in mixing.mix(docs, weights).collect())


def test_rows_without_ids_are_drawn_apart(spark):
    rows = [(None, prose(k, 20), "en", "src0", 1) for k in range(2_000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), {}, 1.0)
    got = Counter(r["text"] for r in out.collect())
    assert len(got) == pytest.approx(2_000 * (1 - exp(-1)), rel=0.1) and max(got.values()) > 2
    per_partition = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(per_partition) < 1.3 * sum(per_partition) / len(per_partition)


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


# --- SQL and pipeline -------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert Counter(want.fetchall()) == Counter(map(tuple, queries.queries()[name](spark, sf_dir).select(columns).collect()))


def plain_run(spark, sf_dir):
    """doc_id, source and text of what the first four stages leave, from the classifier's own scores."""
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.op4_compression_quality(spark, sf_dir).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if scores[r["doc_id"]] >= quality_classifier.THRESHOLD]
    stays = {i for i, _, _, kept, _ in plain_copies(rows, "smallest") if kept}
    rows = [r for r in rows if r[0] in stays]
    low = plain_similar([r[:2] for r in rows])
    rows = [r for r in rows if low[r[0]] == r[0]]
    return rows, plain_mix(rows, mixing.WEIGHTS, mixing.EPOCHS, mixing.SEED)


def test_pipeline_on_a_whole_table(spark, sf_dir):
    rows, drawn = plain_run(spark, sf_dir)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "piece_ids"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in drawn.elements())
    coder, by_id = piece_bpe._coder(piece_bpe.public_tokenizers.path(piece_bpe.MODEL), piece_bpe.DROPOUT, piece_bpe.SEED), {r[0]: r for r in rows}
    import numpy as np

    for r in got:
        assert coder.decode(np.array(r["piece_ids"])) == by_id[r["doc_id"]][1] and r["source"] == by_id[r["doc_id"]][3]


def test_stages_take_odd_rows_and_nothing(spark, odd, empty, sf_dir):
    rows = odd_rows()
    known = [r for r in rows if r[0] is not None]
    low = plain_similar([r[:2] for r in known])
    scores = quality_classifier.score(odd, quality_classifier.trained(spark, sf_dir)).collect()
    want = {
        "quality classifier": Counter(r["doc_id"] for r in scores if r["quality_score"] >= quality_classifier.THRESHOLD),
        "exact dedup": Counter(i for i, _, _, kept, _ in plain_copies(rows, "smallest") if kept),
        "SimHash near-dedup": Counter(i for i, *_ in rows if i is None or low[i] == i),
        "mixing sources": Counter(i for i, _ in plain_mix(rows, mixing.WEIGHTS, mixing.EPOCHS, mixing.SEED).elements()),
        "sentencepiece encoding": Counter(i for i, *_ in rows),
    }
    assert list(want) == [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        left, none = stage(spark, odd, sf_dir), stage(spark, empty, sf_dir)
        if name != "sentencepiece encoding":
            assert left.columns == odd.columns and none.columns == empty.columns
        assert Counter(r["doc_id"] for r in left.select("doc_id").collect()) == want[name], name
        assert none.count() == 0
