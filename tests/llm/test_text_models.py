"""Quality rules, the classifier, token counts, pieces and language-model scores against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderlake.llm import piece_bpe, quality_classifier, quality_rules, suffix_tree_lm, token_counts

from .conftest import SCHEMA, odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality rules ----------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words, lines = words_of(text), text.split("\n")
    filled = [x for x in lines if x.strip(BLANKS)]
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    repeated = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in Counter(filled).values()), len(repeated)


def test_counts_and_fixed_limits_of_odd_rows(odd):
    got = quality_rules.judge(odd).collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in odd_rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] <= (not r["base_failed"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=80))
def test_repeated_windows(words):
    assert quality_rules.repeat_words(words) == plain_counts(" ".join(words))[4]


def test_chi_square():
    assert isclose(quality_rules.chi2_quantile(0.95, 1), 3.841459, abs_tol=1e-5)
    assert isclose(quality_rules.chi2_quantile(0.99, 6), 16.811894, abs_tol=1e-5)


def plain_vectors(texts):
    """The six statistics of each text and which texts pass the fixed limits."""
    counts = []
    for text in texts:
        text = text or ""
        n, chars, _, _, repeated = plain_counts(text)
        words, lines = words_of(text), [x for x in text.split("\n") if x.strip(BLANKS)]
        capitals, marks = len(regex.findall(r"\p{Lu}", text)), len(regex.findall(r"[^\p{L}\p{N}\s]", text))
        counts.append((n, chars, len(lines), capitals, marks, len({w.lower() for w in words}), sum(len(w) <= 3 for w in words), repeated))
    n, chars, lines, capitals, marks, types, short, repeated = np.array(counts, float).T
    passed = (n >= 20) & (100 * repeated <= 30 * n)
    rate = lambda x, y: x[passed].sum() / y[passed].sum()
    more = 20 * rate(chars, n)
    share = lambda x: np.sqrt((x + more * rate(x, chars)) / (chars + more))
    x = [np.log((chars + more) / (n + 20)), share(capitals), share(marks), np.log((types + 20) / (n + 20)) / np.log(n + 20), np.log((n + 20) / (lines + 20 * rate(lines, n))), np.sqrt((short + 20 * rate(short, n)) / (n + 20))]
    return np.column_stack(x), passed


def plain_mcd(x, floor, seed):
    """The least determinant that concentration steps reach from very many random starts, with other draws than the library's."""
    rng, best, h = np.random.default_rng(seed), None, max(1, -(-55 * len(x) // 100))
    for k in range(150):
        near = np.arange(len(x)) if not k else rng.choice(len(x), min(len(x), 7), replace=False)
        last = np.inf
        while True:
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + np.diag(floor)
            det = np.linalg.slogdet(cov)[1]
            if len(near) == h and last - det < 1e-9:
                break
            last = det if len(near) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = np.argsort(d, kind="stable")[:h]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best[1:]


def plain_verdicts(rows, identity=False):
    """kept of each row (lang, source, text): exact searches for each cell, language and the table, shrinkage and limits."""
    x, passed = plain_vectors([t for _, _, t in rows])
    variances = x[passed].var(axis=0)
    q = lambda share: quality_rules.chi2_quantile(share, 6)
    factor = 0.55 / quality_rules.chi2_cdf(q(0.55), 8)
    keys = [[("", ""), (lang or "", ""), (lang or "", source or "")] for lang, source, _ in rows]
    members = [defaultdict(list) for _ in range(3)]
    for k, key in enumerate(keys):
        for level in range(3) if passed[k] else ():
            members[level][key[level]].append(k)
    unique = [{key: np.unique(x[at], axis=0) for key, at in level.items()} for level in members]
    found = [{key: plain_mcd(u, variances / 1000, 3) for key, u in level.items()} for level in unique]

    def chain(cell):
        mean, cov = x[passed].mean(axis=0), np.diag(variances)
        for level, key in enumerate([("", ""), (cell[0], ""), cell]):
            (m, c), w = found[level][key], len(unique[level][key]) / (len(unique[level][key]) + 100)
            mean, cov = w * m + (1 - w) * mean, w * c * factor + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
        return mean, np.eye(6) * np.trace(cov) / 6 if identity else cov

    estimates = {cell: chain(cell) for cell in members[2]}
    distance = lambda v, cell: np.einsum("ij,jk,ik->i", v - estimates[cell][0], np.linalg.inv(estimates[cell][1]), v - estimates[cell][0])
    by_cell = {cell: np.log(distance(u, cell)) for cell, u in unique[2].items()}
    own = lambda test: np.concatenate([d for cell, d in by_cell.items() if test(cell)])
    low, middle, top = (np.log(q(s)) for s in (0.25, 0.5, quality_rules.QUANTILE))
    kept = np.zeros(len(rows), bool)
    for cell, at in members[2].items():
        where, stretch = middle, 1.0
        for d in (own(lambda c: True), own(lambda c, cell=cell: c[0] == cell[0]), by_cell[cell]):
            w, quarter, half = len(d) / (len(d) + 100), *np.quantile(d, [0.25, 0.5])
            where, stretch = w * half + (1 - w) * where, w * (half - quarter) / (middle - low) + (1 - w) * stretch
        kept[at] = distance(x[at], cell) <= np.exp(where + max(1, stretch) * (top - middle))
    return kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_of_a_whole_table_are_those_of_an_exact_search(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").orderBy("doc_id").collect()
    got = [r["kept"] for r in quality_rules.op3_robust_outliers(spark, f"/root/testdata/{sf}").orderBy("doc_id").collect()]
    rows = [(r["lang"], r["source"], r["text"]) for r in docs]
    want = plain_verdicts(rows)
    assert np.sum(np.array(got) != want) <= max(1, 0.002 * len(want))  # quantiles by bins against those between rows
    assert np.mean(plain_verdicts(rows, identity=True) != want) > 0.03  # the covariance decides


def test_large_cells_have_the_verdicts_of_small_ones(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["kept"] for r in quality_rules.op3_robust_outliers(spark, sf).collect()}
    monkeypatch.setattr(quality_rules, "BLOCK_ROWS", 150)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.op3_robust_outliers(spark, sf).collect()}
    assert sum(got[k] != want[k] for k in want) <= 0.002 * len(want)


def test_a_text_copied_many_times_does_not_shape_its_cell(spark):
    rows = [(k, prose(k, 60), "en", "s", 1) for k in range(300)] + [(1_000 + k, prose(7, 60), "en", "s", 1) for k in range(900)]
    assert all(r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect())


def test_a_table_of_few_rows_is_kept(spark):
    rows = [(k, prose(k, 30 + 9 * k), "en", f"s{k}", 1) for k in range(4)]
    assert all(r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect())


def test_junk_goes_and_prose_stays(spark):
    rows = [(k, prose(k, 60), "en", "s", 1) for k in range(400)]
    rows += [(1_000 + k, "#$% ".join(prose(k, 60).split()), "en", "s", 1) for k in range(8)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[k] for k in range(400)) and not any(kept[1_000 + k] for k in range(8))


@pytest.mark.parametrize("n_junk", [180, 270])
def test_junk_goes_from_a_cell_with_much_of_it(spark, n_junk):
    rows = [(k, prose(k, 60), "en", "s", 1) for k in range(600 - n_junk)]
    rows += [(1_000 + k, ("#$%" * (1 + k % 3) + " ").join(prose(k, 60).split()), "en", "s", 1) for k in range(n_junk)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[k] for k in range(600 - n_junk)) and not any(kept[1_000 + k] for k in range(n_junk))


def test_quality_rules_of_nothing(empty):
    assert quality_rules.judge(empty).count() == 0


# --- quality classifier -----------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op4_compression_quality(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert auc > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.8
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def test_scores_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, 0, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(odd, labels)
    got = quality_classifier.score(odd, model)
    assert got.columns == [*(c for c in odd.columns if c != "quality_score"), "quality_score"]
    scores = got.select("text", "quality_score").collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r["quality_score"] <= 1 for r in scores)
    assert len({r["quality_score"] for r in scores if not r["text"]}) == 1
    assert quality_classifier.keep_good(odd, model, 0.0).count() == len(odd_rows())
    assert quality_classifier.keep_good(odd, model, 1.1).count() == 0


def plain_model(texts, labels):
    """Dictionaries and calibration from dictionaries of Python, for tables within the sample's bounds."""
    import zstandard

    lowest = {}
    for i, y in labels:
        if i is not None and y is not None:
            lowest[i] = min(y, lowest.get(i, y))
    share = Counter(lowest.values())
    of = {y: [(i, texts[i]) for i in sorted(lowest) if lowest[i] == y and texts.get(i)] for y in (0, 1)}
    cut = lambda t: [t.encode()[k : k + quality_classifier.BLOCK_BYTES] for k in range(0, len(t.encode()), quality_classifier.BLOCK_BYTES)]
    taught = {y: sorted((i, b) for k, (i, t) in enumerate(of[y]) if k % 3 for b in cut(t)) for y in (0, 1)}
    holders = defaultdict(set)
    for i, b in taught[0] + taught[1]:
        for line in b.split(b"\n"):
            holders[line].add(i)
    coders = []
    for y in (1, 0):
        left = [b"\n".join(x for x in b.split(b"\n") if len(holders[x]) < 2) for _, b in taught[y]]
        try:
            data = zstandard.train_dictionary(quality_classifier.DICTIONARY_BYTES, [b for b in left if len(b) >= 8]).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(b for b in left if len(b) >= 8)
        coders.append(zstandard.ZstdCompressor(quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False))

    def measures(t):
        good, bad = (sum(len(c.compress(b)) for b in cut(t)) for c in coders)
        return [(bad - good) / (bad + good), (bad - good) / len(t.encode())] if t else [0.0, 0.0]

    rows = [(measures(t), y, share[y] / len(of[y])) for y in (0, 1) for k, (_, t) in enumerate(of[y]) if k % 3 == 0]
    x, y, w = (np.array(v, float) for v in zip(*rows, strict=True))
    mean, scale, w = x.mean(axis=0), x.std(axis=0), w / w.mean()
    z, beta = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(3)
    ridge = np.array([0.1, 0.1, 1e-6])
    for _ in range(60_000):  # plain gradient steps up the penalised likelihood
        step = z.T @ (w * (y - 1 / (1 + np.exp(-z @ beta)))) - ridge * beta
        beta += step / len(x)
        if np.abs(step).max() < 1e-9:
            break
    return lambda t: 1 / (1 + np.exp(-(np.append((np.array(measures(t or "")) - mean) / scale, 1) @ beta)))


def test_scores_of_a_whole_table_are_those_of_a_plain_model(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = plain_model(docs, labels)
    for r in quality_classifier.op4_compression_quality(spark, sf_dir).collect():
        assert isclose(r["score"], want(docs[r["doc_id"]]), abs_tol=1e-4), r


def test_labelled_texts_may_be_long_and_ids_repeated(spark):
    rows = [(k, prose(k, 30) if k % 2 else "#$% " * 30 + str(k), "en", "s", 1) for k in range(24)]
    rows += [(24, prose(24, 50_000), "en", "s", 1), (1, "another text of the id one", "en", "s", 1), (0, None, "en", "s", 1)]
    labels = spark.createDataFrame([(k, int(k % 2 or k == 24)) for k in range(25)], "doc_id long, quality int")
    models = [quality_classifier.fit(spark.createDataFrame(rows, SCHEMA).repartition(n), labels) for n in (1, 5)]
    assert models[0] == models[1]  # whatever the order of the rows
    few = quality_classifier.fit(spark.createDataFrame(rows, SCHEMA), labels, sample_rows=5, sample_blocks=4)
    assert few is not None and len(few.good) <= 4 * quality_classifier.BLOCK_BYTES


def test_classifier_without_labels(odd, empty, spark):
    assert quality_classifier.fit(odd, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")) is None
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(empty, none) is None
    assert quality_classifier.keep_good(odd, None).count() == len(odd_rows())
    assert quality_classifier.score(empty, None).count() == 0


# --- token counts -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts._counter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def lib_count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strevl<|>endoftxANé日1 ́🙂"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_every_prefix_has_the_librarys_count(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_every_prefix_has_the_librarys_count, "t") else test_every_prefix_has_the_librarys_count.t
    test_every_prefix_has_the_librarys_count.t = t
    counts = token_counts._counter(public_tokenizers.path("byte_bpe_50k.json")).prefix_counts(text)
    assert counts.tolist() == [lib_count(t, text[:k]) for k in range(len(text) + 1)]


def test_counts_of_whole_texts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op7_token_counts(spark, "/root/testdata/sf0.01").collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        n = lib_count(library, text or "")
        assert got[doc_id] == (len((text or "").encode()), n, n > 1024)


def test_counts_of_odd_rows_and_budgets(odd, library, empty):
    out = token_counts.prefix_token_counts(odd)
    got = out.withColumns({"fit": token_counts.chars_within("prefix_tokens", 5), "first": token_counts.tokens_within("prefix_tokens", 12), "all": F.element_at("prefix_tokens", -1)}).collect()
    assert sorted((r["doc_id"] or -1, r["all"]) for r in got) == sorted((r[0] or -1, lib_count(library, r[1] or "")) for r in odd_rows())
    for r in got[:8]:
        text = r["text"] or ""
        assert r["first"] == lib_count(library, text[:12])
        assert r["fit"] == max(k for k in range(min(len(text), 80) + 1) if lib_count(library, text[:k]) <= 5)
    assert token_counts.prefix_token_counts(empty).count() == 0


# --- pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_without_dropout_the_ids_are_the_librarys(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in piece_bpe.encode_pieces(docs, dropout=0.0).collect():
        assert r["piece_ids"] == pieces.encode(r["text"] or ""), r["doc_id"]


def plain_dropout(coder, text, key):
    """One agenda a unit, in plain loops: the candidate of the lowest rank and then the leftmost is next."""
    import xxhash

    if not text:
        return []
    marked = " " + text
    units = regex.findall(r"\n| *[^ \n]+| +", marked)
    out = []
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    seed = xxhash.xxh64_intdigest(f"{coder.seed} {key}")
    text_of = {i: t for t, i in coder.id_of.items()}
    for u, unit in enumerate(units):
        base, n = mix(seed + (u + 1) * 0x9E3779B97F4A7C15 & mask), 0
        parts, skipped = list(unit), set()
        stamps = list(range(len(parts)))  # a new stamp when a symbol changes
        fresh = len(parts)
        while True:
            options = []
            for k in range(len(parts) - 1):
                whole = parts[k] + parts[k + 1]
                if whole in coder.id_of and parts[k] in coder.id_of and parts[k + 1] in coder.id_of and (stamps[k], stamps[k + 1]) not in skipped:
                    options.append((coder.pairs.rank[coder.id_of[whole]], k))
            if not options:
                break
            _, k = min(options)
            drop = mix(base + (n + 1) * 0x9E3779B97F4A7C15 & mask) < int(coder.under)
            n += 1
            if drop:
                skipped.add((stamps[k], stamps[k + 1]))
                continue
            parts[k : k + 2], stamps[k : k + 2] = [parts[k] + parts[k + 1]], [fresh]
            fresh += 1
        for part in parts:
            out += [coder.id_of[part]] if part in coder.id_of else [int(coder.byte_ids[b]) for b in part.encode()]
    assert text_of
    return out


def test_dropout_against_plain_agendas():
    coder = piece_bpe.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"), 0.2, 7)
    texts = ["Reproducible words, internationalization  twice\n\n and  more ", "ünï 日本語 ▁ x\ty", "", "a" * 90 + " " + "hello" * 30, prose(1, 50)]
    keys = [1, None, 3, 4, 5]
    for ids, text, key in zip(coder.encode(texts, keys), texts, keys, strict=True):
        assert ids.tolist() == plain_dropout(coder, text, key)
        assert coder.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdefgh▁é日"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5), st.sampled_from([0.0, 0.3, 0.9]))
def test_any_texts_round_trip(texts, dropout):
    coder = piece_bpe._coder(public_tokenizers.path("piece_bpe_32k.model"), dropout, 3)
    assert [coder.decode(x) for x in coder.encode(texts, list(range(len(texts))))] == texts


def test_pieces_of_odd_rows(odd, empty):
    out = piece_bpe.decode_pieces(piece_bpe.encode_pieces(odd, keep=("source", "key"))).collect()
    assert sorted((repr(r["doc_id"]), r["decoded"]) for r in out) == sorted((repr(r[0]), r[1] or "") for r in odd_rows())
    again = piece_bpe.encode_pieces(odd.repartition(3), keep=("source", "key")).collect()
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in out) == Counter((r["doc_id"], tuple(r["piece_ids"])) for r in again)
    assert piece_bpe.encode_pieces(empty).count() == 0


# --- language-model scores --------------------------------------------------------------------


def plain_tree_scores(rows, min_gain, strength):
    """The same tree from plain dictionaries. rows: (id, text, train). Also the number of contexts by depth."""
    docs = [(i, [*words_of((t or "").translate(LOWER)), "\n"], train) for i, t, train in rows]
    grams = lambda n: Counter(tuple(ws[k - n : k]) for _, ws, train in docs if train for k in range(n, len(ws) + 1))
    words = grams(1)
    total, types = sum(words.values()), len(words)
    p = [[(words[(w,)] + 1) / (total + types + 1) for w in ws] for _, ws, _ in docs]
    base = [sum(map(log10, x)) for x in p]
    q = [[max(words[(w,)], 1) / max(total + types, 1) for w in ws] for _, ws, _ in docs]
    asked, kept, seen, sizes = {0: {()}}, {-1: {()}, 0: {()}}, words, []
    for j in range(1, 1_000):
        longer, m = grams(j + 1), strength[min(j, len(strength)) - 1]
        every = {tuple(ws[k - j : k]) for _, ws, _ in docs for k in range(j, len(ws))}
        asked[j] = {s for s in every if seen[s] >= 2 and s[1:] in asked[j - 1] and (j == 1 or s[:-1] in asked[j - 1]) and (j < 3 or s[2:] in kept[j - 2])}
        tested = {s for s in asked[j] if s[1:] in kept[j - 1]}
        gain, then = defaultdict(float), []
        for d, (_, ws, train) in enumerate(docs):
            for k in range(j, len(ws)):
                s = tuple(ws[k - j : k])
                if s in tested:
                    c, n = longer[(*s, ws[k])], seen[s]
                    with_, without = (c + m * p[d][k]) / (n + m), (max(c - 1, 0) + m * q[d][k]) / (n - 1 + m)
                    then.append((d, k, s, with_, without))
                    if train:
                        gain[s] += np.log(without / q[d][k])
        kept[j] = {s for s in tested if gain[s] >= min_gain}
        if not kept[j]:
            break
        for d, k, s, with_, without in then:
            if s in kept[j]:
                p[d][k], q[d][k] = with_, without
        sizes.append(len(kept[j]))
        seen = longer
    known = [sum((w,) in words for w in ws) for _, ws, _ in docs]
    return [(i, train, len(ws), known[d], total, base[d], sum(map(log10, p[d]))) for d, (i, ws, train) in enumerate(docs)], sizes


@pytest.mark.parametrize("batch_tokens", [2_000_000, 90, 400])
def test_scores_against_plain_dictionaries(spark, batch_tokens, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "BATCH_TOKENS", batch_tokens)
    rows = [(k, t, k is None or k % 7 != 2) for k, t, *_ in odd_rows()]
    rows += [(500 + k, f"Spring {prose(k, 2)} rains bring may flowers {prose(-k, 3)} rains bring {prose(k, 1)} or may fall", k % 7 != 2) for k in range(60)]
    rows += [(600 + k, " ".join(f"own{k // 2}x{j}" for j in range(40)), True) for k in range(20)]  # texts that occur twice
    docs = spark.createDataFrame([(k, t, u) for k, t, u in rows], "doc_id long, text string, use boolean").repartition(3)
    got = suffix_tree_lm.score_texts(docs, train="use", min_gain=1.0, strength=(20.0, 8.0, 3.0)).collect()
    want, sizes = plain_tree_scores(rows, 1.0, (20.0, 8.0, 3.0))
    assert len(sizes) > 3 and min(sizes[:2]) > 0
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-9), (a, b)
    assert sum(r["score"] for r in got if r["train"]) > sum(r["base_score"] for r in got if r["train"])


@pytest.mark.parametrize("share", [0, 64])
def test_batches_that_take_their_tokens_along_are_not_walked_again(spark, share, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "BATCH_TOKENS", 700)
    monkeypatch.setattr(suffix_tree_lm, "OPEN_SHARE", share)
    rounds, walked = [], suffix_tree_lm._with_answers
    monkeypatch.setattr(suffix_tree_lm, "_with_answers", lambda tokens, answers, *a: rounds.append((len(answers), tokens.count())) or walked(tokens, answers, *a))
    rows = [(k, f"{prose(k, 5)} rains bring {prose(k, 1)} or may fall", k % 7 != 2) for k in range(60)]
    rows += [(600 + k, " ".join(f"own{k // 2}x{j}" for j in range(40)), k % 7 != 2) for k in range(20)]
    rows += [(700 + k, " ".join(f"lone{k}x{j}" for j in range(40)), True) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, use boolean").coalesce(1)
    got = suffix_tree_lm.score_texts(docs, train="use", min_gain=1.0, strength=(20.0, 8.0, 3.0)).collect()
    want, sizes = plain_tree_scores(rows, 1.0, (20.0, 8.0, 3.0))
    for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and isclose(a[6], b[6], rel_tol=1e-9), (a, b)
    assert rounds[0][0] == 2 and len(sizes) > 2
    if not share:  # all batches after the first round
        assert len(rounds) == 1
    else:  # those without a context to test
        assert rounds[0][1] > rounds[1][1] > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3), max_size=30))
def test_numbered_keys(keys):
    x = np.array(keys, np.uint64)
    distinct, number = suffix_tree_lm._numbered(x)
    assert distinct.tolist() == sorted(set(keys)) and distinct[number].tolist() == keys


def test_contexts_grow_with_the_corpus_and_texts_that_occur_twice_stand_out(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"{prose(k, 30)} {' '.join(f'w{j}' for j in rng.integers(0, 3_000, 40))}", True) for k in range(300)]
    rows += [(1_000 + k, rows[k][1], True) for k in range(20)]
    half, whole = (plain_tree_scores(r, suffix_tree_lm.MIN_GAIN, suffix_tree_lm.STRENGTH)[1] for r in (rows[:150], rows))
    assert sum(whole) > 1.3 * sum(half)
    docs = spark.createDataFrame(rows, "doc_id long, text string, use boolean")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_tree_lm.score_texts(docs, train="use").collect()}
    assert min(got[k] for k in range(20)) > max(got[k] for k in range(20, 300))
    assert not spark.sql("SHOW TABLES").filter("tableName like 'tokens_%'").collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_packed_keys(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert suffix_tree_lm._keys(suffix_tree_lm._steps(keys)).tolist() == keys.tolist()


def test_odd_rows_are_scored_with_clashing_columns(odd, empty):
    got = suffix_tree_lm.score_texts(odd, train="doc_id is not null").collect()
    assert len(got) == len(odd_rows())
    assert suffix_tree_lm.score_texts(empty, train="true").count() == 0
    untrained = suffix_tree_lm.score_texts(odd, train="false").collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in untrained)


def test_base_score_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = suffix_tree_lm.op10_suffix_tree_score(spark, sf).collect()
    tokens = {r["doc_id"]: [*words_of((r["text"] or "").translate(LOWER)), "\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(w in c for w in ws), n)
        assert isclose(r["base_score"], sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
