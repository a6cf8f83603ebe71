"""Operators that judge each text by itself, against brute force."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import packing, quality, repetition, tokens
from mnemospark.llm.common import chunks, materialize, span_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repetition(text, least):
    w = WORD.findall(text)
    n = len(w)
    best = [max((next((k for k in range(n - max(i, j)) if w[i + k] != w[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0) for i in range(n)]
    covered = {k for i in range(n) if best[i] >= least for k in range(i, i + best[i])}
    seen = {}
    for i in range(n - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), sum(c in repetition.SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated), len(covered), max(best, default=0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=["a", "b", "é", "😀", " ", "\n", "\t", "#", "|", "\u00a0"], max_size=80), min_size=1, max_size=12))
def test_repetition_counts(texts):
    got = []
    for _, data, offsets in chunks(pa.RecordBatch.from_pydict({"text": texts}), most=100):
        got += list(zip(*[v.tolist() for v in repetition.rule_counts(data, offsets, 3).values()]))
    assert got == [brute_repetition(t, 3) for t in texts]


def test_repetition_rows(awkward, awkward_rows, empty):
    got = {}
    for r in repetition.judge_repetition(awkward).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(awkward_rows)
    assert len(got[4]) == 2 and got[1][0].n_words == 0 and got[1][0].base_failed and not got[1][0].kept
    assert got[7][0].n_dup_lines == 2 and got[8][0].base_failed and got[8][0].longest_repeat == 2999
    assert got[13][0].kept and repetition.judge_repetition(empty).count() == 0


def test_lines_that_collide_in_polynomial_hashes_are_told_apart(spark):
    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    rows = [(1, f"{one}\n{other}"), (2, f"{one}\n{one}"), (3, " ".join(one) + "\n" + " ".join(other))]
    got = {r.doc_id: r for r in repetition.judge_repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dup_lines == 0 and got[2].n_dup_lines == 1 and got[3].n_dup_lines == 0 and got[1].n_words == 2


def test_verdict_adds_to_the_base_rules(spark):
    base = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:150] + base[20:50] + base[150:])), (3, " ".join(base[:101] + [f"v{k}" for k in range(1000)] + base[:101]))]
    got = {r.doc_id: r for r in repetition.judge_repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].base_failed and not got[2].kept and not got[3].base_failed and not got[3].kept


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAeétT'sl <|>ndof x0\n\u3000日", max_size=80))
def test_token_counts_equal_the_library(library, text):
    count = tokens.counter(tokens.vocabulary_path("byte_bpe_50k.json")).count
    assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_count_rows(library, awkward, awkward_rows, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(awkward).collect())
    want = []
    for i, t, *_ in awkward_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or 0, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want) and tokens.count_tokens(empty).count() == 0


def test_word_spans_follow_the_pattern():
    texts = ["", "a", " a  bb\x0bc\u00a0d ", "é", "\x1c x", "日本 語"]
    for _, data, offsets in chunks(pa.RecordBatch.from_pydict({"text": texts})):
        starts, ends, first = word_spans(data, offsets)
        raw = data.tobytes()
        assert [[raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))] == [WORD.findall(t) for t in texts]


def test_optimal_boundaries_by_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 20, len(lengths))

        def cost(bounds):
            return sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))

        for k in (1, 2, 3, 4):
            got = packing.optimal_boundaries(lengths, counts, k)
            options = [(*c, lengths[-1]) for m in range(k) for c in combinations(lengths[:-1].tolist(), m)]
            assert len(got) <= k and cost(got) == min(map(cost, options))


def test_packing(awkward, awkward_rows, empty):
    rows = packing.pack_documents(awkward, 4, 500).collect()
    size = {}
    for i, t, *_ in awkward_rows:
        size.setdefault(i, []).append(len(WORD.findall(t or "")))
    assert len(rows) == len(awkward_rows) and all(r.n_tokens in size[r.doc_id] and 0 <= r.padding == r.bucket_length - r.n_tokens for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert len({r.bucket_length for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b))) and {r.batch_rows for r in b} == {len(b)}
        assert len(b) == 1 or len(b) * b[0].bucket_length <= 500
    by_bucket = {}
    for b in batches.values():
        by_bucket.setdefault(b[0].bucket_length, []).append(len(b))
    assert all(sum(n < max(1, 500 // max(length, 1)) for n in sizes) <= 1 for length, sizes in by_bucket.items())
    assert packing.pack_documents(empty).count() == 0


def brute_layers(lengths, counts, buckets):
    """Least padded size, by the plain quadratic recurrence."""
    below = np.concatenate([[0], np.cumsum(counts)])
    best = below[1:] * lengths
    for _ in range(1, buckets):
        held = np.concatenate([[0], best])
        best = np.array([(held[: i + 1] + (below[i + 1] - below[: i + 1]) * lengths[i]).min() for i in range(len(lengths))])
    return int(best[-1])


def test_boundaries_are_optimal_over_long_lengths():
    rng = np.random.default_rng(5)
    for buckets in (2, 5, 16):
        lengths = np.unique(np.concatenate([rng.integers(0, 3000, 900), (10 ** rng.uniform(3, 6, 600)).astype(np.int64)]))
        counts = rng.integers(1, 50, len(lengths))
        bounds = np.array(packing.optimal_boundaries(lengths, counts, buckets))
        assert len(bounds) <= buckets and int((counts * bounds[np.searchsorted(bounds, lengths)]).sum()) == brute_layers(lengths, counts, buckets)


def test_packing_without_ids_keeps_columns(spark):
    rows = [(None, "a b c " * (k % 5), f"r{k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(4)
    out = packing.pack_documents(docs, 3, 40, keep=("part", "text")).collect()
    assert sorted(r.part for r in out) == sorted(f"r{k}" for k in range(500)) and all(r.n_tokens == len(r.text.split()) for r in out)
    assert len({(r.batch_id, r.slot) for r in out}) == 500


def labelled(spark, n=1500):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{k}" for k in rng.integers(0, 300, rng.integers(30, 200))]
        toxic, junk = i % 9 == 0, i % 7 == 0
        if toxic:
            w[len(w) // 2] = ["idiot", "scum"][i % 2] + ","
        if junk:
            w = [x + "***" for x in w]
        docs.append((i, " ".join(w), "en", f"s{i % 5}", 0))
        if i % 3 != 1:
            labels.append((i, int(not junk), int(toxic)))
    truth = {i: not (i % 9 == 0 or i % 7 == 0) for i in range(n)}
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_quality_on_unlabelled_rows(spark, awkward, awkward_rows, empty):
    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r.kept for r in quality.score_quality(docs, labels).collect()}
    rest = [i for i in truth if i % 3 == 1]
    assert len(got) == len(truth) and np.mean([got[i] == truth[i] for i in rest]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]}
    assert quality.score_quality(awkward, labels.limit(0)).filter("kept").count() == len(awkward_rows)
    assert quality.score_quality(empty, labels).count() == 0
    both = docs.unionByName(awkward.select(docs.columns))
    assert quality.score_quality(both, labels).count() == len(truth) + len(awkward_rows)


def brute_quality(model, text, lang, source, n_chars):
    """Score of one document from the model's weights, by regular expressions and loops."""
    raw = (text or "").encode()
    lower = raw.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    runs = {lower[m.start() : m.end()] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)}
    hashed = {int(span_hashes(np.frombuffer(r, np.uint8), np.array([0]), np.array([len(r)]))[0]) >> (64 - quality.TEXT_BITS) for r in runs}
    z = model.text_w[-1] + sum(model.text_w[model.chosen.tolist().index(h)] for h in hashed if h in set(model.chosen.tolist()))
    words = [w.encode() for w in WORD.findall(text or "")]
    w, b = max(len(words), 1), max(len(raw), 1)
    symbols = bytes(x for x in range(256) if not (chr(x).isalnum() and x < 128) and x < 128 and x not in b" \t\n\x0b\x0c\r.,;:'\"?-")
    shape = [np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, sum(65 <= x <= 90 for x in raw) / b, sum(48 <= x <= 57 for x in raw) / b, sum(x in symbols for x in raw) / b, raw.count(10) / b]
    shape += [len(set(words)) / w, sum(x == y for x, y in zip(words, words[1:])) / w]
    width = quality.BINS + 2
    for j, x in enumerate(shape):
        z += model.text_w[len(model.chosen) + j * width + sum(e <= x for e in model.edges[j])]
    page = model.page_w[-1] + model.page_w[sum(e <= np.log1p(n_chars or 0) for e in model.edges[-1])]
    page += model.page_w[width + (0 if lang is None else 1 + zlib.crc32(lang.encode()) % (quality.LANG_KEYS - 1))]
    page += model.page_w[width + quality.LANG_KEYS + (0 if source is None else 1 + zlib.crc32(source.encode()) % (quality.SOURCE_KEYS - 1))]
    a, c = (k[0] * x + k[1] for k, x in zip(model.calibration, (z, page)))
    return 1 / (1 + np.exp(model.combination[0] * a + model.combination[1] * c + model.combination[2]))


def test_quality_scores_by_brute_force(spark, awkward):
    docs, labels, _ = labelled(spark)
    both = docs.limit(150).unionByName(awkward.select(docs.columns))
    model, _ = quality.fit_quality(docs, labels)
    got = sorted((r.doc_id or 0, round(r.score, 6)) for r in quality.score_quality(both, labels).collect())
    again, _ = quality.fit_quality(both, labels)
    want = sorted((r.doc_id or 0, round(float(brute_quality(again, r.text, r.lang, r.source, r.n_chars)), 6)) for r in both.collect())
    assert len(got) == len(want) and all(i == j and abs(x - y) < 1e-5 for (i, x), (j, y) in zip(got, want))
    assert len(model.chosen)


def test_every_unlabelled_document_takes_part(spark):
    """The text view is sure of documents from a source that no labelled one has; the page view learns it from all of them."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 2
        words = " ".join(f"w{k}" for k in rng.integers(0, 50, 40)) + (" junk spam" if bad else "")
        new = i >= 300
        rows.append((i, words, "en", f"s{bad}" if new else "old", 200))
        if not new:
            labels.append((i, 1 - bad, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    model, features = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    at = quality.BINS + 2 + quality.LANG_KEYS + 1
    weight = [model.page_w[at + zlib.crc32(f"s{k}".encode()) % (quality.SOURCE_KEYS - 1)] for k in (0, 1)]
    assert weight[1] - weight[0] > 2 and features.filter("bad is null").count() == 600


def test_quality_with_few_labels(spark):
    docs = spark.createDataFrame([(k, f"word{k} text", "en", "a", 10) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for marks in ([(0, 1, 0)], [(0, 0, 0)], [(0, 1, 0), (1, 0, 0)]):
        rows = quality.score_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == 30 and all(0 <= r.score <= 1 for r in rows)


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(5), "x")
    assert spark.conf.get("spark.checkpoint.dir").split("file:")[-1].strip("/") in df.inputFiles()[0] and df.count() == 5
