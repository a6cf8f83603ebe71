"""Operators that compare rows with all others, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import components as stars
from mnemospark.llm import fmindex, lm, mixing, neighbours, reputation, simhash, substrings
from mnemospark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removed(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        out.append([x for x, y in zip(w, keep) if y])
    return words, out


def test_substrings_by_brute_force(awkward, awkward_rows, empty):
    words, kept = brute_removed([r[1] for r in awkward_rows], 35)
    want = sorted((r[0] or 0, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, w, k in zip(awkward_rows, words, kept))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_digest(awkward).collect()) == want
    assert substrings.repeat_digest(empty).count() == 0
    out = substrings.dedup_substrings(awkward)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.filter("text is null").count() == 1


@pytest.mark.parametrize("alphabet", [1, 2, 5])
def test_substrings_with_few_words(spark, alphabet):
    rng = random.Random(alphabet)
    rows = [(i, " ".join(rng.choice("abcde"[:alphabet]) for _ in range(rng.randint(0, 90)))) for i in range(40)]
    words, kept = brute_removed([t for _, t in rows], 12)
    got = {r.doc_id: r.kept_words for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect()}
    assert got == {i: " ".join(k) for (i, _), k in zip(rows, kept)}


def test_substrings_of_texts_inside_others(spark):
    """Texts all of whose runs stand in other texts too lose their words in the digest as well."""
    rows = [(n, "a " * n) for n in (81, 195, 337, 451, 860)] + [(2000, " ".join(f"w{k}" for k in range(100)))]
    words, kept = brute_removed([t for _, t in rows], 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), w, k in zip(rows, words, kept)}


@pytest.mark.parametrize("hot", [0, 2, 10])
def test_substrings_with_hot_grams(spark, hot):
    """A passage in many contexts, and a text that repeats one word: the same result by single windows."""
    rng = random.Random(hot)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, " ".join([*(f"w{rng.randrange(50)}" for _ in range(20)), passage, *(f"w{rng.randrange(50)}" for _ in range(20))])) for i in range(40)] + [(90, "x " * 70), (91, "a " + "x " * 30)]
    words, kept = brute_removed([t for _, t in rows], 20)
    got = {r.doc_id: r.kept_words for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 20, 4, hot).collect()}
    assert got == {i: " ".join(k) for (i, _), k in zip(rows, kept)}


def test_index_counts_foreign_patterns():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = fmindex.FMIndex(text, 4, 6)
    other = np.concatenate([rng.integers(1, 5, 120), text[40:70], rng.integers(1, 5, 20)])
    raw = text.tolist()
    found = {int(p): int(hi - lo) for _, at, los, his in index.statistics(other, np.array([0]), np.array([len(other)])) for p, lo, hi in zip(at, los, his)}
    for p in range(len(other) - 5):
        n = sum(raw[k : k + 6] == other[p : p + 6].tolist() for k in range(len(raw) - 5))
        assert found.get(p, 0) == n


def fingerprint(text, k=4):
    w = [x.encode().lower() for x in WORD.findall(text or "")]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_by_brute_force(awkward, awkward_rows, empty):
    ids, prints = [r[0] for r in awkward_rows], [fingerprint(r[1]) for r in awkward_rows]
    want = sorted(zip([i or 0 for i in ids], [f"{p:016x}" for p in prints], [c or 0 for c in brute_classes(ids, prints, 4)]))
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in simhash.near_duplicate_classes(awkward).collect()) == want
    assert simhash.near_duplicate_classes(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 4, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng, masks = random.Random(radius), simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for turn in (masks, simhash.covering_masks(radius, 1)):
        for _ in range(2000):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(differing & m == 0 for m in turn)


def test_large_buckets_go_through_the_second_family(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p, p) for p in signed], "node long, fp long")
    links = simhash.near_links(nodes, 4, large=8).collect()
    ids = list(range(len(signed)))
    want = brute_classes(ids, [p & (1 << 64) - 1 for p in signed], 4)
    place = {p: i for i, p in enumerate(signed)}
    got = list(ids)

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        a, b = sorted((find(place[r.a]), find(place[r.b])))
        got[b] = a
    assert [find(i) for i in ids] == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[200] == got[180] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(stars, "FEW", 2)
    monkeypatch.setattr(stars, "HUBS", 20)
    rng = random.Random(11)
    edges = [(5, k) for k in range(10, 60)] + [(k, 200 + k % 3) for k in range(60, 120)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(59, 60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_near_duplicate_stage(spark, awkward, awkward_rows, empty):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = [(500 + k, " ".join(w if j != 40 * k else "changed" for j, w in enumerate(base))) for k in range(1, 8)]
    other = [(600 + k, " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for k in range(20)]
    rows = spark.createDataFrame([(500, " ".join(base)), *near, *other], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(rows).collect()} == {500, *[i for i, _ in other]}
    kept = simhash.drop_near_duplicates(awkward)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == awkward.columns and ids.count(4) == 1 and 5 in ids and 6 not in ids and {1, 2, 3} & set(ids) == {1} and simhash.drop_near_duplicates(empty).count() == 0


def near_variants(rng):
    """Texts of 300 words with a foreign block appended or the tail cut, all at Jaccard 0.8 or more with the original."""
    rows = []
    for k in range(60):
        base = [f"v{k}x{rng.randrange(4000)}" for _ in range(300)]
        block = [f"b{k}x{rng.randrange(4000)}" for _ in range(55)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + block if k % 2 else base[:250]))]
    return rows


def test_near_duplicates_with_blocks_added_or_cut(spark):
    rows = spark.createDataFrame(near_variants(random.Random(3)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(rows).collect()} == set(range(0, 120, 2))


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    """The stage keeps the smallest id of each group that pairs of Jaccard 0.8 or more connect, found by trying all pairs."""
    from pathlib import Path

    docs = spark.read.parquet(f"{Path(sf_dir).parent}/sf0.01/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, ids = [], []
    for r in docs.orderBy("doc_id").collect():
        w = WORD.findall((r.text or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
        ids.append(r.doc_id)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (len(x & y) >= 0.8 * len(x | y)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {ids[k] for k in range(len(ids)) if find(k) == k}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == want and len(want) < len(ids)


def test_all_pairs_between_groups_are_verified(spark, monkeypatch):
    """Seven texts, each pair of them near the limit: the one link is found though its estimate is among the lowest."""
    alike = [105, 104, 103, 102, 101, 100, 101]
    low = np.zeros((7, simhash.MINIMA), np.uint8)
    for k, n in enumerate(alike):
        low[k, n:] = k + 1
    rows = [(k, 1000, [1, *range(100 * k + 100, 100 * k + 100 + simhash.BANDS - 1)], *map(int, low[k].view(np.int64))) for k in range(7)]
    nodes = spark.createDataFrame(rows, ", ".join(["node long, n long, keys array<long>", *(f"{c} long" for c in simhash.LOW)]))
    monkeypatch.setattr(simhash, "verified", lambda pairs, texts, similarity: pairs.withColumn("near", (F.least("a", "b") == 5) & (F.greatest("a", "b") == 6)))
    got = simhash.near_set_links(nodes, None, 0.8).collect()
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} == {(5, 6)}


@pytest.mark.parametrize("held", [3, 16])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, held):
    """Buckets dealt out in parts keep what buckets in one piece keep: big families, families that only meet in other
    rows than their first, and texts that share a passage without being alike."""
    rng, rows = random.Random(12), []
    for f in range(3):
        base = [f"f{f}x{rng.randrange(4000)}" for _ in range(300)]
        rows += [" ".join(w if j != 7 * k else "changed" for j, w in enumerate(base)) for k in range(40)]
        rows.append(" ".join(base + [f"g{f}x{k}" for k in range(60)]))
    chain = [f"c{rng.randrange(9000)}" for _ in range(900)]
    rows += [" ".join(chain[20 * k : 20 * k + 300]) for k in range(30)]
    passage = " ".join(f"p{rng.randrange(4000)}" for _ in range(240))
    rows += [passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(90)) for _ in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "HELD", held)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want
    assert 30 <= len(want) < 60


def test_pairs_of_a_dense_bucket_stay_in_proportion(spark):
    """Ninety texts of one bucket, each pair near the limit: a few pairs a row, the best, and the bucket is named."""
    size = 90
    low = np.zeros((size, simhash.MINIMA), np.uint8)
    for k in range(size):
        low[k, 100 + k % 8 :] = k + 1
    rows = [(k, 1000, [1, *range(100 * k + 100, 100 * k + 100 + simhash.BANDS - 1)], *map(int, low[k].view(np.int64))) for k in range(size)]
    nodes = spark.createDataFrame(rows, ", ".join(["node long, n long, keys array<long>", *(f"{c} long" for c in simhash.LOW)]))
    got = [(r.a, r.b, r.agree) for r in simhash.near_pairs(nodes, 0.8).collect()]
    assert len(got) <= simhash.TRIES * size + 1 and [x for x in got if x[2] < 0] == [(0, 1, -1)]
    assert {k for a, b, _ in got[:-1] for k in (a, b)} == set(range(size))


@pytest.mark.parametrize("held", [8192, 16])
def test_dense_groups_against_all_pairs(spark, monkeypatch, held):
    """Groups of variants near the limit, in which few are linked: what all pairs connect is one group, nothing else is."""
    rng, rows = random.Random(21), []
    for g in range(3):
        base = [f"g{g}x{rng.randrange(9000)}" for _ in range(300)]
        edits = [rng.sample(range(300), 14) for _ in range(4)]
        for k in range(70):
            text = list(base)
            for j in rng.sample(range(300), rng.randint(3, 7)) if k % 3 else rng.sample(edits[k % 4], 7):
                text[j] = f"e{g}x{k}x{j}" if k % 3 else f"s{g}x{j}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {k for k in range(len(rows)) if find(k) == k}
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "SIDE", (16, 32))
    met, cells = [], simhash.dense_links
    monkeypatch.setattr(simhash, "dense_links", lambda *given: met.append(1) or cells(*given))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == want
    assert met and 20 <= len(want) < 180, len(want)


@pytest.mark.parametrize("band", [0, 3])
def test_cells_find_every_link_once(band):
    """A cell joins what brute force joins: rows that ask against all, pairs that meet in an earlier band left out."""
    rng = random.Random(band)
    sets = [np.array(sorted(set(range(100)) - set(rng.sample(range(100), rng.randint(5, 12)))), np.uint64) for _ in range(40)]
    low = np.zeros((40, simhash.MINIMA), np.uint8)
    for k in range(40):
        low[k, rng.sample(range(128), 18)] = k + 1
    keys = np.array([[rng.randrange(12) for _ in range(simhash.BANDS)] for _ in range(40)])
    plain = np.array([[band, 7, 0, 0, k, len(sets[k]), 0 if k < 10 else k, k < 10] for k in range(40)], np.int64)
    rows = np.concatenate([plain, low.view(np.int64), keys], axis=1)
    asking = rows[10:].copy()
    asking[:, 3] = 1
    got = simhash.cell_links(np.concatenate([rows, asking]), sets + sets[10:], 0.8, 116, 89)

    def groups(pairs):
        root = [0 if k < 10 else k for k in range(40)]
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    fits = [(a, b) for a in range(40) for b in range(10, 40) if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    fits = [(a, b) for a, b in fits if (low[a] == low[b]).sum() >= 89 and not (keys[a, :band] == keys[b, :band]).any()]
    assert groups(got) == groups(fits) and len(got) == 31 - len(set(groups(fits))) and 3 < len(got) < 31


def test_near_duplicates_are_verified_and_other_partners_tried(spark):
    rng, rows, stay = random.Random(6), [], set()
    for k in range(40):
        base = [f"v{k}x{rng.randrange(4000)}" for _ in range(300)]
        block = [f"b{k}x{rng.randrange(4000)}" for _ in range(100)]
        # the second and third are copies at 0.99, both at 0.75 of the first
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(base + block)), (3 * k + 2, " ".join(base + block[:95]))]
        stay |= {3 * k, 3 * k + 1}
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == stay


def brute_mix(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = collections.defaultdict(int)
    for r, n in zip(rows, size):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = 1.5 * sum(total.values()), set(order)
    while left > 1e-9 and open_:
        share, left = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    return size, total, target


def test_mixing(awkward, awkward_rows, empty):
    size, total, target = brute_mix(awkward_rows)
    rows = mixing.mix_plan(awkward).collect()
    source = collections.defaultdict(set)
    for r, n in zip(awkward_rows, size):
        source[r[0], n].add(r[3])
    taken = collections.defaultdict(int)
    largest = collections.defaultdict(int)
    for r in rows:
        (s,) = source[r.doc_id, r.size]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], 2 * r.size)
    assert len(rows) == len(awkward_rows) and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in total)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(awkward.repartition(7)).collect()))
    assert mixing.mix_plan(empty).count() == 0
    mixed = mixing.mix_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.passes for r in rows)


def test_mixing_takes_as_many_of_equal_rows_as_the_target_needs(spark):
    """A source of rows without ids, all equal or not, ends within half a document of its target."""
    rows = [(None, "w " * 10, "a")] * 200 + [(None, f"x{k} " * 7, "b") for k in range(150)] + [(k, "y " * 900, "c") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in mixing.mix_plan(docs).collect():
        key = {10: "a", 7: "b", 900: "c"}[r.size]
        taken[key] += r.taken
        target[key], largest[key] = r.target, r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in target) and len(target) == 3


def test_mixed_documents_keep_columns_of_any_name(spark):
    names = ["h", "copies", "theta", "ties", "part", "size", "passes", "target", "doc", "_pass", "_source", "source_size"]
    rows = spark.createDataFrame([(k, f"word {k} " * (k + 1), "ab"[k % 2]) for k in range(30)], "doc_id long, text string, source string")
    docs = rows.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    plain = collections.Counter(r.doc_id for r in mixing.mix_documents(rows).collect())
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and collections.Counter(r.doc_id for r in out.collect()) == plain
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names)


def test_mixing_with_many_sources_salts_the_join(awkward, monkeypatch):
    want = sorted(map(str, mixing.mix_plan(awkward).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_plan(awkward).collect())) == want


def test_language_model(spark, awkward_rows, empty):
    rng = random.Random(2)
    chain = {w: [rng.randrange(60) for _ in range(2)] for w in range(60)}

    def text(n):
        w, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        return " ".join(out)

    rows = [(i, text(rng.randint(20, 60))) for i in range(900)] + [(r[0], r[1]) for r in awkward_rows]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*WORD.findall((t or "").translate(lower)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, h, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for (i, _), t, h in zip(rows, tokens, held))
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    fresh = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 110]
    assert sum(r.score for r in fresh) > 0.95 * sum(r.base_score for r in fresh) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_language_model_has_heads_of_rare_groups(spark):
    """A group whose tokens come after hundreds of more frequent ones has its most frequent tokens as heads too."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(700)] * 60
    rng.shuffle(words)
    rows = [" ".join(x for w in words[k : k + 100] for x in (f"a{rng.randrange(31)}", w)) for k in range(0, len(words), 100)]
    rows += [" ".join(f"bbb x{rng.randrange(30)}" for _ in range(10)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    _, found, _ = lm.encode_documents(docs)
    seen = collections.Counter(w for k, t in enumerate(rows) if zlib.crc32(str(k).encode()) % 7 != 2 for w in t.split())
    code = {w: int(lm.as_long(lm.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])))[0]) for w in seen}
    first = lm.FIRST_LEAF + found.groups[code["bbb"]] * lm.WIDTH
    heads = {t for t, leaf in found.leaf.items() if first <= leaf < first + lm.HEADS}
    least = min(n for w, n in seen.items() if code[w] in heads)
    assert len(heads) == lm.HEADS
    assert all(code[w] in heads or w == "bbb" or seen[w] <= least for w in seen if w[0] in "bx")


def test_language_model_of_awkward_rows(awkward, awkward_rows):
    got = lm.score_documents(awkward).collect()
    assert len(got) == len(awkward_rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 1} == {1}


def test_language_model_learns_from_contexts_and_repeats_itself(spark):
    """Two languages of 40 words each: the word before tells which of them comes next, so known tokens gain on the start."""
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        own = [f"{'ab'[i % 2]}{k}" for k in range(40)]
        rows.append((i, " ".join(rng.choices(own, [1 / (k + 1) for k in range(40)], k=rng.randint(20, 60)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").cache()
    start, first, second = ({r.doc_id: r.score for r in lm.score_documents(docs, **a).collect() if r.held_out} for a in ({"rounds": 0}, {}, {}))
    assert first == second
    n = sum(len(t.split()) for i, t in rows if i in first)
    # telling the two apart is worth log10(2) a token
    assert (sum(first.values()) - sum(start.values())) / n > 0.2


def test_company_groups():
    table = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)):
        table[a, b] = 50
    table[2, 3] = 1
    g = lm.company_groups(table, 2)
    assert g[0] == g[1] == g[2] != g[3] == g[4] == g[5]


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            out[i] = sorted((-float((v * q).sum()), j) for j, v in rows if j != i and len(v) == len(q))[:k]
    return {i: near for i, near in out.items() if near}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(1500)]
    rows += [(3000 + i, rows[40][1]) for i in range(60)] + [(4000, [0.0] * 8), (4020, None), (4040, [1.0] * 7 + [None]), (4060, [float("nan")] * 8), (4080, [1.0] * 3), (None, [1.0] * 8), (4100, [])]
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=400).collect():
        got[r.query_id].append((r.rank, -r.score, r.vec_id))
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
        hits += len({v for _, _, v in mine} & {v for _, v in near})
    assert hits / (20 * len(want)) >= 0.9
    assert [v for _, _, v in sorted(got[40])] == list(range(3000, 3020))
    few = neighbours.nearest_neighbours(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"))
    assert few.count() == 4 and neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_mixed_lengths(spark):
    """Each length is searched on its own; one longer vector leaves the others' rows as they were."""
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.standard_normal(6 if i % 3 else 9)]) for i in range(300)] + [(1000, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "width", "shard", "ids", "total", "score", "rank")})
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(df).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    want = brute_nearest(rows, 20)
    assert set(got) == set(want) and 1000 not in got
    size = {i: len(v) for i, v in rows}
    assert all(size[v] == size[q] for q, near in got.items() for _, v in near) and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({v for _, v in got[q]} & {v for _, v in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_recall_on_the_test_tables(spark, sf_dir):
    from pathlib import Path

    for sf, most in (("sf0.01", 0.6), ("sf0.1", 0.45)):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{Path(sf_dir).parent}/{sf}/embeddings.parquet").collect()]
        x = np.array([v for _, v in rows], float)
        forest = neighbours.PrefixForest(x, float(np.sqrt((x * x).sum(1)).max()))
        found = forest.search(x[::20], 21)
        scores = x[::20] @ x.T
        assert np.mean([len(set(np.argsort(-s)[:21]) & set(r.tolist())) / 21 for s, (r, _) in zip(scores, found)]) >= 0.9
        assert forest.scored <= most * len(x) * len(found)


def test_url_rules(spark):
    urls = [None, "", "no scheme.com/x", "http://Example.COM/en/a?b#c", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "a://b://c/d", "http://host?x/y", "http://h\n/p\nq"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge_urls(pages, labels).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/a", "example.com/en/", "block") and got[4] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[6][2:] == ("com/", "allow") and got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block")
    assert got[9][2] is None and got[10][:2] == ("b:", "//c/d") and got[11][:2] == ("host", "") and got[12][:2] == ("h\n", "/p\nq")


def test_url_reputation_shrinks(spark):
    rows, labels, k = [], [], 0
    for host, good, bad in (("bad.site.org", 2, 60), ("one.site.org", 0, 1), ("fine.place.org", 80, 2), ("new.place.org", 0, 0)):
        for i in range(max(good + bad, 3)):
            rows.append((k, f"http://{host}/{i}"))
            if i < good + bad:
                labels.append((k, int(i < good), 0))
            k += 1
    rows.append((k, "http://bad.site.org/last"))
    got = {}
    for r in reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect():
        got.setdefault(r.host, set()).add(r.verdict)
    assert got["bad.site.org"] == {"block"} and got["fine.place.org"] == got["new.place.org"] == {"allow"}
    model = {r.host: r for r in reputation.host_reputation(spark.createDataFrame([(h, g) for h, g in [("a.x.org", 1)] * 9 + [("a.x.org", 0)] + [("b.x.org", 0)]], "host string, good int")).collect()}
    assert 0 < model["b.x.org"].mean < model["a.x.org"].mean < 1


def test_url_reputation_of_hosts_without_labels(spark):
    rows = [(k, f"http://h{k % 5}.{'bad.org' if k < 200 else 'fine.org'}/{k}") for k in range(400)]
    labels = [(k, int(k >= 200), 0) for k in range(400)]
    rows += [(500, "http://new.bad.org/"), (501, "http://new.fine.org/")]
    out = reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.page_id: r for r in out.filter("page_id >= 500").collect()}
    assert got[500].verdict == "block" and got[501].verdict == "allow" and 0 < got[500].high < 0.5
    assert got[500].high < got[501].high


def test_urls_without_pages_and_with_repeats(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, None, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert reputation.judge_urls(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0
    rows = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://b.org/"), (2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "good", "n", "low", "domain")})
    assert sorted((r.page_id or 0, r.host) for r in reputation.judge_urls(pages, labels).collect()) == [(0, "b.org"), (1, "a.org"), (1, "a.org"), (2, "")]
    marked = [("a.org", 1), ("a.org", 0), ("b.org", None)]
    counts = {r.host: (r.n, r.good) for r in reputation.host_reputation(spark.createDataFrame(marked, "host string, good int")).collect()}
    assert counts == {"a.org": (2, 1), "b.org": (0, 0)}


def test_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.org",), ("org",), ("",)], "h string")
    got = [tuple(r) for r in hosts.select(reputation.registered_domain(F.col("h")), reputation.public_suffix(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.org", "org"), ("org", "org"), ("", "")]


def test_arrow_buffers_of_slices():
    from mnemospark.llm.common import text_buffers

    column = pa.array(["aa", None, "b", "ccc"]).slice(1, 3)
    data, offsets = text_buffers(column)
    assert data.tobytes() == b"bccc" and offsets.tolist() == [0, 0, 1, 4]


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    names = ["n_words", "n_removed", "kept_words", "spans", "other", "h", "copies", "theta", "part", "doc", "row", "print", "whole", "score", "kept", "key", "u", "v"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-clash")
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "substring dedup":
            _, kept = brute_removed([r.text for r in docs.orderBy("doc_id").collect()], 35)
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r, k in zip(docs.orderBy("doc_id").collect(), kept) if k or not WORD.search(r.text or "")}
        docs = out
    assert "batch_id" in docs.columns
