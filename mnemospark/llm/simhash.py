"""SimHash near-duplicates found with covering locality-sensitive hashing.

Every position of the fingerprint gets a nonzero vector of r + 1 bits; the table of each nonzero v keeps the positions
whose vector has an odd product with v. The vectors of any r differing positions leave a v that is orthogonal to all of
them, so a pair within the radius r agrees on all that some table keeps: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import as_long, chunks, joined_words, materialize, mix, sequence_hashes, span_hashes, word_spans
from .components import components

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
#: Buckets beyond this size are split by a second family of masks over the positions that the first leaves open.
LARGE_BUCKET = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def covering_masks(radius: int, turn: int = 0) -> list[int]:
    """The 2^(radius + 1) - 1 masks of a covering family; ``turn`` gives other families."""
    n = (1 << (radius + 1)) - 1
    order = np.random.default_rng(1000 * radius + turn).permutation(np.resize(np.arange(1, n + 1), max(n, BITS)) if n < BITS else np.arange(1, n + 1))[:BITS]
    return [sum(1 << i for i in range(BITS) if (int(order[i]) & v).bit_count() % 2 == 1) for v in range(1, n + 1)]


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, lanes: int = 0) -> np.ndarray:
    """One fingerprint per text: bit k is set if over half the shingles' XXH64 values have it.

    With ``lanes``, a row of so many independent fingerprints each, from remixed values.
    """
    starts, ends, first = word_spans(data, offsets)
    out = np.zeros((len(offsets) - 1, max(1, lanes)), np.uint64)
    if not len(starts):
        return out if lanes else out[:, 0]
    joined, to, till = joined_words(_LOWER[data], starts, ends)
    text = joined.tobytes()
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    last = np.minimum(begin + shingle, first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(text[s:e], SEED) for s, e in zip(to[begin].tolist(), till[last].tolist())), np.uint64, len(row))
    full = np.flatnonzero(n)
    heads = np.concatenate([[0], np.cumsum(n[full])])
    step = 1 << 16  # rows of bits at once
    for lane in range(max(1, lanes)):
        lane_values = mix(values + np.uint64(lane)) if lanes else values
        sums = np.zeros((len(full), BITS), np.int64)
        at = 0
        while at < len(values):
            bits = np.unpackbits(lane_values[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo = int(np.searchsorted(heads, at, side="right")) - 1
            hi = int(np.searchsorted(heads, at + len(bits), side="left"))
            cuts = np.maximum(heads[lo:hi] - at, 0)
            sums[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
            at += step
        out[full, lane] = np.packbits(sums * 2 > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out if lanes else out[:, 0]


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(as_long(fingerprints(data, offsets, shingle)))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def bucket_links(rows: np.ndarray, radius: int, apart: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows (node, fingerprint, signature lanes) of one bucket: fingerprints
    within ``radius`` of each other and signatures within ``apart``."""
    rest, out = rows, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest[:, 1] ^ x[1]) <= radius
            if rows.shape[1] > 2 and near.any():
                near[near] = np.bitwise_count(rest[near, 2:] ^ x[2:]).sum(axis=1) <= apart
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out.extend((int(x[0]), y) for y in found[:, 0].tolist())
                queue.extend(found)
    return out


def _bucket_scan(radius: int, apart: int, lanes: int, large: int | None):
    """A scan of rows (bucket, key, node, fp, lanes...) that come sorted: links of each bucket as (-1, 0, a, b, ...),
    and the rows of buckets beyond ``large`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "key", "a", "b", *[f"s{k}" for k in range(lanes)]]
        held: list[np.ndarray] = []
        at, size, deferred = None, 0, False
        links: list[tuple[int, int]] = []
        late: list[tuple[tuple[int, int], np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            n = [len(x) for _, x in late]
            rows = np.concatenate([x for _, x in late]) if late else np.zeros((0, 2 + lanes), np.uint64)
            pairs = np.array(links, np.uint64).reshape(-1, 2)
            blank = np.zeros((len(pairs), lanes), np.uint64)
            both = np.concatenate([np.column_stack([pairs, blank]), rows]).view(np.int64)
            bucket = np.concatenate([np.full(len(pairs), -1), np.repeat([k[0] for k, _ in late], n)]).astype(np.int64)
            key = np.concatenate([np.zeros(len(pairs), np.int64), np.repeat(np.array([k[1] for k, _ in late], np.int64), n)])
            links.clear(), late.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key), *[pa.array(both[:, k]) for k in range(2 + lanes)]], names=names)

        def close() -> None:
            nonlocal held, size, deferred
            if deferred:
                late.extend((at, x) for x in held)
            elif size > 1:
                links.extend(bucket_links(np.concatenate(held), radius, apart))
            held, size, deferred = [], 0, False

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, key, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = np.column_stack(rest).view(np.uint64)
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])) + 1
            heads, tails = np.concatenate([[0], new]), np.append(new, len(rows))
            long = tails - heads > 1
            long[[0, -1]] = True  # these may go on in other batches
            for s, e in zip(heads[long].tolist(), tails[long].tolist()):
                here = (int(bucket[s]), int(key[s]))
                if here != at:
                    if at is not None:
                        close()
                    at = here
                held.append(rows[s:e].copy())
                size += e - s
                if large is not None and size > large:
                    deferred = True
                    late.extend((at, x) for x in held)
                    held = []
                if len(links) + sum(len(x) for _, x in late) > 1 << 16:
                    yield flush()
        if at is not None:
            close()
        if links or late:
            yield flush()

    return run


def _tables(nodes: DataFrame, masks: list[int], key: Column | None = None) -> DataFrame:
    """``(bucket, key, node, fp, ...)``: every row in every table; with ``key``, tables inside what ``bucket, key`` name."""
    longs = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    spread = nodes.select("*", F.posexplode(longs).alias("_t", "_mask"))
    part = F.col("fp").bitwiseAND(F.col("_mask"))
    kept = [c for c in nodes.columns if c not in ("bucket", "key")]
    if key is None:
        return spread.select(F.col("_t").cast("long").alias("bucket"), part.alias("key"), *kept)
    return spread.select((F.col("bucket") * len(masks) + F.col("_t")).cast("long").alias("bucket"), F.xxhash64("key", part).alias("key"), *kept)


def near_links(nodes: DataFrame, radius: int = RADIUS, apart: int = 0, large: int = LARGE_BUCKET) -> DataFrame:
    """Links ``(a, b)`` that join every two of the distinct ``nodes (node, fp, lanes...)`` that are near (through others
    where they chain): fp within ``radius`` and, if there are lanes, these within ``apart``.

    A bucket's links are a spanning forest, never all its pairs. Buckets over ``large`` go through a second family of
    masks; what agrees on both families differs in about 16 positions of fp, so those buckets hold at most some 2^16
    fingerprints whatever the input.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = len(nodes.columns) - 2
    names = [f"s{k}" for k in range(lanes)]
    schema = ", ".join(f"{c} long" for c in ("bucket", "key", "a", "b", *names))

    def scanned(rows: DataFrame, limit: int | None) -> DataFrame:
        dealt = rows.repartition(n, "bucket", "key").sortWithinPartitions("bucket", "key")
        return dealt.mapInArrow(_bucket_scan(radius, apart, lanes, limit), schema)

    found = materialize(scanned(_tables(nodes.toDF("node", "fp", *names), covering_masks(radius)), large), "simhash-links")
    again = found.filter("bucket >= 0").select("bucket", "key", F.col("a").alias("node"), F.col("b").alias("fp"), *names)
    more = scanned(_tables(again, covering_masks(radius, 1), F.col("key")), None)
    return found.filter("bucket < 0").select("a", "b").union(more.select("a", "b"))


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints are one node, so copies cost one row; null or wordless texts all have fingerprint zero and are
    linked like any other. Null doc_ids stay, and do not count for the smallest id (a group of only such has a null
    component_id). Repeated ids give repeated rows; an empty table gives none.
    """
    prints = materialize(fingerprint_documents(docs, shingle), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), radius))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "simhash-nodes")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The deduplicating stage: texts as sets of five-word shingles. Two texts of Jaccard similarity j agree on all minima of
#: one of the bands with probability 1 - (1 - j^BAND)^BANDS: all but 3 in 100,000 at 0.8.
CONFIRM_SHINGLE = 5
BAND, BANDS = 4, 20
MINIMA = 128
SIMILARITY = 0.8
#: Deviations of the agreement among MINIMA from its mean at the similarity: above SURE a pair is a link by itself, below
#: MAYBE it is none.
SURE, MAYBE = 2.8, -3.0
#: Best pairs of a group of surely linked texts that are verified first, and pairs a row that a bucket gives at most.
TRIES = 3
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = CONFIRM_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's different shingles, in order, and for each text (and the end) where they begin.

    Fewer words than a shingle has are one shingle; no words, none.
    """
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    words = span_hashes(_LOWER[data], starts, ends)
    values = sequence_hashes(words, begin, np.minimum(begin + shingle, first[1:][row]))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.searchsorted(row[fresh], np.arange(len(offsets)))


def set_prints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: a hash of the whole, the band keys, and the lowest byte of each minimum packed into longs."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    whole = np.zeros(len(n), np.uint64)
    least = np.zeros((len(n), MINIMA), np.uint64)
    if len(full):
        whole[full] = mix(np.add.reduceat(mix(values), first[:-1][full]) + n[full].astype(np.uint64))
        for k, factor in enumerate(_FACTORS):
            least[full, k] = mix(np.minimum.reduceat(values * factor, first[:-1][full]))
    keys = np.zeros((len(n), BANDS), np.uint64)
    for k in range(BAND):
        keys = mix(keys + least[:, k : BAND * BANDS : BAND])
    return whole, keys, np.ascontiguousarray(least.astype(np.uint8)).view(np.uint64)


def agreement(similarity: float, deviations: float) -> int:
    """Agreeing minima of a pair at ``similarity``, so many deviations off the mean."""
    return int(np.ceil(MINIMA * similarity + deviations * np.sqrt(MINIMA * similarity * (1 - similarity))))


def best_pairs(pairs: np.ndarray) -> np.ndarray:
    """Of the rows (x, y, agreement) those that are among the best TRIES of x or of y."""
    ends, partners, agree = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]]), np.tile(pairs[:, 2], 2)
    order = np.lexsort((partners, -agree, ends))
    own = ends[order]
    return pairs[np.unique(order[np.arange(len(own)) - np.searchsorted(own, own) < TRIES] % len(pairs))]


def bucket_pairs(n: np.ndarray, low: np.ndarray, similarity: float, sure: int, maybe: int) -> tuple[np.ndarray, bool]:
    """Rows (x, y, agreement) of one bucket: a spanning forest of the pairs that agree on ``sure`` bytes of ``low`` or more,
    and open pairs, those between its trees with ``maybe`` or more and set sizes that allow ``similarity``.

    The bucket is dense (the second result) if it has over TRIES times as many open pairs as rows; of these, each row's
    best TRIES are given, and ``dense_links`` looks at all. Other buckets give all.
    """

    def agreeing(x: int) -> tuple[np.ndarray, np.ndarray]:
        fit = rest[np.minimum(n[rest], n[x]) >= similarity * np.maximum(n[rest], n[x])]
        return fit, (low[fit] == low[x]).sum(axis=1)

    rest, out, dense = np.arange(len(n)), [], False
    others, held, most = [np.zeros((0, 3), np.int64)], 0, TRIES * len(n)
    while len(rest) > 1:
        tree, rest = [int(rest[0])], rest[1:]
        for x in tree:  # grows meanwhile
            fit, agree = agreeing(x)
            near = fit[agree >= sure].tolist()
            if near:
                out.extend((x, y, sure) for y in near)
                tree.extend(near)
                rest = rest[~np.isin(rest, near, assume_unique=True)]
        for x in tree if len(rest) else []:
            fit, agree = (fit, agree) if len(tree) == 1 else agreeing(x)
            open_ = agree >= maybe
            if open_.any():
                others.append(np.column_stack([np.full(int(open_.sum()), x), fit[open_], agree[open_]]))
                held += len(others[-1])
            if held > 8 * most:
                others, dense = [best_pairs(np.concatenate(others))], True
                held = len(others[0])
    other = np.concatenate(others)
    dense = dense or len(other) > most
    return np.concatenate([np.array(out, np.int64).reshape(-1, 3), best_pairs(other) if dense else other]), dense


LOW = [f"s{k}" for k in range(MINIMA // 8)]


#: Rows of a bucket that one task compares. Buckets beyond this, and beyond one in BUCKETS of all rows, are large: fewer
#: than BUCKETS are, so their keys are broadcast.
HELD, BUCKETS = 8192, 1 << 18


def sorted_groups(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[np.ndarray]:
    """The rows of each value of the first ``width`` columns, by which the batches come sorted; groups of fewer than
    ``least`` rows may be left out."""
    held: list[np.ndarray] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        new = np.flatnonzero((rows[1:, :width] != rows[:-1, :width]).any(axis=1)) + 1
        heads, tails = np.concatenate([[0], new]), np.append(new, len(rows))
        wanted = tails - heads >= least
        wanted[[0, -1]] = True  # these may go on in other batches
        for s, e in zip(heads[wanted].tolist(), tails[wanted].tolist()):
            here = tuple(rows[s, :width].tolist())
            if here != at and held:
                yield np.concatenate(held)
                held = []
            at = here
            held.append(rows[s:e].copy())
    if held:
        yield np.concatenate(held)


def _scan(width: int, least: int, names: list[str], step):
    """A scan of rows that come sorted by their first ``width`` columns: what ``step`` makes of each group, as ``names``."""

    def batch_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        n = 0
        for rows in sorted_groups(batches, width, least):
            if len(rows) >= least:
                out.append(step(rows))
                n += len(out[-1])
            if n > 1 << 16:
                yield batch_of(out)
                out, n = [], 0
        if out:
            yield batch_of(out)

    return run


def _low(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint8)


def _pair_step(similarity: float, sure: int, maybe: int):
    """Rows (bucket, key, node, n, lows...) of one bucket to its pairs (a, b, agree); a dense bucket adds (bucket, key, -1)."""

    def step(rows: np.ndarray) -> np.ndarray:
        found, dense = bucket_pairs(rows[:, 3], _low(rows[:, 4:]), similarity, sure, maybe)
        pairs = np.column_stack([rows[found[:, 0], 2], rows[found[:, 1], 2], found[:, 2]])
        return np.concatenate([pairs, [[rows[0, 0], rows[0, 1], -1]]]) if dense else pairs

    return step


def _family_step(similarity: float, sure: int, maybe: int):
    """Rows (bucket, key, part, node, n, lows...) of one part of a large bucket to (bucket, key, a, b, agree): its pairs,
    and one row (node, node, -1) of each family that sure links join."""

    def step(rows: np.ndarray) -> np.ndarray:
        found, _ = bucket_pairs(rows[:, 4], _low(rows[:, 5:]), similarity, sure, maybe)
        heads = rows[np.setdiff1d(np.arange(len(rows)), found[found[:, 2] >= sure, 1]), 3]  # each other row is reached once
        pairs = np.column_stack([rows[found[:, 0], 3], rows[found[:, 1], 3], found[:, 2]])
        both = np.concatenate([pairs, np.column_stack([heads, heads, np.full(len(heads), -1)])])
        return np.column_stack([np.broadcast_to(rows[0, :2], (len(both), 2)), both])

    return step


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of equal ``by`` in one task and next to each other, in the order of their nodes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *by).sortWithinPartitions(*by, "node")


def large_bucket_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b, agree)`` of the buckets of ``rows (bucket, key, node, n, lows...)``, none of which one task holds.

    Parts of HELD rows become families joined by sure links; one row of each family goes on to the next round, until
    families no longer meet. ``dense_links`` then compares what is still apart.
    """
    sure, maybe = agreement(similarity, SURE), agreement(similarity, MAYBE)
    bucket, pairs = ["bucket", "key"], []
    schema = "bucket long, key long, a long, b long, agree long"
    now = materialize(rows, "near-large")
    n = now.count()
    while True:
        sizes = now.groupBy(*bucket).agg(F.ceil(F.count("*") / HELD).alias("_parts"))
        split = now.join(F.broadcast(sizes), bucket).select(*bucket, F.pmod(F.xxhash64("node"), "_parts").alias("part"), "node", "n", *LOW)
        step = _scan(3, 1, [*bucket, "a", "b", "agree"], _family_step(similarity, sure, maybe))
        found = materialize(_dealt(split, *bucket, "part").mapInArrow(step, schema), "near-families")
        pairs.append(found.filter("agree >= 0").select("a", "b", "agree"))
        now = materialize(now.join(found.filter("agree < 0").select(*bucket, F.col("a").alias("node")), [*bucket, "node"], "left_semi"), "near-heads")
        was, n = n, now.count()
        if n > was / 2 or sizes.filter("_parts > 1").isEmpty():
            break
    out = pairs[0]
    for more in pairs[1:]:
        out = out.union(more)
    return out


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """``(bucket, key, node, n, lows...)``: every node with a shingle in its bucket of each band."""
    spread = nodes.filter("n > 0").select("*", F.posexplode("keys").alias("_t", "key"))
    return spread.select(F.col("_t").cast("long").alias("bucket"), "key", "node", "n", *LOW)


def near_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b, agree)`` among ``nodes (node, n, keys, lows...)`` from each band's buckets: a forest's links, and
    pairs between its trees that may reach ``similarity``, TRIES a row of the bucket at most. Buckets that may have more
    such pairs are named by rows ``(bucket, key, -1)``."""
    rows = bucket_rows(nodes)
    beyond = max(HELD, nodes.count() * BANDS // BUCKETS)
    large = materialize(rows.groupBy("bucket", "key").count().filter(F.col("count") > beyond).select("bucket", "key"), "near-buckets")
    some = not large.isEmpty()
    plain = rows.join(F.broadcast(large), ["bucket", "key"], "left_anti") if some else rows
    step = _scan(2, 2, ["a", "b", "agree"], _pair_step(similarity, agreement(similarity, SURE), agreement(similarity, MAYBE)))
    pairs = _dealt(plain, "bucket", "key").mapInArrow(step, "a long, b long, agree long")
    if not some:
        return pairs
    held = large_bucket_pairs(rows.join(F.broadcast(large), ["bucket", "key"], "left_semi"), similarity)
    return pairs.union(held).union(large.select("bucket", "key", F.lit(-1).cast("long")))


#: Sides of the cells in which the rows of a dense bucket meet, from the least to the most.
SIDE = 128, 1024
#: Candidates of a row that are compared with it at once.
AT_ONCE = 64


def cell_links(rows: np.ndarray, sets: list[np.ndarray], similarity: float, sure: int, maybe: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that a cell finds between groups: rows (bucket, key, cell, asks, node, n, root, top,
    lows..., keys...) that ask are compared with the others where the bucket is the first that both stand in, best first."""
    node, n, root, top = rows[:, 4:8].T
    low, keys = _low(rows[:, 8 : 8 + len(LOW)]), rows[:, 8 + len(LOW) : 8 + len(LOW) + int(rows[0, 0])]
    others, out = np.flatnonzero(rows[:, 3] == 0), []
    names, group = np.unique(root, return_inverse=True)
    for y in np.flatnonzero(rows[:, 3] == 1).tolist():
        # two rows outside the largest group ask for each other: once is enough
        x = others[(group[others] != group[y]) & ((top[others] == 1) | (node[others] < node[y]))]
        x = x[np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])]
        agree = (low[x] == low[y]).sum(axis=1)
        fit = (agree >= maybe) & ~(keys[x] == keys[y]).any(axis=1)
        order = np.argsort(-agree[fit], kind="stable")
        x, agree = x[fit][order], agree[fit][order]
        for at in range(0, len(x), AT_ONCE):
            some = np.arange(at, min(at + AT_ONCE, len(x)))
            some = some[group[x[some]] != group[y]]
            if not len(some):
                continue
            sizes, values = n[x[some]], np.concatenate([sets[k] for k in x[some].tolist()])
            place = np.minimum(np.searchsorted(sets[y], values), len(sets[y]) - 1)
            shared = np.add.reduceat(sets[y][place] == values, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in x[some[(shared >= similarity * (sizes + n[y] - shared)) | (agree[some] >= sure)]].tolist():
                if group[k] != group[y]:
                    out.append((int(node[k]), int(node[y])))
                    group[group == group[k]] = group[y]
    return out


def _cell_scan(similarity: float, sure: int, maybe: int):
    """A scan of rows (bucket, key, cell, asks, node, n, root, top, lows..., keys, text) that come sorted to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        at = None

        def close() -> pa.RecordBatch:
            found = np.array(cell_links(np.concatenate(held), sets, similarity, sure, maybe), np.int64).reshape(-1, 2)
            held.clear(), sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for rows, data, offsets in chunks(batch):
                values, first = shingle_sets(data, offsets)
                plain = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(8 + len(LOW))]
                both = np.column_stack([*plain, rows.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)])
                new = np.flatnonzero((both[1:, :3] != both[:-1, :3]).any(axis=1)) + 1
                for s, e in zip([0, *new.tolist()], [*new.tolist(), len(both)]):
                    here = tuple(both[s, :3].tolist())
                    if here != at and held:
                        yield close()
                    at = here
                    held.append(both[s:e].copy())
                    sets.extend(values[first[k] : first[k + 1]].copy() for k in range(s, e))
        if held:
            yield close()

    return run


def dense_links(nodes: DataFrame, dense: DataFrame, links: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join what the pairs of the buckets ``dense (bucket, key)`` connect and ``links`` do not.

    In each bucket, what ``links`` leave outside the largest group is compared with the whole bucket, in cells of rows with
    their texts. A cell gives a forest of links, so no pair becomes a row, and none between two groups is passed over.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = ["bucket", "key"]
    roots = materialize(components(links), "near-roots")
    rows = bucket_rows(nodes).select(*bucket, "node").join(dense, bucket, "left_semi")
    rows = materialize(rows.join(roots, "node", "left").select(*bucket, "node", F.coalesce("root", "node").alias("root")), "near-dense")
    per = rows.groupBy(*bucket, "root").agg(F.count("*").alias("c")).groupBy(*bucket).agg(F.sum("c").alias("_all"), F.max(F.struct("c", "root")).alias("_m"))
    per = per.withColumn("_rest", F.col("_all") - F.col("_m.c")).filter("_rest > 0")
    side = F.least(F.lit(SIDE[1]), F.greatest(F.lit(SIDE[0]), F.ceil(F.sqrt(F.col("_all") * F.col("_rest") / (4 * parts)))))
    per = per.select(*bucket, F.col("_m.root").alias("_top"), F.ceil(F.col("_all") / side).alias("_parts"), F.ceil(F.col("_rest") / side).alias("_blocks"))
    rows = materialize(rows.join(per, bucket).withColumn("top", (F.col("root") == F.col("_top")).cast("long")), "near-open")
    known = nodes.join(rows.select("node").distinct(), "node", "left_semi").join(texts.withColumnRenamed("row", "node"), "node")
    known = materialize(known.select("node", "n", *LOW, "keys", "text"), "near-known")

    def cells(asks: int, own: str, others: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("node", F.lit(asks)), own)
        cell = mine * F.col("_blocks") + F.col("_o") if own == "_parts" else F.col("_o") * F.col("_blocks") + mine
        spread = rows.filter("top = 0") if asks else rows
        return spread.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).select(*bucket, cell.alias("cell"), F.lit(asks).cast("long").alias("asks"), "node", "root", "top")

    met = cells(0, "_parts", "_blocks").union(cells(1, "_blocks", "_parts")).join(known, "node")
    met = met.select(*bucket, "cell", "asks", "node", "n", "root", "top", *LOW, "keys", "text")
    return _dealt(met, *bucket, "cell").mapInArrow(_cell_scan(similarity, agreement(similarity, SURE), agreement(similarity, MAYBE)), "a long, b long")


#: The verification: links of one text that a task checks with one copy of it.
LINKS = 256


def _verify_scan(similarity: float):
    """A scan of rows (a, part, other, text) that come sorted: a text first (other -1), then those to compare with it;
    gives the pairs with whether their sets reach ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            for rows, data, offsets in chunks(batch):
                values, first = shingle_sets(data, offsets)
                a, b, near = [], [], []
                for k, (x, y) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist())):
                    own = values[first[k] : first[k + 1]]
                    if y < 0:
                        hub = own.copy()
                        continue
                    shared = len(np.intersect1d(hub, own, assume_unique=True))
                    a.append(x), b.append(y), near.append(shared / max(1, len(hub) + len(own) - shared) >= similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, near)``: whether the five-word shingle sets of two ``texts (row, text)`` reach ``similarity``."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    busy = pairs.groupBy("a").agg(F.ceil(F.count("*") / LINKS).alias("_parts"))
    dealt = pairs.join(busy, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_parts").alias("part"))
    hubs = dealt.select("a", "part").distinct().select("a", "part", F.lit(-1).cast("long").alias("other"), F.col("a").alias("row"))
    ends = hubs.union(dealt.select("a", "part", "b", "b"))
    held = texts.join(ends.hint("shuffle_hash"), "row").select("a", "part", "other", "text")
    return held.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "other").mapInArrow(_verify_scan(similarity), "a long, b long, near boolean")


def near_set_links(nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join the nodes which pairs of ``similarity`` or more connect.

    Pairs that agree on SURE minima are links. Where what these join has pairs with others that may reach ``similarity``,
    the best TRIES of each such group are verified on the texts, then, of the pairs whose ends these links do not join
    yet, all the others that ``near_pairs`` gives, and last all pairs of dense buckets: no candidate between two groups
    is left to the estimate.
    """
    every = materialize(near_pairs(nodes, similarity), "near-every")
    dense = materialize(every.filter("agree < 0").select(F.col("a").alias("bucket"), F.col("b").alias("key")), "near-buckets")
    found = every.filter("agree >= 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree"))
    found = materialize(found, "near-pairs")
    at_least = agreement(similarity, SURE)
    links = found.filter(F.col("agree") >= at_least).select("a", "b")
    maybe = found.filter(F.col("agree") < at_least)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends ``links`` do not join, with the roots of their ends."""
        roots = materialize(components(links), "near-roots")
        for c in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"_{c}", c)).drop(f"_{c}")
        return pairs.filter(F.col("ra") != F.col("rb"))

    maybe = materialize(apart(maybe), "near-maybe")
    lo, hi = F.least("ra", "rb"), F.greatest("ra", "rb")
    pairs = maybe.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("lo", "hi", "p.*")
    sides = pairs.select(F.col("lo").alias("root"), "agree", "a", "b").union(pairs.select("hi", "agree", "a", "b"))
    best = sides.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy(F.col("agree").desc(), "a", "b"))).filter(F.col("_n") <= TRIES)
    tried = materialize(best.select("a", "b").distinct(), "near-tried")
    judged = materialize(verified(tried, texts, similarity).filter("near").select("a", "b"), "near-judged")
    links = links.union(judged)
    rest = materialize(apart(maybe.select("a", "b").join(tried, ["a", "b"], "left_anti")).select("a", "b"), "near-rest")
    links = materialize(links.union(verified(rest, texts, similarity).filter("near").select("a", "b")), "near-links")
    if dense.isEmpty():
        return links
    return links.union(materialize(dense_links(nodes, dense, links, texts, similarity), "near-links"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the row with the smallest doc_id stays.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is ``similarity`` or more; groups
    are what links connect. Bands of minima propose the pairs (all but some 3 in 100,000 of those at 0.8); pairs near the
    limit are verified on the texts. Copies (also of an id) leave one row; a null doc_id stays only if its group has no other; null texts and
    wordless ones are copies of each other.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = []
            for _, data, offsets in chunks(pa.RecordBatch.from_arrays([text], names=["text"])):
                values, first = shingle_sets(data, offsets)
                whole, keys, low = set_prints(values, first)
                parts.append(np.column_stack([whole, np.diff(first).astype(np.uint64), low, keys]))
            all_ = as_long(np.concatenate(parts) if parts else np.zeros((0, 2 + len(LOW) + BANDS), np.uint64))
            plain = [pa.array(np.ascontiguousarray(all_[:, k])) for k in range(2 + len(LOW))]
            keys = np.ascontiguousarray(all_[:, 2 + len(LOW) :])
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.StructArray.from_arrays([*plain, lists], names=["whole", "n", *LOW, "keys"])

    prints = arrow_udf(run, ", ".join(f"{c} long" for c in ("whole", "n", *LOW)) + ", keys array<long>")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("doc"), prints(F.col("text")).alias("print"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "near-rows")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
    ids = rows.select(F.col("print.whole").alias("whole"), "print", "row", order.alias("order"))
    # equal sets are one node, named by the row that stays
    nodes = ids.groupBy("whole").agg(F.min("order").alias("least"), F.first("print").alias("print"))
    nodes = materialize(nodes.select(F.col("least.row").alias("node"), "least", *[f"print.{c}" for c in ("n", *LOW, "keys")]), "near-nodes")
    links = near_set_links(nodes.drop("least"), rows.select("row", F.col("doc.text").alias("text")), similarity)
    roots = components(links)
    kept = nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    return rows.join(kept.select(F.col("least.row").alias("row")), "row", "left_semi").select("doc.*")
