"""Nearest neighbours by inner product with hash-prefix forests.

The rows lie in shards. Each shard holds, per tree, the sorted array of its rows' hash strings: under a random rotation,
first the coordinate of the largest size with its sign, then the signs of the coordinates one by one. A query descends
every tree to its longest-prefix matches by binary search; from there all trees ascend together, one prefix bit at a time,
and only the rows of the matched ranges are scored. The ascent ends at the depth where a row as near as the k-th best
found so far would have been missed by all trees with at most the given probability, so tight neighbourhoods stop early
and flat ones go on, to the roots if they must.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TREES = 96
HASH_BITS = 32
#: Coordinates that a rotation keeps at most; longer vectors are projected.
MOST_AXES = 64
MISS = 0.2
NEAREST = 20
QUERY_EVERY = 20
SHARD_ROWS = 32_768
#: Queries that a task searches at once.
QUERY_ROWS = 512
#: The rates at which rows at an angle share prefixes are measured on so many made-up pairs for each of so many cosines.
PAIRS, COSINES = 4000, 41


@functools.lru_cache(maxsize=4)
def rotations(width: int, trees: int) -> np.ndarray:
    """For each tree, orthonormal directions as columns: (trees, width, axes)."""
    rng, axes = np.random.default_rng(7), min(width, MOST_AXES)
    return np.stack([np.linalg.qr(rng.standard_normal((width, axes)))[0] for _ in range(trees)]).astype(np.float32)


def hash_strings(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hash strings of HASH_BITS bits: sign and index of the largest coordinate after the turn, then all signs."""
    y = x @ turn
    axes = y.shape[1]
    bits = max(1, (axes - 1).bit_length())
    top = np.abs(y).argmax(axis=1)
    sign = y[np.arange(len(y)), top] > 0
    out = (sign.astype(np.uint64) << np.uint64(bits)) | top.astype(np.uint64)
    rest = HASH_BITS - bits - 1
    for k in range(rest):
        out = (out << np.uint64(1)) | (y[:, k] > 0) if k < axes else out << np.uint64(1)
    return out


@functools.lru_cache(maxsize=4)
def prefix_rates(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, and for each depth and cosine the share of pairs at that angle that agree on so many bits."""
    rng = np.random.default_rng(11)
    cosines = np.linspace(0.0, 1.0, COSINES)
    turn = rotations(width, 1)[0]
    rates = np.zeros((HASH_BITS + 1, COSINES))
    for k, c in enumerate(cosines):
        a, b = rng.standard_normal((2, PAIRS, width))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b, axis=1, keepdims=True)
        differ = (hash_strings(a.astype(np.float32), turn) ^ hash_strings(b.astype(np.float32), turn)).astype(np.float64)
        common = HASH_BITS - np.frexp(differ)[1]
        rates[:, k] = [(common >= d).mean() for d in range(HASH_BITS + 1)]
    return cosines, rates


class PrefixForest:
    """Sorted arrays of hash strings over the rows of ``vectors`` (float64); ``longest``: the largest norm in the table,
    ``total``: the rows in the table, of which these are a random share."""

    def __init__(self, vectors: np.ndarray, longest: float, total: int | None = None, trees: int = TREES):
        self.vectors, self.longest, self.trees = vectors, longest, trees
        n, width = vectors.shape
        self.share = n / max(total or n, n)
        # one more coordinate gives all rows the same norm, so that inner products order like angles
        rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.narrow = np.column_stack([vectors, rest]).astype(np.float32)
        self.turns = rotations(width + 1, trees)
        self.order, self.keys = np.empty((trees, n), np.int32), np.empty((trees, n), np.uint64)
        for t in range(trees):
            key = hash_strings(self.narrow, self.turns[t])
            self.order[t] = np.argsort(key, kind="stable")
            self.keys[t] = key[self.order[t]]
        self.cosines, self.rates = prefix_rates(width + 1)
        #: How many rows were scored so far.
        self.scored = 0

    def ranges(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the rows that share the first ``depth`` bits."""
        drop = np.uint64(HASH_BITS - depth)
        low = (keys >> drop) << drop
        high = low + (np.uint64(1) << drop)
        lo, hi = np.empty(keys.shape, np.int32), np.empty(keys.shape, np.int32)
        for t in range(self.trees):
            lo[t] = np.searchsorted(self.keys[t], low[t], side="left")
            hi[t] = np.searchsorted(self.keys[t], high[t], side="left")
        return lo, hi

    def stops(self, cosine: np.ndarray, depth: int, miss: float) -> np.ndarray:
        """Whether rows at these cosines are missed by all trees at ``depth`` with at most that probability."""
        rate = np.interp(cosine, self.cosines, self.rates[depth])
        return (1 - rate) ** self.trees <= miss

    def search(self, queries: np.ndarray, k: int, miss: float = MISS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (float64) the rows and scores of its k best candidates, or a few more where they tie.

        In a random share of the table only a share of the k nearest is to be expected; the ascent is judged by those.
        """
        n, many = len(self.vectors), len(queries)
        narrow = np.column_stack([queries, np.zeros(many)]).astype(np.float32)
        keys = np.stack([hash_strings(narrow, turn) for turn in self.turns])
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", queries, queries)) * self.longest, 1e-300)
        expected = min(k, int(np.ceil(k * self.share + 2 * np.sqrt(k * self.share * (1 - self.share)))))
        rows = [np.zeros(0, np.int64)] * many
        scores = [np.zeros(0, np.float32)] * many
        seen = [np.zeros(0, bool)] * many
        was: list[tuple[np.ndarray, np.ndarray] | None] = [None] * many
        open_ = np.arange(many)
        for depth in range(HASH_BITS, -1, -1):
            if not len(open_):
                break
            lo, hi = self.ranges(keys[:, open_], depth)
            on = np.ones(len(open_), bool)
            for j, i in enumerate(open_.tolist()):
                a, b = lo[:, j], hi[:, j]
                if was[i] is None:
                    if not (b > a).any():
                        continue
                    was[i], seen[i] = (a, a), np.zeros(n, bool)
                c, d = was[i]
                parts = [self.order[t, x:y] for t, x, y in zip(range(self.trees), a.tolist(), c.tolist()) if x < y]
                parts += [self.order[t, x:y] for t, x, y in zip(range(self.trees), d.tolist(), b.tolist()) if x < y]
                was[i] = (a, b)
                if parts:
                    fresh = np.concatenate(parts)
                    fresh = fresh[~seen[i][fresh]]
                    seen[i][fresh] = True
                    fresh = np.unique(fresh)
                    self.scored += len(fresh)
                    rows[i] = np.concatenate([rows[i], fresh])
                    scores[i] = np.concatenate([scores[i], self.narrow[fresh] @ narrow[i]])
                    if len(rows[i]) > k:
                        least = np.partition(scores[i], len(rows[i]) - k)[len(rows[i]) - k]
                        near = scores[i] >= least - 1e-5 * norm[i]
                        rows[i], scores[i] = rows[i][near], scores[i][near]
                if len(rows[i]) >= expected:
                    kth = np.partition(scores[i], len(rows[i]) - expected)[len(rows[i]) - expected]
                    on[j] = not self.stops(min(1.0, max(0.0, float(kth / norm[i]))), depth, miss)
                if not on[j]:
                    seen[i] = np.zeros(0, bool)
            open_ = open_[on]
        return [(r, (self.vectors[r] * q).sum(axis=1)) for r, q in zip(rows, queries)]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


FOUND = "query_id long, qhash long, vec_id long, score double"


def _nearest(forest: PrefixForest, ids: list[list[int]], queries: pa.RecordBatch, k: int, miss: float) -> pa.RecordBatch:
    """The k best rows of the forest for each of some queries (query_id, qhash, vec)."""
    q = np.stack(queries.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
    who, mark = queries.column("query_id").to_pylist(), queries.column("qhash").to_pylist()
    out: tuple[list, ...] = ([], [], [], [])
    # one more than asked for: the query's own vector may be among them
    for i, (rows, s) in enumerate(forest.search(q, k + 1, miss)):
        pairs = sorted((-x, v) for x, r in zip(s.tolist(), rows.tolist()) for v in ids[r] if v != who[i])[:k]
        out[0].extend([who[i]] * len(pairs))
        out[1].extend([mark[i]] * len(pairs))
        out[2].extend(v for _, v in pairs)
        out[3].extend(-x for x, _ in pairs)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "qhash", "vec_id", "score"])


def _search_shards(k: int, miss: float):
    """A scan of rows (width, shard, query_id, qhash, ids, vec, longest, total) that come sorted: a shard's rows first
    (no query_id), of which the forest is built once, then the queries, which stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, forest, ids, held = None, None, [], []

        def plant() -> None:
            nonlocal forest, ids, held
            table = pa.Table.from_batches(held)
            x = np.stack(table.column("vec").to_numpy()).astype(np.float64)
            forest = PrefixForest(x, table.column("longest")[0].as_py(), table.column("total")[0].as_py())
            ids, held = table.column("ids").to_pylist(), []

        for batch in batches:
            width, shard = (batch.column(c).to_numpy() for c in ("width", "shard"))
            is_row = np.asarray(batch.column("query_id").is_null())
            cuts = np.flatnonzero((width[1:] != width[:-1]) | (shard[1:] != shard[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (width[a], shard[a]) != at:
                    at, forest, ids, held = (width[a], shard[a]), None, [], []
                if is_row[a]:
                    held.append(part)
                    continue
                if forest is None:
                    plant()
                for block in range(0, part.num_rows, QUERY_ROWS):
                    yield _nearest(forest, ids, part.slice(block, QUERY_ROWS), k, miss)

    return run


def nearest_neighbours(rows: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, miss: float = MISS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows nearest to each query among all rows of ``rows (vec_id, embedding)``.

    Queries are the rows whose vec_id is divisible by ``every``; a query's own id is no candidate. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id. Vectors of another
    length have no inner product with a query: each length is searched on its own. Equal vectors are indexed once, with
    their k + 1 smallest ids, which is all that can rank; scores are exact double-precision inner products; ties go to
    the smaller vec_id. A repeated query id with different vectors is ranked for each of them. Each shard's forest is built
    once, by one task, and the queries of that length stream through it.
    """
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    named = materialize(named.withColumns({"key": F.xxhash64("vec"), "width": F.size("vec")}), "ann-vectors")
    among = Window.partitionBy("key", "vec").orderBy("vec_id")
    index = named.withColumn("_n", F.row_number().over(among)).filter(F.col("_n") <= k + 1).groupBy("key", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = materialize(index.withColumn("width", F.size("vec")), "ann-index")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # one row for each length: at most the square root of twice the table's components, so it may be broadcast
    widths = index.groupBy("width").agg(F.max(norm).alias("longest"), F.count("*").alias("total"))
    widths = F.broadcast(materialize(widths.withColumn("shards", F.ceil(F.col("total") / shard_rows).cast("long")), "ann-widths"))
    nothing = F.lit(None).cast("long")
    left = index.join(widths, "width").select("width", F.pmod("key", "shards").alias("shard"), nothing.alias("query_id"), nothing.alias("qhash"), "ids", "vec", "longest", "total")
    queries = named.filter(F.col("vec_id") % every == 0).select("width", F.col("vec_id").alias("query_id"), F.col("key").alias("qhash"), "vec").distinct()
    spread = queries.join(widths, "width").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    right = spread.select("width", "shard", "query_id", "qhash", F.array().cast("array<long>").alias("ids"), "vec", "longest", "total")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by range, so that no two shards share a task while others idle
    dealt = left.union(right).repartitionByRange(parts, "width", "shard").sortWithinPartitions("width", "shard", F.col("query_id").asc_nulls_first(), "qhash")
    found = dealt.mapInArrow(_search_shards(k, miss), FOUND)
    by_query = Window.partitionBy("query_id", "qhash").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
