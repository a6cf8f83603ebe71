"""Blocks of rows against blocks of rows: the nearest vectors, the messages that hold most of a span's tokens.

Each pair of blocks is one group in one task, and its pairs exist only as a small array there, so no pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one block at most, and blocks at least (for work in parallel).
ROWS, QUERIES, LEAST = 65_536, 16_384, 24
#: Sums in another order differ by less.
MARGIN = 2e-9


def in_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_rows: int, right_rows: int, left_least: int = 1, right_least: int = 1):
    """Both sides dealt into blocks by their keys and grouped so that every block meets every block of the other side."""
    a = max(left_least, -(-left.count() // left_rows))
    b = max(right_least, -(-right.count() // right_rows))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mine = left.select("*", F.pmod(F.xxhash64(left_key), F.lit(a)).cast("int").alias("_a"), every(b).alias("_b"))
    theirs = right.select("*", F.pmod(F.xxhash64(right_key), F.lit(b)).cast("int").alias("_b"), every(a).alias("_a"))
    return mine.groupBy("_a", "_b").cogroup(theirs.groupBy("_a", "_b"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of ``size`` components as rows; others, and those with nulls, are zero."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = sizes != size
    if flat.null_count:
        bad[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    out = np.zeros((len(sizes), size))
    out[~bad] = flat.to_numpy(zero_copy_only=False).astype(np.float64)[~bad[row]].reshape(-1, size)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def best_cosines(q: np.ndarray, v: np.ndarray, limit: int, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, vector, score)``: for each row of ``q`` the ``limit`` rows of ``v`` with the largest cosines, equal to nine
    digits in the order of ``v``. Products in blocks choose what is scored by sums in order."""
    with np.errstate(all="ignore"):
        qn, vn = _norms(q), _norms(v)
        # of equal vectors only the first can be among the best
        _, same = np.unique(v, axis=0, return_inverse=True)
        order = np.argsort(same.ravel(), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(same.ravel()[order]) != 0]))
        nth = np.arange(len(v)) - np.repeat(heads, np.diff(np.append(heads, len(v))))
        held = np.sort(order[nth < limit])
        v, vn = v[held], vn[held]
        out = []
        for lo in range(0, len(q), 512):
            x, xn = q[lo : lo + 512], qn[lo : lo + 512]
            least = np.full(len(x), -MARGIN if positive else -np.inf)
            row, col, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            at, step = 0, 512
            while at < len(v):
                norms = np.outer(xn, vn[at : at + step])
                part = np.where(norms == 0, 0.0, x @ v[at : at + step].T / norms)
                part[np.isnan(part)] = np.inf
                r, c = np.nonzero(part >= least[:, None])
                row, col, near = np.concatenate([row, r]), np.concatenate([col, c + at]), np.concatenate([near, part[r, c]])
                by = np.lexsort((-near, row))
                row, col, near = row[by], col[by], near[by]
                first = np.searchsorted(row, np.arange(len(x) + 1))
                full = np.flatnonzero(np.diff(first) >= limit)
                least[full] = np.maximum(least[full], near[first[full] + limit - 1] - MARGIN)
                keep = near >= least[row]
                row, col, near = row[keep], col[keep], near[keep]
                at, step = at + step, min(2 * step, 4096)
            for k in range(0, len(row), 1 << 17):
                r, c = row[k : k + (1 << 17)], col[k : k + (1 << 17)]
                norms = xn[r] * vn[c]
                near[k : k + len(r)] = np.where(norms == 0, 0.0, np.cumsum(x[r] * v[c], axis=1)[:, -1] / norms)
            if positive:
                fine = ~(near <= 0)
                row, col, near = row[fine], col[fine], near[fine]
            level = np.where(np.isnan(near), np.inf, np.floor(near * 1e9 + 0.5))
            by = np.lexsort((col, -level, row))
            row, col, near = row[by], col[by], near[by]
            best = np.arange(len(row)) - np.searchsorted(row, row) < limit
            out.append((row[best] + lo, held[col[best]], near[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(queries: DataFrame, vectors: DataFrame, tie: str, limit: int, positive: bool = False) -> DataFrame:
    """``(qid, id, score, <tie>)``: of every block of ``vectors (id, embedding, <tie>)`` the ``limit`` best by cosine for each of
    ``queries (qid, embedding)``, the larger ``tie`` and then the smaller id first where scores agree to nine digits; with
    ``positive`` only scores above 0. The best of all blocks are among them.

    Exact: all vectors are scored. Vectors that are null, zero, of another length or with null components score 0.
    """

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:  # such a side comes without columns
            return none
        v = v.take(pc.sort_indices(v, sort_keys=[(tie, "descending"), ("id", "ascending")]))
        sizes = pc.fill_null(pc.list_value_length(q.column("q")), 0).to_numpy()
        out = []
        for size in np.unique(sizes).tolist():
            mine = q.filter(pa.array(sizes == size))
            a, b, score = best_cosines(_matrix(mine.column("q"), max(size, 1)), _matrix(v.column("embedding"), max(size, 1)), limit, positive)
            out.append(pa.table({"qid": mine.column("qid").take(a), "id": v.column("id").take(b), "score": score, tie: v.column(tie).take(b)}))
        return pa.concat_tables(out)

    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField(tie, vectors.schema[tie].dataType)])
    none = to_arrow_schema(schema).empty_table()
    # the two sides may be one table, so the queries' column gets a name of its own
    met = in_blocks(queries.select("qid", F.col("embedding").alias("q")), vectors.select("id", "embedding", tie), "qid", "id", QUERIES, ROWS, 1, LEAST)
    return met.applyInArrow(search, schema)


#: Tokens of a block whose counts are a product of matrices; the others are counted one by one.
DENSE = 256


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of each entry of ``tokens``."""
    column = table.column("tokens")
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def most_shared(a: tuple[np.ndarray, np.ndarray], time: np.ndarray, b: tuple[np.ndarray, np.ndarray], said_at: np.ndarray) -> np.ndarray:
    """For each row of ``a`` the most of its tokens that one row of ``b`` with an earlier time holds. Both are (row, token)
    with each token of a row once, and come in the order of their times."""
    tokens, code = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    x, y = code[: len(a[1])], code[len(a[1]) :]
    nx, ny = np.bincount(x, minlength=len(tokens)), np.bincount(y, minlength=len(tokens))
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(-(nx * ny), kind="stable")] = np.arange(len(tokens))
    x, y = rank[x], rank[y]
    both = np.zeros(len(tokens), bool)
    both[rank] = (nx > 0) & (ny > 0)
    wide = min(DENSE, int(both.sum()))
    left, right = np.zeros((len(time), wide), np.float32), np.zeros((len(said_at), wide), np.float32)
    left[a[0][x < wide], x[x < wide]] = 1
    right[b[0][y < wide], y[y < wide]] = 1
    rare_x, rare_y = (x >= wide) & both[x], (y >= wide) & both[y]
    row, x = a[0][rare_x], x[rare_x]
    by = np.lexsort((b[0][rare_y], y[rare_y]))
    post, y = b[0][rare_y][by], y[rare_y][by]
    before = np.searchsorted(said_at, time)
    out = np.zeros(len(time), np.int64)
    for lo in range(0, len(time), 256):
        hi = min(lo + 256, len(time))
        s, e = np.searchsorted(row, [lo, hi])
        begin, end = np.searchsorted(y, x[s:e]), np.searchsorted(y, x[s:e], side="right")
        # the rare tokens' pairs, in the order of the rows of b
        n = end - begin
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        r, c = np.repeat(row[s:e] - lo, n), post[at]
        by = np.argsort(c, kind="stable")
        r, c = r[by], c[by]
        most = np.zeros(hi - lo, np.float32)
        for start in range(0, int(before[hi - 1]), 4096):
            stop = min(start + 4096, int(before[hi - 1]))
            part = left[lo:hi] @ right[start:stop].T
            f, t = np.searchsorted(c, [start, stop])
            np.add.at(part.reshape(-1), r[f:t] * (stop - start) + c[f:t] - start, np.float32(1))
            if before[lo] < stop:
                part[np.arange(start, stop) >= before[lo:hi, None]] = 0
            most = np.maximum(most, part.max(axis=1))
        out[lo:hi] = most
    return out


def best_coverage(spans: DataFrame, messages: DataFrame, min_coverage: float) -> DataFrame:
    """``(cid, coverage)``: of the spans ``(cid, time, tokens)`` the largest share of tokens that one of ``messages (mid,
    said_at, tokens)`` with an earlier time holds, where that is ``min_coverage`` or more. Tokens are hashes, each once in
    a row; every span meets every message."""

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return none
        a, b = a.filter(pc.is_valid(a.column("time"))), b.filter(pc.is_valid(b.column("said_at")))
        a, b = a.sort_by("time"), b.sort_by("said_at")
        shared = most_shared(_tokens(a), a.column("time").to_numpy(), _tokens(b), b.column("said_at").to_numpy())
        share = shared / np.maximum(pc.list_value_length(a.column("tokens")).to_numpy(), 1)
        hit = (share >= min_coverage) & (shared > 0)
        return pa.table({"cid": a.column("cid").filter(pa.array(hit)), "coverage": share[hit]})

    met = in_blocks(spans.select("cid", "time", "tokens"), messages.select("mid", "said_at", "tokens"), "cid", "mid", 2 * ROWS, QUERIES, 2, 6)
    schema = T.StructType([T.StructField("cid", spans.schema["cid"].dataType), T.StructField("coverage", T.DoubleType())])
    none = to_arrow_schema(schema).empty_table()
    found = met.applyInArrow(search, schema)
    return found.groupBy("cid").agg(F.max("coverage").alias("coverage"))
