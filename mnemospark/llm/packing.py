"""Packing documents into token-budget batches inside optimal length buckets.

One pass gives the histogram of lengths. Dynamic programming over it finds the bucket boundaries with the least padding
when every document is padded to its bucket's boundary. Inside a bucket the documents are numbered, by counts of the parts
of the table that they lie in and offsets rather than one sort, and every floor(budget / boundary) of them form a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

BUCKETS = 16
TOKEN_BUDGET = 16_384


def _next_layer(before: np.ndarray, below: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padded sizes of the first i + 1 lengths with one bucket more than ``before`` (whose item j is the least size
    of the first j lengths), and where that bucket begins.

    The best beginning never moves back as i grows, so the middle of a range of i bounds those of both halves; all ranges
    of one depth are searched at once.
    """
    d = len(lengths)
    best, begin = np.zeros(d, np.int64), np.zeros(d, np.int64)
    lo, hi, a, b = (np.array([x], np.int64) for x in (0, d - 1, 0, d - 1))
    while len(lo):
        mid = (lo + hi) // 2
        n = np.minimum(b, mid) - a + 1
        heads = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - np.repeat(heads - a, n)
        total = before[j] + (np.repeat(below[mid + 1], n) - below[j]) * np.repeat(lengths[mid], n)
        least = np.minimum.reduceat(total, heads)
        at = np.flatnonzero(total == np.repeat(least, n))
        first = j[at[np.searchsorted(at, heads)]]
        best[mid], begin[mid] = least, first
        lo, hi, a, b = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (a, first), (first, b)))
        some = lo <= hi
        lo, hi, a, b = lo[some], hi[some], a[some], b[some]
    return best, begin


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries (at most ``buckets``, the last being the largest length) with the least total padding.

    Exact, in integers; the time grows with buckets * distinct lengths * the logarithm of these.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    d = len(lengths)
    if d <= buckets:
        return lengths.tolist()
    below = np.concatenate([[0], np.cumsum(counts)])
    sizes = below[1:] * lengths  # with one bucket
    begins = [np.zeros(d, np.int64)]
    for _ in range(1, buckets):
        sizes, begin = _next_layer(np.concatenate([[0], sizes]), below, lengths)
        begins.append(begin)
    out, i, k = [], d - 1, buckets - 1
    while i >= 0:
        out.append(int(lengths[i]))
        i, k = int(begins[k][i]) - 1, max(k - 1, 0)
    return out[::-1]


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, the columns named in ``keep``, n_tokens (words), bucket_length, batch_id, slot, padding,
    batch_rows.

    A batch holds floor(budget / bucket_length) documents of one bucket (one, where a document alone exceeds the
    budget), so its padded size stays within the budget; only the last batch of a bucket may be short. batch_id counts
    through all buckets. Null text has length 0; repeated and null ids are packed as often as they come, numbered by the
    part of the table that they lie in, so ties share no task; an empty table gives no rows. The driver takes one number
    for each distinct length: at most the square root of twice the number of all words.
    """
    given = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    slim = docs.select("doc_id", *given, word_count(F.col("text")).alias("n_tokens"), F.spark_partition_id().alias("part"))
    slim = materialize(slim, "pack-lengths")
    histogram = slim.groupBy("n_tokens").count().toArrow()
    lengths, counts = (histogram.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    bounds = optimal_boundaries(lengths, counts, buckets) or [0]
    held = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([-1, *bounds[:-1]], bounds)]
    room = [max(1, budget // max(b, 1)) for b in bounds]
    first_batch = np.concatenate([[0], np.cumsum([-(-n // r) for n, r in zip(held, room)])])[:-1]

    where = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        where = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(where)
    placed = slim.withColumns({"bucket": where, "key": F.xxhash64("doc_id")})
    sizes = placed.groupBy("bucket", "part").count()
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("row", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("key", "doc_id", "n_tokens")))
    numbered = numbered.join(offsets, (F.col("bucket") == F.col("_b")) & (F.col("part") == F.col("_p")))

    def of(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    place = F.col("offset") + F.col("row") - 1
    return numbered.withColumns({"bucket_length": of(bounds), "_room": of(room), "_first": of(first_batch), "_held": of(held)}).select(
        "doc_id",
        *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)],
        "n_tokens",
        "bucket_length",
        (F.col("_first") + F.floor(place / F.col("_room"))).cast("long").alias("batch_id"),
        (place % F.col("_room")).cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        F.least("_room", F.col("_held") - F.floor(place / F.col("_room")) * F.col("_room")).cast("int").alias("batch_rows"),
    )
