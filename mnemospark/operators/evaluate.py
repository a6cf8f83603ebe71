"""Measures over labelled rows, probes and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(rows: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn (of each group) over rows with a known truth."""
    known = rows.filter(truth.isNotNull() & said.isNotNull())
    counts = [F.count_if(a & b).alias(n) for n, a, b in (("tp", truth, said), ("fp", ~truth, said), ("fn", truth, ~said), ("tn", ~truth, ~said))]
    return known.groupBy(*by).agg(*counts) if by else known.agg(*counts)


def with_rates(counts: DataFrame, empty: float = 1.0) -> DataFrame:
    """With precision, recall and F1; where nothing was said, or nothing true, the rate is ``empty``."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp == 0, F.lit(empty)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(empty)).otherwise(tp / (tp + fn))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


#: Ranges of values that running counts are summed in.
BINS = 1024


def counts_below(per: DataFrame, value: str, count: str) -> DataFrame:
    """``per``, one row per distinct ``value``, with ``_below``: the sum of ``count`` over smaller values.

    Values are cut into at most BINS + 1 ranges; sums run inside each range and over the ranges, never over all values.
    """
    x = F.col(value).cast("double")
    ends = F.broadcast(per.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    place = F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bin_ = F.when(F.isnan(place), BINS).otherwise(F.floor(F.coalesce(place, F.lit(0.0)) * (BINS - 1))).cast("int")
    cut = per.crossJoin(ends).withColumn("_bin", bin_).drop("_lo", "_hi")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_bin").agg(F.sum(count).alias("_s")).select("_bin", F.coalesce(F.sum("_s").over(before.orderBy("_bin")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(count).over(before.partitionBy("_bin").orderBy(value)), F.lit(0))
    return cut.join(F.broadcast(sums), "_bin").withColumn("_below", F.col("_base") + inside).drop("_bin", "_base")


def auc(rows: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half, as one row; null without both.

    From counts per distinct score, so neither pairs nor ranks of single rows are made.
    """
    per = rows.filter(truth.isNotNull() & score.isNotNull()).groupBy(score.alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    wins = counts_below(per, "s", "n").select((F.col("p") * (F.col("_below") + F.col("n") / 2)).alias("w"), "p", "n")
    total = F.sum("p") * F.sum("n")
    return wins.agg(F.when(total > 0, F.sum("w") / total).alias("auc"))


def retrieval(ranks: DataFrame, *by: str) -> DataFrame:
    """Hit@1/3/5/10, MRR and misses over probes with ``rank`` (null or 0: missed)."""
    hit = F.coalesce("rank", F.lit(0))
    measures = [F.count("*").alias("n"), *[F.count_if((hit > 0) & (hit <= k)).alias(f"hit{k}") for k in (1, 3, 5, 10)], F.avg(F.when(hit > 0, 1.0 / hit).otherwise(0.0)).alias("mrr"), F.count_if(hit == 0).alias("missed")]
    return ranks.groupBy(*by).agg(*measures) if by else ranks.agg(*measures)


def probe_ranks(probes: DataFrame, ranking: DataFrame) -> DataFrame:
    """Rank of each probe's target ``(qid, target_id)`` in a ranking, null if it is not there."""
    return probes.join(ranking.select("qid", F.col("id").alias("target_id"), "rank"), ["qid", "target_id"], "left")


def threshold_sweep(rows: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """Confusion and rates at each threshold, in one pass."""
    at = rows.select(truth.alias("truth"), score.alias("score"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return with_rates(confusion(at, F.col("truth"), F.col("score") >= F.col("threshold"), "threshold"))


def histogram(rows: DataFrame, score: Column, label: Column, bands: int = 5) -> DataFrame:
    """Rows per band of equal width on [0, 1] and label."""
    band = F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor(score / F.lit(1.0 / bands)))).cast("int")
    return rows.groupBy(band.alias("band")).agg(F.count_if(label).alias("positive"), F.count_if(~label).alias("negative"))


def upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, least, upper median and largest value of each group (A15, A16): the median is element n // 2 of the sorted.

    From counts per distinct value; without groups these run in ranges.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    if by:
        below = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        place = per.withColumns({"_below": F.coalesce(below, F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    else:
        place = counts_below(per, value, "_c").crossJoin(F.broadcast(per.agg(F.sum("_c").alias("_n"))))
    middle = F.floor(F.col("_n") / 2)
    here = (F.col("_below") <= middle) & (middle < F.col("_below") + F.col("_c"))
    return place.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.min(value).alias("least"), F.max(F.when(here, F.col(value))).alias("median"), F.max(value).alias("most"))


def stability(runs: DataFrame) -> DataFrame:
    """Over repeated runs ``(row, score, write)``: rows, flips of the decision, rows that moved over 0.01."""
    per = runs.groupBy("row").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_if("write").alias("w"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("rows"), F.count_if((F.col("w") > 0) & (F.col("w") < F.col("n"))).alias("flips"), F.count_if(F.col("hi") - F.col("lo") > 0.01).alias("moved"), F.max(F.col("hi") - F.col("lo")).alias("widest"))


def movement(pairs: DataFrame, before: Column, after: Column, dead: float = 0.01) -> DataFrame:
    """Improved, worsened and same pairs."""
    d = after - before
    return pairs.agg(F.count_if(d > dead).alias("improved"), F.count_if(d < -dead).alias("worsened"), F.count_if(F.abs(d) <= dead).alias("same"))


def compare(now: DataFrame, baseline: DataFrame, key: list[str], value: str, digits: int = 2) -> DataFrame:
    """Values against a baseline's, with the difference at printed precision."""
    b = baseline.select(*key, F.col(value).alias("_was"))
    shown = lambda c: F.floor(F.col(c) * 10**digits + 0.5) / 10**digits
    return now.join(b, key, "full").select(*key, F.col(value).alias("now"), F.col("_was").alias("was"), (shown(value) - shown("_was")).alias("delta"))


def best_of_sweep(rows: DataFrame) -> DataFrame:
    """The sweep row with the most coverage, then share, then fewest tokens."""
    return rows.orderBy(F.col("covered").desc(), F.col("share").desc(), F.col("tokens")).limit(1)


def provenance(lines: DataFrame) -> DataFrame:
    """Shares of lines said by the user, the assistant or neither."""
    kind = F.when(F.col("by_user"), "user").when(F.col("by_assistant"), "assistant").otherwise("neither")
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), (F.count("*") / F.sum(F.count("*")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("share"))


def mode_of(votes: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first."""
    counted = votes.groupBy(key, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value))


def length_ratio(pairs: DataFrame) -> DataFrame:
    """Mean length ratio of accepted rewrites, and counts by reason."""
    return pairs.groupBy("reason").agg(F.count("*").alias("n"), F.avg(F.when(F.col("reason") == "ok", F.length("after") / F.length("before"))).alias("ratio"))
