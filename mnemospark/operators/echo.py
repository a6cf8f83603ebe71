"""Text that only repeats what others said before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.tokens import token_set
from .nearest import best_coverage


def echo_windows(needle: Column, floor: Column) -> Column:
    """``array<struct<size,start,part>>``: windows of a needle from its length down to the floor by four, at every
    fourth start (H3)."""
    n = F.length(needle)
    sizes = F.when(n >= floor, F.sequence(n, floor, F.lit(-4))).otherwise(F.array().cast("array<int>"))
    return F.flatten(
        F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(0), n - size, F.lit(4)), lambda start: F.struct(size.alias("size"), start.alias("start"), F.substring(needle, start + 1, size).alias("part"))))
    )


def earlier_pairs(candidates: DataFrame, messages: DataFrame) -> DataFrame:
    """Candidates ``(cid, session_id, seq, text)`` with each earlier message of others in their session."""
    said = messages.filter("role != 'user'").select("session_id", F.col("seq").alias("said_seq"), "role", F.col("text").alias("said"))
    return candidates.join(said, "session_id").filter(F.col("said_seq") < F.col("seq"))


def find_echoes(candidates: DataFrame, messages: DataFrame, min_chars: int = 8, min_coverage: float = 0.6) -> DataFrame:
    """``(cid, coverage)`` of candidates of which a long enough window stands in an earlier message.

    The equi-join on the session comes first; windows are tried inside the pair, so none of them is shuffled.
    """
    pairs = earlier_pairs(candidates, messages).withColumns({"needle": T.echo_form("text"), "hay": T.echo_form("said")})
    n = F.length("needle")
    floor = F.greatest(F.lit(min_chars), F.ceil(n * F.lit(min_coverage)).cast("int"))
    # a longer window holds the shortest one of its start, so pairs without any of those are done
    pairs = pairs.filter(n >= min_chars).withColumn("floor", floor).withColumn("shortest", n - 4 * F.floor((n - F.col("floor")) / 4))
    starts = F.sequence(F.lit(0), (n - F.col("shortest")).cast("int"), F.lit(4))
    likely = pairs.filter(F.exists(starts, lambda s: F.contains(F.col("hay"), F.substring(F.col("needle"), s + 1, F.col("shortest").cast("int")))))
    hit = F.filter(echo_windows(F.col("needle"), F.col("floor")), lambda w: F.contains(F.col("hay"), w["part"]))
    size = F.array_max(F.transform(hit, lambda w: w["size"]))
    found = likely.select("cid", n.alias("n"), size.alias("size")).filter("size is not null")
    return found.groupBy("cid").agg((F.max("size") / F.first("n")).alias("coverage"))


def find_span_echoes(spans: DataFrame, messages: DataFrame, min_tokens: int = 15, min_coverage: float = 0.95, lookback: int = 2) -> DataFrame:
    """``(cid, said_seq, coverage)``: the newest of the last ``lookback`` earlier messages of others that holds nearly
    all tokens of a span (J8, W4)."""
    words = spans.withColumn("tokens", token_set(F.col("text"))).filter(F.size("tokens") >= min_tokens)
    newest = Window.partitionBy("cid").orderBy(F.col("said_seq").desc())
    near = earlier_pairs(words, messages).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= lookback)
    share = F.size(F.array_intersect("tokens", token_set(F.col("said")))) / F.size("tokens")
    return near.withColumn("coverage", share).filter(F.col("coverage") >= min_coverage).groupBy("cid").agg(F.max(F.struct("said_seq", "coverage")).alias("m")).select("cid", "m.*")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring (T19), one array step for each character of the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    row, best = np.zeros(len(y) + 1, np.int32), 0
    for c in x:
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        best = max(best, int(row.max(initial=0)))
    return best


def overlap_join(items: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``(iid, lid, share)``: the label ``(lid, session_id, seq, label_text)`` that overlaps an item ``(iid,
    session_id, seq, text)`` of the same message most, by longest common substring over the shorter length (J16)."""
    @pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([longest_common(x or "", y or "") for x, y in zip(a, b)], dtype="int32")

    pairs = items.join(labels, ["session_id", "seq"])
    share = common("text", "label_text") / F.greatest(F.lit(1), F.least(F.length("text"), F.length("label_text")))
    by = Window.partitionBy("iid").orderBy(F.col("share").desc(), "lid")
    good = pairs.select("iid", "lid", share.alias("share")).filter(F.col("share") >= least)
    return good.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def global_echoes(candidates: DataFrame, messages: DataFrame, min_tokens: int = 15, min_coverage: float = 0.95) -> DataFrame:
    """``(cid, coverage)`` against all messages of any session with an earlier time.

    Blocks of spans meet blocks of messages; what two of them share is counted inside one task, and no pair is shuffled.
    Tokens are told apart by 64-bit hashes.
    """
    hashes = F.transform(token_set(F.col("text")), lambda t: F.xxhash64(t))
    words = candidates.select("cid", "time", hashes.alias("tokens")).filter(F.size("tokens") >= min_tokens)
    said = messages.filter("role = 'assistant'").select("mid", F.col("time").alias("said_at"), hashes.alias("tokens"))
    return best_coverage(words, said, min_coverage)
