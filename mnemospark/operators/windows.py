"""Ordered slices of conversations ``(session_id, seq, role, text)``: rounds, windows, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def session() -> WindowSpec:
    """Messages of a session in order."""
    return Window.partitionBy("session_id").orderBy("seq")


def rounds(messages: DataFrame) -> DataFrame:
    """Each user message with its round number and the last assistant line before the next one.

    ``(session_id, round, seq, text, answer_seq, answer)``; assistant lines before the first user message belong to none.
    """
    numbered = messages.filter(F.col("role").isin("user", "assistant")).withColumn("round", F.sum((F.col("role") == "user").cast("int")).over(session()))
    user, other = F.col("role") == "user", F.col("role") == "assistant"
    last = F.max(F.when(other, F.struct("seq", "text")))
    return (
        numbered.filter("round > 0")
        .groupBy("session_id", "round")
        .agg(F.min(F.when(user, F.struct("seq", "text"))).alias("u"), last.alias("a"))
        .select("session_id", "round", F.col("u.seq").alias("seq"), F.col("u.text").alias("text"), F.col("a.seq").alias("answer_seq"), F.col("a.text").alias("answer"))
    )


def conversation_windows(messages: DataFrame, anchors: DataFrame, n_rounds: int = 3, answer_chars: int = 200, recent_rounds: int = 0, recent_chars: int = 1500) -> DataFrame:
    """The last rounds before each anchor ``(session_id, at)`` in reading order.

    ``(session_id, at, pos, seq, role, text)``. An answer counts for an anchor only if it stands before it; answers are
    cut at ``answer_chars`` (0: left out), the newest ``recent_rounds`` of them at ``recent_chars`` instead.
    """
    told = messages.filter(F.col("role").isin("user", "assistant")).withColumn("round", F.sum((F.col("role") == "user").cast("int")).over(session())).filter("round > 0")
    before = anchors.join(told, "session_id").filter(F.col("seq") < F.col("at"))
    user = F.col("role") == "user"
    shaped = before.groupBy("session_id", "at", "round").agg(F.min(F.when(user, F.struct("seq", "text"))).alias("u"), F.max(F.when(~user, F.struct("seq", "text"))).alias("a"))
    newest = Window.partitionBy("session_id", "at").orderBy(F.col("round").desc())
    kept = shaped.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n_rounds)
    # the wider cap counts answers, not rounds
    kept = kept.withColumn("nth", F.sum(F.col("a").isNotNull().cast("int")).over(newest))
    cap = F.when(F.col("a").isNotNull() & (F.col("nth") <= recent_rounds), F.lit(recent_chars)).otherwise(F.lit(answer_chars))
    question = F.struct(F.col("u.seq").alias("seq"), F.lit("user").alias("role"), F.col("u.text").alias("text"))
    answer = F.when(F.col("a").isNotNull() & (cap > 0), F.struct(F.col("a.seq").alias("seq"), F.lit("assistant").alias("role"), F.substring(F.col("a.text"), F.lit(1), cap).alias("text")))
    lines = kept.select("session_id", "at", F.explode(F.array_compact(F.array(question, answer))).alias("m")).select("session_id", "at", "m.*")
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy("session_id", "at").orderBy("seq")) - 1)


def windows_ending_at(messages: DataFrame, n: int) -> DataFrame:
    """Each message with itself and the n - 1 before it."""
    frame = session().rowsBetween(-(n - 1), 0)
    return messages.withColumn("window", F.collect_list(F.struct("seq", "role", "text")).over(frame))


def earlier_counts(messages: DataFrame) -> DataFrame:
    """Each message with how many messages and characters stand before it."""
    frame = session().rowsBetween(Window.unboundedPreceding, -1)
    return messages.select("session_id", "seq", F.count("*").over(frame).alias("n_before"), F.coalesce(F.sum(F.length("text")).over(frame), F.lit(0)).alias("chars_before"))


def hopping_windows(messages: DataFrame, size: int = 5, step: int = 4) -> DataFrame:
    """Windows of ``size`` consecutive messages every ``step`` (W18): session_id, start, seqs."""
    n = messages.withColumn("k", F.row_number().over(session()) - 1).withColumn("total", F.count("*").over(Window.partitionBy("session_id")))
    # a message lies in the windows whose start is a multiple of step in [k - size + 1, k]
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - (size - 1)) / F.lit(step)) * step).cast("int")
    starts = F.filter(F.sequence(first, F.greatest(first, F.col("k").cast("int"))), lambda s: (s % step == 0) & (s <= F.col("k")) & (s + size <= F.col("total")))
    return n.select("session_id", "seq", F.explode(starts).alias("start")).groupBy("session_id", "start").agg(F.sort_array(F.collect_list("seq")).alias("seqs"))


def extraction_source(messages: DataFrame) -> DataFrame:
    """Position of the last user message of each session, -1 if there is none."""
    pos = messages.withColumn("pos", F.row_number().over(session()) - 1)
    return pos.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("pos"))), F.lit(-1)).alias("source"))


def recall_queries(messages: DataFrame, k: int = 3, most: int = 4000) -> DataFrame:
    """The last k user messages of each session, oldest first, as a query text."""
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    kept = messages.filter("role = 'user'").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= k)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return kept.groupBy("session_id").agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("query"))


def turns(events: DataFrame, boundary: str = "turn/start") -> DataFrame:
    """Events with their turn number: how many boundaries stand at or before them."""
    return events.withColumn("turn", F.sum((F.col("type") == boundary).cast("int")).over(session()))


def last_turn(events: DataFrame, boundary: str = "turn/start") -> DataFrame:
    """The events after each session's last boundary."""
    numbered = turns(events, boundary).withColumn("_last", F.max("turn").over(Window.partitionBy("session_id")))
    return numbered.filter((F.col("turn") == F.col("_last")) & (F.col("type") != boundary)).drop("_last")


def turn_summary(messages: DataFrame) -> DataFrame:
    """Messages, characters and distinct roles of each session."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans ``(key, start, end)`` that begin before their left neighbour ends."""
    before = F.lag("end").over(Window.partitionBy("key").orderBy("start", "end"))
    return spans.withColumn("_before", before).filter(F.col("start") < F.col("_before")).drop("_before")


def newest(rows: DataFrame, by: str, k: int, *key: str) -> DataFrame:
    """The k newest rows (of each key)."""
    w = Window.partitionBy(*key).orderBy(F.col(by).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n") if key else rows.orderBy(F.col(by).desc()).limit(k)
