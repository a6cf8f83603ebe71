"""Labelled rows against sessions and answers: where they stand, what covers them, how a write path did on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Notes that say a text came from a model (fixed values).
MODEL_NOTES = ("模型的输出", "模型的回答", "模型先说的", "模型给了", "粘贴的模型", "引用的模型", "是模型说的")
#: Types that a write keeps.
WRITE_TYPES = ("constraint", "pitfall", "decision")


def model_note(note: Column) -> Column:
    """Whether a label's note says that the text came from a model."""
    return F.coalesce(note, F.lit("")).rlike("|".join(MODEL_NOTES))


def unit_sources(messages: DataFrame, units: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """``(session_id, seq, pos, raw, model_type)``: the units ``(session_id, seq, pos, text, type)`` that a model gave for
    the messages it answered about (``decided``; None: all), the sentences of other messages (J13).

    A message that was answered about and has no unit yields nothing: that is the model's verdict on it.
    """
    keys = ["session_id", "seq"]
    said = messages.select(*keys, "text")
    if decided is None:
        own, rest = said, said.limit(0)
    else:
        decided = decided.select(*keys).distinct()
        own, rest = said.join(decided, keys, "left_semi"), said.join(decided, keys, "left_anti")
    given = own.select(*keys).join(units.select(*keys, "pos", F.col("text").alias("raw"), F.col("type").alias("model_type")), keys)
    split = rest.select(*keys, F.posexplode(T.split_sentences("text")).alias("pos", "raw"))
    return given.unionByName(split.withColumn("model_type", F.lit(None).cast("string")))


def label_positions(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """``(session_id, seq, key, text, label)`` of every place ``(session_id, key, seq)`` with a decided label.

    Labels ``(batch, id, text, label)`` are decided if they are 0 or 1; the first batch that decides an id counts.
    """
    decided = labels.withColumns({"id": F.trim("id"), "label": F.trim("label")}).filter(F.col("label").isin("0", "1") & (F.col("id") != ""))
    first = decided.groupBy("id").agg(F.min(F.struct("batch", "text", "label")).alias("row")).select(F.col("id").alias("key"), "row.text", "row.label")
    return positions.select("session_id", "seq", "key").join(first, "key").select("session_id", "seq", "key", "text", "label")


def with_workspace(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Review rows, whose ``window`` is the last eight characters of a session and a position, with that session's ``cwd``
    (J24); of sessions that end alike the newest one's, null where none does."""
    ends = sessions.groupBy(F.right("session_id", F.lit(8)).alias("_end")).agg(F.max_by("cwd", F.struct("time", "session_id")).alias("cwd"))
    return rows.withColumn("_end", F.substring_index("window", ":", 1)).join(ends, "_end", "left").drop("_end")


def covered(rows: DataFrame, items: DataFrame, *key: str, types: tuple[str, ...] = WRITE_TYPES, least: int = 8) -> DataFrame:
    """The rows ``(*key, text, ...)`` that an accepted item ``(*key, text, who, worth, type)`` of the same window covers
    (J17): in echo form one holds the other, and the row has at least ``least`` characters there."""
    kept = items.filter((F.col("who") == "user") & F.col("worth") & F.col("type").isin(*types))
    hay = kept.select(*[F.col(c).alias(f"_{c}") for c in key], T.echo_form("text").alias("_hay")).distinct()
    needle = T.echo_form("text")
    on = (F.length(needle) >= least) & (F.contains("_hay", needle) | F.contains(needle, F.col("_hay")))
    for c in key:
        on &= F.col(c) == F.col(f"_{c}")
    return rows.join(hay, on, "left_semi")


def balanced_sample(rows: DataFrame, limit: int) -> DataFrame:
    """All positive rows, then negative ones in order of ``pos`` up to ``limit`` in all."""
    positive = rows.filter("label = '1'")
    room = max(0, limit - positive.count())
    return positive.union(rows.filter("label = '0'").orderBy("pos").limit(room))


def review_order(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Review rows with the written ones first, each kind in its own order (O11); ``most``: how much of the sheet is read."""
    ordered = rows.orderBy(F.col("arm") != "written", "pos")
    return ordered.limit(most) if most is not None else ordered


def first_conflict(pending: DataFrame) -> DataFrame:
    """The one conflict that a turn may ask about: its first."""
    first = Window.partitionBy("session_id", "turn").orderBy("pos")
    return pending.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def candidate_ids(search: DataFrame, bm25: DataFrame, targets: DataFrame) -> DataFrame:
    """``(qid, id, is_target)``: all that either ranker found for a query, and its target (U4)."""
    found = search.select("qid", "id").union(bm25.select("qid", "id")).union(targets.select("qid", "id")).distinct()
    return found.join(targets.select("qid", "id", F.lit(True).alias("is_target")), ["qid", "id"], "left").fillna(False, ["is_target"])


def changed_spans(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """User spans ``(session_id, text)`` that are no sentence of the session's user messages."""
    own = messages.filter("role = 'user'").select("session_id", F.explode(T.split_sentences("text")).alias("text")).distinct()
    return spans.join(own, ["session_id", "text"], "left_anti")


def refusal(types: tuple[str, ...] = WRITE_TYPES) -> Column:
    """Why an accepted item ``(who, worth, type)`` is not written: who, worth or type, in this order; null if it is."""
    return F.when(F.col("who") != "user", "who").when(~F.col("worth"), "worth").when(~F.col("type").isin(*types), "type")


def write_arm(windows: DataFrame, items: DataFrame, matches: DataFrame, labels: DataFrame, types: tuple[str, ...] = WRITE_TYPES) -> DataFrame:
    """One row of counters of a write path over its windows.

    ``windows (window, refused)``; ``items (window, iid, who, worth, type)`` that were accepted; ``matches (iid, lid)`` of
    items with labelled rows that they overlap enough, one each; ``labels (window, lid, label)`` inside the windows. Counted:
    windows, refusals, produced, windows without any, items kept back by cause, matched to positive and negative rows,
    unmatched, and positive rows that no written item touched.
    """
    judged = items.withColumn("why", refusal(types))
    written = judged.filter("why is null").join(matches, "iid", "left").join(labels.select("lid", "label").distinct(), "lid", "left")
    per_item = written.agg(
        F.count("*").alias("produced"),
        F.count_if(F.col("label") == "1").alias("matched_positive"),
        F.count_if(F.col("label") == "0").alias("matched_negative"),
        F.count_if(F.col("label").isNull()).alias("unmatched"),
    )
    causes = judged.agg(*[F.count_if(F.col("why") == c).alias(f"refused_{c}") for c in ("who", "worth", "type")])
    full = windows.join(judged.filter("why is null").select("window").distinct().withColumn("_some", F.lit(True)), "window", "left")
    per_window = full.agg(F.count("*").alias("windows"), F.count_if("refused").alias("refusals"), F.count_if(F.col("_some").isNull()).alias("windows_empty"))
    touched = written.filter("label is not null").select("window", "lid").distinct()
    missed = labels.filter("label = '1'").join(touched, ["window", "lid"], "left_anti").agg(F.count("*").alias("missed"))
    # four single rows
    return per_window.crossJoin(per_item).crossJoin(causes).crossJoin(missed)


def turn_outcomes(candidates: DataFrame, written: DataFrame) -> DataFrame:
    """``(session_id, turn, candidates, duplicates, written, review)`` of every turn (A26): how many candidates there were
    ``(.., duplicate)``, how many the store held already, how many were written ``(.., status)`` and held for review."""
    keys = ["session_id", "turn"]
    seen = candidates.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if("duplicate").alias("duplicates"))
    done = written.groupBy(*keys).agg(F.count("*").alias("written"), F.count_if(F.col("status") == "needs-review").alias("review"))
    return seen.join(done, keys, "left").fillna(0, ["written", "review"])


def arm_summary(scores: DataFrame, thresholds: tuple[float, ...] = (0.12, 0.3)) -> DataFrame:
    """Per ``arm`` of ``(arm, label, score)``: the upper median of the scores of positive and of negative rows (0 without
    any), how many there are, and how many reach each threshold (A29)."""
    rows = scores.filter("label in ('0', '1') and score is not null")
    place = Window.partitionBy("arm", "label")
    ranked = rows.withColumns({"_n": F.count("*").over(place), "_k": F.row_number().over(place.orderBy("score"))})
    out = []
    for name, label in (("positive", "1"), ("negative", "0")):
        mine = F.col("label") == label
        out.append(F.coalesce(F.max(F.when(mine & (F.col("_k") == F.floor(F.col("_n") / 2) + 1), F.col("score"))), F.lit(0.0)).alias(f"{name}_median"))
        out.append(F.count_if(mine).alias(f"{name}_rows"))
        out += [F.count_if(mine & (F.col("score") >= t)).alias(f"{name}_from_{round(100 * t)}") for t in thresholds]
    return ranked.groupBy("arm").agg(*out)
