"""From events to candidates: archive rows, sentences, screens, scores, caps, failures, repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T

FAILURE_SCORE = 0.75


@dataclass(frozen=True)
class ExtractConfig:
    min_chars: int = 8
    max_chars: int = 240
    per_message: int = 3
    per_turn: int = 6


def archive_rows(events: DataFrame) -> DataFrame:
    """``(session_id, seq, role, text)`` of user and assistant messages with text; the role of a user message is its
    source kind (D10)."""
    spoken = events.filter(F.col("type").isin("user/message", "assistant/message") & F.col("seq").isNotNull())
    role = F.when(F.col("type") == "assistant/message", "assistant").otherwise(F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("user")))
    return spoken.select("session_id", "seq", role.alias("role"), T.normalize(T.blocks_text("blocks")).alias("text")).filter("text != ''")


def sentences(messages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``(key columns, pos, raw, sentence, reason)``: cleaned sentences of ``text`` that are long enough, with the
    screen's reason or null (T7, T10, F1, F21)."""
    # white space is collapsed before the split, so line ends never split a user's message
    split = messages.withColumn("_text", T.normalize("text")).select("*", F.posexplode(T.split_sentences("_text")).alias("pos", "raw")).drop("_text")
    cleaned = split.withColumn("sentence", T.strip_pasted("raw")).filter(F.length("sentence") >= config.min_chars)
    return cleaned.withColumn("reason", T.screen("sentence"))


def sentence_candidates(messages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Candidates of user messages ``(session_id, turn, seq, text)``, before the caps of a turn.

    The identity comes from the raw sentence with a hard cut, the stored text from the cleaned one cut at a clause.
    """
    kept = sentences(messages, config).filter(F.col("reason").isNull())
    cut = F.when(F.length("raw") > config.max_chars, F.concat(F.substring("raw", 1, config.max_chars - 1), F.lit("…"))).otherwise(F.col("raw"))
    kept = kept.withColumns({"hinted_type": T.signal_type("sentence"), "weight": T.signal_weight("sentence"), "emphasis": T.emphasis_weight("sentence")})
    score = F.least(F.lit(1.0), F.lit(0.35) + F.col("weight") * 0.35 + F.col("emphasis") + F.least(F.lit(0.15), F.length("sentence") / 800))
    rows = kept.select(
        "session_id", "turn", "seq", "pos", F.lit("user").alias("kind"), T.clip_at_clause("sentence", config.max_chars).alias("text"), T.signature(cut).alias("key"),
        T.excerpt("raw", 200).alias("quote"), "hinted_type", score.alias("score"),
    )
    best = Window.partitionBy("session_id", "seq").orderBy(F.col("score").desc(), "pos")
    return rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= config.per_message).drop("_n")


def failure_rows(events: DataFrame) -> DataFrame:
    """Failed tool results with the tool's name: the last call of that id before the result (J1), else the error's."""
    results = events.filter("type = 'tool/result'").filter(F.col("error_name").isNotNull() | F.col("error_code").isNotNull() | F.coalesce(F.exists("blocks", lambda b: F.coalesce(b["is_error"], F.lit(False))), F.lit(False)))
    calls = events.filter("type = 'tool/call' and call_id is not null and name is not null").select(F.col("session_id").alias("_session"), F.col("turn").alias("_turn"), F.col("seq").alias("_seq"), F.col("call_id").alias("_call"), F.col("name").alias("_name"))
    named = results.join(calls, (F.col("session_id") == F.col("_session")) & (F.col("turn") == F.col("_turn")) & (F.col("call_id") == F.col("_call")) & (F.col("_seq") < F.col("seq")), "left")
    whole = named.groupBy("session_id", "turn", "seq").agg(F.max_by("_name", "_seq").alias("called"), F.first("error_name").alias("error_name"), F.first("error_code").alias("error_code"), F.first("blocks").alias("blocks"))
    detail = T.normalize(T.blocks_text("blocks", " "))
    tool = F.coalesce("called", "error_name", F.lit("tool"))
    named = whole.select("session_id", "turn", "seq", tool.alias("tool"), detail.alias("detail"), "error_code")
    named = named.withColumn("summary", F.when(F.col("detail") != "", F.col("detail")).otherwise(F.coalesce("error_code", F.lit("")))).drop("error_code")
    text = F.concat("tool", F.lit(" 失败："), F.when(F.col("summary") != "", F.col("summary")).otherwise("未知错误"))
    return named.withColumn("text", F.substring(T.normalize(text), 1, 240))


def failure_candidates(events: DataFrame) -> DataFrame:
    """Candidates of failures that say more than a code."""
    rows = failure_rows(events).filter((F.length("text") >= 12) & T.has_diagnostic("summary"))
    return rows.select(
        "session_id", "turn", "seq", F.lit(0).alias("pos"), F.lit("tool-failure").alias("kind"), "text", T.signature("text").alias("key"),
        T.excerpt(F.when(F.col("detail") != "", F.col("detail")).otherwise(F.col("text")), 200).alias("quote"), F.lit("pitfall").alias("hinted_type"), F.lit(FAILURE_SCORE).alias("score"),
    )


def turn_candidates(rows: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """First of each key in a turn, then the best of the turn."""
    first = Window.partitionBy("session_id", "turn", "key").orderBy("seq", F.col("score").desc(), "pos")
    best = Window.partitionBy("session_id", "turn").orderBy(F.col("score").desc(), "seq", "pos")
    once = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= config.per_turn)


def extract(events: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """All candidates of events with turns (§ write path): user messages of source kind ``user`` (F22) and failures."""
    user = events.filter("type = 'user/message' and source_kind = 'user'").select("session_id", "turn", "seq", T.blocks_text("blocks").alias("text"))
    return turn_candidates(sentence_candidates(user, config).unionByName(failure_candidates(events)), config)


def vetoes(messages: DataFrame, config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Screened-out sentences with their reason and whether it is worth a ledger line."""
    return sentences(messages, config).filter(F.col("reason").isNotNull()).withColumn("noteworthy", T.is_noteworthy("reason"))


def repeat_gate(observations: DataFrame, least: int = 2) -> DataFrame:
    """Observations ``(key, t)`` that are at least the ``least``-th of their key."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("t", *[c for c in observations.columns if c not in ("key", "t")]))
    return observations.withColumn("nth", nth).filter(F.col("nth") >= least)


def secret_veto(rows: DataFrame) -> DataFrame:
    """Without rows whose text and quote screen as secret (F19). Other reasons do not matter on this path, but for the
    one that the screen puts first: a transcript line is not screened as secret."""
    whole = F.concat_ws(" ", "text", "quote")
    return rows.filter(T.matches_any(whole, P.TRANSCRIPTS) | ~T.matches_any(whole, P.SECRETS))


def model_rows(items: DataFrame, per_turn: int = 6, types: tuple[str, ...] = ("constraint", "pitfall", "decision")) -> DataFrame:
    """Items of a model's answer that are kept: the user's own, worth it, of a written type, the first few."""
    good = items.filter((F.col("who") == "user") & F.col("worth") & F.col("type").isin(*types))
    return good.withColumn("_n", F.row_number().over(Window.partitionBy("turn").orderBy("pos"))).filter(F.col("_n") <= per_turn).drop("_n")
