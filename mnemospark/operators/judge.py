"""Validating and applying what models answered: judgements, gates, rewritten forms, segments, written items."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T
from ..functions.maths import clamp01, score_to_unit
from ..functions.tokens import token_set

#: Fixed labels of the answers.
ATTRIBUTIONS = ("user", "quoted", "pasted", "tool-output", "assistant")
RELATIONS = ("same-update", "same-duplicate", "different")
ANSWER = "map<string, struct<noul:double, choice:string, score:double, confidence:double, probabilities:map<string,double>>>"


def relation_torn(probabilities: Column, band: float) -> Column:
    """Both keeping apart and adding nothing are likely."""
    p = lambda k: F.coalesce(F.try_element_at(probabilities, F.lit(k)), F.lit(0.0))
    return F.lit(band > 0) & probabilities.isNotNull() & (p("different") >= band) & (p("same-update") + p("same-duplicate") >= band)


def apply_gate(types: tuple[str, ...], min_importance: float = 0.6, min_remember: float = 0.12, review_on_conflict: bool = True, band: float = 0.3) -> Column:
    """struct(write, review, reason) over type, importance, remember, probabilities."""
    answer = lambda w, v, r: F.struct(F.lit(w).alias("write"), F.lit(v).alias("review"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(F.col("type").isNull(), answer(False, False, "no-judgement"))
        .when(~F.col("type").isin(*types), answer(False, False, F.concat(F.lit("type-disabled:"), F.col("type"))))
        .when(F.col("remember").isNotNull() & (F.col("remember") < min_remember), answer(False, False, "below-min-remember"))
        .when(F.col("remember").isNull() & (F.col("importance") < min_importance), answer(False, False, "below-min-importance"))
        .when(F.lit(review_on_conflict) & relation_torn(F.col("probabilities"), band), answer(True, True, "conflict-uncertain"))
        .otherwise(answer(True, False, "ok"))
    )


def apply_model_gate(review_on_conflict: bool = True, band: float = 0.3) -> Column:
    """Always write, in review if torn."""
    torn = F.lit(review_on_conflict) & relation_torn(F.col("probabilities"), band)
    return F.struct(F.lit(True).alias("write"), torn.alias("review"), F.when(torn, "conflict-uncertain").otherwise("model-write").alias("reason"))


def parse_decisions(batches: DataFrame, levels: int = 5) -> DataFrame:
    """Judgement rows from ``(batch, raw, candidates array<struct<key,hinted_type>>)``.

    raw is ``{"answers": {"remember:0": ..., "type:0": ...}}``. A candidate without any of its first three answers has
    no row; related is null, -1 (none) or a position.
    """
    parsed = batches.withColumn("a", F.from_json("raw", f"answers {ANSWER}")["answers"])
    rows = parsed.select("batch", "a", F.posexplode("candidates").alias("i", "candidate"))
    get = lambda name: F.try_element_at(F.col("a"), F.concat(F.lit(f"{name}:"), F.col("i").cast("string")))
    rows = rows.select("batch", "i", "candidate", *[get(n).alias(n) for n in ("remember", "type", "importance", "pair", "related")])
    rows = rows.filter(F.coalesce("remember", "type", "importance").isNotNull())
    noul = clamp01(F.col("remember.noul"))
    relation = F.when(F.col("pair.choice").isin(*RELATIONS), F.col("pair.choice"))
    probabilities = F.transform_values(F.map_filter("pair.probabilities", lambda k, v: v.isNotNull()), lambda k, v: clamp01(v))
    label, related = F.col("type.choice"), F.col("related.choice")
    confidence = F.coalesce("type.confidence", "importance.confidence")
    return rows.select(
        "batch", "i", F.col("candidate.key").alias("key"),
        F.when(label.isNotNull() & ~label.isin("none-of-the-above", ""), label).otherwise(F.col("candidate.hinted_type")).alias("type"),
        F.when(F.col("importance.score").isNotNull(), score_to_unit(F.col("importance.score"), levels)).when(F.col("remember.noul").isNotNull(), noul).alias("importance"),
        F.when(F.col("remember.noul").isNotNull(), noul).alias("remember"),
        relation.alias("relationship"), probabilities.alias("probabilities"),
        F.when(related == "none", -1).when(related.rlike(r"^m\d+\z"), F.substring(related, 2, 9).try_cast("int")).alias("related_index"),
        F.when(relation == "same-update", "yes").otherwise("unknown").alias("conflict"),
        F.try_element_at(probabilities, F.coalesce(relation, F.lit(""))).alias("conflict_score"),
        F.when(confidence.isNotNull(), clamp01(confidence)).alias("confidence"),
    )


def chosen_partner(choice: Column, known: Column) -> Column:
    """The known memory that a label m<k> names, or null."""
    k = F.when(choice.rlike(r"^m\d+\z"), F.substring(choice, 2, 9).try_cast("int"))
    return F.when((k >= 0) & (k < F.size(known)), F.get(known, k))


def conflict_choice(choice: Column, labels: dict[str, str]) -> Column:
    """A label's meaning, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), choice)


def judged(candidates: DataFrame, rows: DataFrame, types: tuple[str, ...] = P.MEMORY_TYPES) -> DataFrame:
    """Candidates with their judgement; without one the local signals stand, noted as missing."""
    r = rows.select("key", F.col("type").alias("_type"), F.col("importance").alias("_importance"), "remember", "probabilities", "relationship", "related_index")
    out = candidates.join(r, "key", "left")
    missing = F.col("_type").isNull() & F.col("_importance").isNull()
    kind = F.when(F.col("_type").isin(*types), F.col("_type")).otherwise(F.coalesce("hinted_type", F.lit("fact")))
    return out.withColumns({"type": kind, "importance": F.coalesce("_importance", "score"), "note": F.when(missing, "missing-row")}).drop("_type", "_importance")


def canonical_reason(before: Column, answer: Column, ratio: float = 3.0, overlap: float = 0.25) -> Column:
    """struct(text, reason) of a rewritten form."""
    value = T.trim(T.replace(T.replace(T.trim(F.coalesce(answer, F.lit(""))), P.OPENING_QUOTES, ""), P.CLOSING_QUOTES, ""))
    value = T.trim(T.replace(value, P.ANSWER_LABELS, ""))
    tokens = token_set(value)
    shared = F.size(F.array_intersect(tokens, token_set(before)))
    reason = (
        F.when(F.length(value) < 2, "empty")
        .when(value == T.trim(before), "unchanged")
        .when(T.matches(value, P.REFUSALS), "model-refused")
        .when(F.length(value) > F.greatest(F.lit(20.0), F.length(before) * ratio), "too-long")
        .when(F.size(tokens) == 0, "no-tokens")
        .when(shared / F.size(tokens) < overlap, "low-overlap")
        .otherwise("ok")
    )
    return F.struct(F.when(reason == "ok", value).alias("text"), reason.alias("reason"))


def fold_answer(chunks: DataFrame) -> DataFrame:
    """Streamed chunks ``(answer, i, kind, text)`` to one text each, with reasoning characters and the failure."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("i", "text")))), lambda x: x["text"]), "")
    out = chunks.groupBy("answer").agg(text.alias("text"), F.coalesce(F.sum(F.when(F.col("kind") == "reasoning", F.length("text"))), F.lit(0)).alias("reasoning_chars"), F.max(F.when(F.col("kind") == "finish", F.col("text"))).alias("finish"))
    return out.withColumn("failure", F.when(F.col("finish") == "length", "truncated").when(T.trim("text") == "", "empty"))


# Answers in JSON that may be cut off or carry bare quotes. Their repair walks characters, so it runs in Python.


def repair_quotes(text: str) -> str:
    """JSON text with quotes inside strings escaped: a quote ends a string only before , : } ] or the end."""
    out, inside, skip = [], False, False
    for k, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            ahead = text[k + 1 :].lstrip()[:1] if inside else ""
            if inside and ahead not in ("", ",", ":", "}", "]"):
                out.append('\\"')
                continue
            inside = not inside
        out.append(c)
    return "".join(out)


def _load(text: str):
    """(value, whether it needed repair); raises ValueError if neither reading works."""
    try:
        return json.loads(text, strict=True), False
    except ValueError:
        return json.loads(repair_quotes(text), strict=True), True


def complete_objects(raw: str) -> tuple[list | None, bool, bool]:
    """(objects, closed, repaired): the whole objects of a list that may break off."""
    at = raw.find("[")
    if at < 0:
        return None, False, False
    found: list = []
    depth, begin, inside, skip, repaired = 0, -1, False, False, False
    for k in range(at + 1, len(raw)):
        c = raw[k]
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            begin = k if depth == 0 else begin
            depth += 1
        elif c == "}" and depth == 1:
            try:
                value, fixed = _load(raw[begin : k + 1])
            except ValueError:
                return found, False, repaired
            found.append(value)
            repaired |= fixed
            depth = 0
        elif c == "}":
            depth = max(0, depth - 1)
        elif c == "]" and depth == 0:
            return found, True, repaired
    return found, False, repaired


def parse_answer(raw: str | None) -> tuple[str | None, str]:
    """(JSON list as text, state): state is ok, repaired, truncated or unparsable (F16)."""
    raw = raw or ""
    a, b = raw.find("["), raw.rfind("]")
    value, state = None, "ok"
    if 0 <= a < b:
        try:
            value, fixed = _load(raw[a : b + 1])
            state = "repaired" if fixed else "ok"
        except ValueError:
            value = None
    if value is None:
        objects, closed, fixed = complete_objects(raw)
        if not objects:
            return None, "unparsable"
        value, state = objects, "truncated" if not closed else "repaired" if fixed else "ok"
    return (json.dumps(value, ensure_ascii=False), state) if isinstance(value, list) else (None, "unparsable")


def with_parsed(answers: DataFrame, column: str = "raw") -> DataFrame:
    """Answers with ``parsed`` struct(list, state): the repaired JSON list."""
    @pandas_udf("list string, state string")
    def parse(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_answer(x) for x in raw], columns=["list", "state"])

    return answers.withColumn("parsed", parse(column))


ITEM = "array<struct<message:string, source:string, text:string, who:string, worth:string, type:string, summary:string>>"


def written_items(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checks of a write answer ``(answer, raw, messages array<struct<seq,role,text>>)`` (F16).

    Returns the accepted items (answer, pos, seq, start, end, who, worth, type, summary) and a reason per answer.
    """
    parsed = with_parsed(answers).withColumn("items", F.from_json("parsed.list", ITEM))
    source_at = F.aggregate(F.sequence(F.lit(0), F.size("messages") - 1), F.lit(-1), lambda s, k: F.when(F.get("messages", k)["role"] == "user", k).otherwise(s))
    rows = parsed.filter(F.size("items") > 0).select("answer", "messages", source_at.alias("newest"), F.posexplode("items").alias("pos", "item"))
    rows = rows.withColumn("index", F.col("item.message").try_cast("int"))
    rows = rows.withColumns({"message": F.when(F.col("index") >= 0, F.get("messages", F.col("index"))), "span": F.coalesce("item.source", "item.text", F.lit("")), "short": T.trim(F.coalesce("item.summary", F.lit("")))})
    rows = rows.withColumn("at", F.expr("locate(span, message.text)"))
    drift = T.summary_drift("short", "span")
    refusal = (
        F.when(F.col("message").isNull() | ~F.coalesce(F.col("item.who").isin(*ATTRIBUTIONS), F.lit(False)), "attribution")
        .when(F.col("index") != F.col("newest"), "not-newest")
        .when(T.trim("span") == "", "blank")
        .when(F.coalesce(F.col("at"), F.lit(0)) == 0, "not-verbatim")
        .when(F.col("short") == "", "no-summary")
        .when(drift.isNotNull(), F.concat(F.lit("drifted:"), drift))
    )
    rows = rows.withColumn("refusal", refusal)
    items = rows.filter("refusal is null").select("answer", "pos", F.col("message.seq").alias("seq"), (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("span")).alias("end"), F.col("item.who").alias("who"), (F.col("item.worth") == "true").alias("worth"), F.col("item.type").alias("type"), F.col("short").alias("summary"))
    drifted = F.max_by("refusal", F.when(F.col("refusal").startswith("drifted:"), F.col("pos")))
    totals = rows.groupBy("answer").agg(F.count_if(F.col("refusal").isNull()).alias("kept"), F.count_if(F.col("refusal").isNotNull()).alias("refused"), drifted.alias("drift"))
    reason = (
        F.when(F.col("parsed.list").isNull(), "unparsable")
        .when(F.size("items") == 0, "empty")
        .when((F.col("kept") == 0) & (F.col("refused") > 0), F.coalesce("drift", F.lit("all-refused")))
        .when(F.col("parsed.state").isin("truncated", "repaired"), F.col("parsed.state"))
        .otherwise("ok")
    )
    return items, parsed.join(totals, "answer", "left").select("answer", reason.alias("reason"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("refused", F.lit(0)).alias("refused"))


def segment_reasons(answers: DataFrame, min_coverage: float = 0.6) -> DataFrame:
    """Verdict on a segment answer ``(answer, raw, messages)``: the first rule broken refuses all of it."""
    slice_ = F.regexp_extract("raw", r"(?s)(\[.*\])", 1)
    parsed = answers.withColumn("items", F.from_json(F.nullif(slice_, F.lit("")), ITEM))
    rows = parsed.filter(F.size("items") > 0).select("answer", "messages", F.posexplode("items").alias("pos", "item")).withColumn("index", F.col("item.message").try_cast("int"))
    rows = rows.withColumns({"message": F.when(F.col("index") >= 0, F.get("messages", F.col("index"))), "span": F.coalesce("item.text", F.lit(""))})
    rows = rows.withColumn("at", F.expr("locate(span, message.text)"))
    broken = (
        F.when(~F.coalesce(F.col("item.who").isin(*ATTRIBUTIONS), F.lit(False)), "unknown-attribution")
        .when(F.col("message").isNull(), "out-of-range")
        .when(T.trim("span") == "", "empty")
        .when(F.coalesce(F.col("at"), F.lit(0)) == 0, "not-verbatim")
    )
    rows = rows.withColumn("broken", broken)
    before = F.lag(F.col("at") + F.length("span")).over(Window.partitionBy("answer", "index").orderBy("at"))
    rows = rows.withColumn("overlaps", F.col("at") < before)
    solid = lambda c: F.length(T.replace(c, r"\s+", ""))
    per = rows.groupBy("answer").agg(F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("pos"))).alias("broken"), F.max("overlaps").alias("overlaps"), F.sum(F.when(F.col("message.role") == "user", solid("span")).otherwise(0)).alias("covered"))
    mine = F.filter("messages", lambda m: m["role"] == "user")
    total = F.aggregate(mine, F.lit(0), lambda s, m: s + F.length(T.replace(m["text"], r"\s+", "")))
    out = parsed.join(per, "answer", "left").withColumn("coverage", F.when(total == 0, 0.0).otherwise(F.col("covered") / total))
    reason = (
        F.when(F.col("items").isNull(), "unparsable").when(F.size("items") == 0, "empty").when(F.col("broken").isNotNull(), F.col("broken")).when(F.coalesce("overlaps", F.lit(False)), "overlap")
        .when(F.size(mine) == 0, "no-user-text").when(F.col("coverage") < min_coverage, "low-coverage").otherwise("ok")
    )
    return out.select("answer", reason.alias("reason"), F.when(reason.isin("ok", "low-coverage"), F.col("coverage")).otherwise(0.0).alias("coverage"))


def window_prompt(messages: Column) -> Column:
    """Labelled lines of a window."""
    return F.array_join(F.transform(messages, lambda m, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), m["role"], F.lit(": "), m["text"])), "\n")


def request_body(candidates: Column) -> Column:
    """Questions for candidates as JSON."""
    return F.to_json(F.struct(F.transform(candidates, lambda c, i: F.struct(F.concat(F.lit("remember:"), i.cast("string")).alias("id"), c["text"].alias("text"))).alias("questions")))
