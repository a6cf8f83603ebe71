"""The keyed store of memories as tables: coercion, re-keying, upserts, supersession, deletes, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import text as T
from ..functions.maths import clamp01


def _number(x: Column, otherwise: Column) -> Column:
    y = x.try_cast("double")
    return F.when(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))), y).otherwise(otherwise)


def coerce_records(raw: DataFrame, now_ms: int) -> DataFrame:
    """Rows as read from a hand-editable document to memories (S2): blank texts go, unknown types are facts, unknown
    statuses active, bad numbers defaults, importance in [0, 1]."""
    text, at = T.normalize("text"), _number(F.col("createdAt"), F.lit(float(now_ms))).cast("long")
    nonblank = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.filter(text != "").select(
        F.coalesce(nonblank("id"), T.hash_text("text")).alias("id"),
        F.when(F.col("type").isin(*P.MEMORY_TYPES), F.col("type")).otherwise("fact").alias("type"),
        text.alias("text"),
        nonblank("cwd").alias("cwd"),
        clamp01(F.col("importance").try_cast("double")).alias("importance"),
        F.when(F.col("status").isin(*P.STATUSES), F.col("status")).otherwise("active").alias("status"),
        "supersedes",
        F.col("supersededBy").alias("superseded_by"),
        "canonical",
        F.col("canonicalModel").alias("canonical_model"),
        _number(F.col("canonicalAt"), F.lit(None).cast("double")).cast("long").alias("canonical_at"),
        F.struct(
            F.col("source.sessionId").alias("session_id"), _number(F.col("source.seq"), F.lit(None).cast("double")).cast("long").alias("seq"),
            T.normalize(F.col("source.quote")).alias("quote"), _number(F.col("source.at"), at.cast("double")).cast("long").alias("at"),
        ).alias("source"),
        at.alias("created_at"),
        _number(F.col("updatedAt"), at.cast("double")).cast("long").alias("updated_at"),
        _number(F.col("recalls"), F.lit(0.0)).cast("long").alias("recalls"),
        _number(F.col("lastRecalledAt"), F.lit(None).cast("double")).cast("long").alias("last_recalled_at"),
        F.struct(
            F.coalesce("judge.kind", F.lit("unknown")).alias("kind"), _number(F.col("judge.confidence"), F.lit(None).cast("double")).alias("confidence"),
            F.coalesce("judge.conflict", F.lit("unknown")).alias("conflict"), F.col("judge.mode").alias("mode"),
        ).alias("judge"),
    )


def rekey(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories whose id is a folded signature get the text's hash; links follow (S3, J9). Also the ids that collide."""
    old = ~F.col("id").rlike("^[a-z][a-z0-9]*:") & (F.col("id").rlike(P.FOLD_MARKER) | (F.col("id") == T.signature("text")))
    moved = memories.filter(old).select(F.col("id").alias("_from"), T.hash_text("text").alias("_to")).filter("_from != _to").dropDuplicates(["_from"])
    out = memories
    for c in ("id", "supersedes", "superseded_by"):
        out = out.join(moved, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return out, out.groupBy("id").count().filter("count > 1").select("id", "count")


def upsert(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace memories of the same id, which keep their creation time and recall counters (D-1)."""
    kept = memories.select(F.col("id").alias("_id"), F.col("created_at").alias("_created"), F.col("recalls").alias("_recalls"), F.col("last_recalled_at").alias("_last"))
    new = rows.join(kept, F.col("id") == F.col("_id"), "left")
    new = new.withColumns({"created_at": F.coalesce("_created", "created_at"), "recalls": F.coalesce("_recalls", "recalls"), "last_recalled_at": F.coalesce("_last", "last_recalled_at")})
    return memories.join(rows.select("id"), "id", "left_anti").unionByName(new.select(*memories.columns))


def supersede(memories: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """Mark ``pairs (id, by)`` as superseded (D-2)."""
    p = pairs.groupBy("id").agg(F.max("by").alias("_by"))
    hit = F.col("_by").isNotNull()
    out = memories.join(p, "id", "left")
    return out.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.when(hit, F.col("_by")).otherwise(F.col("superseded_by")), "updated_at": F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_at"))}).select(*memories.columns)


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given ids (D-3, J23)."""
    return memories.join(ids.select("id"), "id", "left_anti")


def note_recalled(memories: DataFrame, recalls: DataFrame) -> DataFrame:
    """Counters after recalls ``(id, t)`` (D-4)."""
    seen = recalls.groupBy("id").agg(F.count("*").alias("_n"), F.max("t").alias("_t"))
    out = memories.join(seen, "id", "left")
    return out.withColumns({"recalls": F.col("recalls") + F.coalesce("_n", F.lit(0)), "last_recalled_at": F.coalesce("_t", "last_recalled_at")}).select(*memories.columns)


def exact_duplicates(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Candidates ``(text, ...)`` that the store does not hold as they are."""
    held = memories.select(F.col("id").alias("_id"), F.col("text").alias("_text"))
    return candidates.withColumn("_key", T.hash_text("text")).join(held, (F.col("_key") == F.col("_id")) & (F.col("text") == F.col("_text")), "left_anti").drop("_key")


def resolve_writes(candidates: DataFrame) -> DataFrame:
    """What becomes of each judged candidate (D-5): skip-duplicate, update, review, replace or insert.

    Needs text, partner_id, partner_text, relationship, torn. A torn relation changes nothing and is held for review;
    an update whose text differs from its partner's only in literals (numbers, paths, quotes) replaces it.
    """
    literal = T.signature("text") == T.signature("partner_text")
    action = (
        F.when(F.col("partner_id").isNull(), "insert")
        .when(F.col("torn"), "review")
        .when((F.col("relationship") == "same-duplicate") & literal & (T.normalize("text") != T.normalize("partner_text")), "replace")
        .when(F.col("relationship") == "same-duplicate", "skip-duplicate")
        .when(F.col("relationship") == "same-update", "replace")
        .otherwise("insert")
    )
    return candidates.withColumn("action", action)


def apply_writes(memories: DataFrame, resolved: DataFrame, now_ms: int) -> DataFrame:
    """The store after a turn's resolved candidates (D-5): ``pos, text, type, cwd, importance, partner_id, action``.

    A duplicate changes nothing. All others are put under their text's hash, held for review or active; a text that only
    differs in case or space from what that id holds thereby updates it in place, keeping its creation time and counters. A
    replacement also supersedes its partner. Of candidates with one id the last counts. Partners are those of the store
    before the turn, so the candidates need no order among themselves.
    """
    kept = resolved.filter("action != 'skip-duplicate'").withColumn("id", T.hash_text("text"))
    last = kept.groupBy("id").agg(F.max_by(F.struct(*[c for c in kept.columns if c != "id"]), "pos").alias("row")).select("id", "row.*")
    replaces = (F.col("action") == "replace") & (F.col("partner_id") != F.col("id"))
    given = {
        "id": F.col("id"), "type": F.col("type"), "text": F.col("text"), "cwd": F.col("cwd"), "importance": F.col("importance"),
        "status": F.when(F.col("action") == "review", "needs-review").otherwise("active"), "supersedes": F.when(replaces, F.col("partner_id")),
        "created_at": F.lit(now_ms), "updated_at": F.lit(now_ms), "recalls": F.lit(0),
    }
    rows = last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in memories.schema])
    return supersede(upsert(memories, rows), kept.filter(replaces).select(F.col("partner_id").alias("id"), F.col("id").alias("by")), now_ms)


def answer_conflicts(memories: DataFrame, answers: DataFrame, now_ms: int) -> DataFrame:
    """Apply answers ``(new_id, old_id, choice)`` (D-6): keep-old drops the new one, replace supersedes the old one and
    activates the new one, keep-both activates the new one."""
    gone = answers.filter("choice = 'keep-old'").select(F.col("new_id").alias("id"))
    out = supersede(forget(memories, gone), answers.filter("choice = 'replace'").select(F.col("old_id").alias("id"), F.col("new_id").alias("by")), now_ms)
    on = answers.filter("choice in ('replace', 'keep-both')").select(F.col("new_id").alias("id"), F.lit(True).alias("_on")).distinct()
    return out.join(on, "id", "left").withColumn("status", F.when(F.col("_on"), "active").otherwise(F.col("status"))).select(*memories.columns)


def attach_canonical(memories: DataFrame, forms: DataFrame, now_ms: int) -> DataFrame:
    """Attach ``forms (id, text, canonical, model)`` to active memories whose text is unchanged and whose form is
    missing or another model's (D-7)."""
    f = forms.select(F.col("id").alias("_id"), F.col("text").alias("_text"), F.col("canonical").alias("_form"), F.col("model").alias("_model"))
    out = memories.join(f, F.col("id") == F.col("_id"), "left")
    take = (F.col("status") == "active") & (F.col("text") == F.col("_text")) & (F.col("canonical").isNull() | ~F.col("canonical_model").eqNullSafe(F.col("_model")))
    take = F.coalesce(take, F.lit(False))
    return out.withColumns({"canonical": F.when(take, F.col("_form")).otherwise(F.col("canonical")), "canonical_model": F.when(take, F.col("_model")).otherwise(F.col("canonical_model")), "canonical_at": F.when(take, F.lit(now_ms)).otherwise(F.col("canonical_at"))}).select(*memories.columns)


def manual_write(rows: DataFrame, now_ms: int) -> DataFrame:
    """Memories from ``(text, type, importance, cwd)`` that a caller states (D-8)."""
    text = F.substring(T.trim("text"), 1, 400)
    return rows.filter(T.trim("text") != "").select(T.hash_text(text).alias("id"), F.when(F.col("type").isin(*P.MEMORY_TYPES), F.col("type")).otherwise("fact").alias("type"), text.alias("text"), "cwd", clamp01(F.coalesce("importance", F.lit(0.8))).alias("importance"), F.lit("active").alias("status"), F.lit(now_ms).alias("created_at"))


def ledger_counts(lines: DataFrame) -> DataFrame:
    """``(kind, key, n)`` from ledger lines ``(value)``: observations by signature or id, questions by id; broken lines
    are skipped (S4, A2)."""
    kind, id_, sig = (F.get_json_object("value", f"$.{k}") for k in ("kind", "id", "signature"))
    rows = lines.select(kind.alias("kind"), F.when(kind == "observed", F.coalesce(F.nullif(T.trim(sig), F.lit("")), id_)).otherwise(id_).alias("key"))
    return rows.filter(F.col("kind").isin("observed", "conflict-ask") & F.col("key").isNotNull()).groupBy("kind", "key").agg(F.count("*").alias("n"))


def store_stats(memories: DataFrame) -> DataFrame:
    """Counts per type and in all (A1); the row with a null type is the total."""
    return memories.rollup("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "needs-review").alias("needs_review"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.sum("recalls").alias("recalls"))


def archive_matches(hits: DataFrame, archive_hits: DataFrame) -> DataFrame:
    """Memory hits, then archive hits as rows of the same shape (P-1, U1)."""
    old = archive_hits.select(T.archive_id("session_id", "seq").alias("id"), F.lit("archive").alias("type"), "text", F.lit(0.5).alias("importance"), "score")
    return hits.select("id", "type", "text", "importance", "score", F.lit("memory").alias("origin")).unionByName(old.withColumn("origin", F.lit("archive")))


def missing_vectors(texts: DataFrame, cache: DataFrame, model: str, dims: int) -> DataFrame:
    """Texts whose vector the cache ``(key, embedding)`` lacks."""
    from ..functions.maths import vector_key

    keyed = texts.withColumn("key", vector_key(F.lit(model), F.lit(dims), F.col("text")))
    return keyed.join(cache.select("key"), "key", "left_anti")


def complete_vectors(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers ``(request, index, embedding)`` in the order asked, all or nothing for each request."""
    joined = asked.join(answers, ["request", "index"], "left")
    short = F.max(F.col("embedding").isNull()).over(Window.partitionBy("request"))
    return joined.withColumn("_short", short).filter(~F.col("_short")).drop("_short")
