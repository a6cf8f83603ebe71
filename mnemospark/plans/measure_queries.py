"""Queries over labelled rows, write paths and store changes, with their DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labelling as L
from ..operators import rank as R
from ..operators import store as D
from . import tables as B
from .registry import query
from .text_queries import _CUT, _ECHO, norm

_M = f"WITH {B.MESSAGES}"
_TYPES = "('constraint', 'pitfall', 'decision')"

#: Items that a model might have drawn from the messages: pieces of them, by every kind of speaker, worth and type.
_ITEM = (
    "it AS (SELECT session_id, seq, session_id * 100 + seq AS iid, CASE WHEN length(text) % 3 = 0 THEN text ELSE substr(text, 3, 30) END AS text, CASE WHEN seq % 4 = 3 THEN 'assistant' ELSE 'user' END AS who, "
    "length(text) % 5 <> 0 AS worth, CASE length(text) % 4 WHEN 0 THEN 'constraint' WHEN 1 THEN 'pitfall' WHEN 2 THEN 'decision' ELSE 'fact' END AS type FROM msg)"
)


def _items(messages):
    n = F.length("text")
    return messages.select(
        "session_id", "seq", (F.col("session_id") * 100 + F.col("seq")).alias("iid"), F.when(n % 3 == 0, F.col("text")).otherwise(F.substring("text", 3, 30)).alias("text"),
        F.when(F.col("seq") % 4 == 3, "assistant").otherwise("user").alias("who"), (n % 5 != 0).alias("worth"),
        F.when(n % 4 == 0, "constraint").when(n % 4 == 1, "pitfall").when(n % 4 == 2, "decision").otherwise("fact").alias("type"),
    )


@query(
    f"{_M}, {_ITEM}, k AS (SELECT session_id, {_ECHO} AS hay FROM it WHERE who = 'user' AND worth AND type IN {_TYPES}), r AS (SELECT session_id, seq, {_ECHO} AS needle FROM msg WHERE role = 'user') "
    "SELECT session_id, seq FROM r WHERE length(needle) >= 8 AND EXISTS (SELECT 1 FROM k WHERE k.session_id = r.session_id AND (contains(hay, needle) OR contains(needle, hay)))"
)
def j17_covered_rows(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    return L.covered(m.filter("role = 'user'"), _items(m), "session_id").select("session_id", "seq")


@query(
    f"{_M}, u AS (SELECT session_id, seq, 0 AS pos, left(text, 25) AS raw, 'fact' AS model_type FROM msg WHERE seq % 3 = 0), p AS (SELECT session_id, seq, unnest(string_split({_CUT}, chr(1))) AS raw FROM msg WHERE seq % 2 = 1), "
    f"n AS (SELECT session_id, seq, {norm('raw')} AS raw FROM p), s AS (SELECT session_id, seq, raw, NULL AS model_type FROM n WHERE raw <> '') SELECT session_id, seq, raw, model_type FROM u WHERE seq % 2 = 0 UNION ALL SELECT * FROM s"
)
def j13_unit_sources(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    units = m.filter("seq % 3 = 0").select("session_id", "seq", F.lit(0).alias("pos"), F.substring("text", 1, 25).alias("text"), F.lit("fact").alias("type"))
    return L.unit_sources(m, units, m.filter("seq % 2 = 0")).select("session_id", "seq", "raw", "model_type")


_KEY = f"left(sha1(lower({norm('text')})), 12)"


@query(
    f"{_M}, k AS (SELECT session_id, seq, {_KEY} AS key, text, role FROM msg), l AS (SELECT key AS id, text, CASE length(text) % 3 WHEN 0 THEN '1' WHEN 1 THEN ' 0 ' ELSE '?' END AS label, session_id AS batch FROM k WHERE role = 'user'), "
    "f AS (SELECT id, arg_min(text, (batch, text)) AS text, arg_min(trim(label), (batch, text)) AS label FROM l WHERE trim(label) IN ('0', '1') GROUP BY id) SELECT session_id, seq, key, f.text, label FROM k JOIN f ON k.key = f.id"
)
def j15_label_positions(spark, sf_dir):
    k = B.messages(spark, sf_dir).withColumn("key", T.hash_text("text"))
    n = F.length("text")
    labels = k.filter("role = 'user'").select(F.col("session_id").alias("batch"), F.col("key").alias("id"), "text", F.when(n % 3 == 0, "1").when(n % 3 == 1, " 0 ").otherwise("?").alias("label"))
    return L.label_positions(k, labels)


@query(
    "WITH s AS (SELECT 'session-' || lpad(CAST(conv_id AS VARCHAR), 10, '0') AS session_id, max(turn) AS time, CASE WHEN conv_id % 3 > 0 THEN '/w/' || (conv_id % 7) END AS cwd FROM conversations GROUP BY conv_id), "
    "e AS (SELECT right(session_id, 8) AS e, arg_max(cwd, (time, session_id)) FILTER (true) AS cwd FROM s GROUP BY 1), r AS (SELECT lpad(CAST(conv_id + 2 AS VARCHAR), 8, '0') || ':' || turn AS w FROM conversations) SELECT w AS \"window\", cwd FROM r LEFT JOIN s ON right(s.session_id, 8) = split_part(w, ':', 1)"
)
def j24_workspaces(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    sessions = c.groupBy("conv_id").agg(F.max("turn").alias("time")).select(F.concat(F.lit("session-"), F.lpad(F.col("conv_id").cast("string"), 10, "0")).alias("session_id"), "time", F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("/w/"), F.col("conv_id") % 7)).alias("cwd"))
    rows = c.select(F.concat_ws(":", F.lpad((F.col("conv_id") + 2).cast("string"), 8, "0"), "turn").alias("window"))
    return L.with_workspace(rows, sessions)


_VECTORS = """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding, vec_id, (vec_id * 7 % 10) / 10.0::DOUBLE AS importance, vec_id * 104729 % 90000 AS updated_at FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT id AS qid, embedding AS qe FROM v WHERE vec_id % 50 = 0),
sims AS (SELECT qid, id, importance, updated_at, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q CROSS JOIN v)"""


def _vectors(spark, sf_dir):
    i = F.col("vec_id")
    v = B.table(spark, sf_dir, "embeddings").filter("embedding is not null").select(i.cast("string").alias("id"), "embedding", "vec_id", ((i * 7 % 10) / 10.0).alias("importance"), (i * 104729 % 90000).alias("updated_at"))
    return v, v.filter("vec_id % 50 = 0").select(F.col("id").alias("qid"), "embedding")


@query(f"{_VECTORS} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, updated_at DESC, id) AS rank FROM sims) WHERE rank <= 20")
def o5_vector_partners(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.conflict_partners_by_vector(q, v)


@query(f"{_VECTORS} SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, importance DESC, id) AS rank FROM sims WHERE score > 0) WHERE rank <= 20")
def o6_vector_search(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return R.vector_search(v, q)


_NOTES = list(enumerate([*(f"看来{n}，不记" for n in L.MODEL_NOTES), "用户自己说的", "", "模型"]))


@query(f"WITH {B.sql_all_texts(_NOTES)} SELECT id, regexp_matches(text, '{'|'.join(L.MODEL_NOTES)}') AS by_model FROM s")
def f23_model_notes(spark, sf_dir):
    return B.all_texts(spark, sf_dir, _NOTES).select("id", L.model_note(F.col("text")).alias("by_model"))


_ROWS = "r AS (SELECT session_id * 100 + seq AS pos, CASE length(text) % 4 WHEN 0 THEN '1' WHEN 1 THEN '?' ELSE '0' END AS label, CASE WHEN length(text) % 3 = 0 THEN 'written' ELSE 'refused' END AS arm FROM msg)"


def _rows(spark, sf_dir):
    n = F.length("text")
    return B.messages(spark, sf_dir).select((F.col("session_id") * 100 + F.col("seq")).alias("pos"), F.when(n % 4 == 0, "1").when(n % 4 == 1, "?").otherwise("0").alias("label"), F.when(n % 3 == 0, "written").otherwise("refused").alias("arm"))


@query(f"{_M}, {_ROWS}, p AS (SELECT count(*) AS n FROM r WHERE label = '1') SELECT pos, label FROM r WHERE label = '1' UNION ALL SELECT pos, label FROM (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM r WHERE label = '0') WHERE k <= greatest(0, 300 - (SELECT n FROM p))")
def o10_balanced_sample(spark, sf_dir):
    return L.balanced_sample(_rows(spark, sf_dir), 300).select("pos", "label")


@query(f"{_M}, {_ROWS} SELECT pos, arm FROM r ORDER BY arm <> 'written', pos LIMIT 250")
def o11_review_order(spark, sf_dir):
    return L.review_order(_rows(spark, sf_dir), 250).select("pos", "arm")


@query(f"{_M} SELECT session_id, min(seq) AS pos FROM msg WHERE length(text) % 2 = 0 GROUP BY session_id, seq // 4")
def o12_first_conflict(spark, sf_dir):
    pending = B.messages(spark, sf_dir).filter(F.length("text") % 2 == 0).select("session_id", F.floor(F.col("seq") / 4).alias("turn"), F.col("seq").alias("pos"))
    return L.first_conflict(pending).select("session_id", "pos")


@query("WITH s AS (SELECT label AS qid, vec_id AS id FROM embeddings WHERE vec_id % 3 = 0), b AS (SELECT label AS qid, vec_id AS id FROM embeddings WHERE vec_id % 5 = 0), t AS (SELECT label AS qid, min(vec_id) AS id FROM embeddings GROUP BY label), u AS (SELECT * FROM s UNION SELECT * FROM b UNION SELECT * FROM t) SELECT qid, id, id = (SELECT t.id FROM t WHERE t.qid = u.qid) AS is_target FROM u")
def u4_candidate_ids(spark, sf_dir):
    v = B.table(spark, sf_dir, "embeddings").select(F.col("label").alias("qid"), F.col("vec_id").alias("id"))
    return L.candidate_ids(v.filter("id % 3 = 0"), v.filter("id % 5 = 0"), v.groupBy("qid").agg(F.min("id").alias("id")))


@query(
    f"{_M}, p AS (SELECT session_id, unnest(string_split({_CUT}, chr(1))) AS raw FROM msg WHERE role = 'user'), n AS (SELECT DISTINCT session_id, {norm('raw')} AS text FROM p), "
    "d AS (SELECT session_id, seq, CASE WHEN seq % 4 = 0 THEN text ELSE left(text, 30) END AS text FROM msg WHERE role = 'user') SELECT session_id, seq FROM d ANTI JOIN n USING (session_id, text)"
)
def u9_changed_spans(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    spans = m.filter("role = 'user'").select("session_id", "seq", F.when(F.col("seq") % 4 == 0, F.col("text")).otherwise(F.substring("text", 1, 30)).alias("text"))
    return L.changed_spans(spans, m).select("session_id", "seq")


@query(
    f"{_M}, {_ITEM}, j AS (SELECT *, CASE WHEN who <> 'user' THEN 'who' WHEN NOT worth THEN 'worth' WHEN type NOT IN {_TYPES} THEN 'type' END AS why FROM it), w AS (SELECT DISTINCT session_id, session_id % 9 = 0 AS refused FROM msg), "
    "lab AS (SELECT session_id, iid AS lid, CASE WHEN length(text) % 2 = 0 THEN '1' ELSE '0' END AS label FROM it WHERE seq % 3 < 2), x AS (SELECT j.session_id, j.iid, lab.lid, lab.label FROM j LEFT JOIN lab ON j.iid = lab.lid AND j.seq % 3 = 0 WHERE why IS NULL) "
    "SELECT (SELECT count(*) FROM w) AS windows, (SELECT count(*) FROM w WHERE refused) AS refusals, (SELECT count(*) FROM w WHERE session_id NOT IN (SELECT session_id FROM x)) AS windows_empty, "
    "(SELECT count(*) FROM x) AS produced, (SELECT count(*) FROM x WHERE label = '1') AS matched_positive, (SELECT count(*) FROM x WHERE label = '0') AS matched_negative, (SELECT count(*) FROM x WHERE label IS NULL) AS unmatched, "
    "(SELECT count(*) FROM j WHERE why = 'who') AS refused_who, (SELECT count(*) FROM j WHERE why = 'worth') AS refused_worth, (SELECT count(*) FROM j WHERE why = 'type') AS refused_type, "
    "(SELECT count(*) FROM lab WHERE label = '1' AND lid NOT IN (SELECT lid FROM x WHERE lid IS NOT NULL)) AS missed"
)
def a23_write_arm(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    items = _items(m).withColumnRenamed("session_id", "window")
    windows = m.select(F.col("session_id").alias("window"), (F.col("session_id") % 9 == 0).alias("refused")).distinct()
    labels = items.filter("seq % 3 < 2").select("window", F.col("iid").alias("lid"), F.when(F.length("text") % 2 == 0, "1").otherwise("0").alias("label"))
    return L.write_arm(windows, items, items.filter("seq % 3 = 0").select("iid", F.col("iid").alias("lid")), labels)


@query(f"{_M}, c AS (SELECT session_id, seq // 4 AS turn, length(text) % 3 = 0 AS dup, CASE WHEN length(text) % 5 = 0 THEN 'needs-review' ELSE 'active' END AS status FROM msg) SELECT session_id, turn, count(*) AS candidates, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup) AS written, count(*) FILTER (NOT dup AND status = 'needs-review') AS review FROM c GROUP BY ALL")
def a26_turn_outcomes(spark, sf_dir):
    n = F.length("text")
    c = B.messages(spark, sf_dir).select("session_id", F.floor(F.col("seq") / 4).alias("turn"), (n % 3 == 0).alias("duplicate"), F.when(n % 5 == 0, "needs-review").otherwise("active").alias("status"))
    return L.turn_outcomes(c, c.filter("not duplicate"))


@query(
    f"{_M}, s AS (SELECT role AS arm, CASE WHEN seq % 3 = 0 THEN '1' ELSE '0' END AS label, (length(text) % 97) / 97.0::DOUBLE AS score FROM msg), k AS (SELECT *, row_number() OVER (PARTITION BY arm, label ORDER BY score) AS k, count(*) OVER (PARTITION BY arm, label) AS n FROM s) "
    "SELECT arm, "
    + ", ".join(f"coalesce(max(score) FILTER (label = '{x}' AND k = n // 2 + 1), 0.0) AS {n}_median, count(*) FILTER (label = '{x}') AS {n}_rows, count(*) FILTER (label = '{x}' AND score >= 0.12) AS {n}_from_12, count(*) FILTER (label = '{x}' AND score >= 0.3) AS {n}_from_30" for n, x in (("positive", "1"), ("negative", "0")))
    + " FROM k GROUP BY arm"
)
def a29_arm_summary(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    return L.arm_summary(m.select(F.col("role").alias("arm"), F.when(F.col("seq") % 3 == 0, "1").otherwise("0").alias("label"), ((F.length("text") % 97) / 97.0).alias("score")))


_MEM = f"WITH {B.MEMORIES}"


@query(
    f"{_MEM}, c AS (SELECT CAST(id AS BIGINT) AS pos, 'note ' || id AS text, type, importance, CASE WHEN CAST(id AS BIGINT) % 3 > 0 THEN id END AS partner, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'skip-duplicate' WHEN 1 THEN 'replace' WHEN 2 THEN 'review' ELSE 'insert' END AS action FROM mem), "
    "n AS (SELECT left(sha1(lower(text)), 12) AS id, * FROM c WHERE action <> 'skip-duplicate') "
    "SELECT n.id, n.text, CASE WHEN action = 'review' THEN 'needs-review' ELSE 'active' END AS status, NULL AS superseded_by FROM n UNION ALL "
    "SELECT m.id, m.text, CASE WHEN n.id IS NOT NULL THEN 'superseded' ELSE m.status END, coalesce(n.id, m.superseded_by) FROM mem m LEFT JOIN n ON n.partner = m.id AND n.action = 'replace'"
)
def d5_applied_writes(spark, sf_dir):
    m = B.memories(spark, sf_dir)
    i = F.col("id").cast("long")
    action = F.when(i % 4 == 0, "skip-duplicate").when(i % 4 == 1, "replace").when(i % 4 == 2, "review").otherwise("insert")
    resolved = m.select(i.alias("pos"), F.concat(F.lit("note "), "id").alias("text"), "type", "cwd", "importance", F.when(i % 3 > 0, F.col("id")).alias("partner_id"), action.alias("action"))
    return D.apply_writes(m, resolved, B.NOW_MS).select("id", "text", "status", "superseded_by")
