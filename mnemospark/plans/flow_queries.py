"""Queries over conversations and events: windows, extraction, echoes, gates, with their DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.tokens import token_set
from ..operators import echo as E
from ..operators import extract as X
from ..operators import windows as W
from . import tables as B
from .registry import query
from .text_queries import _ECHO, SCREEN, norm

_M = f"WITH {B.MESSAGES}"
_R = "r AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq) AS round FROM msg WHERE role IN ('user', 'assistant'))"


@query(
    f"{_M}, {_R} SELECT session_id, round, min(seq) FILTER (role = 'user') AS seq, arg_min(text, seq) FILTER (role = 'user') AS text, max(seq) FILTER (role = 'assistant') AS answer_seq, arg_max(text, seq) FILTER (role = 'assistant') AS answer FROM r WHERE round > 0 GROUP BY session_id, round"
)
def w20_rounds(spark, sf_dir):
    return W.rounds(B.messages(spark, sf_dir))


_WINDOW = f"""{_M}, {_R},
an AS (SELECT session_id, seq AS "at" FROM msg WHERE role = 'user'),
bef AS (SELECT an.session_id, "at", round, min(seq) FILTER (role = 'user') AS us, arg_min(text, seq) FILTER (role = 'user') AS ut, max(seq) FILTER (role = 'assistant') AS ans, arg_max(text, seq) FILTER (role = 'assistant') AS ant
  FROM an JOIN r ON r.session_id = an.session_id AND r.seq < "at" WHERE round > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS back, sum(CAST(ans IS NOT NULL AS INTEGER)) OVER w AS nth FROM bef WINDOW w AS (PARTITION BY session_id, "at" ORDER BY round DESC)),
l AS (SELECT session_id, "at", us AS seq, 'user' AS role, ut AS text FROM k WHERE back <= 3
  UNION ALL SELECT session_id, "at", ans, 'assistant', left(ant, CASE WHEN nth <= 1 THEN 150 ELSE 40 END) FROM k WHERE back <= 3 AND ans IS NOT NULL)"""


@query(f'{_WINDOW} SELECT session_id, "at", row_number() OVER (PARTITION BY session_id, "at" ORDER BY seq) - 1 AS pos, seq, role, text FROM l')
def w1_conversation_windows(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    anchors = m.filter("role = 'user'").select("session_id", F.col("seq").alias("at"))
    return W.conversation_windows(m, anchors, 3, 40, 1, 150).select("session_id", "at", "pos", "seq", "role", "text")


@query(f"{_M} SELECT session_id, seq, len(w) AS n, w[1] AS first FROM (SELECT session_id, seq, list(seq) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w FROM msg)")
def w6_w19_windows_ending_at(spark, sf_dir):
    return W.windows_ending_at(B.messages(spark, sf_dir), 5).select("session_id", "seq", F.size("window").alias("n"), F.col("window")[0]["seq"].alias("first"))


@query(f"{_M} SELECT session_id, seq, count(*) OVER w AS n_before, coalesce(sum(length(text)) OVER w, 0) AS chars_before FROM msg WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w7_earlier_counts(spark, sf_dir):
    return W.earlier_counts(B.messages(spark, sf_dir))


@query(f"{_M}, n AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS total FROM msg), s AS (SELECT n.*, st.start FROM n JOIN (SELECT unnest(range(0, 1000, 4)) AS start) st ON k BETWEEN st.start AND st.start + 4 WHERE st.start + 5 <= total) SELECT session_id, start, array_to_string(list_sort(list(seq)), ',') AS seqs FROM s GROUP BY ALL")
def w18_hopping_windows(spark, sf_dir):
    return W.hopping_windows(B.messages(spark, sf_dir)).select("session_id", "start", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))


@query(f"{_M}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS pos FROM msg) SELECT session_id, coalesce(max(pos) FILTER (role = 'user'), -1) AS source FROM n GROUP BY session_id")
def w8_extraction_source(spark, sf_dir):
    return W.extraction_source(B.messages(spark, sf_dir))


@query(f"{_M}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM msg WHERE role = 'user') SELECT session_id, left(string_agg(text, chr(10) ORDER BY seq), 4000) AS query FROM n WHERE k <= 3 GROUP BY session_id")
def w9_recall_queries(spark, sf_dir):
    return W.recall_queries(B.messages(spark, sf_dir))


@query(f"{_M}, n AS (SELECT session_id, seq, role, sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM msg), l AS (SELECT *, max(turn) OVER (PARTITION BY session_id) AS last FROM n) SELECT session_id, seq, turn FROM l WHERE turn = last AND role <> 'user'")
def w10_w11_last_turn(spark, sf_dir):
    return W.last_turn(B.messages(spark, sf_dir).withColumnRenamed("role", "type"), "user").select("session_id", "seq", "turn")


@query(f"{_M} SELECT session_id, count(*) AS n, sum(length(text)) AS chars, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM msg GROUP BY session_id")
def a16_a25_turn_summary(spark, sf_dir):
    return W.turn_summary(B.messages(spark, sf_dir))


_SPANS = [("a", 0, 5), ("a", 4, 9), ("a", 9, 12), ("b", 3, 8), ("b", 0, 3), ("c", 1, 2)]


@query(f"WITH {B.sql_values('s', _SPANS, 'key, start, \"end\"')} SELECT key, start, \"end\" FROM (SELECT *, lag(\"end\") OVER (PARTITION BY key ORDER BY start, \"end\") AS b FROM s) WHERE start < b")
def w17_overlapping_spans(spark, sf_dir):
    return W.overlapping_spans(B.values(spark, _SPANS, "key string, start int, end int"))


_FILES = [("/logs/s1/log.v1.jsonl",), ("/logs/s1/log.v12.jsonl",), ("/logs/s1/log.v3.jsonl",), ("/logs/s2/log.jsonl",)]


@query(f"WITH {B.sql_values('f', _FILES, 'path')} SELECT regexp_extract(path, '/([^/]+)/[^/]*$', 1) AS session_id, arg_max(path, coalesce(TRY_CAST(nullif(regexp_extract(path, 'v(\\d+)[^/]*$', 1), '') AS INTEGER), 0)) AS path FROM f GROUP BY 1")
def s11_w5_newest_generation(spark, sf_dir):
    from ..sources.logs import newest_generations

    return newest_generations(B.values(spark, _FILES, "path string"))


@query(f"WITH {B.EVENTS}, l AS (SELECT user_id AS session_id, t, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY t, event_id) AS last FROM ev) SELECT session_id, t, kind FROM l WHERE last IS DISTINCT FROM kind")
def w14_recall_changes(spark, sf_dir):
    from ..operators.recall import recall_changes

    e = B.events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.struct("t", "event_id").alias("at"), "t", F.col("kind").alias("ids"))
    return recall_changes(e.withColumnsRenamed({"t": "time", "at": "t"})).select("session_id", F.col("time").alias("t"), F.col("ids").alias("kind"))


@query(f"WITH {B.EVENTS} SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, event_id) AS nth FROM ev) WHERE nth >= 2")
def w15_repeat_gate(spark, sf_dir):
    e = B.events(spark, sf_dir).select(F.concat_ws(":", "user_id", "kind").alias("key"), "t", "event_id")
    return X.repeat_gate(e).select("event_id", "nth")


@query(f"WITH {B.EVENTS} SELECT user_id, kind, count(*) AS n FROM ev GROUP BY ALL")
def a2_observed_counts(spark, sf_dir):
    return B.events(spark, sf_dir).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


# --- extraction ---------------------------------------------------------------------------------------------------

_TALK = [("s1", 1, 1, t) for t in ("部署必须走灰度通道，周五不发布。好的。为什么缓存没有命中？", )] + [
    ("s1", 1, 3, "The loader crashes when the cache is empty. We decided on parquet instead of csv! Never commit generated files; keep the index small; always pin the compiler."),
    ("s1", 2, 5, "记住：构建机器只有八个核！\\end{itemize} 请按下面步骤操作并回报"), ("s2", 1, 1, "see `make check` before release. password = hunter2hunter2hunter2"), ("s2", 1, 2, "ok"),
    ("s2", 1, 4, "Never commit generated files; plain statement about storage."),
]


def _talk(spark):
    return B.values(spark, _TALK, "session_id string, turn int, seq long, text string")


@query()
def x_sentence_candidates(spark, sf_dir):
    return X.sentence_candidates(_talk(spark))


@query()
def w2_w3_turn_candidates(spark, sf_dir):
    return X.turn_candidates(X.sentence_candidates(_talk(spark)), X.ExtractConfig(per_turn=3))


@query()
def e5_vetoes(spark, sf_dir):
    return X.vetoes(_talk(spark)).select("session_id", "seq", "sentence", "reason", "noteworthy")


_EV = [
    ("s1", 1, 0, "turn/start", None, None, None, [], None, None), ("s1", 1, 1, "user/message", "user", None, None, [("text", "Never commit generated files to git. ok", False)], None, None),
    ("s1", 1, 2, "user/message", "plugin", None, None, [("text", "Always inject this context first", False)], None, None), ("s1", 1, 3, "tool/call", None, "c1", "bash", [], None, None),
    ("s1", 1, 4, "tool/result", None, "c1", None, [("text", "command not found: foo", True)], None, None), ("s1", 1, 5, "tool/result", None, "c2", None, [], "E_TIMEOUT", "fetch"),
    ("s1", 1, 6, "tool/result", None, "c1", None, [("text", "fine", False)], None, None), ("s1", 1, 7, "assistant/message", None, None, None, [("text", "done", False), ("image", "x", False)], None, None),
]
_EV_SCHEMA = "session_id string, turn int, seq long, type string, source_kind string, call_id string, name string, blocks array<struct<type:string,text:string,is_error:boolean>>, error_code string, error_name string"


@query()
def x_extract(spark, sf_dir):
    return X.extract(B.values(spark, _EV, _EV_SCHEMA))


@query()
def j1_tool_failures(spark, sf_dir):
    return X.failure_rows(B.values(spark, _EV, _EV_SCHEMA))


@query()
def t9_archive_rows(spark, sf_dir):
    return X.archive_rows(B.values(spark, _EV, _EV_SCHEMA))


@query(f"WITH {B.MEMORIES}, s AS (SELECT id, text, text || ' ' || lower(text) AS both_ FROM mem) SELECT id FROM s WHERE coalesce(({SCREEN.replace('text,', 'both_,').replace('text)', 'both_)')}) = 'secret', false) = false")
def f19_secret_veto(spark, sf_dir):
    rows = B.memories(spark, sf_dir).select("id", "text", F.lower("text").alias("quote"))
    return X.secret_veto(rows).select("id")


_ITEMS = [(1, 0, "user", True, "constraint"), (1, 1, "assistant", True, "constraint"), (1, 2, "user", False, "pitfall"), (1, 3, "user", True, "fact"), (1, 4, "user", True, "pitfall"), (1, 5, "user", True, "decision"), (2, 0, "user", True, "decision")]


@query(f"WITH {B.sql_values('i', _ITEMS, 'turn, pos, who, worth, type')} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY pos) AS k FROM i WHERE who = 'user' AND worth AND type IN ('constraint', 'pitfall', 'decision')) WHERE k <= 2".replace("SELECT * FROM (", "SELECT turn, pos, who, worth, type FROM ("))
def f18_model_rows(spark, sf_dir):
    return X.model_rows(B.values(spark, _ITEMS, "turn int, pos int, who string, worth boolean, type string"), 2)


# --- echoes -------------------------------------------------------------------------------------------------------


def _cands(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    return m.filter("role = 'user'").select(F.concat_ws(":", "session_id", "seq").alias("cid"), "session_id", "seq", "text"), m


_C = f"{_M}, c AS (SELECT session_id || ':' || seq AS cid, session_id, seq, text FROM msg WHERE role = 'user'), p AS (SELECT cid, c.text, m.seq AS said_seq, m.text AS said FROM c JOIN msg m ON m.session_id = c.session_id AND m.seq < c.seq WHERE m.role <> 'user')"


@query(f"{_C} SELECT cid, said_seq FROM p")
def j6_earlier_pairs(spark, sf_dir):
    return E.earlier_pairs(*_cands(spark, sf_dir)).select("cid", "said_seq")


@query(
    f"{_C}, n AS (SELECT cid, {_ECHO} AS needle, {_ECHO.replace('lower(text)', 'lower(said)')} AS hay FROM p), z AS (SELECT cid, needle, hay, length(needle) AS l, greatest(8, CAST(ceil(length(needle) * 0.6::DOUBLE) AS BIGINT)) AS f FROM n WHERE length(needle) >= 8), "
    "w AS (SELECT cid, needle, hay, l, unnest(range(l, f - 1, -4)) AS size FROM z), v AS (SELECT cid, needle, hay, l, size, unnest(range(0, l - size + 1, 4)) AS start FROM w) SELECT cid, max(size) * 1.0::DOUBLE / any_value(l) AS coverage FROM v WHERE contains(hay, substr(needle, start + 1, size)) GROUP BY cid"
)
def j7_echoes(spark, sf_dir):
    return E.find_echoes(*_cands(spark, sf_dir))


_TK = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_.-]{{3,}}'))"


@query(
    f"{_C}, t AS (SELECT cid, said_seq, {_TK.format(c='text')} AS w, {_TK.format(c='said')} AS s FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY said_seq DESC) AS k FROM t WHERE len(w) >= 5), "
    "v AS (SELECT cid, said_seq, len(list_intersect(w, s)) * 1.0::DOUBLE / len(w) AS coverage FROM k WHERE k <= 2) SELECT cid, max(said_seq) AS said_seq, arg_max(coverage, said_seq) AS coverage FROM v WHERE coverage >= 0.2 GROUP BY cid"
)
def j8_w4_span_echoes(spark, sf_dir):
    return E.find_span_echoes(*_cands(spark, sf_dir), 5, 0.2, 2)


@query()
def j16_t19_overlap_join(spark, sf_dir):
    items, m = _cands(spark, sf_dir)
    labels = m.select("session_id", "seq", F.concat_ws(":", "session_id", "seq").alias("lid"), F.substring("text", 5, 40).alias("label_text"))
    return E.overlap_join(items.withColumnRenamed("cid", "iid"), labels)


@query(
    f"{_M}, g AS (SELECT session_id || ':' || seq AS id, role, session_id * 100 + seq AS time, {_TK.format(c='text')} AS w FROM msg), a AS (SELECT id AS cid, time, len(w) AS n, unnest(w) AS token FROM g WHERE role = 'user' AND len(w) >= 5), b AS (SELECT id AS mid, time AS said_at, unnest(w) AS token FROM g WHERE role = 'assistant'), "
    "c AS (SELECT cid, mid, count(*) * 1.0::DOUBLE / any_value(n) AS coverage FROM a JOIN b USING (token) WHERE said_at < time GROUP BY ALL) SELECT cid, max(coverage) AS coverage FROM c WHERE coverage >= 0.3 GROUP BY cid"
)
def j20_global_echoes(spark, sf_dir):
    m = B.messages(spark, sf_dir).withColumns({"id": F.concat_ws(":", "session_id", "seq"), "time": F.col("session_id") * 100 + F.col("seq")})
    return E.global_echoes(m.filter("role = 'user'").withColumnRenamed("id", "cid"), m.withColumnRenamed("id", "mid"), 5, 0.3)


@query(f"{_M}, b AS (SELECT session_id, seq, CASE WHEN role = 'user' THEN {norm('text')} END AS mine, CASE WHEN role = 'assistant' THEN {norm('text')} END AS theirs FROM msg), k AS (SELECT CASE WHEN mine IS NOT NULL THEN 'user' WHEN theirs IS NOT NULL THEN 'assistant' ELSE 'neither' END AS kind FROM b) SELECT kind, count(*) AS n, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM k) AS share FROM k GROUP BY kind")
def a22_provenance(spark, sf_dir):
    from ..operators.evaluate import provenance

    return provenance(B.messages(spark, sf_dir).select((F.col("role") == "user").alias("by_user"), (F.col("role") == "assistant").alias("by_assistant")))


@query(f"{_M} SELECT session_id, role, count(*) AS n, len(list_distinct(flatten(list({_TK.format(c='text')})))) AS tokens FROM msg GROUP BY ALL")
def a28_role_tokens(spark, sf_dir):
    m = B.messages(spark, sf_dir).select("session_id", "role", token_set(F.col("text")).alias("t"))
    return m.groupBy("session_id", "role").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("tokens"))


@query(f"{_M} SELECT session_id, string_agg('[' || k || '] ' || role || ': ' || text, chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS k FROM msg) GROUP BY session_id")
def t25_window_prompt(spark, sf_dir):
    from ..operators.judge import window_prompt

    m = B.messages(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("m"))
    return m.select("session_id", window_prompt(F.col("m")).alias("prompt"))


del P, T
