"""Queries over text functions, with their DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import tables as B
from .registry import query


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def has(column: str, patterns, whole: bool = False) -> str:
    """SQL for: any of the patterns occurs."""
    one = (patterns,) if isinstance(patterns, str) else patterns
    return f"regexp_matches({column}, {_q(P.any_of(one, P.re2))})"


def sub(column: str, pattern: str, by: str) -> str:
    """SQL for replacing all matches."""
    return f"regexp_replace({column}, {_q(P.re2(pattern))}, {_q(by)}, 'g')"


def norm(column: str) -> str:
    """SQL for normalised text."""
    return sub(sub(f"coalesce({column}, '')", r"\s+", " "), r"^\s+|\s+$", "")


_ASSERTS = f"({has('text', P.DECISION_ASSERTIONS)} OR regexp_matches(regexp_replace(text, '我们?决定(?:了?吗|呢)', '', 'g'), '我们?决定'))"
_QUESTION = f"({has(norm('text'), P.INTERROGATIVES)} OR ({has('text', P.QUESTION_MARKERS)} AND NOT {has('text', P.INSTRUCTION_MARKERS)}))"
SCREEN = f"""CASE WHEN {has("text", P.TRANSCRIPTS)} THEN 'transcript' WHEN {has("text", P.SECRETS)} THEN 'secret'
  WHEN NOT {has("text", P.REMEMBER_REQUESTS)} AND {has("text", P.TASK_INSTRUCTIONS)} THEN 'task-instruction' WHEN {has("text", P.PAYLOADS)} THEN 'payload'
  WHEN {has("text", P.FRAGMENTS)} THEN 'fragment' WHEN {has("text", P.NOISE)} THEN 'noise' WHEN {_ASSERTS} THEN NULL WHEN {_QUESTION} THEN 'question' END"""
_S = "WITH " + B.sql_all_texts(B.SENTENCES)
_L = "WITH " + B.sql_all_texts(B.LITERALS)
_PAIRS = "WITH " + B.sql_values("s", B.LITERALS, "id, text")
SIGNAL_TYPE = "CASE " + " ".join(f"WHEN {has('text', f)} THEN '{n}'" for n, _, f in P.TYPE_SIGNALS) + " END"
SIGNAL_WEIGHT = "CASE " + " ".join(f"WHEN {has('text', f)} THEN {w}::DOUBLE" for _, w, f in P.TYPE_SIGNALS) + " ELSE 0.0::DOUBLE END"
EMPHASIS = " + ".join(f"CASE WHEN {has('text', g)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for w, g in P.EMPHASIS)


def _sentences(spark, sf_dir):
    return B.all_texts(spark, sf_dir, B.SENTENCES)


def _literals(spark, sf_dir):
    return B.all_texts(spark, sf_dir, B.LITERALS)


@query(f"{_S} SELECT id, {SCREEN} AS reason, coalesce({SCREEN} IN ('secret', 'task-instruction', 'payload', 'fragment', 'transcript'), false) AS noteworthy FROM s")
def f1_screen(spark, sf_dir):
    return _sentences(spark, sf_dir).select("id", T.screen("text").alias("reason")).withColumn("noteworthy", T.is_noteworthy("reason"))


@query(f"{_S} SELECT id, {has('text', P.NOISE)} AS noise, {norm('text')} <> '' AND {has(norm('text'), P.INTERROGATIVES)} AS asks, {_ASSERTS} AS decides FROM s")
def f3_f4_f5_flags(spark, sf_dir):
    return _sentences(spark, sf_dir).select("id", T.is_noise("text").alias("noise"), T.looks_interrogative("text").alias("asks"), T.asserts_decision("text").alias("decides"))


@query(f"{_S} SELECT id, {SIGNAL_TYPE} AS type, {SIGNAL_WEIGHT} AS weight, coalesce(CASE {' '.join('WHEN ' + has('text', f) + ' THEN ' + ' + '.join(f'CAST({has("text", p)} AS INTEGER)' for p in f) for _, _, f in P.TYPE_SIGNALS)} END, 0) AS n_hits FROM s")
def t13_type_signals(spark, sf_dir):
    return _sentences(spark, sf_dir).withColumn("m", T.type_signal("text")).select("id", "m.type", "m.weight", F.size("m.hits").alias("n_hits"))


@query(f"{_S} SELECT id, {EMPHASIS} AS emphasis, least(1.0::DOUBLE, 0.35 + ({SIGNAL_WEIGHT}) * 0.35 + ({EMPHASIS}) + least(0.15::DOUBLE, length(text) / 800.0::DOUBLE)) AS score FROM s")
def t14_m1_scores(spark, sf_dir):
    return _sentences(spark, sf_dir).select("id", T.emphasis_weight("text").alias("emphasis"), T.candidate_score("text").alias("score"))


_SIG = "coalesce(text, '')"
for _p, _by in P.SIGNATURE_FOLDS:
    _SIG = sub(_SIG, _p, _by)


@query(f"{_L} SELECT id, lower({sub(sub(_SIG, r'\s+', ' '), r'^\s+|\s+$', '')}) AS signature FROM s")
def t11_signature(spark, sf_dir):
    return _literals(spark, sf_dir).select("id", T.signature("text").alias("signature"))


_STRIP = sub(sub("text", r"^\s*\\+(?:end|begin)\{[^}]*\}\s*", ""), r"^\s*\\+(?:item|hline)\b[\s\d.]*", "")
_STRIP = sub(_STRIP, r"^\s*\\+(?:textbf|textit|emph|texttt)\{([^}]*)\}\s*", r"\1")
_STRIP = sub(sub(_STRIP, P.SCRATCH_PATHS, "<path>"), r"\s{2,}", " ")
_STRIP = sub(_STRIP, r"^\s+|\s+$", "")
_SHORTER = sub(sub("v", r"\s*\d{1,2}[.、)）]\s*$", ""), r"^\s+|\s+$", "")


@query(f"{_L}, c AS (SELECT id, {_STRIP} AS v FROM s) SELECT id, CASE WHEN length({_SHORTER}) >= 12 THEN {_SHORTER} ELSE v END AS cleaned FROM c")
def t10_strip_pasted(spark, sf_dir):
    return _literals(spark, sf_dir).select("id", T.strip_pasted("text").alias("cleaned"))


@query(f"{_L} SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_q(P.re2(P.NAME_LIKE))}))), ' ') AS names, 16.0::DOUBLE * len(list_filter(list_distinct(regexp_extract_all(text, {_q(P.re2(P.NAME_LIKE))})), lambda n: contains('uses memory.json and broke', n))) AS bonus FROM s")
def t15_t16_names(spark, sf_dir):
    names = T.names_in("text")
    return _literals(spark, sf_dir).select("id", F.array_join(F.sort_array(names), " ").alias("names"), T.name_bonus(names, F.lit("uses memory.json and broke")).alias("bonus"))


_F = "WITH " + B.sql_all_texts(B.FAILURES)
_DETAIL = sub(sub("text", r"^[^:：]*[:：]\s*", ""), r"^\s+|\s+$", "")


@query(f"{_F}, d AS (SELECT id, {_DETAIL} AS v FROM s) SELECT id, v <> '' AND NOT {has('v', P.BARE_ERRORS)} AND NOT {has('v', P.BARE_CODE)} AS kept FROM d")
def f10_failure_kept(spark, sf_dir):
    return B.all_texts(spark, sf_dir, B.FAILURES).select("id", T.failure_kept("text").alias("kept"))


_HEAD = "left(v, {m} - 1)"


def _last(mark: str) -> str:
    return f"CASE WHEN instr(reverse(h), '{mark}') > 0 THEN length(h) - instr(reverse(h), '{mark}') + 1 ELSE 0 END"


_CUTS = ", ".join(f"greatest({', '.join(_last(m) for m in tier)}) AS c{k}" for k, tier in enumerate(T.CLAUSE_TIERS))
_TAIL = r"[\x{09}-\x{0D}\x{20}\x{A0}\x{3000}]+\z"


@query(
    f"WITH {B.sql_all_texts(B.LONG_TEXTS)}, n AS (SELECT id, {norm('text')} AS v FROM s), h AS (SELECT id, v, left(v, 39) AS h FROM n), c AS (SELECT *, {_CUTS} FROM h) "
    f"SELECT id, CASE WHEN length(v) <= 40 THEN v ELSE regexp_replace(left(h, CAST(CASE WHEN c0 - 1 >= 20 THEN c0 WHEN c1 - 1 >= 20 THEN c1 WHEN c2 - 1 >= 20 THEN c2 ELSE length(h) END AS BIGINT)), '{_TAIL}', '') || '…' END AS clipped FROM c"
)
def t4_clip_at_clause(spark, sf_dir):
    return B.all_texts(spark, sf_dir, B.LONG_TEXTS).select("id", T.clip_at_clause("text", 40).alias("clipped"))


_N = norm("text")


@query(
    f"WITH {B.MESSAGES}, n AS (SELECT session_id, seq, {_N} AS v FROM msg) SELECT session_id, seq, CASE WHEN length(v) <= 60 THEN v ELSE regexp_replace(left(v, 59), '{_TAIL}', '') || '…' END AS clipped, "
    "CASE WHEN length(v) <= 30 THEN v ELSE left(v, 30) || '…' END AS excerpt, left(sha1(lower(v)), 12) AS id, CAST(ceil(length(v) / 4.0) AS INTEGER) AS tokens, 'l0:' || session_id || ':' || seq AS address FROM n"
)
def t2_t3_t5_t6_t8_texts(spark, sf_dir):
    m = B.messages(spark, sf_dir)
    return m.select("session_id", "seq", T.clip("text", 60).alias("clipped"), T.excerpt("text", 30).alias("excerpt"), T.hash_text("text").alias("id"), T.estimate_tokens(T.normalize("text")).alias("tokens"), T.archive_id("session_id", "seq").alias("address"))


_CUT = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([。！？!?；;\n])', '\1' || chr(1), 'g'), '\.([" + P.SPACE + r"]+[\w\"''“(\x{4e00}-\x{9fff}])', '.' || chr(1) || '\1', 'g')"


@query(f"WITH {B.MESSAGES}, p AS (SELECT session_id, seq, unnest(string_split({_CUT}, chr(1))) AS raw FROM msg), n AS (SELECT session_id, seq, {norm('raw')} AS v FROM p) SELECT session_id, seq, count(*) AS n, sum(length(v)) AS chars, min(v) AS least FROM n WHERE v <> '' GROUP BY ALL")
def t7_sentences(spark, sf_dir):
    m = B.messages(spark, sf_dir).select("session_id", "seq", F.explode(T.split_sentences("text")).alias("v"))
    return m.groupBy("session_id", "seq").agg(F.count("*").alias("n"), F.sum(F.length("v")).alias("chars"), F.min("v").alias("least"))


_ECHO = "translate(" + sub("lower(text)", r"\s+", "") + ", " + _q(P.ECHO_IGNORED) + ", '')"


@query(f"WITH {B.MESSAGES} SELECT session_id, seq, {_ECHO} AS echo FROM msg")
def t12_echo_form(spark, sf_dir):
    return B.messages(spark, sf_dir).select("session_id", "seq", T.echo_form("text").alias("echo"))


@query(f"{_PAIRS} SELECT a.id, b.id AS other, list_first(list_filter(regexp_extract_all(a.text, {_q(P.re2(P.NAME_LIKE))}), lambda n: NOT contains(lower(b.text), lower(n)))) AS drift FROM s a JOIN s b ON b.id = (a.id + 1) % {len(B.LITERALS)}")
def f17_summary_drift(spark, sf_dir):
    a = B.values(spark, B.LITERALS, "id long, text string")
    b = a.select(F.col("id").alias("other"), F.col("text").alias("source"))
    return a.join(b, F.col("other") == (F.col("id") + 1) % len(B.LITERALS)).select("id", "other", T.summary_drift("text", "source").alias("drift"))


_PATHS = [(0, "/home/a/work/repo/src/x.py"), (1, "/srv/app"), (2, "rel/path/a/b/c/d"), (3, None)]


@query(f"WITH {B.sql_values('s', _PATHS, 'id, path')} SELECT id, array_to_string(list_slice(string_split(path, '/'), 1, 5), '/') AS root FROM s")
def t22_project_root(spark, sf_dir):
    return B.values(spark, _PATHS, "id long, path string").select("id", T.project_root("path").alias("root"))


_DIRS = [(0, "work~2f~a"), (1, "plain"), (2, "x~4e2d~y~20~z")]


@query()
def t21_decode_workspace(spark, sf_dir):
    return B.values(spark, _DIRS, "id long, name string").select("id", T.decode_workspace("name").alias("workspace"))
