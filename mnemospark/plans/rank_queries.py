"""Queries over rankers and recall, with their DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths
from ..functions.tokens import token_list, token_set
from ..operators import rank as R
from ..operators import recall as C
from . import tables as B
from .registry import query

WORKSPACE = "src0"
PROBES = [(0, "the thtion of inthe thatnd and the"), (1, "schlich der ungen erlich"), (2, "Orre ciónes para las menteí"), (3, "")]
_P = B.sql_values("q", PROBES, "qid, query")
TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_.-]{{3,}}')"
_TOK, _QTOK = TOKENS.format(c="text"), TOKENS.format(c="query")
_SCOPED = f"scoped AS (SELECT * FROM mem WHERE (cwd IS NULL OR cwd = '{WORKSPACE}') AND status <> 'superseded')"


def bm25_sql(docs: str) -> str:
    """Common table expressions ending in scores(qid, id, score)."""
    return f"""
tok AS (SELECT id, {_TOK} AS t FROM {docs}),
stats AS (SELECT count(*) AS n, CASE WHEN coalesce(avg(len(t)), 0) = 0 THEN 1.0 ELSE avg(len(t)) END AS avg_length FROM tok),
post AS (SELECT id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(t) AS l, unnest(t) AS token FROM tok) GROUP BY id, token),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
want AS (SELECT qid, unnest(list_distinct({_QTOK})) AS token FROM q),
scores AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_length))) AS score
  FROM want JOIN post USING (token) JOIN dfs USING (token), stats GROUP BY qid, id)"""


_NAME = r"'\b[A-Za-z][A-Za-z0-9_.-]{4,}\b'"
SEARCH = f"""{bm25_sql('scoped')},
names AS (SELECT qid, unnest(list_distinct(regexp_extract_all(query, {_NAME}))) AS name FROM q),
held AS (SELECT qid, id, name FROM names JOIN scoped ON contains(text, name)),
bonus AS (SELECT qid, id, count(*) * 16.0 AS bonus FROM held GROUP BY ALL),
alls AS (SELECT qid, id, coalesce(score, 0) + coalesce(bonus, 0) AS score FROM scores FULL JOIN bonus USING (qid, id)),
hits AS (SELECT qid, a.id, a.score, row_number() OVER (PARTITION BY qid ORDER BY round(a.score, 9) DESC, importance DESC, created_at DESC, a.id) AS rank FROM alls a JOIN scoped ON a.id = scoped.id WHERE a.score > 0),
search AS (SELECT * FROM hits WHERE rank <= 20)"""
_HEAD = f"WITH {B.MEMORIES}, {_SCOPED}, {_P}"
SUBSTRING = f"""sub AS (
  SELECT qid, id, (CAST(contains(hay, lower(trim(query))) AS DOUBLE) + 0.3 * len(list_filter(list_distinct({_QTOK}), lambda t: contains(hay, t)))) * importance AS score
  FROM q CROSS JOIN (SELECT id, importance, lower(text || ' ' || type) AS hay FROM scoped)),
subr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sub WHERE score > 0)"""


def _probes(spark):
    return B.values(spark, PROBES, "qid int, query string")


def _search(spark, sf_dir):
    return R.search(B.memories(spark, sf_dir), _probes(spark), WORKSPACE)


def _scoped(spark, sf_dir):
    return R.searchable(B.memories(spark, sf_dir), WORKSPACE)


@query(f"{_HEAD}, {SEARCH} SELECT qid, id, score, rank FROM search")
def r1_search_memories(spark, sf_dir):
    return _search(spark, sf_dir)


@query(f"{_HEAD}, {bm25_sql('scoped')} SELECT qid, id, score FROM scores")
def j4_bm25(spark, sf_dir):
    return R.bm25(_scoped(spark, sf_dir), _probes(spark))


@query(f"WITH {B.MEMORIES}, t AS (SELECT len({_TOK}) AS l FROM mem) SELECT count(*) AS n, CASE WHEN avg(l) = 0 THEN 1.0 ELSE avg(l) END AS avg_length FROM t")
def a3_corpus_stats(spark, sf_dir):
    return R.corpus_stats(B.memories(spark, sf_dir))


@query(f"WITH {B.MEMORIES}, t AS (SELECT unnest(list_distinct({_TOK})) AS token FROM mem) SELECT token, count(*) AS df FROM t GROUP BY token")
def a4_document_frequency(spark, sf_dir):
    return R.document_frequency(B.memories(spark, sf_dir), token_list(F.col("text")))


@query(f"{_HEAD}, {SUBSTRING} SELECT qid, id, score, rank FROM subr")
def r2_substring_rank(spark, sf_dir):
    return R.substring_rank(_scoped(spark, sf_dir), _probes(spark))


_VEC = """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding, label, vec_id FROM embeddings WHERE embedding IS NOT NULL),
qs AS (SELECT label AS qid, arg_min(embedding, vec_id) AS qe FROM v GROUP BY label),
sims AS (SELECT qid, id, list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM qs CROSS JOIN v),
vec AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sims WHERE score > 0)"""


@query(f"{_VEC} SELECT qid, id, score, rank FROM vec WHERE rank <= 50")
def r3_vector_rank(spark, sf_dir):
    v = B.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    probes = v.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return R.vector_rank(v.select(F.col("vec_id").cast("string").alias("id"), "embedding"), probes, 50)


@query(f"{_HEAD}, {SEARCH}, {SUBSTRING}, u AS (SELECT qid, id, score / max(score) OVER (PARTITION BY qid) AS score FROM search UNION ALL SELECT qid, id, score / max(score) OVER (PARTITION BY qid) FROM subr), s AS (SELECT qid, id, sum(score) AS score FROM u GROUP BY ALL) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s")
def r4_hybrid(spark, sf_dir):
    return R.hybrid(_search(spark, sf_dir), R.substring_rank(_scoped(spark, sf_dir), _probes(spark)))


_FUSED = "fu AS (SELECT qid, id, 1.0 / (60 + rank) AS score FROM search UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM subr), fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT qid, id, sum(score) AS score FROM fu GROUP BY ALL))"


@query(f"{_HEAD}, {SEARCH}, {SUBSTRING}, {_FUSED} SELECT qid, id, score FROM fused")
def r5_rank_fusion(spark, sf_dir):
    return R.fuse(_search(spark, sf_dir), R.substring_rank(_scoped(spark, sf_dir), _probes(spark))).select("qid", "id", "score")


_PINS = "pins AS (SELECT DISTINCT qid, id FROM (SELECT qid, id, count(*) OVER (PARTITION BY qid, name) AS df FROM held) WHERE df <= 2)"


@query(f"{_HEAD}, {SEARCH}, {_PINS} SELECT qid, id FROM pins")
def j12_pinned_names(spark, sf_dir):
    return R.pinned(_scoped(spark, sf_dir), _probes(spark))


@query(f"{_HEAD}, {SEARCH}, {_PINS}, b AS (SELECT qid, id, 0 AS part, 0 AS rank, 0.0 AS score FROM pins UNION ALL SELECT qid, id, 1, rank, score FROM search), f AS (SELECT qid, id, min(part * 1000000 + rank) AS place, max(score) AS score FROM b GROUP BY ALL) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS rank FROM f")
def r7_u2_pin_first(spark, sf_dir):
    return R.pin_first(_search(spark, sf_dir), R.pinned(_scoped(spark, sf_dir), _probes(spark)))


@query(f"{_HEAD}, {SEARCH}, {SUBSTRING}, {_FUSED}, {_PINS}, b AS (SELECT qid, id, 0 AS part, 0 AS rank FROM pins UNION ALL SELECT qid, id, 1, rank FROM fused), f AS (SELECT qid, id, min(part * 1000000 + rank) AS place FROM b GROUP BY ALL) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS rank FROM f")
def r6_fusion_with_pins(spark, sf_dir):
    fused = R.fuse(_search(spark, sf_dir), R.substring_rank(_scoped(spark, sf_dir), _probes(spark)))
    return R.pin_first(fused, R.pinned(_scoped(spark, sf_dir), _probes(spark))).select("qid", "id", "rank")


_TERMS = f"""found AS (SELECT qid, id, unnest(list_distinct({_TOK})) AS token FROM search JOIN scoped USING (id) WHERE rank <= 5),
fresh AS (SELECT qid, token, count(*) AS n FROM found GROUP BY ALL HAVING count(*) >= 2),
terms AS (SELECT qid, token, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, token) AS k FROM fresh ANTI JOIN want USING (qid, token))"""


@query(f"{_HEAD}, {SEARCH}, {_TERMS} SELECT qid, token, n FROM terms WHERE k <= 5")
def r8_u7_feedback_terms(spark, sf_dir):
    return R.feedback_terms(_scoped(spark, sf_dir), _probes(spark), _search(spark, sf_dir))


@query()
def r8_feedback_search(spark, sf_dir):
    return R.search_with_feedback(B.memories(spark, sf_dir), _probes(spark), WORKSPACE)


@query(f"{_HEAD}, {SEARCH}, sweep AS (SELECT w.b AS bonus, a.qid, a.id, coalesce(s.score, 0) + coalesce(bo.bonus, 0) / 16.0 * w.b AS score FROM (VALUES (0.0::DOUBLE), (4.0::DOUBLE), (16.0::DOUBLE)) w(b), alls a LEFT JOIN scores s USING (qid, id) LEFT JOIN bonus bo USING (qid, id)) SELECT bonus, qid, count(*) AS n, max(score) AS best FROM sweep WHERE score > 0 GROUP BY ALL")
def r9_bonus_sweep(spark, sf_dir):
    scoped = _scoped(spark, sf_dir)
    out = None
    for bonus in (0.0, 4.0, 16.0):
        hits = R.search(scoped, _probes(spark), WORKSPACE, 1 << 30, bonus).groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("best")).select(F.lit(bonus).alias("bonus"), "qid", "n", "best")
        out = hits if out is None else out.union(hits)
    return out


_PAIR = f"""b AS (SELECT item_id AS lid, list_distinct({_TOK}) AS t FROM benchmark), d AS (SELECT id AS rid, list_distinct({_TOK}) AS t FROM mem),
x AS (SELECT lid, len(t) AS ln, unnest(t) AS token FROM b), y AS (SELECT rid, len(t) AS rn, unnest(t) AS token FROM d),
pairs AS (SELECT lid, rid, count(*) AS shared, count(*) * 1.0 / least(any_value(ln), any_value(rn)) AS score FROM x JOIN y USING (token) GROUP BY ALL)"""


def _items(spark, sf_dir):
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


@query(f"WITH {B.MEMORIES}, {_PAIR} SELECT lid, rid, shared, score FROM pairs WHERE score >= 0.5")
def j3_overlap_pairs(spark, sf_dir):
    return R.overlap_pairs(_items(spark, sf_dir), B.memories(spark, sf_dir), 0.5)


@query(f"WITH {B.MEMORIES}, {_PAIR} SELECT lid, rid, shared, score FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(score, 9) DESC, rid) AS k FROM pairs WHERE score >= 0.2) WHERE k = 1")
def j3_conflict_partner(spark, sf_dir):
    return R.conflict_partner(_items(spark, sf_dir), B.memories(spark, sf_dir))


@query(
    f"WITH {B.MEMORIES}, {_P}, {bm25_sql('mem')}, a AS (SELECT qid, m.id, coalesce(s.score, 0) AS score, updated_at FROM q CROSS JOIN mem m LEFT JOIN scores s USING (qid, id)) SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, updated_at DESC, id) AS rank FROM a) WHERE rank <= 20"
)
def j5_o4_conflict_partners(spark, sf_dir):
    return R.conflict_partners(_probes(spark).select(F.col("qid").alias("id"), F.col("query").alias("text")), B.memories(spark, sf_dir))


_AGE = f"greatest(0.0, ({B.NOW_MS} - created_at) / 86400000.0::DOUBLE)"


@query(f"WITH {B.MEMORIES}, a AS (SELECT *, {_AGE} AS age FROM mem) SELECT id, age AS age_days, importance * 0.85 + pow(0.5, age / 180) * 0.15 AS prior, 0.4 * pow(0.5, age * 24 / 6) AS recency FROM a")
def m3_m5_prior_recency(spark, sf_dir):
    a = B.memories(spark, sf_dir).withColumn("age", maths.age_days(F.col("created_at"), B.NOW_MS))
    return a.select("id", F.col("age").alias("age_days"), maths.prior(F.col("importance"), F.col("age")).alias("prior"), maths.recency(F.col("age"), 0.4).alias("recency"))


_ELIGIBLE = f"type IN ('constraint', 'pitfall', 'decision') AND (cwd IS NULL OR cwd = '{WORKSPACE}') AND status = 'active'"
_BLEND = f"""rel AS (SELECT id, score / max(score) OVER () AS r FROM hits WHERE qid = 0),
blended AS (SELECT m.*, {_AGE} AS age, 0.8 * coalesce(r, 0) + (1 - 0.8) * (importance * 0.85 + pow(0.5, {_AGE} / 180) * 0.15) + 0.4 * pow(0.5, {_AGE} * 24 / 6) AS score FROM mem m LEFT JOIN rel USING (id) WHERE {_ELIGIBLE})"""
_CONFIG = C.RecallConfig(recency_bonus=0.4, max_tokens=2600, quota={"constraint": 4, "pitfall": 3, "decision": 2})


def _blended(spark, sf_dir):
    m = B.memories(spark, sf_dir)
    relevance = R.search(m, B.values(spark, PROBES[:1], "qid int, query string"), WORKSPACE, 1 << 30).select("id", "score")
    return C.scored(m, B.NOW_MS, WORKSPACE, _CONFIG, relevance)


@query(f"{_HEAD}, {SEARCH}, {_BLEND} SELECT id, type, score, age AS age_days FROM blended")
def f8_m4_blended_scores(spark, sf_dir):
    return _blended(spark, sf_dir).select("id", "type", "score", "age_days")


@query(
    f"""WITH RECURSIVE {B.MEMORIES}, {_SCOPED}, {_P}, {SEARCH}, {_BLEND},
lines AS (SELECT id, type, score, created_at, '- [' || type || '] ' || text || ' (' || CASE WHEN left(sha1(lower(trim(regexp_replace(text, '[\\x{{09}}-\\x{{0D}}\\x{{20}}\\x{{A0}}]+', ' ', 'g')))), 12) = id THEN '' ELSE id || ', ' END || strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') || ')' AS line FROM blended),
items AS (SELECT *, CAST(ceil(length(line) / 4.0) AS INTEGER) AS cost, row_number() OVER (ORDER BY round(score, 9) DESC, created_at DESC, id) AS pos FROM lines),
fold(pos, tokens, c, p, d, taken) AS (
  SELECT CAST(0 AS BIGINT), 66, 0, 0, 0, false
  UNION ALL
  SELECT i.pos, f.tokens + CASE WHEN ok THEN cost ELSE 0 END, f.c + CASE WHEN ok AND type = 'constraint' THEN 1 ELSE 0 END, f.p + CASE WHEN ok AND type = 'pitfall' THEN 1 ELSE 0 END, f.d + CASE WHEN ok AND type = 'decision' THEN 1 ELSE 0 END, ok
  FROM fold f JOIN items i ON i.pos = f.pos + 1, LATERAL (SELECT f.tokens + i.cost <= 2600 AND CASE i.type WHEN 'constraint' THEN f.c < 4 WHEN 'pitfall' THEN f.p < 3 ELSE f.d < 2 END AS ok))
SELECT row_number() OVER (ORDER BY pos) AS place, id, type, cost FROM fold JOIN items USING (pos) WHERE taken"""
)
def r10_w12_select_memories(spark, sf_dir):
    rows = _blended(spark, sf_dir).withColumn("line", C.rendered_line(_CONFIG)).select("id", "type", "score", "created_at", "line")
    return C.pick(rows, C.RecallConfig(recency_bonus=0.4, max_tokens=2600, fixed_tokens=66)).select("place", "id", "type", "cost")


@query()
def r10_w13_recent_slots(spark, sf_dir):
    config = C.RecallConfig(recency_bonus=0.4, max_tokens=2600, recent_slots=2)
    return C.select_memories(B.memories(spark, sf_dir), PROBES[0][1], B.NOW_MS, WORKSPACE, config)


@query()
def t24_r11_rendered_block(spark, sf_dir):
    return C.render(C.select_memories(B.memories(spark, sf_dir), PROBES[0][1], B.NOW_MS, WORKSPACE, _CONFIG))


_BQ = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"
_TARGET = "target AS (SELECT lid AS qid, arg_min(rid, (-score, rid)) AS target_id FROM pairs GROUP BY lid)"
_RANKED = f"{bm25_sql('mem')}, rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scores), {_PAIR}, {_TARGET}, pr AS (SELECT t.qid, t.target_id, r.rank FROM target t LEFT JOIN (SELECT * FROM rk WHERE rank <= 50) r ON r.qid = t.qid AND r.id = t.target_id)"


def _probe_ranks(spark, sf_dir):
    m, items = B.memories(spark, sf_dir), _items(spark, sf_dir)
    ranking = R.ranked(R.bm25(m, items.select(F.col("id").alias("qid"), F.col("text").alias("query")))).filter("rank <= 50")
    from ..operators.evaluate import probe_ranks

    target = R.overlap_pairs(items, m, 0.0).groupBy(F.col("lid").alias("qid")).agg(F.min_by("rid", F.struct((-F.col("score")).alias("s"), "rid")).alias("target_id"))
    return probe_ranks(target, ranking)


@query(f"WITH {B.MEMORIES}, {_BQ}, {_RANKED} SELECT qid, target_id, rank FROM pr")
def w16_probe_ranks(spark, sf_dir):
    return _probe_ranks(spark, sf_dir)


@query(f"WITH {B.MEMORIES}, {_BQ}, {_RANKED} SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS hit1, count(*) FILTER (rank <= 3) AS hit3, count(*) FILTER (rank <= 5) AS hit5, count(*) FILTER (rank <= 10) AS hit10, avg(coalesce(1.0 / rank, 0)) AS mrr, count(*) FILTER (rank IS NULL) AS missed FROM pr")
def a10_retrieval(spark, sf_dir):
    from ..operators.evaluate import retrieval

    return retrieval(_probe_ranks(spark, sf_dir))


@query(f"WITH {B.MEMORIES}, n AS (SELECT unnest(list_distinct({_TOK})) AS token FROM mem), u AS (SELECT token FROM n GROUP BY token HAVING count(*) = 1), r AS (SELECT id, unnest(list_distinct({_TOK})) AS token FROM mem) SELECT id, arg_max(token, (length(token), token)) AS name FROM r JOIN u USING (token) GROUP BY id")
def j25_identifier_probes(spark, sf_dir):
    rows = B.memories(spark, sf_dir).select("id", F.explode(token_set(F.col("text"))).alias("token"))
    once = rows.groupBy("token").agg(F.count("*").alias("n"), F.first("id").alias("id")).filter("n = 1")
    return once.groupBy("id").agg(F.max_by("token", F.struct(F.length("token").alias("l"), "token")).alias("name"))


@query(f"WITH {B.MEMORIES}, {_BQ}, {_PAIR} SELECT closeness, count(*) AS n, avg(score) AS overlap FROM (SELECT score, CASE WHEN score >= 0.5 THEN 'close' ELSE 'far' END AS closeness FROM pairs WHERE score >= 0.2) GROUP BY closeness")
def a24_probe_overlap(spark, sf_dir):
    p = R.overlap_pairs(_items(spark, sf_dir), B.memories(spark, sf_dir), 0.2)
    return p.groupBy(F.when(F.col("score") >= 0.5, "close").otherwise("far").alias("closeness")).agg(F.count("*").alias("n"), F.avg("score").alias("overlap"))


@query()
def a18_funnel(spark, sf_dir):
    m = B.memories(spark, sf_dir)
    ranking = _search(spark, sf_dir)
    rows = C.scored(m, B.NOW_MS, WORKSPACE, _CONFIG).withColumn("line", C.rendered_line(_CONFIG)).select("id", "type", "score", "created_at", "line")
    chosen = C.pick(rows, _CONFIG).select(F.lit(0).alias("qid"), "id")
    return C.funnel(m, ranking.select("qid", "id"), chosen, _CONFIG.types, ranking, 10)


@query()
def a17_a19_weight_sweep(spark, sf_dir):
    m = B.memories(spark, sf_dir)
    relevance = R.search(m, B.values(spark, PROBES[:1], "qid int, query string"), WORKSPACE, 1 << 30).select("id", "score")
    out = None
    for weight in (0.0, 0.35, 0.8, 1.0):
        config = C.RecallConfig(relevance_weight=weight, max_tokens=2600)
        rows = C.scored(m, B.NOW_MS, WORKSPACE, config, relevance).withColumn("line", C.rendered_line(config)).select("id", "type", "score", "created_at", "line")
        chosen = C.pick(rows, config).agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).alias("tokens")).select(F.lit(weight).alias("weight"), "n", "tokens")
        out = chosen if out is None else out.union(chosen)
    return out


@query(f"WITH {B.MEMORIES} SELECT id, type, importance FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM mem) WHERE k <= 100")
def o1_newest(spark, sf_dir):
    return B.memories(spark, sf_dir).orderBy(F.col("created_at").desc(), "id").limit(100).select("id", "type", "importance")


@query(f"WITH {B.MEMORIES}, a AS (SELECT id, cwd IS NULL OR cwd = '{WORKSPACE}' AS here, cwd IS NULL AS nowhere FROM mem) SELECT * FROM a")
def f7_scope(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id", F.coalesce(R.in_scope(F.col("cwd"), WORKSPACE), F.lit(False)).alias("here"), R.in_scope(F.col("cwd"), None).alias("nowhere"))


_WORDS = [(0, "部署目录不要改动 memory.json"), (1, "依赖管理必须统一用 pnpm"), (2, "plain words only here")]


@query()
def t1_dictionary_tokens(spark, sf_dir):
    from ..functions.tokens import with_dictionary_tokens

    return with_dictionary_tokens(B.values(spark, _WORDS, "id int, text string"), "text", "id").select("id", F.array_join("tokens", " ").alias("tokens"))


@query(
    f"WITH {B.sql_values('s', _WORDS, 'id, text')}, r AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_.-]{{3,}}') AS latin, regexp_extract_all(lower(text), '[\\x{{3400}}-\\x{{9FFF}}]{{2,}}') AS runs FROM s) "
    "SELECT id, array_to_string(list_concat(latin, flatten(list_transform(runs, lambda x: list_transform(range(1, length(x)), lambda k: substr(x, k, 2))))), ' ') AS tokens FROM r"
)
def t1_bigram_tokens(spark, sf_dir):
    return B.values(spark, _WORDS, "id int, text string").select("id", F.array_join(token_list(F.col("text")), " ").alias("tokens"))


@query("SELECT a.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m6_cosine(spark, sf_dir):
    v = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select(F.col("vec_id").alias("id"), maths.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query(f"WITH {B.MEMORIES} SELECT id, left(sha256('m|64|' || text), 32) AS key FROM mem")
def m9_vector_key(spark, sf_dir):
    return B.memories(spark, sf_dir).select("id", maths.vector_key(F.lit("m"), F.lit(64), F.col("text")).alias("key"))
