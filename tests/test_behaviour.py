"""Hand-written expectations of the memory engine."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import maths
from mnemospark.functions import text as T
from mnemospark.operators import echo as E
from mnemospark.operators import evaluate as V
from mnemospark.operators import judge as J
from mnemospark.operators import rank as R
from mnemospark.operators import recall as C
from mnemospark.operators import sampling as S
from mnemospark.operators import store as D
from mnemospark.operators import windows as W
from mnemospark.sources import logs
from mnemospark.sources import store as files

NOW = 1_700_000_000_000
DAY = 86_400_000
MEM = "id string, type string, text string, cwd string, importance double, status string, superseded_by string, canonical string, canonical_model string, canonical_at long, created_at long, updated_at long, recalls long, last_recalled_at long"


def memory(id, type="constraint", text=None, importance=0.5, age=0, cwd=None, status="active"):
    return (id, type, text or f"text of {id}", cwd, importance, status, None, None, None, None, NOW - age * DAY, NOW - age * DAY, 0, None)


def store(spark, *rows):
    return spark.createDataFrame(list(rows), MEM)


def ids(df):
    return [r.id for r in df.orderBy("place").collect()]


def test_quota_and_type_filter(spark):
    m = store(spark, memory("c1", importance=0.9), memory("c2", importance=0.8), memory("c3", importance=0.7), memory("p1", "pitfall"), memory("f1", "fact", importance=1.0))
    config = C.RecallConfig(types=("constraint", "pitfall"), quota={"constraint": 2, "pitfall": 1})
    assert ids(C.select_memories(m, "", NOW, None, config)) == ["c1", "c2", "p1"]


def test_importance_before_decay_and_scope_and_status(spark):
    m = store(spark, memory("old", importance=0.9, age=300), memory("new", "pitfall", importance=0.5), memory("here", cwd="/a", importance=0.4), memory("there", cwd="/b"), memory("held", status="needs-review"))
    assert ids(C.select_memories(m, "", NOW, "/a")) == ["old", "new", "here"]
    assert "here" not in ids(C.select_memories(m, "", NOW, None))


def test_budget_skips_and_goes_on(spark):
    m = store(spark, memory("long", text="x" * 800, importance=0.9), memory("short", text="keep it short", importance=0.3))
    assert ids(C.select_memories(m, "", NOW, None, C.RecallConfig(max_tokens=100))) == ["short"]
    assert ids(C.select_memories(m, "", NOW, None, C.RecallConfig(max_tokens=50))) == []


def test_recent_slot_evicts_the_last(spark):
    m = store(spark, *[memory(f"o{k}", text="y" * 200, importance=0.9 - k / 100, age=50) for k in range(4)], memory("fresh", text="z" * 200, importance=0.1))
    config = C.RecallConfig(max_tokens=66 + 3 * 60, recent_slots=1)
    assert ids(C.select_memories(m, "", NOW, None, config)) == ["o0", "o1", "fresh"]


def test_relevance_against_importance(spark):
    m = store(spark, memory("deploy", text="deploy through the blue lane", importance=0.5), memory("style", text="prefer short names", importance=0.9))
    assert ids(C.select_memories(m, "how do we deploy", NOW))[0] == "deploy"
    assert ids(C.select_memories(m, "", NOW))[0] == "style"
    assert ids(C.select_memories(m, "how do we deploy", NOW, None, C.RecallConfig(relevance_weight=0.0)))[0] == "style"


def test_sweep_equals_one_selection_after_another(spark):
    words = "deploy lane blue green cache proxy socket shard index table".split()
    m = store(spark, *[memory(f"m{k}", ("constraint", "pitfall", "decision", "fact")[k % 4], text=" ".join(words[(k * 3 + j * j) % 10] for j in range(4 + 6 * (k % 5))), importance=(k * 37 % 100) / 100, age=k % 9) for k in range(40)])
    rows = [(0, "deploy the blue lane", "m3"), (1, "shard index", "m8"), (2, "", "m1"), (3, "nothing held", "m2")]
    probes = spark.createDataFrame(rows, "qid int, query string, target_id string")
    settings = {"plain": C.RecallConfig(), "small": C.RecallConfig(max_tokens=110), "slots": C.RecallConfig(recent_slots=2, max_tokens=160), "none": C.RecallConfig(max_tokens=1), "recent": C.RecallConfig(recency_bonus=0.6, relevance_weight=0.3)}
    got = {r.setting: r for r in C.sweep(m, probes, settings, NOW, None, F.col("importance") >= 0.5).collect()}
    good = {r.id for r in m.filter("importance >= 0.5").collect()}
    for name, config in settings.items():
        picked = [(t, C.select_memories(m, q, NOW, None, config)) for _, q, t in rows]
        chosen = [ids(c) for _, c in picked]
        tokens = [C.render(c).select(T.estimate_tokens("block")).first()[0] if i else 0 for (_, c), i in zip(picked, chosen)]
        flat = [i for c in chosen for i in c]
        r = got[name]
        assert (r.probes, r.covered, r.non_empty) == (4, sum(t in c for (t, _), c in zip(picked, chosen)), sum(map(bool, chosen)))
        assert (r.mean_count, r.mean_tokens) == (len(flat) / 4, sum(tokens) / 4)
        assert r.share == (sum(i in good for i in flat) / len(flat) if flat else 0.0)


def test_config_of_odd_values():
    config, problems = C.resolve_config({"types": ["pitfall", "odd", 3], "max_tokens": float("nan"), "relevance_weight": 7, "recent_slots": "2", "quota": {"fact": 4, "pitfall": None}, "prefer_canonical": 1})
    assert config == C.RecallConfig(types=("pitfall",), relevance_weight=1.0, quota={"constraint": 4, "pitfall": 3, "decision": 2, "fact": 4})
    assert [p.split(":")[0] for p in problems] == ["types", "max_tokens", "recent_slots", "prefer_canonical", "quota"]
    assert C.resolve_config({}) == (C.RecallConfig(), [])


def test_counts_in_ranges(spark):
    values = [float("inf"), -float("inf"), 0.0, 1e-9, 5.0, 5.0, 2.5, -3.0, 7.25, float("nan")]
    rows = spark.createDataFrame([(v, k % 3 == 0) for k, v in enumerate(values)], "s double, t boolean")
    for some in (rows, rows.filter("s < 100 and s > -100")):
        pairs = [(p.s, n.s) for p in some.collect() if p.t for n in some.collect() if not n.t]
        rank = lambda x: (x != x, 0.0 if x != x else x)
        want = sum((rank(a) > rank(b)) + (rank(a) == rank(b)) / 2 for a, b in pairs) / len(pairs)
        assert abs(V.auc(some, F.col("t"), F.col("s")).first().auc - want) < 1e-12
    ints = spark.createDataFrame([(k * 7 % 5, k % 2) for k in range(11)] + [(None, 0)], "v int, g int")
    assert V.upper_median(ints, "v").first() == (11, 0, 2, 4)
    want = {g: sorted(k * 7 % 5 for k in range(11) if k % 2 == g) for g in (0, 1)}
    assert {r.g: tuple(r)[1:] for r in V.upper_median(ints, "v", "g").collect()} == {g: (len(w), w[0], w[len(w) // 2], w[-1]) for g, w in want.items()}
    assert V.upper_median(ints.limit(0), "v").first().median is None


def test_block(spark):
    m = store(spark, memory("a", text="use yarn"))
    block = C.render(C.select_memories(m, "", NOW)).first().block
    assert block.startswith(C.HEADER + "\n- [constraint] use yarn (a, 2023-11-14)") and block.endswith(C.HELP)
    assert C.render(C.select_memories(m.limit(0), "", NOW)).first().block == ""


def test_search_prefers_exact_names_and_needs_a_match(spark):
    m = store(spark, memory("a", text="the memory store keeps memory of memory"), memory("b", text="see memory.json for paths"), memory("gone", text="memory.json", status="superseded"))
    q = lambda t: spark.createDataFrame([(0, t)], "qid int, query string")
    assert [r.id for r in R.search(m, q("where is memory.json memory")).orderBy("rank").collect()][0] == "b"
    assert R.search(m, q("entirely unrelated")).count() == 0 and R.search(m, q("constraint")).count() == 0


def test_pins_are_rare(spark):
    m = store(spark, *[memory(f"m{k}", text="see config.yaml") for k in range(3)], memory("n", text="see secret.toml"))
    q = spark.createDataFrame([(0, "config.yaml and secret.toml")], "qid int, query string")
    assert [r.id for r in R.pinned(m, q).collect()] == ["n"]


def test_partners_fill_up_with_the_newest(spark):
    m = store(spark, memory("hit", text="ports are fixed", age=99), *[memory(f"f{k}", text=f"filler number {k}", age=k) for k in range(24)])
    rows = R.conflict_partners(spark.createDataFrame([("q", "which ports")], "id string, text string"), m, 20).orderBy("rank").collect()
    assert [r.id for r in rows] == ["hit", *[f"f{k}" for k in range(19)]]


@pytest.mark.parametrize(("text", "want"), [("a. b", ["a.", "b"]), ("v1.2 is out. Next", ["v1.2 is out.", "Next"]), ("一。二！三", ["一。", "二！", "三"]), ("", []), ("x;y", ["x;", "y"])])
def test_sentences(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.split_sentences("t")).first()[0] == want


def test_token_estimate_counts_wide_characters(spark):
    rows = spark.createDataFrame([("abcd",), ("abcde",), ("中文",), ("中a",), ("😀😀",), (None,)], "t string").select(T.estimate_tokens("t")).collect()
    assert [r[0] for r in rows] == [1, 2, 2, 2, 1, 0]


def test_signatures_fold_what_identities_keep(spark):
    a, b = spark.createDataFrame([("port 80 in /etc/app/x",), ("port 81 in /etc/app/y",)], "t string").select(T.signature("t"), T.hash_text("t")).collect()
    assert a[0] == b[0] and a[1] != b[1]


def test_fnv(spark):
    want = []
    for s in ("", "a", "20260928:x"):
        h = 0x811C9DC5
        for c in s:
            h = (h ^ ord(c)) * 0x01000193 % 2**32
        want.append(h)
    assert [r[0] for r in spark.createDataFrame([("",), ("a",), ("20260928:x",)], "s string").select(maths.fnv1a(F.col("s"))).collect()] == want


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(maths.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_sample_is_stable_as_the_pool_grows(spark):
    pick = lambda n: {r.key for r in S.hash_ranked_sample(spark.range(n).select(F.concat(F.lit("k"), "id").alias("key")), "key", n=40).collect()}
    assert len(pick(653) - pick(666)) <= 3


def messages(spark, *rows):
    return spark.createDataFrame([("s", k, r, t) for k, (r, t) in enumerate(rows)], "session_id string, seq long, role string, text string")


def test_window_keeps_the_last_answer_and_widens_answers(spark):
    m = messages(spark, ("assistant", "before"), ("user", "q1"), ("assistant", "draft"), ("assistant", "answer one"), ("tool", "noise"), ("user", "q2"), ("user", "q3"), ("assistant", "answer three"), ("user", "now"))
    at = spark.createDataFrame([("s", 8)], "session_id string, at long")
    rows = W.conversation_windows(m, at, 3, 6, 1, 9).orderBy("pos").collect()
    assert [r.text for r in rows] == ["q1", "answer", "q2", "q3", "answer th"]
    assert [r.text for r in W.conversation_windows(m, at, 1, 0).collect()] == ["q3"]


def test_echo_rules(spark):
    m = messages(spark, ("assistant", "The quick brown fox jumps over the lazy dog."), ("user", "quick brown fox JUMPS over"), ("user", "something else entirely"), ("assistant", "something else entirely"))
    c = m.filter("role = 'user'").select(F.col("seq").alias("cid"), "session_id", "seq", "text")
    assert [(r.cid, r.coverage) for r in E.find_echoes(c, m).collect()] == [(1, 1.0)]
    words = " ".join(f"word{k}" for k in range(16))
    m = messages(spark, ("assistant", words), ("assistant", "a"), ("assistant", "b"), ("user", words))
    c = m.filter("role = 'user'").select(F.col("seq").alias("cid"), "session_id", "seq", "text")
    assert E.find_span_echoes(c, m).count() == 0 and E.find_span_echoes(c, m, lookback=3).count() == 1


def test_longest_common():
    assert E.longest_common("xabcy", "zabcw") == 3 and E.longest_common("", "a") == 0


def test_torn_relations(spark):
    rows = [({"same-update": 0.5, "same-duplicate": 0.1, "different": 0.4},), ({"same-update": 0.5, "same-duplicate": 0.45, "different": 0.05},), ({"different": 0.95},), (None,)]
    df = spark.createDataFrame(rows, "p map<string,double>")
    assert [r[0] for r in df.select(J.relation_torn(F.col("p"), 0.3)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(J.relation_torn(F.col("p"), 0.0)).collect()] == [False] * 4


def test_answer_repair():
    assert json.loads(J.repair_quotes('{"a": "say "hi" now"}')) == {"a": 'say "hi" now'}
    assert J.complete_objects('x [{"a":1},{"b":"]}"},{"c":') == ([{"a": 1}, {"b": "]}"}], False, False)
    assert J.parse_answer(None) == (None, "unparsable") and J.parse_answer("[]") == ("[]", "ok")


def test_rates_of_nothing(spark):
    none = spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    assert V.with_rates(none).first()[4:] == (1.0, 1.0, 1.0) and V.with_rates(none, 0.0).first()[4:] == (0.0, 0.0, 0.0)
    assert V.auc(spark.createDataFrame([(True, 0.5)], "t boolean, s double"), F.col("t"), F.col("s")).first().auc is None


def test_store_round_trip(spark, tmp_path):
    m = store(spark, memory("a"), memory("b", age=1))
    files.write_memories(m, f"{tmp_path}/mem")
    version = files.current_version(spark, f"{tmp_path}/mem")
    assert {r.id for r in spark.read.schema(MEM).json(version).collect()} == {"a", "b"}
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"records": [{"id": "x", "text": " a  b ", "importance": 7, "type": "odd"}, {"text": ""}, {"text": "c", "createdAt": 5, "source": {"seq": 3}}]}))
    rows, healthy = files.read_memories(spark, str(doc), NOW)
    got = {r.text: r for r in rows.collect()}
    assert healthy and set(got) == {"a b", "c"} and got["a b"].type == "fact" and got["a b"].importance == 1.0 and got["c"].created_at == 5 and got["c"].source.seq == 3
    doc.write_text("{not json")
    rows, healthy = files.read_memories(spark, str(doc), NOW)
    assert not healthy and rows.count() == 0 and not doc.exists() and (tmp_path / f"doc.json.corrupt-{NOW}").read_text() == "{not json"
    rows, healthy = files.read_memories(spark, str(doc), NOW)
    assert healthy and rows.count() == 0


def test_archive_round_trip(spark, tmp_path):
    path = f"{tmp_path}/archive"
    rows = [("s1", k, "user", NOW - k * DAY // 2, None, f"m{k}") for k in range(20)] + [("s2", 3, "user", NOW, None, "other")]
    files.append_archive(spark.createDataFrame(rows, files.ARCHIVE), path)
    archive = files.read_archive(spark, path)
    assert archive.count() == 21 and files.archive_tail(archive, 2, 100).count() == 5 and files.archive_tail(archive, 7, 5).count() == 5
    assert files.forget_archive(spark, path, "l0:s1:3") == 1 and files.forget_archive(spark, path, "l0:s9:3") == 0
    left = {(r.session_id, r.seq) for r in files.read_archive(spark, path).collect()}
    assert ("s1", 3) not in left and ("s2", 3) in left and len(left) == 20


def test_label_sheet_round_trip(spark, tmp_path):
    rows = [("1", 'a "quoted" word', "x,y"), ("2", "two\nlines", None), ("3", "plain", "?")]
    files.write_labels(spark.createDataFrame(rows, "row string, text string, label string"), f"{tmp_path}/csv")
    back = files.read_labels(spark, f"{tmp_path}/csv", "row string, text string, label string")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_session_logs(spark, tmp_path):
    for name, depth in (("s1", 0), ("s2", 1)):
        folder = tmp_path / name
        folder.mkdir()
        lines = [{"id": name, "cwd": "/w", "delegationDepth": depth}, {"type": "turn/start"}, {"type": "user/message", "data": {"source": {"kind": "user"}, "content": [{"type": "text", "text": "hi"}]}}]
        (folder / "log.v1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{bad\n")
    lines = logs.read_session_lines(spark, f"{tmp_path}/s1/log.v1.jsonl", f"{tmp_path}/s2/log.v1.jsonl")
    assert [(r.session_id, r.seq, r.type) for r in logs.session_events(lines).orderBy("seq").collect()] == [("s1", 0, "turn/start"), ("s1", 1, "user/message")]
    assert logs.session_events(lines, include_children=True).select("session_id").distinct().count() == 2


def test_upsert_keeps_counters(spark):
    old = store(spark, memory("a", age=9)).withColumn("recalls", F.lit(4).cast("long"))
    row = D.upsert(old, store(spark, memory("a", text="new"), memory("b"))).filter("id = 'a'").first()
    assert row.text == "new" and row.recalls == 4 and row.created_at == NOW - 9 * DAY


def test_names_are_found_either_way(spark, monkeypatch):
    m = store(spark, memory("a", text="uses memory.json and Config.yaml."), memory("b", text="x-memory.json-y"), memory("c", text="MEMORY.JSON"), memory("d", text="plain"))
    q = spark.createDataFrame([(0, "where is memory.json"), (1, "Config.yaml or plain words")], "qid int, query string")
    found = lambda: {(r.qid, r.id, r["name"]) for r in R.names_held(m, q).collect()}
    few = found()
    monkeypatch.setattr(R, "FEW_NAMES", 0)
    assert few == found() == {(0, "a", "memory.json"), (0, "b", "memory.json"), (1, "a", "Config.yaml"), (1, "d", "plain")}


def _cosine(a, b):
    ok = a and b and len(a) == len(b) and None not in a and None not in b
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if ok else 0
    return sum(x * y for x, y in zip(a, b)) / norms if norms else 0.0


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors with many copies and ties, others of no use."""
    rng = random.Random(3)
    rows = [(str(k), [float(rng.randint(-2, 2)) for _ in range(3)], rng.randint(0, 3), k % 4 / 4) for k in range(300)]
    rows += [(f"x{k}", v, 9, 1.0) for k, v in enumerate([None, [], [0.0] * 3, [1.0], [1.0, None, 2.0], [1e-3, 2e-3, 3e-3]])]
    return rows, spark.createDataFrame(rows, "id string, embedding array<double>, updated_at long, importance double")


def _nearest(rows, place, positive):
    out = set()
    for q, v, _, _ in rows[::5]:
        hits = [(i, _cosine(v, w), rows[k][place]) for k, (i, w, _, _) in enumerate(rows)]
        hits = sorted([h for h in hits if h[1] > 0 or not positive], key=lambda h: (-round(h[1], 9), -h[2], h[0]))
        out |= {(q, i, round(s, 9), k + 1) for k, (i, s, _) in enumerate(hits[:20])}
    return out


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vector_partners_in_blocks(spark, vectors):
    rows, df = vectors
    queries = df.filter(F.col("id").isin([r[0] for r in rows[::5]])).select(F.col("id").alias("qid"), "embedding")
    got = R.conflict_partners_by_vector(queries, df)
    assert "Join" not in _plan(got)  # no table of all pairs
    assert {(r.qid, r.id, round(r.score, 9), r["rank"]) for r in got.collect()} == _nearest(rows, 2, False)
    assert R.conflict_partners_by_vector(queries.limit(0), df).count() == 0


def test_vector_search_in_blocks(spark, vectors):
    rows, df = vectors
    queries = df.filter(F.col("id").isin([r[0] for r in rows[::5]])).select(F.col("id").alias("qid"), "embedding")
    got = R.vector_search(df, queries)
    assert "Join" not in _plan(got)
    assert {(r.qid, r.id, round(r.score, 9), r["rank"]) for r in got.collect()} == _nearest(rows, 3, True)


def test_global_echoes_in_blocks(spark):
    """Spans meet messages in blocks: the same coverage as trying all pairs, and no row for each shared token."""
    rng = random.Random(4)
    rows = [(f"{k}", rng.choice(["user", "assistant", "assistant"]), rng.randint(0, 40), " ".join(f"tok{min(rng.randrange(1, 600), rng.randrange(1, 600))}" for _ in range(rng.randint(0, 25)))) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, role string, time long, text string")
    got = E.global_echoes(df.filter("role = 'user'").withColumnRenamed("id", "cid"), df.withColumnRenamed("id", "mid"), 5, 0.3)
    assert "Join" not in _plan(got)
    want = {}
    said = [(t, set(x.split())) for _, role, t, x in rows if role == "assistant"]
    for i, role, t, x in rows:
        mine = set(x.split())
        best = max((len(mine & s) / len(mine) for u, s in said if u < t), default=0) if role == "user" and len(mine) >= 5 else 0
        if best >= 0.3:
            want[i] = best
    assert {r.cid: r.coverage for r in got.collect()} == want and want
