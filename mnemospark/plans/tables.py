"""The engine's tables over the test tables, and the same as SQL; inline fixtures for what those tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1_720_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: language as type, half of the sources as workspaces, derived importance and times."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("id"),
        F.when(F.col("lang") == "en", "constraint").when(F.col("lang") == "fr", "pitfall").when(F.col("lang") == "de", "decision").otherwise("preference").alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(i % 2 == 0, F.col("source")).alias("cwd"),
        ((F.coalesce("n_chars", F.lit(0)) % 100) / 100.0).alias("importance"),
        F.when(i % 10 == 3, "superseded").when(i % 10 == 7, "needs-review").otherwise("active").alias("status"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.lit(None).cast("string").alias("canonical"),
        F.lit(None).cast("string").alias("canonical_model"),
        F.lit(None).cast("long").alias("canonical_at"),
        (F.lit(NOW_MS) - (i * 7919 % 40_000) * 3_600_000).alias("created_at"),
        (F.lit(NOW_MS) - (i * 104_729 % 90_000) * 60_000).alias("updated_at"),
        (i % 5).alias("recalls"),
        F.lit(None).cast("long").alias("last_recalled_at"),
    )


MEMORIES = f"""
mem AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE lang WHEN 'en' THEN 'constraint' WHEN 'fr' THEN 'pitfall' WHEN 'de' THEN 'decision' ELSE 'preference' END AS type,
    coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN source END AS cwd, (coalesce(n_chars, 0) % 100) / 100.0::DOUBLE AS importance,
    CASE WHEN doc_id % 10 = 3 THEN 'superseded' WHEN doc_id % 10 = 7 THEN 'needs-review' ELSE 'active' END AS status,
    CAST(NULL AS VARCHAR) AS superseded_by, CAST(NULL AS VARCHAR) AS canonical, CAST(NULL AS VARCHAR) AS canonical_model, CAST(NULL AS BIGINT) AS canonical_at,
    {NOW_MS} - (doc_id * 7919 % 40000) * 3600000 AS created_at, {NOW_MS} - (doc_id * 104729 % 90000) * 60000 AS updated_at,
    doc_id % 5 AS recalls, CAST(NULL AS BIGINT) AS last_recalled_at
  FROM documents)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of sessions."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"))


MESSAGES = "msg AS (SELECT conv_id AS session_id, turn AS seq, role, coalesce(text, '') AS text FROM conversations)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as observations."""
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "user_id", F.col("event_type").alias("kind"), "value")


EVENTS = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type AS kind, value FROM events)"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """An inline table."""
    return spark.createDataFrame(rows, schema)


def sql_values(name: str, rows: list[tuple], columns: str) -> str:
    """The same inline table as a common table expression."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return f"{x}::DOUBLE" if isinstance(x, float) else repr(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]"
        if "\n" in x:
            return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n")) + ")"
        return "'" + x.replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def all_texts(spark: SparkSession, sf_dir: str, fixtures: list[tuple]) -> DataFrame:
    """``(id, text)``: every message, every whole document, and the rows of our own that hold what those tables lack."""
    m = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("m"), "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    d = table(spark, sf_dir, "documents").select(F.concat_ws(":", F.lit("d"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return m.union(d).union(values(spark, [(f"f:{k}", t) for k, t in fixtures], "id string, text string"))


def sql_all_texts(fixtures: list[tuple]) -> str:
    """The same as a common table expression named s."""
    own = sql_values("own", [(f"f:{k}", t) for k, t in fixtures], "id, text")
    return f"{own}, s(id, text) AS (SELECT 'm:' || conv_id || ':' || turn, coalesce(text, '') FROM conversations UNION ALL SELECT 'd:' || doc_id, coalesce(text, '') FROM documents UNION ALL SELECT id, text FROM own)"


#: Sentences of our own for every screen and signal.
SENTENCES = list(enumerate([
    "部署必须走灰度通道，周五不发布", "你：这个接口怎么调用", "Assistant: here is the plan", "我的密钥是 sk-abcdefghijklmnopqrstuvwxyz123456 别外传", "请按下面步骤操作并回报",
    "把第三部分的结果贴出来给我看看吧", "记住：构建机器只有八个核", "帮我记住：缓存目录别动", "{\"name\": \"x\", \"args\": []}", "// remove the old loader before merging",
    "const limit = 40;", "# Overview of the module", "好的", "ok", "继续吧", "为什么缓存没有命中", "Which port does the proxy use", "端口别改，定 8000 了吗", "我觉得不需要单独的服务吧",
    "我们决定用列式存储，可以吗？", "我们决定了吗", "上次升级之后构建失败", "The loader crashes when the cache is empty", "We decided on parquet instead of csv", "I prefer tabs by default",
    "Never commit generated files to git", "发布前先跑检查清单", "see `make check` and /usr/local/bin/run.sh for details", "from now on keep in mind that the index is rebuilt nightly",
    "你先说说整体的设计", "password = hunter2hunter2hunter2", "deadbeefdeadbeefdeadbeefdeadbeefdeadbeefdeadbeef", "| a | b |", "这个项目有哪些约定", "能不能把日志级别改成 info", "a plain statement about storage layout",
    "不要改动 data 目录里的文件", "默认用 pnpm 安装依赖，见 package.json", "第 2 步 之后再重启", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3.sig", "难道每次都要重建索引", "请调用 `search` 工具查一下", "Is the gate open", "The gate is open", "排除这个方案，改用队列",
]))
#: Texts with literals, prefixes and clause ends.
LITERALS = list(enumerate([
    "error 404 at /srv/app/main.py line 12", "error 500 at /srv/app/other.py line 7", "run `make test` before 'deploy now' and \"ship it\"", "commit deadbeef1234 broke   the build",
    "\\end{itemize} keep the index small and sorted", "\\item 3. use two replicas for the store", "\\textbf{always} pin the compiler version", "look at /tmp/paste-1/x.txt for the whole trace", "the plan has these open questions: 2.", "x 1.",
    "foo-bar- uses memory.json and Config.yaml.", "端口memory.json在这里", "short", "",
]))
LONG_TEXTS = list(enumerate([
    "first clause, second clause; third clause ends here. fourth clause goes on and on without an end", "一句话说完了。后面还有很多没有说完的内容，一直一直说下去没有停", "word " * 30, "nospacesatallinthisverylongtokenthatneverends" * 2, "fits",
]))
FAILURES = list(enumerate(["bash 失败：E_TIMEOUT", "bash 失败：command not found: foo", "tool 失败：未知错误", "fetch 失败：Error", "fetch 失败：", "build 失败: exit status 2"]))
