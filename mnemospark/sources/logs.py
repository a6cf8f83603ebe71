"""Readers of session logs and other agents' logs as event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .schemas import BLOCKS

_LINE = (
    "id string, cwd string, delegationDepth int, type string, seq long, time long, "
    f"data struct<source:struct<kind:string>, callId:string, name:string, content:{BLOCKS.replace('is_error', 'isError')}, "
    f"message:struct<content:{BLOCKS.replace('is_error', 'isError')}, source:struct<callId:string>>, error:struct<code:string,name:string>>"
)
#: Context that a rollout injects into the user's role (fixed values).
INJECTED = r"^\s*<(environment_context|user_instructions|permissions|skill|turn_aborted|INSTRUCTIONS)"


def newest_generations(files: DataFrame) -> DataFrame:
    """Of log files ``(path)`` named .../<session>/...v<N>..., the highest N of each session."""
    named = files.select("path", F.regexp_extract("path", r"/([^/]+)/[^/]*$", 1).alias("session_id"), F.regexp_extract("path", r"v(\d+)[^/]*$", 1).try_cast("int").alias("generation"))
    return named.groupBy("session_id").agg(F.max_by("path", F.struct(F.coalesce("generation", F.lit(0)), "path")).alias("path"))


def read_session_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of session logs with their file and place. Files in .gz or .zst are read as Hadoop's codecs allow; one
    file is read by one task, as order inside it matters."""
    # wholetext keeps each file's lines together and in order
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).filter("value != ''")


def session_events(lines: DataFrame, include_children: bool = False) -> DataFrame:
    """Events of logs ``(path, line, value)`` (S10, F20): the first line is a header; seq counts through the session and
    never starts anew; child sessions are left out; broken lines are skipped."""
    parsed = lines.withColumn("e", F.from_json("value", _LINE)).filter("e is not null and (e.type is not null or line = 0)")
    by_file = Window.partitionBy("path")
    header = {c: F.max(F.when(F.col("line") == 0, F.col(f"e.{c}"))).over(by_file) for c in ("id", "cwd", "delegationDepth")}
    rows = parsed.withColumns({"session_id": header["id"], "cwd": header["cwd"], "depth": F.coalesce(header["delegationDepth"], F.lit(0))}).filter("line > 0")
    if not include_children:
        rows = rows.filter("depth <= 0")
    blocks = F.transform(F.coalesce("e.data.content", "e.data.message.content"), lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["isError"].alias("is_error")))
    numbered = rows.withColumn("seq", (F.row_number().over(by_file.orderBy("line")) - 1).cast("long"))
    return numbered.select(
        "session_id", "cwd", "seq", F.col("e.type").alias("type"), F.col("e.data.source.kind").alias("source_kind"), F.coalesce("e.data.callId", "e.data.message.source.callId").alias("call_id"),
        F.col("e.data.name").alias("name"), blocks.alias("blocks"), F.col("e.data.error.code").alias("error_code"), F.col("e.data.error.name").alias("error_name"), F.col("e.time").alias("time"),
    )


def rollout_turns(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User messages of rollout logs ``(path, line, value)`` by turn, and counts of what was skipped by reason."""
    schema = "type string, payload struct<cwd:string, id:string, type:string, role:string, content:array<struct<type:string,text:string>>>"
    rows = lines.withColumn("e", F.from_json("value", schema))
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumns({"turn": F.sum((F.col("e.type") == "turn_context").cast("int")).over(by), "session_id": F.max(F.when(F.col("e.type") == "session_meta", F.col("e.payload.id"))).over(Window.partitionBy("path")), "cwd": F.last("e.payload.cwd", True).over(by)})
    text = F.array_join(F.transform(F.filter("e.payload.content", lambda b: b["type"].isin("input_text", "text")), lambda b: b["text"]), "\n")
    said = rows.filter("e.type = 'response_item' and e.payload.role = 'user'").withColumn("text", text)
    reason = F.when(T.trim("text") == "", "empty").when(F.col("text").rlike(INJECTED), "injected")
    said = said.withColumn("reason", reason)
    broken = rows.filter("e is null or e.type is null").select(F.lit("malformed").alias("reason"))
    skipped = said.filter("reason is not null").select("reason").union(broken).groupBy("reason").agg(F.count("*").alias("n"))
    return said.filter("reason is null").select("session_id", "cwd", "turn", F.col("line").alias("seq"), "text"), skipped


def chat_bubbles(rows: DataFrame) -> DataFrame:
    """User bubbles of a key-value chat store exported as ``(key, value)`` (S13, X6): the key's two parts and the text."""
    good = rows.filter(F.col("key").startswith("bubbleId:") & (F.get_json_object("value", "$.type") == "1"))
    return good.select(F.split("key", ":")[1].alias("session_id"), F.split("key", ":")[2].alias("bubble"), F.get_json_object("value", "$.text").alias("text")).filter("text is not null and text != ''")


def read_chat_store(spark: SparkSession, url: str) -> DataFrame:
    """The same from a live database by JDBC, the conditions running there (S13); needs that database's driver."""
    query = "select key, value from cursorDiskKV where key like 'bubbleId:%' and json_extract(value, '$.type') = 1"
    return chat_bubbles(spark.read.format("jdbc").option("url", url).option("query", query).load())


def union_turns(*sources: DataFrame) -> DataFrame:
    """Turns of several sources with the columns they share (U8)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
