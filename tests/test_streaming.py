"""Streaming forms over files, run to the end."""

import pytest

from mnemospark.streaming import memory as M


def drained(df, tmp_path, mode):
    name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, tmp_path, rows, schema, name="in"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")


def test_observed_counts(spark, tmp_path):
    rows = drained(M.observed_counts(source(spark, tmp_path, [("a",), ("a",), ("b",)], "key string")), tmp_path, "update").collect()
    assert {(r.key, r.n, r.open) for r in rows} == {("a", 2, True), ("b", 1, False)}


def test_retries(spark, tmp_path):
    rows = [("s", 1, "asked"), ("s", 2, "turn"), ("s", 3, "turn"), ("s", 4, "turn"), ("r", 1, "asked"), ("r", 2, "answered"), ("r", 3, "turn")]
    got = drained(M.retried_questions(source(spark, tmp_path, rows, "session_id string, t long, kind string")), tmp_path, "append").collect()
    assert [(r.session_id, r.t, r.attempt) for r in sorted(got)] == [("s", 2, 2), ("s", 3, 3)]


def test_changed_recalls(spark, tmp_path):
    rows = [("s", 1, "a"), ("s", 2, "a"), ("s", 3, "b"), ("r", 1, "a")]
    got = drained(M.changed_recalls(source(spark, tmp_path, rows, "session_id string, t long, ids string")), tmp_path, "append").collect()
    assert sorted((r.session_id, r.t) for r in got) == [("r", 1), ("s", 1), ("s", 3)]


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = drained(M.windowed_counts(stream), tmp_path, "complete")
    assert got.groupBy().sum("n").first()[0] == events.count()


def test_sink_sees_every_row(spark, tmp_path):
    seen = []
    stream = source(spark, tmp_path, [(k,) for k in range(7)], "k long")
    q = M.turn_sink(stream, lambda batch, i: seen.append(batch.count()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 7


@pytest.mark.parametrize("n", [20, 21])
def test_flush(spark, n):
    assert M.flushed(spark.createDataFrame([(n,)], "n int")).count() == (n == 20)
