from pyspark.sql import functions as F

from vellum.streaming.progress import delivered, delivered_stream, latest_progress, task_states


def drain(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_latest_progress_stream(spark, tmp_path):
    rows = [("a", i, f"s{i}") for i in range(5)] + [("b", 9, "x")]
    spark.createDataFrame(rows, "task_id string, seq long, stage string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id string, seq long, stage string").parquet(str(tmp_path / "in"))
    got = drain(spark, latest_progress(stream), "latest", "complete").select("task_id", "latest.seq", "latest.stage")
    assert {tuple(r) for r in got.collect()} == {("a", 4, "s4"), ("b", 9, "x")}


def test_task_state_stream(spark, tmp_path):
    rows = [("a", 1, "start"), ("a", 2, "complete"), ("b", 1, "start"), ("b", 2, "fail"), ("b", 3, "retry")]
    spark.createDataFrame(rows, "task_id string, seq long, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id string, seq long, event string").parquet(str(tmp_path / "in"))
    got = drain(spark, task_states(stream), "states", "update").orderBy(F.desc("seq"))
    assert {(r.task_id, r.status, r.closed) for r in got.collect()} == {("a", "completed", True), ("b", "pending", False)}


def test_a_terminal_event_closes_the_subscription(spark, tmp_path):
    rows = [("a", 1, "processing"), ("a", 2, "completed"), ("a", 3, "processing"), ("b", 1, "processing"), ("b", 2, "processing")]
    later = [("a", 4, "completed"), ("b", 3, "failed"), ("b", 4, "completed")]
    schema = "task_id string, seq long, status string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)}
    assert {(r.task_id, r.seq) for r in delivered(spark.createDataFrame(rows + later, schema)).collect()} == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, delivered_stream(stream), "delivered", "append")
    assert {(r.task_id, r.seq) for r in got.collect()} == want
