"""Task store, profiles and benchmark figures as DataFrame queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 100
ACTIVE = ("pending", "processing")


def tasks_with_counts(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks with ``result_count``, 0 where there is none; results are counted before they are joined."""
    counts = results.groupBy("task_id").agg(F.count("*").alias("result_count"))
    return tasks.join(counts, "task_id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))


def count_tasks(tasks: DataFrame, status: str | None = None) -> DataFrame:
    kept = tasks if status is None else tasks.where(F.col("status") == status)
    return kept.agg(F.count("*").alias("total"))


def list_tasks(tasks: DataFrame, status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of tasks, newest first, ties by task_id; page from 1, page size from 1 to 100."""
    page, page_size = max(1, page), max(1, min(MAX_PAGE_SIZE, page_size))
    kept = tasks if status is None else tasks.where(F.col("status") == status)
    return kept.orderBy(F.desc("created_at"), "task_id").offset((page - 1) * page_size).limit(page_size)


def sort_for_sidebar(tasks: DataFrame) -> DataFrame:
    """Active tasks first, then the newest."""
    return tasks.orderBy(F.desc(F.col("status").isin(*ACTIVE)), F.desc("created_at"), "task_id")


def task_results(results: DataFrame, task_id: str) -> DataFrame:
    return results.where(F.col("task_id") == task_id).orderBy("id")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changes`` in place of rows of the same key, and the new ones."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_cascade(tasks: DataFrame, results: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("task_id").distinct()
    return tasks.join(ids, "task_id", "left_anti"), results.join(ids, "task_id", "left_anti")


def recover_interrupted(tasks: DataFrame, message: str = "服务重启，任务中断") -> DataFrame:
    """Pending and processing tasks become failed."""
    cut = F.col("status").isin(*ACTIVE)
    return tasks.withColumns({"error": F.when(cut, F.lit(message)).otherwise(F.col("error")), "status": F.when(cut, F.lit("failed")).otherwise(F.col("status"))})


def edit_result(results: DataFrame, tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Markdown of results overwritten by (task_id, result_index, markdown), of completed tasks and known indexes only."""
    allowed = edits.join(tasks.where(F.col("status") == "completed").select("task_id"), "task_id", "left_semi").withColumnRenamed("markdown", "__new")
    return results.join(allowed, ["task_id", "result_index"], "left").withColumn("markdown", F.coalesce("__new", "markdown")).drop("__new")


def profile_summary(events: DataFrame) -> DataFrame:
    """(name, n, total_s, mean_s, share, min_depth) by stage; share of the first pipeline.total event, or else the first."""
    anchor = events.agg(F.min_by("duration_s", F.struct((F.col("name") != "pipeline.total").cast("int").alias("other"), "seq")).alias("anchor"))
    stages = events.groupBy("name").agg(F.count("*").alias("n"), F.sum("duration_s").alias("total_s"), F.min("depth").alias("min_depth"))
    # One row stands against one row for each stage name.
    share = F.when(F.col("anchor") > 0, F.col("total_s") / F.col("anchor") * 100).otherwise(0.0)
    return stages.join(F.broadcast(anchor), F.lit(True)).select("name", "n", "total_s", (F.col("total_s") / F.col("n")).alias("mean_s"), share.alias("share"), "min_depth")


def top_stages(summary: DataFrame, n: int = 8) -> DataFrame:
    return summary.orderBy(F.desc("total_s"), "name").limit(n)


def trace_stats(rows: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, maximum and p95 = sorted[max(0, int(0.95 n) - 1)]; what isn't a number is left out.

    Values are counted first, so only distinct values and their counts are sorted.
    """
    from pyspark.sql import Window

    numbers = rows.select(*keys, F.expr(f"try_cast({value} as double)").alias("v")).where("v is not null")
    counted = numbers.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("v")
    total = Window.partitionBy(*keys)
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(total))
    place = F.greatest(F.lit(1), F.floor(F.col("all") * 0.95))
    return ranked.groupBy(*keys).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"), F.min(F.when(F.col("upto") >= place, F.col("v"))).alias("p95"))


def throughput(runs: DataFrame, n_images: Column) -> DataFrame:
    return runs.groupBy("config").agg((F.first(n_images) / F.avg("seconds")).alias("images_per_s"))


def speedup(serial: Column, parallel: Column) -> Column:
    return serial / F.nullif(parallel, F.lit(0.0))


def find_prefix(columns: list[str], prefix: str) -> str | None:
    return next((c for c in columns if c.strip().startswith(prefix)), None)


def latest_status(events: DataFrame) -> DataFrame:
    """(task_id, status, error): state after all events (task_id, seq, event), as the task machine has it.

    Completed and failed are ends, but a failed task can be retried; a cancel fails an active one.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event")))

    def step(s: Column, e: Column) -> Column:
        return (
            F.when((s == "pending") & (e["event"] == "start"), "processing")
            .when((s == "processing") & (e["event"] == "complete"), "completed")
            .when((s == "processing") & (e["event"] == "fail"), "failed")
            .when(s.isin(*ACTIVE) & e["event"].isin("cancel", "restart"), "failed")
            .when((s == "failed") & (e["event"] == "retry"), "pending")
            .otherwise(s)
        )

    return events.groupBy("task_id").agg(F.aggregate(ordered, F.lit("pending"), step).alias("status"))


def judged_uploads(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """``files`` (session_id, name, size) with ``verdict``: accepted, or why not.

    A session must be known and open, a name must end in a known suffix, and a file may have MAX_UPLOAD bytes.
    """
    from vellum.sources.files import LISTED_SUFFIXES, MAX_UPLOAD, has_suffix

    told = files.join(sessions.select("session_id", F.col("completed").alias("__done")), "session_id", "left")
    verdict = (
        F.when(F.col("__done").isNull(), "no such session").when(F.col("__done"), "session is complete")
        .when(~has_suffix(F.col("name"), LISTED_SUFFIXES), "unknown kind").when(F.col("size") > MAX_UPLOAD, "too large").otherwise("accepted")
    )
    return told.withColumn("verdict", verdict).drop("__done")


def judged_completions(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """``requests`` (session_id, seq) to complete a session with ``verdict``: once, and only with files."""
    from pyspark.sql import Window

    counts = uploads.where("verdict = 'accepted'").groupBy("session_id").agg(F.count("*").alias("__files"))
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    told = requests.join(counts, "session_id", "left").withColumn("__turn", turn)
    verdict = F.when(F.col("__files").isNull(), "no files").when(F.col("__turn") > 1, "already complete").otherwise("complete")
    return told.withColumn("verdict", verdict).drop("__files", "__turn")


def uploads(files: DataFrame) -> DataFrame:
    """(session_id, n_files, n_bytes)."""
    return files.groupBy("session_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def live_sessions(sessions: DataFrame, now: str, ttl_seconds: int = 3600) -> DataFrame:
    """Sessions younger than their time to live, counted from creation to the microsecond; ``now`` is read as ``created_at`` is, with a time zone or without."""
    kind = "timestamp_ntz" if sessions.schema["created_at"].dataType.typeName() == "timestamp_ntz" else "timestamp"
    return sessions.where(F.col("created_at").cast(kind) > F.lit(now).cast(kind) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def progress_label(label: Column, index: Column, total: Column, message: Column) -> Column:
    return F.format_string("[%d/%d %s] %s", index, total, label, message)
