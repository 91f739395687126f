"""Helpers that the corpus operators share: shared-folder tables and components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.shipping import ship
from vellum.storage import written


#: In a Python worker: what it holds beyond one task, and how to let go of it.
_held: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    _held[name] = release


def let_go(keep: str = "") -> None:
    import gc

    import pyarrow as pa

    gone = [n for n in _held if n != keep]
    for name in gone:
        _held.pop(name)()
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Free memory of this worker goes back to the system; workers stay alive between tasks."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library, which has its own ways


def shrink_heaps(spark: SparkSession) -> None:
    """Every executor collects garbage and gives free heap back to the system.

    A heap that one stage has filled otherwise stays its size beside the Python workers of the next.
    """
    tasks = spark.sparkContext.defaultParallelism  # one for each core, so that each executor has some
    calls = spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    calls.write.format("noop").mode("overwrite").save()


def map_arrow(df: DataFrame, run, schema: str, holds: str = "") -> DataFrame:
    """``mapInArrow``; a worker that still holds the memory of another operator lets go of it first."""

    def alone(batches):
        let_go(holds)
        try:
            yield from run(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(alone, schema)


def map_pandas(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def group_pandas(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` over each group; callers see to it that groups are bounded."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, schema)


def parts(batch, column: int, rows: int, size: int = 4_000_000):
    """Slices of an Arrow batch, of at most ``rows`` rows and, past one row, ``size`` bytes of a text column."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= rows or total + n > size):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)


def finite(vector):
    """Whether an array column of doubles is a vector: not empty, and all of its components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrices(column):
    """(rows, matrix) for every length of vector in an Arrow list column of doubles, nulls and empty lists left out."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.asarray(column.offsets)[:-1]
    values = column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if n:
            yield rows, values[starts[rows][:, None] + np.arange(n)]


def blobs(matrix):
    """An Arrow binary column with the bytes of each row."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(matrix)
    each = raw.shape[1] * raw.itemsize
    ends = np.arange(len(raw) + 1, dtype=np.int64) * each
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path, spark = df._vellum_path, df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def finished(result: DataFrame, name: str, *tables: DataFrame) -> DataFrame:
    """``result`` written as its own table, after which the ``tables`` that it was made from are deleted."""
    out = written(result, name)
    dropped(*tables)
    return out


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions of about ``each`` rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


#: Nodes with more than this share of all edges (and so fewer than 1 / HOT of them) don't go through a shuffle by their number.
HOT, HOT_LEAST = 0.01, 100


def _told(edge: DataFrame):
    """What tells one state of the edges from another, and the nodes that may be hot at either end."""
    top = lambda c: F.expr(f"approx_top_k({c}, {int(1 / HOT)}, 4096)").alias(f"top_{c}")
    return edge.agg(
        F.count("*").alias("n"),
        F.sum(F.col("u").cast("decimal(38,0)")).alias("a"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
        top("u"), top("v"),
    ).first()


def _looked_up(rows: DataFrame, end: str, low: DataFrame, state, hot_rows: DataFrame) -> DataFrame:
    """``rows`` (u, v) with m, the least of ``low`` (at, m) at their ``end`` or null.

    Hot nodes, 1 / HOT of them at most, are looked up in a list, made from ``hot_rows`` (at, m); their rows stay where they are.
    """
    hot = [r["item"] for r in state[f"top_{end}"] if r["count"] > max(HOT_LEAST, HOT * state["n"])]
    if not hot:
        return rows.join(low, rows[end] == low["at"], "left").select("u", "v", "m")
    least = dict(map(tuple, hot_rows.where(F.col("at").isin(hot)).groupBy("at").agg(F.min("m")).collect()))
    known = F.broadcast(rows.sparkSession.createDataFrame([(x, least.get(x)) for x in hot], "hot long, hot_m long"))
    other = "v" if end == "u" else "u"
    told = rows.join(known, rows[end] == known["hot"], "left").withColumn("key", F.when(F.col("hot").isNotNull(), F.xxhash64(other)).otherwise(F.col(end)))
    return told.join(low, told["key"] == low["at"], "left").select("u", "v", F.when(F.col("hot").isNotNull(), F.col("hot_m")).otherwise(F.col("m")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src long, dst long).

    Alternating large-star and small-star steps; each star is a grouped minimum
    joined back to its edges, so no neighbour list is ever gathered, and hot nodes, as a
    root at which all of its component's edges come to end, are looked up without a shuffle.  Returns
    (id, component) for every node that has an edge to another node, component
    being the smallest id reachable.  Nulls and self loops take no part.  The result
    reads a written table, which ``dropped`` deletes.
    """
    edge = written(
        edges.select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct(),
        "edges",
    )
    state = _told(edge)
    while state["n"]:
        ends = edge.select(F.col("u").alias("at"), F.col("v").alias("m"))
        large = _looked_up(edge, "v", ends.groupBy("at").agg(F.min("m").alias("m")), state, ends).select("u", F.coalesce("m", "v").alias("v"))
        ends = large.select(F.col("u").alias("at"), F.col("v").alias("m"))
        low = ends.groupBy("at").agg(F.min("m").alias("m"))
        small = _looked_up(large, "u", low, state, ends)
        step = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low.select(F.col("at").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        now = _told(step)
        dropped(edge)
        edge = step
        if (state["n"], state["a"], state["h"]) == (now["n"], now["a"], now["h"]):
            break
        state = now
    found = edge.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found._vellum_path = edge._vellum_path
    return found


def joined_components(label: DataFrame, more: DataFrame) -> DataFrame:
    """``label`` (id, component), which is written, with its components joined by the links ``more`` (src, dst).

    Only links between components go through the steps: each component is one node there.  Returns
    a written table with every node of ``label`` and every end of a link; component is the smallest id.
    """
    known = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"{side}_c"))
    ends = more.join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    lifted = written(ends.select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst")).where("src <> dst"), "links")
    if lifted.isEmpty():
        dropped(lifted)
        return label
    upper = components(lifted)
    old = label.select("id", "component").union(upper.select("id", F.col("id").alias("component"))).distinct()
    new = old.join(upper.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    return finished(new.groupBy("id").agg(F.min(F.coalesce("root", "component")).alias("component")), "components", lifted, upper, label)
