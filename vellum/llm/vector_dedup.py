"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector to the signs of its products with random directions, joins them to
a key and orders all vectors by it.  Neighbours within a window are compared; verified links
of all passes are united into components.  Equal vectors are one class from the start.

What a pass moves is a key and the vector in bytes, one for each component, whose distance
from the vector is known: that tells nearly all pairs, and the few so near the threshold that
it doesn't are compared in double precision.

How far passes reach is measured: two vectors that share the bits which leave a window of rows
around one of them have met.  Where vectors are so dense that this isn't likely enough over all
passes, those that are still in different components are compared with one another, block by
block; the largest component's rows meet only those outside it.

Directly linked vectors are then counted within components: members so near to the
component's first vector that they must link with one another are counted by their number,
the others are compared with all members, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import blobs, components, dropped, finished, finite, joined_components, map_arrow, matrices, partitions_for, written
from vellum.shipping import ship

COSINE, WINDOW, BITS = 0.95, 64, 48
#: A pair at the threshold is missed by all passes at most so often; pairs nearer by far are not missed.
MISSED = 0.001
LEAST_PASSES = 12
#: Passes made for each that evenly spread rows need: runs are uneven, and every row short of passes is compared with all such rows.
SPARE = 1.3
ROWS_A_PARTITION, CHUNK, LEAST_CHUNK = 100_000, 1024, 64
#: More than the error of a cosine in double precision.
SLACK = 1e-9


def passes_for(rows: int, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """Passes until a pair at the threshold has likely stood within one window, in evenly spread rows.

    Two vectors come within a window if they share the leading bits that leave about a
    window of rows; each bit is shared with probability 1 - angle / pi.
    """
    shared = (1 - math.acos(cosine) / math.pi) ** max(0.0, math.log2(max(1, rows) / window))
    return max(LEAST_PASSES, math.ceil(math.log(missed) / math.log1p(-min(shared, 1 - 1e-9))))


def directions(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([97, dim, turn]).standard_normal((dim, BITS))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are brought to a largest component of 1 first, so that no square leaves the doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coarse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, error) of unit vectors: the bytes' direction is within ``error`` of the vector."""
    q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
    return q, np.sqrt(((unit(q.astype(np.float64)) - x) ** 2).sum(axis=1)) + SLACK


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the lowest one that links (i, j) reach."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (before == low).all():
            break
    return low


def run_bits(keys: np.ndarray, own: np.ndarray, window: int) -> np.ndarray:
    """How many leading bits leave at most ``window`` rows around each row; keys: sorted packed bits; own: the rows' pass.

    BITS + 1 where no number of bits does, and where rows beyond this part may belong to the run.
    """
    n = len(keys)
    shared = np.full(n + window, BITS, np.int64)  # at k: bits that row k - window shares with row k
    if n > window:
        bits = np.unpackbits(keys[:-window] ^ keys[window:], axis=1)[:, :BITS]
        same = np.where(bits.any(axis=1), bits.argmax(axis=1), BITS)
        shared[window:n] = np.where(own[:-window] == own[window:], same, -1)
    return np.lib.stride_tricks.sliding_window_view(shared, window + 1).max(axis=1) + 1


def window_pairs(x: np.ndarray, error: np.ndarray, own: np.ndarray, cosine: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, open) for rows in order, compared with those at most ``window`` on; own: the rows' pass.

    low: for each row the lowest one reached by links that are certain; open (n, 2): pairs that
    may link but needn't and that certain links don't join.  x: unit vectors, known but for ``error``.
    """
    n = len(x)
    linked, may = [], []
    for begin in range(0, n, 256):
        end, upto = min(n, begin + 256), min(n, begin + 256 + window)
        dot = x[begin:end] @ x[begin:upto].T
        i, j = np.nonzero(dot >= cosine - error[begin:end, None] - error[None, begin:upto] - SLACK)
        good = (j > i) & (j - i <= window)
        i, j = i[good], j[good]
        sure = dot[i, j] >= cosine + error[begin + i] + error[begin + j] + SLACK
        i, j = i + begin, j + begin
        same = own[i] == own[j]
        linked.append(np.stack([i[same & sure], j[same & sure]]))
        may.append(np.stack([i[same & ~sure], j[same & ~sure]]))
    i, j = np.concatenate(linked, axis=1) if linked else np.zeros((2, 0), np.intp)
    low = lowest(n, i, j)
    i, j = np.concatenate(may, axis=1) if may else np.zeros((2, 0), np.intp)
    apart = low[i] != low[j]
    return low, np.stack([i[apart], j[apart]], axis=1)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): v binary of doubles, null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.zeros(batch.num_rows, bool)
            for rows, x in matrices(batch.column(1)):
                told[rows] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), blobs(x + 0.0)], names=["vec_id", "v"])  # + 0.0: no negative zeros
            rest = np.flatnonzero(~told)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rest)), pa.nulls(len(rest), pa.binary())], names=["vec_id", "v"])

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    links = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    return map_arrow(source.select("vec_id", F.when(links, F.col("embedding")).alias("embedding")), run, "vec_id long, v binary")


def record(turn: int, bits: np.ndarray, ids: np.ndarray, error: np.ndarray, q: np.ndarray) -> list[bytes]:
    """What a pass moves, a row each, in the order of the bytes: pass, length, key, id, error, vector in bytes."""
    n = len(ids)
    head = np.empty((n, 6), np.uint8)
    head[:] = np.frombuffer(np.array([turn], ">u2").tobytes() + np.array([q.shape[1]], ">u4").tobytes(), np.uint8)
    made = np.concatenate([head, bits, ids.astype(">i8")[:, None].view(np.uint8), error.astype("<f4")[:, None].view(np.uint8), q.view(np.uint8)], axis=1)
    return [row.tobytes() for row in made]


KEY, ID, ERROR, VECTOR = 6, 6 + BITS // 8, 14 + BITS // 8, 18 + BITS // 8


def read_records(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """pass (and length), keys, ids, errors and unit vectors of records of one length."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    own = np.ascontiguousarray(raw[:, :2]).view(">u2")[:, 0].astype(np.int64)
    ids = np.ascontiguousarray(raw[:, ID:ERROR]).view(">i8")[:, 0].astype(np.int64)
    error = np.ascontiguousarray(raw[:, ERROR:VECTOR]).view("<f4")[:, 0].astype(np.float64)
    return own, raw[:, KEY:ID], ids, error, unit(np.ascontiguousarray(raw[:, VECTOR:]).view(np.int8).astype(np.float64))


def by_length(rows: list[bytes]) -> list[list[bytes]]:
    sizes: dict[int, list[bytes]] = {}
    for r in rows:
        sizes.setdefault(len(r), []).append(r)
    return list(sizes.values())


def windowed_links(classes: DataFrame, rows: int, cosine: float, window: int) -> tuple[DataFrame, DataFrame]:
    """For (id, v): (src, dst) of verified links that join all that windows of all passes link, and (id) of dense rows; both read written tables."""
    turns = math.ceil(SPARE * passes_for(rows, cosine, window))
    share = 1 - math.acos(cosine) / math.pi

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size in {len(b) for b in held}:
                at = np.flatnonzero([len(b) == size for b in held])
                x = unit(np.stack([np.frombuffer(held[i]) for i in at]))
                q, error = coarse(x)
                for turn in range(turns):
                    bits = np.packbits(x @ directions(x.shape[1], turn) > 0, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(record(turn, bits, ids[at], np.nextafter(error.astype(np.float32), np.float32(9)), q), pa.binary())], names=["row"])

    names = ["src", "dst", "sure", "edge", "row", "miss"]
    schema = "src long, dst long, sure boolean, edge long, row binary, miss double"

    def out(n, **given):
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in zip(names, types, strict=True)], names=names)

    def pairs(rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        for own in by_length(rows):
            turn, _, ids, error, x = read_records(own)
            low, may = window_pairs(x, error, turn, cosine, window)
            least = ids.copy()  # links go to the smallest id of all that are joined here
            np.minimum.at(least, low, ids)
            joined = np.flatnonzero(least[low] != ids)
            yield out(len(joined), src=ids[joined], dst=least[low[joined]], sure=[True] * len(joined))
            yield out(len(may), src=ids[may].min(axis=1), dst=ids[may].max(axis=1), sure=[False] * len(may))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within a sorted partition, and its first and last window for comparison with its neighbours."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept: list[bytes] = []
        every, head = [], 0
        for batch in batches:
            new = batch.column(0).to_pylist()
            for own in by_length(new):
                turn, keys, ids, _, _ = read_records(own)
                every.append((turn * 100_000 + len(own[0]), ids, keys.copy()))
            if head < window:
                k = min(window - head, len(new))
                yield out(k, edge=[part - 1] * k, row=new[:k])
                head += k
            kept += new
            yield from pairs(kept)
            kept = kept[-window:]
        yield out(len(kept), edge=[part] * len(kept), row=kept)
        if every:
            own, ids, keys = (np.concatenate(c) for c in zip(*every, strict=True))
            bits = run_bits(keys, own, window)
            # The logarithm of the chance that this pass misses a pair at the threshold.
            miss = np.log1p(-np.where(bits <= BITS, np.minimum(share**bits, 1 - 1e-9), 0.0))
            yield out(len(ids), src=ids, miss=miss)

    def seam(frame: pd.DataFrame) -> pd.DataFrame:
        made = [b.to_pandas() for b in pairs(sorted(frame["row"]))]
        return pd.concat(made)[["src", "dst", "sure"]].astype({"src": "int64", "dst": "int64", "sure": "bool"})

    partitions = partitions_for(classes.sparkSession, rows * turns, ROWS_A_PARTITION)
    ordered = map_arrow(classes.select("id", "v"), keyed, "row binary").repartitionByRange(partitions, "row").sortWithinPartitions("row")
    found = written(map_arrow(ordered, compared, schema), "windows")
    # A seam has two windows of rows at most, whatever the input.
    seams = found.where("edge is not null").groupBy("edge").applyInPandas(seam, "src long, dst long, sure boolean")
    told = written(found.where("dst is not null").select("src", "dst", "sure").union(seams).where("src <> dst"), "pairs")
    links = told.where("sure").select("src", "dst").union(verified(told.where("not sure").select("src", "dst").distinct(), classes, cosine))
    links._vellum_path = told._vellum_path
    dense = written(found.where("miss is not null").groupBy(F.col("src").alias("id")).agg(F.sum("miss").alias("miss")).where(F.col("miss") > math.log(MISSED)).select("id"), "dense")
    dropped(found)
    return links, dense


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(src, dst) of ``pairs`` whose vectors link in double precision."""
    both = pairs.join(classes.select(F.col("id").alias("src"), F.col("v").alias("x")), "src").join(classes.select(F.col("id").alias("dst"), F.col("v").alias("y")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = unit(np.frombuffer(x)[None]), unit(np.frombuffer(y)[None])
                keep.append(bool((x * y).sum() >= cosine))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("src", "dst", "x", "y"), run, "src long, dst long")


def dense_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(src, dst) of (id, v, c): links that join all that are linked directly and stand in different components c.

    A pair is missed by all passes only if neither of its vectors has a good chance of being met,
    so dense rows are compared with one another and not with the rest.  Rows are dealt to
    slots of CHUNK: the largest component's (side 0 of blocks with low < 0) meet those outside
    it, which also meet one another.  With m rows there and o others that is (m + o) * o
    comparisons: a group of near copies costs what stands outside it, and only vectors that
    are alike, below the threshold and linked with little else cost a square.
    """
    rows = written(rows.select("id", "v", "c"), "dense")
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    total, (main, m) = rows.count(), next(((r["c"], r["n"]) for r in sizes.orderBy(F.desc("n"), "c").limit(1).collect()), (-1, 0))
    inner, outer = (max(1, math.ceil(n / CHUNK)) for n in (m, total - m))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    inside = rows.where((F.col("c") == main) & F.lit(total > m)).select((-1 - slot(inner)).alias("low"), upto(outer).alias("high"), "id", "v", "c", F.lit(False).alias("side"))
    others = rows.where(F.col("c") != main)
    facing = others.select("id", "v", "c", upto(inner).alias("slot")).select((-1 - F.col("slot")).alias("low"), slot(outer).alias("high"), "id", "v", "c", F.lit(True).alias("side"))
    paired = others.select("id", "v", "c", slot(outer).alias("slot"), upto(outer).alias("other"))
    paired = paired.select(F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), "id", "v", "c", (F.col("slot") > F.col("other")).alias("side"))

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        within = frame["low"].iloc[0] == frame["high"].iloc[0]
        for _, own in frame.groupby(frame["v"].str.len()):
            ids, side, c = own["id"].to_numpy(), own["side"].to_numpy(bool), own["c"].to_numpy()
            x = unit(np.stack([np.frombuffer(b) for b in own["v"]]))
            a, b = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(side == k) for k in (False, True))
            i, j = np.nonzero((x[a] @ x[b].T >= cosine) & (c[a][:, None] != c[b]))
            low = lowest(len(ids), a[i], b[j])
            joined = np.flatnonzero(low != np.arange(len(ids)))
            src += ids[joined].tolist()
            dst += ids[low[joined]].tolist()
        return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    found = written(inside.union(facing).union(paired).groupBy("low", "high").applyInPandas(linked, "src long, dst long"), "links")
    dropped(rows)
    return found


def direct_links(members: DataFrame, cosine: float) -> DataFrame:
    """(id, n) of (id, v, size, component): vectors within cosine of each, itself included, weighted by size."""
    half = math.acos(cosine) / 2 - 1e-6
    pivot = members.where("id = component").select("component", F.col("v").alias("p"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for v, p in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if len(v) != len(p):
                    core.append(False)
                    continue
                a, b = unit(np.frombuffer(v)[None]), unit(np.frombuffer(p)[None])
                core.append(math.acos(max(-1.0, min(1.0, float((a * b).sum())))) <= half)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(core, pa.bool_())], names=["id", "v", "size", "component", "core"])

    told = written(map_arrow(members.join(pivot, "component").select("id", "v", "size", "component", "p"), near, "id long, v binary, size long, component long, core boolean"), "members")
    # Small components in small chunks, so that their blocks spread; a chunk of n rows is copied n times less often.
    chunk = F.least(F.lit(float(CHUNK)), F.greatest(F.lit(float(min(CHUNK, LEAST_CHUNK))), F.sqrt(F.count("*")) * 2))
    shape = told.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("size")).otherwise(0)).alias("core_size"),
        F.ceil(F.count("*") / chunk).cast("int").alias("chunks"),
        F.ceil(F.count_if(~F.col("core")) / chunk).cast("int").alias("shells"),
    )
    full = told.join(shape, "component")
    inside = full.where("core").select("id", F.col("core_size").alias("n"))
    open_ = full.where("shells > 0")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["component", "a", "s", "id", "v", "size", "core"]
    every = open_.withColumn("a", slot("chunks")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shells") - 1))).select(*columns, F.lit(False).alias("asks"))
    shell = open_.where("not core").withColumn("s", slot("shells")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*columns, F.lit(True).alias("asks"))

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [], []
        asks, rest = frame[frame["asks"]], frame[~frame["asks"]]
        if len(asks) and len(rest):
            for size in set(asks["v"].str.len()):
                x, y = asks[asks["v"].str.len() == size], rest[rest["v"].str.len() == size]
                if not len(y):
                    continue
                linked = unit(np.stack([np.frombuffer(b) for b in x["v"]])) @ unit(np.stack([np.frombuffer(b) for b in y["v"]])).T >= cosine
                linked |= x["id"].to_numpy()[:, None] == y["id"].to_numpy()
                ids += x["id"].tolist()
                counts += (linked * y["size"].to_numpy()).sum(axis=1).tolist()
                core = y["core"].to_numpy()
                ids += y["id"][core].tolist()
                counts += (linked[:, core] * x["size"].to_numpy()[:, None]).sum(axis=0).tolist()
        return pd.DataFrame({"id": ids, "n": counts}, dtype="int64")

    ship(members.sparkSession)
    blocks = every.union(shell).groupBy("component", "a", "s").applyInPandas(counted, "id long, n long")
    return finished(inside.union(blocks).groupBy("id").agg(F.sum("n").alias("n")), "counts", told)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of at least ``cosine`` in double precision, ties included.  Those
    that are null, empty, zero or hold null or non-finite components link with nothing.
    Every row is a vector of its own: repeated rows link with one another and are counted in
    n_links, and rows that share a vec_id but not a vector are told apart.  component_id is
    the smallest vec_id reachable, and kept marks it.  A row without an id takes no part: its
    component_id is null and kept false.  Vectors meet only those of their own length.  An
    empty table gives no rows.  Other columns aren't used.
    """
    data = written(usable(vectors, vec_id, embedding).withColumns({"a": F.xxhash64("v"), "b": F.xxhash64("v", F.lit(1))}), "vectors")
    # A class of equal vectors is named by a number that is given when the table is written.
    one = data.where("v is not null and vec_id is not null").groupBy("a", "b").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), F.count("*").alias("size"))
    classes = written(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    links, dense = windowed_links(classes, classes.count(), cosine, window)
    label = components(links)
    if not dense.isEmpty():
        told = classes.join(dense, "id", "left_semi").join(label, "id", "left").select("id", "v", F.coalesce("component", "id").alias("c"))
        more = dense_links(told, cosine)
        label = joined_components(label, more)
        dropped(more)
    members = written(classes.join(label, "id").select("id", "v", "size", "component", "least"), "members")
    direct = direct_links(members, cosine)
    # Written first: a large component's rows then join it under skew handling.
    least = written(members.groupBy("component").agg(F.min("least").alias("first")), "least")
    linked = members.select("id", "component").join(least, "component").join(direct, "id").select("id", "first", "n")
    named = classes.select("a", "b", "id", "least", "size").join(linked, "id", "left").select(
        F.col("a"), F.col("b"), F.coalesce("first", "least").alias("first"), (F.coalesce("n", "size") - 1).alias("n")
    )
    # Rows that take no part are dealt by their ids: null keys would all meet in one task.
    real = F.expr("v is not null and vec_id is not null")
    told = data.select("vec_id", F.when(real, F.col("a")).otherwise(F.xxhash64("vec_id")).alias("a"), "b", real.alias("real"))
    out = told.join(named, ["a", "b"], "left").select(
        "vec_id",
        F.when(F.col("real"), F.col("n")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("real"), F.col("first")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return finished(out, "links", data, classes, links, dense, label, members, direct, least)
