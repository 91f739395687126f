"""Exact top-k by inner product: dual-tree search over cover trees.

Candidates and queries are dealt to cells around pivots and cut into blocks of bounded size;
a cover tree is built once for every block and stored: a node's children cover its points
within a fixed share of its radius.  A pair of nodes is pruned when the largest inner product
that their centres and covering radii allow is below the worst kth score in the query node's
group.  A bounded pilot sample gives every query a lower bound of its kth score to begin
with, by which pairs of cells are pruned too, before any block moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import blobs, dropped, finished, finite, map_arrow, matrices, written
from vellum.shipping import ship

BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 24
#: Query blocks that one task holds beside a block of candidates.
TOGETHER = 8
PILOT, PIVOTS = 1024, 512
#: Children cover a node's points within this share of its radius.
SHRINK = 0.7
#: Products of larger components can't be held in a long.
LIMIT = 2.0**62


@dataclass
class CoverTree:
    """Nodes in arrays; a leaf's points are order[first:last]; children are child[begin:end]."""

    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """Top down: farthest points become centres until all points are covered.

    Where covering takes a centre for every few points, as in many dimensions, the node
    becomes a leaf-level fan: one leaf for each centre.
    """
    nodes: list[list] = []
    order: list[np.ndarray] = []
    placed = 0
    todo = [(np.arange(len(points)), 0, -1)]  # members, centre, parent
    children: list[list[int]] = []
    while todo:
        own, centre, parent = todo.pop()
        apart = np.sqrt(((points[own] - points[centre]) ** 2).sum(axis=1))
        radius = float(apart.max()) if len(own) else 0.0
        at = len(nodes)
        nodes.append([centre, radius, 0, 0])
        children.append([])
        if parent >= 0:
            children[parent].append(at)
        if len(own) <= leaf or radius == 0:
            nodes[at][2:] = [placed, placed + len(own)]
            order.append(own)
            placed += len(own)
            continue
        nearest, group, centres = apart, np.zeros(len(own), np.intp), [centre]
        while len(centres) < max(4, len(own) // (leaf // 2)):
            far = int(nearest.argmax())
            if nearest[far] <= SHRINK * radius:
                break
            d = np.sqrt(((points[own] - points[own[far]]) ** 2).sum(axis=1))
            closer = d < nearest
            nearest, group = np.where(closer, d, nearest), np.where(closer, len(centres), group)
            centres.append(int(own[far]))
        for k, c in enumerate(centres):
            members = own[group == k]
            if len(centres) == 1 or len(members) == len(own):
                # Nothing separates them: cut the list, so that the tree stays finite.
                for half in np.array_split(members[np.argsort(apart[group == k], kind="stable")], 2):
                    todo.append((half, int(half[0]), at))
            elif len(members):
                todo.append((members, c, at))
    flat = [c for own in children for c in own]
    ends = np.cumsum([len(c) for c in children])
    get = lambda k: np.array([n[k] for n in nodes])
    return CoverTree(points, get(0), get(1), ends - [len(c) for c in children], ends, np.array(flat, dtype=np.intp), get(2), get(3), np.concatenate(order) if order else np.zeros(0, np.intp))


def packed(tree: CoverTree) -> bytes:
    """The tree without its points, for storage."""
    import pickle

    return pickle.dumps([tree.centre, tree.radius, tree.begin, tree.end, tree.child, tree.first, tree.last, tree.order], protocol=5)


def unpacked(blob: bytes, points: np.ndarray) -> CoverTree:
    import pickle

    return CoverTree(points, *pickle.loads(blob))


@dataclass
class Block:
    """Distinct vectors of one block, their tree, and the ids that stand on them.

    ids: of every vector its ids in order, ``upto`` their ends; most: vectors that one id has, at most.
    """

    vectors: np.ndarray
    tree: CoverTree
    ids: np.ndarray
    upto: np.ndarray
    most: int

    def own(self, k: int) -> np.ndarray:
        return self.ids[self.upto[k - 1] if k else 0 : self.upto[k]]


def block_of(vec_ids: np.ndarray, rows: list[bytes], least: int | None = None) -> Block:
    """least: so many of the smallest ids stay on a vector (None: all)."""
    frame = pd.DataFrame({"id": vec_ids, "v": rows}).drop_duplicates().sort_values("id", kind="stable")
    most = int(frame["id"].value_counts().max())
    groups = list(frame.groupby("v", sort=False)["id"])
    kept = [g.to_numpy()[:least] for _, g in groups]
    vectors = matrix([v for v, _ in groups])
    return Block(vectors, cover_tree(vectors.astype(np.float64)), np.concatenate(kept), np.cumsum([len(g) for g in kept]), most)


def dual_search(queries: Block, floor: np.ndarray, refs: Block, k: int) -> list[tuple[int, int, int]]:
    """(query id, vec id, score) of the k best ids of each query vector, ties to the smaller id.

    floor: a lower bound of each query vector's kth score; scores below it are left out.
    An id's score is the largest of its vectors'.  Scores are exact integers.
    """
    q_int, r_int, qt, rt = queries.vectors, refs.vectors, queries.tree, refs.tree
    largest = float(max(np.abs(q_int).max(initial=0), np.abs(r_int).max(initial=0)))
    exact = largest * largest * max(1, q_int.shape[1]) < 2.0**52
    fq, fr = q_int.astype(np.float64), r_int.astype(np.float64)
    qnorm, rnorm = (np.sqrt((x[t.centre] ** 2).sum(axis=1)) for x, t in ((fq, qt), (fr, rt)))
    # Every id that stands on a query vector looks for k others: k + 1 serve them all.
    own_ids = [queries.own(i) for i in range(len(q_int))]
    wanted = k + 1
    best: list[dict[int, int]] = [{} for _ in q_int]
    kth = floor.astype(np.float64).copy()

    def bounds(qn: np.ndarray, rn: np.ndarray) -> np.ndarray:
        """Upper bounds of all pairs; the slack covers rounding."""
        b = fq[qt.centre[qn]] @ fr[rt.centre[rn]].T
        far_q, far_r = qnorm[qn] + qt.radius[qn], rnorm[rn] + rt.radius[rn]
        b += qt.radius[qn][:, None] * rnorm[rn] + qnorm[qn][:, None] * rt.radius[rn] + qt.radius[qn][:, None] * rt.radius[rn]
        return b + 1e-12 * far_q[:, None] * far_r + 0.5

    def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if exact:
            return np.rint(fq[q] @ fr[rows].T).astype(np.int64)
        return q_int[q].astype(object) @ r_int[rows].astype(object).T

    def base(q: np.ndarray, leaves: np.ndarray, upper: np.ndarray) -> None:
        """Score the leaves for the queries of one query leaf, most promising first."""
        turn = np.argsort(-upper, kind="stable")
        at = 0
        while at < len(turn) and upper[turn[at]] >= kth[q].min():
            upto, many = at, 0
            while upto < len(turn) and many < 256:
                many += rt.last[leaves[turn[upto]]] - rt.first[leaves[turn[upto]]]
                upto += 1
            rows = np.concatenate([rt.order[rt.first[n] : rt.last[n]] for n in leaves[turn[at:upto]]])
            scores = products(q, rows)
            for i, one in zip(q, scores, strict=True):
                good = np.flatnonzero(one >= kth[i])
                need = wanted * refs.most  # vectors that hold so many different ids
                if exact and len(good) > 4 * need:  # all that tie with the last one stay
                    cut = np.partition(one[good], len(good) - need - 1)[len(good) - need - 1]
                    good = good[one[good] >= cut]
                found = best[i]
                for g in good:
                    s = int(one[g])
                    for v in refs.own(int(rows[g])).tolist():
                        if s > found.get(v, s - 1):
                            found[v] = s
                if len(found) > wanted:
                    first = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:wanted]
                    best[i] = dict(first)
                if len(best[i]) >= wanted:
                    kth[i] = max(kth[i], float(min(best[i].values())))
            at = upto

    stack = [(0, np.zeros(1, np.intp))] if len(q_int) and len(r_int) else []
    members = {}

    def queries_of(n: int) -> np.ndarray:
        if n not in members:
            own = qt.child[qt.begin[n] : qt.end[n]]
            members[n] = np.concatenate([queries_of(c) for c in own]) if len(own) else qt.order[qt.first[n] : qt.last[n]]
        return members[n]

    while stack:
        qn, rn = stack.pop()
        upper = bounds(np.array([qn]), rn)[0]
        keep = upper >= kth[queries_of(qn)].min()
        rn, upper = rn[keep], upper[keep]
        if not len(rn):
            continue
        inner = rt.end[rn] > rt.begin[rn]
        own = qt.child[qt.begin[qn] : qt.end[qn]]
        if inner.any() and (not len(own) or rt.radius[rn[inner]].max() >= qt.radius[qn]):
            grown = np.concatenate([rt.child[rt.begin[n] : rt.end[n]] for n in rn[inner]])
            stack.append((qn, np.concatenate([rn[~inner], grown])))
        elif len(own):
            stack += [(int(c), rn) for c in own]
        else:
            base(queries_of(qn), rn, upper)
    found = []
    for own, held in zip(own_ids, best, strict=True):
        order = sorted(held.items(), key=lambda x: (-x[1], x[0]))
        for query in own.tolist():
            found += [(query, v, s) for v, s in [x for x in order if x[0] != query][:k]]
    if any(not -(2**63) <= s < 2**63 for _, _, s in found):
        raise OverflowError("a score can't be held in a long: use a smaller scale")
    return found


def scaled(vectors: DataFrame, asks, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, asks, dim, v binary of 64-bit integers) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(2)):
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if np.abs(x).max() >= LIMIT:
                    raise OverflowError(f"a component of {np.abs(x).max()} after scaling: products can't be held in a long")
                at = pa.array(rows)
                dims = pa.array(np.full(len(rows), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), dims, blobs(x.astype("<i8"))], names=["vec_id", "asks", "dim", "v"])

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    asks = F.expr(asks) if isinstance(asks, str) else asks
    return map_arrow(source.select("vec_id", F.coalesce(asks, F.lit(False)).alias("asks"), "embedding"), run, "vec_id long, asks boolean, dim int, v binary")


def matrix(rows) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<i8") for b in rows])


def in_cells(data: DataFrame, pilot: dict, pivots: dict[int, int], k: int, floors: bool) -> DataFrame:
    """``data`` (vec_id, dim, v) with its cell, the pivot nearest of the first pivots[dim], its distance and, if asked, a lower bound of the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held = batch.column(2).to_pylist()
            cell, dist, floor = np.zeros(len(ids), np.int32), np.full(len(ids), np.inf), np.full(len(ids), -(2.0**126))
            for d in np.unique(dims):
                if d not in pilot:
                    continue
                own = np.flatnonzero(dims == d)
                sample_ids, sample = pilot[d]
                s = sample.astype(np.float64)
                first = s[: pivots[int(d)]]
                for begin in range(0, len(own), 512):
                    part = own[begin : begin + 512]
                    x = matrix([held[i] for i in part]).astype(np.float64)
                    cell[part] = ((first**2).sum(axis=1) - 2 * x @ first.T).argmin(axis=1)
                    dist[part] = np.sqrt(((x - first[cell[part]]) ** 2).sum(axis=1))
                    if floors and len(sample_ids) > k:
                        scores = x @ s.T
                        scores[ids[part][:, None] == sample_ids] = -np.inf
                        slack = 1e-12 * np.sqrt((x**2).sum(axis=1)) * np.sqrt((s**2).sum(axis=1).max()) + 0.5
                        floor[part] = np.partition(scores, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k] - slack
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist), pa.array(floor)], names=["vec_id", "dim", "v", "cell", "dist", "floor"])

    return map_arrow(data, run, "vec_id long, dim int, v binary, cell int, dist double, floor double")


def needed(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows (vec_id, dim, v) that queries need, a written table that they read): each row once, and of equal vectors those of k + 1 ids.

    Equal ones are told by digests of 128 bits: vectors move only where a row is repeated or a vector has more ids.
    """
    key = ["vec_id", "dim", "a", "b"]
    keyed = rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64("v", F.lit(1))})
    same = Window.partitionBy("dim", "a", "b").orderBy("vec_id")
    each = keyed.groupBy(*key).agg(F.count("*").alias("n")).withColumn("turn", F.row_number().over(same))
    extra = written(each.where((F.col("n") > 1) | (F.col("turn") > k + 1)), "extra")
    if extra.isEmpty():
        return rows, extra
    names = {x: f"__{x}" for x in key}
    other = extra.withColumnsRenamed(names)
    on = [keyed[x] == other[y] for x, y in names.items()]
    once = keyed.join(other.where(F.col("turn") <= k + 1), on, "left_semi").dropDuplicates(key)
    return keyed.join(other, on, "left_anti").union(once).select("vec_id", "dim", "v"), extra


def cut(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their part, cells): a cell's rows are cut by hash into parts of about ``size``.

    cells: (dim, cell, cuts, r, w), r the largest distance from the pivot, w the least floor; at most PIVOTS for each length.
    """
    cells = written(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("cuts"), F.max("dist").alias("r"), F.min("floor").alias("w")), "cells")
    return rows.join(F.broadcast(cells.select("dim", "cell", "cuts")), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("v", "vec_id"), F.col("cuts")).cast("int")), cells


def open_cells(queries: DataFrame, candidates: DataFrame, pilot: dict) -> DataFrame:
    """Pairs of cells (dim, qc, qcuts, rc, rcuts) in which a candidate may reach a query's kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for d, qc, rc, qr, rr, w in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5, 6, 7)), strict=True):
                if d not in pilot:
                    keep.append(True)
                    continue
                a, b = pilot[d][1][qc].astype(np.float64), pilot[d][1][rc].astype(np.float64)
                far_a, far_b = np.sqrt(a @ a), np.sqrt(b @ b)
                upper = a @ b + qr * far_b + rr * far_a + qr * rr
                keep.append(bool(upper + 1e-9 * (far_a + qr) * (far_b + rr) + 1 >= w))
            yield batch.select(["dim", "qc", "qcuts", "rc", "rcuts"]).filter(pa.array(keep, pa.bool_()))

    # Cells of one length meet: at most PIVOTS times PIVOTS rows, whatever the input.
    meet = queries.select("dim", F.col("cell").alias("qc"), F.col("cuts").alias("qcuts"), F.col("r").alias("qr"), "w").join(
        candidates.select("dim", F.col("cell").alias("rc"), F.col("cuts").alias("rcuts"), F.col("r").alias("rr")), "dim"
    )
    return map_arrow(meet.select("dim", "qc", "qcuts", "rc", "rcuts", "qr", "rr", "w"), run, "dim int, qc int, qcuts int, rc int, rcuts int")


def trees(rows: DataFrame, k: int | None) -> DataFrame:
    """(dim, cell, part, block): each block's distinct vectors, ids, floors and cover tree, built once."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        block = block_of(frame["vec_id"].to_numpy(), list(frame["v"]), k)
        low = frame.groupby("v", sort=False)["floor"].min()
        floor = np.array([low[v.tobytes()] for v in block.vectors.astype("<i8")])
        # In the fewest bytes that hold all components.
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(block.vectors).max() <= np.iinfo(t).max)
        blob = pickle.dumps([block.vectors.shape, block.vectors.astype(kind), packed(block.tree), block.ids, block.upto, block.most, floor], protocol=5)
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "cell": frame["cell"].iloc[:1], "part": frame["part"].iloc[:1], "block": [blob]})

    ship(rows.sparkSession)
    return rows.select("dim", "cell", "part", "vec_id", "v", "floor").groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, block binary")


def read_block(blob: bytes) -> tuple[Block, np.ndarray]:
    import pickle

    shape, raw, tree, ids, upto, most, floor = pickle.loads(blob)
    vectors = raw.astype(np.int64).reshape(shape)
    return Block(vectors, unpacked(tree, vectors.astype(np.float64)), ids, upto, most), floor


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x).

    is_query: condition on vec_id.  Candidates are all rows but those of the query's own id;
    ties go to the smaller vec_id.  Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without an id; vectors meet only those of their own
    length.  Scores are exact; where one can't be held in a long, or a scaled component is
    2 ** 62 or more, this raises OverflowError and drops nothing.  An id stands once in a
    query's list: repeated rows count once, and an id with several vectors, as a query or as a
    candidate, has the largest of their scores.  Queries without candidates and empty tables
    give no rows.  Other columns aren't used.
    """
    drawn = written(scaled(vectors, is_query, vec_id, embedding, scale), "vectors")
    pilot_rows = drawn.select("vec_id", "dim", "v").distinct().orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PILOT).collect()
    pilot = {}
    for r in pilot_rows:
        pilot.setdefault(r["dim"], {})[r["vec_id"]] = np.frombuffer(r["v"], "<i8")
    pilot = {d: (np.array(list(own)), np.stack(list(own.values()))) for d, own in pilot.items()}
    rows, asked = drawn.agg(F.count("*"), F.count_if("asks")).first()
    share = lambda n, each: {d: max(1, min(PIVOTS, n // each, len(own))) for d, (own, _) in pilot.items()}
    told, extra = needed(drawn.select("vec_id", "dim", "v"), k)
    candidates = written(in_cells(told, pilot, share(rows, BLOCK), k, False), "candidates")
    queries = written(in_cells(drawn.where("asks").select("vec_id", "dim", "v").distinct(), pilot, share(asked, QUERY_BLOCK), k, True), "queries")
    dropped(drawn, extra)
    r_parts, r_cells = cut(candidates, BLOCK)
    q_parts, q_cells = cut(queries, QUERY_BLOCK)
    r_trees, q_trees = written(trees(r_parts, k + 1), "trees"), written(trees(q_parts, None), "trees")
    open_ = open_cells(q_cells, r_cells, pilot)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A block of candidates meets TOGETHER query blocks of a cell at once.
    pairs = written(open_.withColumn("rp", upto("rcuts")).select("dim", "qc", "qcuts", "rc", "rp", F.explode(F.expr(f"sequence(0, int((qcuts - 1) / {TOGETHER}))")).alias("g")), "pairs")

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(q) and len(r):
            refs, _ = read_block(r["block"].iloc[0])
            for blob in q["block"]:
                block, floor = read_block(blob)
                found += dual_search(block, floor, refs, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    meet = ["dim", "qc", "g", "rc", "rp"]
    left = pairs.join(q_trees.select("dim", F.col("cell").alias("qc"), F.expr(f"int(part / {TOGETHER})").alias("g"), "block"), ["dim", "qc", "g"]).select(*meet, "block")
    right = pairs.join(r_trees.select("dim", F.col("cell").alias("rc"), F.col("part").alias("rp"), "block"), ["dim", "rc", "rp"]).select(*meet, "block")
    ship(vectors.sparkSession)
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    best = left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInPandas(search, "query_id long, vec_id long, score long")
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = each.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return finished(out, "top", candidates, queries, r_cells, q_cells, r_trees, q_trees, pairs)
