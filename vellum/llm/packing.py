"""Best-fit packing of token sequences by exact complements.

Only counts of lengths are planned on the driver: at most ``size`` of them.  Lengths that
fill a sequence alone, in pairs and in triples are looked up by their complement and used
up under their counts; best fit, longest first, places the rest.  The plan says for each
length which ranks go where, so every piece finds its place by its rank among the pieces
of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import BYTES_AT_ONCE, ROWS_AT_ONCE, encoder
from vellum.llm.shared import map_arrow, map_pandas, parts, written

SIZE = 2048
ROWS_A_RANK_GROUP = 500_000


@dataclass
class Plan:
    """runs: (length, times in a sequence, sequences, first sequence, offset in each)."""

    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def complements(left: dict[int, int], size: int, order: str) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) of exactly full sequences of one, two or three pieces; ``left`` loses them."""
    full: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(left.get(x, 0) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= k * n
            full.append((lengths, n))

    use((size,))
    for step in order:
        if step == "2":
            for a in range(size - 1, (size - 1) // 2, -1):
                if left.get(a):
                    use((a, size - a))
        else:
            for a in range(size - 2, (size + 2) // 3 - 1, -1):
                for b in range(min(a, size - a - 1), (size - a - 1) // 2, -1):
                    if not left.get(a):
                        break
                    if left.get(b) and left.get(size - a - b):
                        use((a, b, size - a - b))
    return full


def best_fit(left: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, times), ...], sequences), longest first into the fullest sequence with room.

    Equal sequences stay together, so the work goes with the number of lengths.
    """
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, held: list[tuple[int, int]], n: int) -> None:
        if not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append((held, n))

    def fill(room: int, held: list[tuple[int, int]], n: int, length: int, count: int) -> int:
        """Place up to ``count`` pieces into n equal sequences; returns how many were placed."""
        times = room // length
        whole = min(n, count // times)
        rest = count - whole * times if whole < n else 0
        if whole:
            put(room - times * length, [*held, (length, times)], whole)
        if rest:
            put(room - rest * length, [*held, (length, rest)], 1)
        if n - whole - bool(rest):
            put(room, held, n - whole - bool(rest))
        return whole * times + rest

    for length in sorted((x for x, n in left.items() if n), reverse=True):
        count = left[length]
        while count:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                count -= fill(size, [], -(-count // (size // length)), length, count)
                continue
            room = rooms[i]
            held, n = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            count -= fill(room, held, n, length, count)
    return [group for room in rooms for group in groups[room]]


def plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """The fewest sequences among the orders in which complements can be used up."""
    best: Plan | None = None
    for order in ("23", "32", "2", "3", ""):
        left = dict(counts)
        made = [([(x, 1) for x in lengths], n) for lengths, n in complements(left, size, order)]
        made += best_fit(left, size)
        found = Plan()
        for held, n in made:
            at = 0
            for length, times in held:
                found.runs.append((length, times, n, found.sequences, at))
                at += length * times
            found.sequences += n
        if best is None or found.sequences < best.sequences:
            best = found
    return best


def pieces(docs: DataFrame, path: str, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", ids: bool = True, kept_words: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids (binary) of each document's pieces.

    kept_words: words that a worker remembers (None: bpe.KEPT_WORDS); fewer take less memory and more time.

    A document's ids are closed by id 0; only longer ones are cut, every ``size`` ids.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, kept_words)
        for whole in batches:
            for batch in parts(whole, 1, ROWS_AT_ONCE, BYTES_AT_ONCE if kept_words is None else min(BYTES_AT_ONCE, 16 * kept_words)):
                row, piece, length, crc, held = [], [], [], [], []
                for i, coded in enumerate(bpe.encode(batch.column(1).to_pylist())):
                    coded += b"\0\0\0\0"
                    for k in range(0, len(coded), 4 * size):
                        part = coded[k : k + 4 * size]
                        row.append(i)
                        piece.append(k // (4 * size))
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            held.append(part)
                at = pa.array(piece, pa.int32())
                columns = [batch.column(0).take(pa.array(row, pa.int64())), at, pa.array([size * k for k in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * ids, names=names)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(source, run, schema, holds="bpe")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to ``pieces``, whose column length is 1 to ``size``.

    Every row gets a place, repeated rows one each; no rows, no sequences.  ``pieces``
    should be stored, as it is read twice; a column ``__row`` that tells all rows apart deals
    and orders repeated rows and those without an id too, and is dropped.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, size)
    runs = sorted(made.runs)
    length = np.array([r[0] for r in runs], dtype=np.int64)
    times, many, first, offset = (np.array([r[k] for r in runs], dtype=np.int64) for k in range(1, 5))
    rank_at = np.zeros(len(runs), dtype=np.int64)
    for k in range(1, len(runs)):
        if runs[k][0] == runs[k - 1][0]:
            rank_at[k] = rank_at[k - 1] + runs[k - 1][1] * runs[k - 1][2]
    key = (length << 48) + rank_at

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            run = np.searchsorted(key, (frame["length"].to_numpy() << 48) + frame["rank"].to_numpy(), side="right") - 1
            i = frame["rank"].to_numpy() - rank_at[run]
            frame["sequence_id"] = first[run] + i // times[run]
            frame["offset"] = offset[run] + i % times[run] * frame["length"].to_numpy()
            yield frame.drop(columns="rank")

    # A length that a third of all rows share is ranked in groups of about ROWS_A_RANK_GROUP rows.
    groups = max(64, sum(counts.values()) // ROWS_A_RANK_GROUP)
    own = ["__row"] if "__row" in pieces.columns else ["doc_id", "start"]
    kept = [c for c in pieces.columns if c != "__row"]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*own), F.lit(groups)))
    sizes = dealt.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = sizes.select("length", "__group", (F.sum("__n").over(Window.partitionBy("length").orderBy("__group")) - F.col("__n")).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__group").orderBy(*own)))
    ranked = ranked.join(before, ["length", "__group"]).select(*kept, (F.col("__before") + F.col("__rank") - 1).alias("rank"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept) + ", sequence_id long, offset long"
    return map_pandas(ranked, place, out)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, kept_words: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``.

    Null and empty texts are documents of the single id 0; texts of any length are encoded
    whole.  An empty table gives no rows.  Other columns are not used.
    """
    made = pieces(docs, path, size, ids=False, kept_words=kept_words).withColumn("__row", F.monotonically_increasing_id())
    return pack(written(made, "pieces"), size)
