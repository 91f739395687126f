"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives a signature of POSITIONS minima of 16 bits.  Two
documents are candidates if at most DISTANCE positions differ (more for a similarity asked for
below SIMILARITY).  The positions are split into CHUNKS; by the pigeonhole principle two such
signatures differ in at most one position of some chunk, so every chunk is indexed once for
each position left out, and equal keys find all pairs under the distance.  Links are
confirmed on the full sets.

Equal sets form classes, whatever ids they stand under, and each class is compared once.
Within an index key documents are first compared with the key's most connected one, so a
large group of near copies costs about as many comparisons as it has documents.  Where that
leaves a key's documents in different components, signatures are compared across them in
blocks of bounded size, by a second and longer signature too; only pairs near by both are
put out and confirmed.  The documents of the key's largest component meet only those outside
it there, so that a few outliers beside a large group cost a few times the group's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import components, dropped, finished, joined_components, map_arrow, partitions_for, parts, written

WORDS = 5
SIMILARITY, LEAST = 85, 80  # per cent
POSITIONS, LONG = 64, 512
#: How often a pair at the similarity asked for differs in more positions than are allowed, at most: of the signature, of the longer one.
MISSED, LONG_MISSED = 1e-5, 2e-5


class Reach(NamedTuple):
    """What is looked for: chunks of the signature, and the differences allowed in it and in the longer one."""

    chunks: int
    distance: int
    long_distance: int


def allowed(positions: int, differs: float, missed: float) -> int:
    """The least d that Binomial(positions, differs) exceeds with a probability of at most ``missed``."""
    over, d = 1.0, -1
    while over > missed:
        d += 1
        over = sum(math.comb(positions, k) * differs**k * (1 - differs) ** (positions - k) for k in range(d + 1, positions + 1))
    return d


def reach(similarity: int) -> Reach:
    """The distances for a similarity; above SIMILARITY those of SIMILARITY.  Different minima of 8 bits are equal in one of 256 cases."""
    differs = 1 - min(similarity, SIMILARITY) / 100
    chunks = allowed(POSITIONS, differs, MISSED) // 2 + 1
    return Reach(chunks, 2 * chunks - 1, allowed(LONG, differs * 255 / 256, LONG_MISSED))


USUAL = reach(SIMILARITY)
CHUNKS, DISTANCE, LONG_DISTANCE = USUAL
BLOCK, ROWS_A_PARTITION = 512, 50_000
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
STEP = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
MASK = _rng.integers(0, 1 << 64, POSITIONS + LONG, dtype=np.uint64)
ODD = _rng.integers(0, 1 << 64, POSITIONS + LONG, dtype=np.uint64) | np.uint64(1)
PLACE = _rng.integers(0, 1 << 64, POSITIONS, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    Words are what stands between ASCII blanks, A-Z lower-cased.  A text of fewer words
    has its whole sequence as one shingle, one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    code = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[code]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # A word's hash is a polynomial in its bytes: a difference of running sums, moved to power 0.
    power = np.ones(len(code) + 1, np.uint64)
    inverse = np.ones(len(code) + 1, np.uint64)
    power[1:], inverse[1:] = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(BYTE[code] * power[:-1], out=total[1:])
    word = mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw]) + 1
    upto = np.searchsorted(start, ends, side="left")
    out, begin = [], 0
    for end in upto:
        n = end - begin
        if n >= words:
            w = word[begin:end]
            h = np.zeros(n - words + 1, np.uint64)
            for j in range(words):
                h += w[j : n - words + 1 + j] * STEP[j % WORDS] + np.uint64(j)
            out.append(np.unique(mixed(h)))
        elif n:
            h = np.array([n], np.uint64)
            for w in word[begin:end]:
                h = mixed(h * BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def minima(shingles: np.ndarray, mask: np.ndarray, odd: np.ndarray) -> np.ndarray:
    low = np.full(len(mask), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, ((shingles[at : at + 1024] ^ mask[:, None]) * odd[:, None]).min(axis=1))
    return mixed(low)


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minima, 16 bits of each."""
    return (minima(shingles, MASK[:POSITIONS], ODD[:POSITIONS]) & np.uint64(0xFFFF)).astype(np.uint16)


def long_signature(shingles: np.ndarray) -> np.ndarray:
    """LONG further minima, 8 bits of each."""
    return (minima(shingles, MASK[POSITIONS:], ODD[POSITIONS:]) & np.uint64(0xFF)).astype(np.uint8)


def index_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """(documents, POSITIONS) keys: key p is p's chunk without position p."""
    chunk_of = np.arange(POSITIONS) * chunks // POSITIONS
    each = mixed(signatures.astype(np.uint64) + PLACE)
    chunk = np.stack([each[:, chunk_of == c].sum(axis=1, dtype=np.uint64) for c in range(chunks)], axis=1)
    return mixed(chunk[:, chunk_of] - each + PLACE).view(np.int64)


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, text_a, text_b): the last two are a 128-bit digest of the text, which tells rows of one id apart."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).select("id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64("text", F.lit(1)).alias("text_b"))


def sketch(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """id, text_a, text_b, n_shingles, set_a, set_b (a 128-bit digest of the set) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 1, 1024, 1_000_000):
                sets = shingle_sets(batch.column(1).to_pylist(), words)
                sums = [(mixed(s).sum(dtype=np.uint64), mixed(s ^ BASE).sum(dtype=np.uint64)) for s in sets]
                digest = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k) for k in (0, 2, 3)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["id", "text_a", "text_b", "n_shingles", "set_a", "set_b", "sig"],
                )

    return map_arrow(identified(docs, doc_id, text), run, "id long, text_a long, text_b long, n_shingles long, set_a long, set_b long, sig binary")


def keyed(classes: DataFrame, far: Reach) -> DataFrame:
    """(id, key, place) rows of classes (cid, sig); id is the class's number from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = np.stack([np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()])
                ids = np.repeat(batch.column(0).to_numpy(), POSITIONS)
                place = np.tile(np.arange(POSITIONS, dtype=np.int8), len(sigs))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(index_keys(sigs, far.chunks).ravel()), pa.array(place)], names=["id", "key", "place"])

    return map_arrow(classes.select("cid", "sig"), run, "id long, key long, place byte")


def filter_bit(key: tuple[str, ...] = ("id", "text_a", "text_b")):
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def bit_field(rows: DataFrame) -> DataFrame:
    """(bucket, bits): the hashes of ``rows`` (id, text_a, text_b) as a field of FILTER_BITS bits, 8 MB at most whatever the input."""
    told = rows.select((filter_bit() + 1).alias("bit"))
    return told.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def row_filter(rows: DataFrame) -> np.ndarray:
    """``bit_field`` as an array."""
    field = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in bit_field(rows).toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        field[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return field


def marked(docs: DataFrame, rows: DataFrame, key: tuple[str, ...], name: str) -> DataFrame:
    """``docs`` with ``name``: whether a row's ``key`` may be among ``rows`` (id, text_a, text_b); without a shuffle, as a bit field has a bounded size."""
    field = F.broadcast(bit_field(rows).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    at = filter_bit(key) + 1
    told = docs.withColumns({"__bucket": F.bitmap_bucket_number(at), "__at": F.bitmap_bit_position(at)}).join(field, "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    test = told.withColumn("__byte", byte).withColumn(name, F.expr("coalesce(shiftright(__byte, cast(__at % 8 as int)) & 1, 0) = 1"))
    return test.drop("__bucket", "__at", "__bits", "__byte")


def sets_of(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(cid, shingles, long) of ``classes`` (cid, id, text_a, text_b); a bit field keeps other texts from moving."""
    field = docs.sparkSession.sparkContext.broadcast(row_filter(classes))
    chosen = identified(docs, doc_id, text).withColumn("bit", filter_bit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        for batch in batches:
            at = batch.column(4).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in parts(batch, 1, 1024, 1_000_000):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in (0, 2, 3)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([long_signature(s).tobytes() for s in sets], pa.binary())],
                    names=["id", "text_a", "text_b", "shingles", "long"],
                )

    found = map_arrow(chosen, run, "id long, text_a long, text_b long, shingles binary, long binary")
    return found.join(classes, ["id", "text_a", "text_b"]).select("cid", "shingles", "long").dropDuplicates(["cid"])


def near(pairs: DataFrame, classes: DataFrame, far: Reach) -> DataFrame:
    """Those (a, b) whose signatures differ in at most far.distance positions."""
    sig = classes.select(F.col("cid").alias("id"), "sig")
    both = pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, POSITIONS) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= far.distance))

    return map_arrow(both, run, "a long, b long")


def crossing(ids, component, sig, long, side, within: bool, place: int, far: Reach) -> np.ndarray:
    """Pairs (n, 2) of a block's rows: of different components, near by both signatures, with no earlier common key.

    within: pairs of all rows; else those of a row of side 0 and one of side 1.
    """
    rows, columns = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(side == k) for k in (0, 1))
    i, j = np.nonzero(component[rows][:, None] != component[columns][None, :])
    i, j = rows[i], columns[j]
    if within:
        i, j = i[i < j], j[i < j]
    near = np.concatenate([(sig[i[at : at + 65536]] != sig[j[at : at + 65536]]).sum(axis=1) <= far.distance for at in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[near], j[near]
    near = np.concatenate([(long[i[at : at + 8192]] != long[j[at : at + 8192]]).sum(axis=1) <= far.long_distance for at in range(0, len(i), 8192)] or [np.zeros(0, bool)])
    i, j = i[near], j[near]
    keys = index_keys(sig, far.chunks)
    first = ~(keys[i, :place] == keys[j, :place]).any(axis=1) if place else np.ones(len(i), bool)
    return np.stack([ids[i[first]], ids[j[first]]], axis=1)


def blocks(told: DataFrame) -> DataFrame:
    """(key, low, high, place, id, c, side) of ``told`` (key, place, id, c): the blocks in which rows of different components meet.

    A key's documents are its largest component's and the others, each dealt to slots of
    about BLOCK.  Others meet in pairs of slots (low <= high), and each of their slots meets
    those of the largest component (low < 0); rows of the largest component don't meet one
    another.  With m rows there and o others, that is about m * o / BLOCK rows, never m * m.
    Keys with one component give none.
    """
    slots = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = told.groupBy("key", "c").agg(F.count("*").alias("n"))
    key = sizes.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    key = key.select("key", "main", "kinds", slots(F.col("m")).alias("inner"), slots(F.col("n") - F.col("m")).alias("outer"))
    inside = F.col("c") == F.col("main")
    dealt = told.join(key, "key").withColumn("slot", F.pmod(F.xxhash64("id"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), side.cast("int").alias("side"))
    slot = F.col("slot")
    facing = F.transform(upto("inner"), lambda o: at(-1 - o, slot, F.lit(1)))
    paired = F.transform(upto("outer"), lambda o: at(F.least(slot, o), F.greatest(slot, o), slot > o))
    # Others that are all of one component have no pairs among themselves.
    meets = F.when(inside, F.transform(upto("outer"), lambda o: at(-1 - slot, o, F.lit(0)))).when(F.col("kinds") > 2, F.concat(facing, paired)).otherwise(facing)
    return dealt.select("key", "place", "id", "c", F.explode(meets).alias("block")).select("key", "block.low", "block.high", "place", "id", "c", "block.side")


def across(told: DataFrame, classes: DataFrame, sets: DataFrame, far: Reach) -> DataFrame:
    """(a, b): pairs of ``told`` (key, place, id, c) that share a key and stand in different components, near by both signatures.

    Blocks are sorted together and worked through one after another, so a task holds one
    block at a time however many documents share a key.
    """
    dealt = written(blocks(told), "blocks")
    both = (
        dealt.join(classes.select(F.col("cid").alias("id"), "sig"), "id").join(sets.select(F.col("cid").alias("id"), "long"), "id")
        .select("key", "low", "high", "place", "id", "c", "side", "sig", "long")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table) -> pa.RecordBatch | None:
            ids, c, side = (table.column(k).to_numpy() for k in (4, 5, 6))
            if len(ids) < 2 or (c == c[0]).all():
                return None
            sig = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            long = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, LONG)
            within = table.column(1)[0].as_py() == table.column(2)[0].as_py()
            found = crossing(ids, c, sig, long, side, within, int(table.column(3)[0].as_py()), far)
            return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"]) if len(found) else None

        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            marks = np.stack([kept.column(k).to_numpy() for k in (0, 1, 2)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            begin = 0
            for end in cuts:
                out = work(kept.slice(begin, end - begin))
                begin = end
                if out is not None:
                    yield out
            kept = kept.slice(begin)
        if kept is not None:
            out = work(kept)
            if out is not None:
                yield out

    partitions = partitions_for(told.sparkSession, dealt.count(), ROWS_A_PARTITION)
    ordered = both.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = written(map_arrow(ordered, run, "a long, b long"), "pairs")
    dropped(dealt)
    return found


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(src, dst) of the pairs whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(bool(len(x)) and 100 * common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "src long, dst long")


def row_components(docs: DataFrame, similarity: int, words: int, doc_id: str, text: str) -> DataFrame:
    """A written table with id, text_a, text_b, n_shingles and component (null where the row links with nothing) of every row.

    component is a number of the component's own; a class that links with no other is one too.
    """
    if similarity < LEAST:
        raise ValueError(f"similarity is {LEAST} at least ({SIMILARITY} unless asked for)")
    far = reach(similarity)
    drawn = written(sketch(docs, doc_id, text, words), "sketch")
    full = drawn.where("n_shingles > 0 and id is not null")
    # A class is named by a number that is given when the table is written; ids may stand on several texts.
    one = full.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "text_a", "text_b")).alias("row"), F.first("sig").alias("sig"))
    classes = written(one.select("set_a", "set_b", "row.*", "sig", F.monotonically_increasing_id().alias("cid")), "classes")
    rows = keyed(classes, far)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes, "key").select("id", "key", "place", "n"), "keys")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    hubs = shared.join(degree, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    star = shared.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    first = written(near(star, classes, far), "pairs")
    met = classes.join(shared.select(F.col("id").alias("cid")).distinct(), "cid", "left_semi").select("cid", "id", "text_a", "text_b")
    sets = written(sets_of(docs, met, doc_id, text, words), "sets")
    links = written(confirmed(first, sets, similarity), "links")
    label = components(links)
    # Keys whose documents are still in several components: their pairs across components, all of them.
    told = shared.join(label, "id", "left").select("key", "place", "id", F.coalesce("component", "id").alias("c"))
    pairs = across(told, classes, sets, far)
    more = written(confirmed(pairs, sets, similarity), "links")
    dropped(shared, first, links, sets, pairs)
    label = joined_components(label, more)
    named = classes.select("set_a", "set_b", F.col("cid").alias("id")).join(label, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    # Rows that take no part are dealt by their texts: null keys would all meet in one task.
    real = F.expr("n_shingles > 0 and id is not null")
    dealt = drawn.select("id", "text_a", "text_b", "n_shingles", F.when(real, F.col("set_a")).otherwise(F.xxhash64("id", "text_a")).alias("set_a"), "set_b")
    found = dealt.join(named, ["set_a", "set_b"], "left").withColumn("component", F.when(real, F.col("component")))
    return finished(found.select("id", "text_a", "text_b", "n_shingles", "component"), "components", drawn, classes, more, label)


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    similarity is LEAST at least; below SIMILARITY the distances grow with it.  Documents link
    if 100 * |intersection| >= similarity * |union| of their shingle sets, held as 64-bit
    hashes; component_id is the smallest doc_id reachable, kept marks that document.
    Null and empty texts have no shingles and link with nothing; texts of any length are
    compared whole.  Rows that share an id and a text are one document: all are kept or none;
    rows that share an id alone are documents of their own.  A null id takes no part: its
    component_id is null and kept is false.  An empty table gives no rows.  Other columns
    aren't used.
    """
    rows = row_components(docs, similarity, words, doc_id, text)
    # Written first: a large component's rows then join it under skew handling.
    least = written(rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    apart = F.coalesce("component", -1 - F.pmod(F.xxhash64("id", "text_a"), F.lit(1 << 20)))  # components are numbers from 0
    out = rows.withColumn("component", apart).join(least, "component", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("least", "id").alias("component_id"))
    return finished(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "duplicates", rows, least)


def without_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id (then of the smallest digest of its text).

    Rows without an id and rows without words all stay, as they link with nothing.  Rows that
    share an id and a text are one document, of which one row stays.  Decisions are on rows,
    not on ids: another text under a removed document's id stays.
    """
    rows = row_components(docs, similarity, words, doc_id, text)
    key = ["id", "text_a", "text_b"]
    each = rows.where("component is not null").groupBy("component", *key).agg(F.count("*").alias("n"))
    first = written(each.groupBy("component").agg(F.min(F.struct(*key)).alias("first")), "least")
    judged = each.join(first, "component").withColumn("stays", F.struct(*key) == F.col("first")).where("not stays or n > 1")
    verdicts = finished(judged.select(*key, "stays"), "verdicts", rows, first)
    # Most rows aren't among the verdicts, which a bit field tells: their texts don't move.
    names = ("__id", "__text_a", "__text_b")
    made = {"__id": F.col(doc_id).cast("long"), "__text_a": F.xxhash64(F.col(text)), "__text_b": F.xxhash64(F.col(text), F.lit(1))}
    told = marked(docs.withColumns(made), verdicts, names, "__suspect")
    suspect, named = told.where("__suspect"), verdicts.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], "stays")
    kept = told.where("not __suspect").union(suspect.join(named, list(names), "left_anti").select(*told.columns))
    if not verdicts.where("stays").isEmpty():
        kept = kept.union(suspect.join(named.where("stays").select(*names), list(names), "left_semi").dropDuplicates(list(names)).select(*told.columns))
    return kept.select(*docs.columns)
