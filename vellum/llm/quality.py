"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad.  Emissions are linear in the line's own features and those of its
two neighbours; forward-backward gives each line's marginal, and marginals weighted by line
length give the document's quality.  Only documents bear labels: lines first take their
document's label, then, round by round, lines of bad documents that the field holds good
are relabelled, as long as the document keeps a bad line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import map_arrow, parts

#: Bounds on the labelled documents that are fitted, each of them whole: those with the smallest
#: hashes of their ids, as long as they have so many lines together; documents with more than
#: TRAIN_LONGEST lines are fitted only if there are no others.  Scoring takes all documents.
TRAIN_DOCUMENTS, TRAIN_LINES, TRAIN_LONGEST = 4000, 150_000, 1000
ROUNDS, STEPS = 3, 120
THRESHOLD = 0.3

LOWER, UPPER, DIGIT, SPACE, PIPE, BANG, SYMBOL, STOP, WIDE, OTHER = range(10)


def _byte_classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = LOWER, UPPER, DIGIT, WIDE
    for chars, k in ((b" \t\r", SPACE), (b"|", PIPE), (b"!?", BANG), (b"#$%&*@~^=_<>{}[]\\", SYMBOL), (b".,;:", STOP)):
        t[list(chars)] = k
    return t


BYTE_CLASS = _byte_classes()
OWN = 24  # features of a line without its neighbours


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features (lines, OWN), weights (lines,)) of a text; an empty text is one empty line."""
    lines = (text or "").split("\n")
    raw = (text or "").encode("utf-8", "surrogatepass")
    code = np.frombuffer(raw, np.uint8)
    line = np.cumsum(code == 10)
    counts = np.bincount(line * 10 + BYTE_CLASS[code], minlength=10 * len(lines)).reshape(-1, 10).astype(np.float32)
    counts[1:, OTHER] -= 1  # a line feed is counted with the line after it
    size = counts.sum(axis=1)
    share = counts / np.maximum(size, 1)[:, None]
    same = Counter(lines)
    words_n, different, top, runs, first, last, again, sentences = (np.zeros(len(lines), np.float32) for _ in range(8))
    for i, text_line in enumerate(lines):
        words = text_line.split()
        n = len(words)
        words_n[i] = n
        if n:
            kinds = set(words)
            different[i] = len(kinds) / n
            top[i] = 1 / n if len(kinds) == n else max(map(words.count, kinds)) / n if n < 40 else Counter(words).most_common(1)[0][1] / n
            runs[i] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
            first[i], last[i] = text_line[0].isupper(), words[-1][-1] in ".!?\"'"
            again[i] = (same[text_line] - 1) / len(lines)
            parts = text_line.split(". ")
            sentences[i] = len(set(parts)) / len(parts)
    upper = counts[:, UPPER] / np.maximum(counts[:, UPPER] + counts[:, LOWER], 1)
    f = np.stack(
        [
            np.log1p(size) / 5, np.log1p(words_n) / 3, upper, upper > 0.5, share[:, DIGIT], share[:, SPACE],
            share[:, PIPE] * 10, share[:, PIPE] > 0.03, share[:, BANG] * 10, share[:, BANG] > 0.05, share[:, SYMBOL] * 5, share[:, SYMBOL] > 0.08,
            share[:, STOP] * 10, share[:, WIDE], share[:, OTHER] * 5, different, different < 0.5, top, runs * 3, runs > 0.3,
            first, last, again * 3, sentences,
        ],
        axis=1,
    ).astype(np.float32)
    return f, np.maximum(size, 1)


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at the ends), end flags and 1."""
    zero = np.zeros((1, f.shape[1]), np.float32)
    ends = np.zeros((len(f), 3), np.float32)
    ends[0, 0], ends[-1, 1], ends[:, 2] = 1, 1, 1
    return np.concatenate([f, np.concatenate([zero, f[:-1]]), np.concatenate([f[1:], zero]), ends], axis=1)


@dataclass
class Field:
    """Emission weights of "good" against "bad", transitions (2, 2) from bad, good, and the calibration."""

    w: np.ndarray
    t: np.ndarray
    slope: float = 4.0
    bias: float = -2.0


def marginals(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the summed pair marginals; documents stand one after another in e.

    Documents go longest first, so step s runs over those that have a line s.
    """
    order = np.argsort(-lengths, kind="stable")
    first, many = starts[order], lengths[order]
    steps = int(many[0]) if len(many) else 0
    alive = np.searchsorted(-many, -np.arange(steps), side="left")  # documents with more than s lines
    trans = np.exp(t)
    # Scaled forward and backward passes in probabilities.
    g = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    emit = np.stack([1 - g, g], axis=1)
    alpha = np.empty((len(e), 2))
    for s in range(steps):
        at = first[: alive[s]] + s
        a = emit[at] if s == 0 else (alpha[at - 1] @ trans) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((len(e), 2))
    pairs = np.zeros((2, 2))
    for s in range(steps - 2, -1, -1):
        at = first[: alive[s + 1]] + s
        nxt = emit[at + 1] * beta[at + 1]
        b = nxt @ trans.T
        joint = alpha[at][:, :, None] * trans * nxt[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    return m[:, 1] / m.sum(axis=1), pairs


def slopes(field: Field, x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean negative log-likelihood of the lines' labels y, with its penalties, in w and t; seen: pairs of labels."""
    p, pairs = marginals(x @ field.w, starts, lengths, field.t)
    return [x.T @ (p - y) / len(x) + 1e-4 * field.w, (pairs - seen) / len(x) + 1e-3 * field.t]


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, steps: int = STEPS) -> Field:
    """Field of (own features, weights, label) documents; without both labels, one that finds all good or all bad."""
    width = 3 * OWN + 3
    labels = np.array([y for _, _, y in documents], dtype=int)
    if len(set(labels.tolist())) < 2:
        w = np.zeros(width)
        return Field(w, np.zeros((2, 2)), 0.0, 3.0 if labels.sum() or not len(labels) else -3.0)
    x = np.concatenate([with_neighbours(f) for f, _, _ in documents]).astype(np.float64)
    weight = np.concatenate([v for _, v, _ in documents])
    lengths = np.array([len(f) for f, _, _ in documents])
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(documents)), lengths)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    y = labels[doc].astype(np.float64)
    field = Field(np.zeros(width), np.zeros((2, 2)))
    for turn in range(rounds):
        m1, m2 = [np.zeros(width), np.zeros((2, 2))], [np.zeros(width), np.zeros((2, 2))]
        before, after = y[:-1].astype(int), y[1:].astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (before[inner[1:]], after[inner[1:]]), 1)
        for step in range(1, steps + 1):
            grads = slopes(field, x, y, starts, lengths, seen)
            for part, g, a, b in zip((field.w, field.t), grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.02 * (g * g - b)
                part -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-7)
        p, _ = marginals(x @ field.w, starts, lengths, field.t)
        if turn < rounds - 1:
            y = np.where((labels[doc] == 0) & (p > 0.5), 1.0, labels[doc])
            worst = np.full(len(documents), np.inf)
            np.minimum.at(worst, doc, p)
            y[(labels[doc] == 0) & (p <= worst[doc])] = 0.0
    quality = np.bincount(doc, p * weight) / np.bincount(doc, weight)
    a, b = 4.0, -2.0
    for _ in range(400):  # one-variable logistic calibration
        q = 1 / (1 + np.exp(-(a * quality + b)))
        a -= 2.0 * (((q - labels) * quality).mean() + 1e-4 * a)
        b -= 2.0 * (q - labels).mean()
    field.slope, field.bias = float(a), float(b)
    return field


def score_texts(field: Field, texts: list[str | None]) -> list[float]:
    made = [line_features(t) for t in texts]
    lengths = np.array([len(f) for f, _ in made])
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(made)), lengths)
    e = np.concatenate([with_neighbours(f) @ field.w.astype(np.float32) for f, _ in made])
    weight = np.concatenate([v for _, v in made])
    p, _ = marginals(e, starts, lengths, field.t)
    quality = np.bincount(doc, p * weight) / np.bincount(doc, weight)
    return (1 / (1 + np.exp(-(field.slope * quality + field.bias)))).tolist()


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Field:
    """Fit on at most ``most`` labelled documents that aren't held out, within the bounds on their lines.

    A document labelled twice is good only if no label says bad; null labels don't count.  Of
    several rows under one id one is fitted: that with the fewest lines, then the smallest
    hash of its text.  Ids are chosen first, then rows; only features of those rows reach
    the driver, TRAIN_LINES lines at most or one document.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = told.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(count.alias("lines"), F.xxhash64("text").alias("hash"))).alias("row"), F.first("quality").alias("quality"))
    rows = sorted(sizes.select(F.xxhash64("doc_id").alias("turn"), "doc_id", "row.lines", "row.hash", "quality").collect(), key=lambda r: (r["turn"], r["doc_id"]))
    rows = [r for r in rows if r["lines"] <= TRAIN_LONGEST] or rows[:1]
    picked, total = [], 0
    for r in rows:
        if total + r["lines"] <= TRAIN_LINES or not picked:
            picked.append((r["doc_id"], r["hash"], len(picked), int(r["quality"] > 0)))
            total += r["lines"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = docs.sparkSession.createDataFrame(picked, f"doc_id {kind}, hash long, turn int, label int")
    texts = told.withColumn("hash", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "hash"]).dropDuplicates(["turn"]).select("turn", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2)], names=["turn", "f", "v", "label"])

    rows = sorted(map_arrow(texts, run, "turn int, f binary, v binary, label int").collect(), key=lambda r: r["turn"])
    return fit([(np.frombuffer(r["f"], np.float32).reshape(-1, OWN), np.frombuffer(r["v"], np.float32), r["label"]) for r in rows])


def score_documents(docs: DataFrame, field: Field, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` (double, 0 to 1); it replaces one of that name.

    Every row keeps its columns and gets its score, null and empty texts (one empty line) and
    texts of any length too, which are read whole.  Equal texts get equal scores; an empty table stays empty.
    """
    kept = docs.drop(name)
    at = kept.columns.index(text)
    names = [*kept.columns, name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, at, 512):
                scores = score_texts(field, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return map_arrow(kept, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels serve training alone.

    With no label or one kind of label every document gets the same score.
    """
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
