"""Queries over whole texts against plain versions."""

import re
import unicodedata

import pytest

from vellum.config import LLMConfig
from vellum.operators import segment
from vellum.plans.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    found = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert any(t and len(t) > 8000 for t in found.values())
    return found


def banned(text):
    ids = [len(w) for w in text.split(" ")]
    found = {ids[i + 2] for i in range(max(0, len(ids) - 40), len(ids) - 2) if ids[i : i + 2] == ids[-2:]} - {5}
    return ",".join(map(str, sorted(found)))


def filename(text):
    kept = "".join(c for c in text.replace("/", "_").replace("\\", "_") if c in "._- " or unicodedata.category(c)[0] in "LN")
    return kept.strip(" ") or "unnamed"


def test_banned_tokens_of_whole_texts(spark, sf, texts):
    got = {r.doc_id: r.banned for r in QUERIES["lay_17_banned_tokens"](spark, sf).collect()}
    assert {i: ",".join(map(str, sorted(map(int, filter(None, b.split(",")))))) for i, b in got.items() if texts[i] is not None} == {i: banned(t) for i, t in texts.items() if t is not None}


def test_word_list_of_whole_texts(spark, sf, texts):
    got = {r.doc_id: r.words for r in QUERIES["pii_13_word_list"](spark, sf).collect()}
    assert {i: w for i, w in got.items() if texts[i] is not None} == {i: ",".join(w + "=" for w in t.split(" ") if w) for i, t in texts.items() if t is not None}


def test_filename_of_whole_texts(spark, sf, texts):
    got = {r.doc_id: r.name for r in QUERIES["str_2_filename"](spark, sf).collect()}
    assert {i: n for i, n in got.items() if texts[i] is not None} == {i: filename(t) for i, t in texts.items() if t is not None}


def segments(text):
    """The defaults, written plainly: cuts at headings, at blank lines past 8000 characters, small neighbours joined, lines of context."""
    most, around = LLMConfig.max_chars_per_segment, LLMConfig.segment_overlap_lines
    if not text.strip():
        return []
    lines = text.splitlines(keepends=True)
    if len(text) <= most:
        return [(0, text, 1, len(lines))]
    chunks = []
    for k, line in enumerate(lines):
        if k == 0 or re.match(r"#{1,6}\s+", line):
            chunks.append([])
        chunks[-1].append(line)
    pieces = []
    for chunk in chunks:
        whole = len("".join(chunk)) <= most
        pieces.append([])
        for line in chunk:
            pieces[-1].append(line)
            if not whole and len("".join(pieces[-1])) >= most and not line.strip():
                pieces.append([])
        if not pieces[-1]:
            pieces.pop()
    done = []
    for piece in pieces:
        a, b = len("".join(done[-1])) if done else most, len("".join(piece))
        if done and min(a, b) < most // 4 and a + b <= most:
            done[-1] = done[-1] + piece
        else:
            done.append(piece)
    out, begin = [], 0
    for k, piece in enumerate(done):
        end = begin + len(piece)
        before = "".join(lines[max(0, begin - around) : begin]).rstrip("\n") + "\n" if k and around else ""
        after = "\n" + "".join(lines[end : end + around]).rstrip("\n") if end < len(lines) and around else ""
        out.append((k, before + "".join(piece).rstrip("\n") + after, begin + 1, end))
        begin = end
    return out


def test_segments_of_all_documents(spark, sf, texts):
    got = sorted(tuple(r) for r in QUERIES["seg_0_all_documents"](spark, sf).collect())
    assert got == sorted((i, *s) for i, t in texts.items() if t is not None for s in segments(t))
    assert {i for i, t in texts.items() if t and len(t) > 8000} <= {r[0] for r in got}


def test_segments_of_long_texts(spark):
    texts = {1: "".join(f"# H{k}\n" + "word " * (k * 130) + "\n\n" for k in range(1, 20)), 2: ("line of text\n" * 40 + "\n") * 60, 3: "x" * 9000}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, markdown string")
    got = sorted(tuple(r) for r in segment.segment(rows).collect())
    assert got == sorted((i, *s) for i, t in texts.items() for s in segments(t))
    assert {i: sum(r[0] == i for r in got) > 1 for i in texts} == {1: True, 2: True, 3: False}
