"""Segmentation of long Markdown for model refinement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import LLMConfig
from vellum.functions.text import lines
from vellum.shipping import ship

HEADING = r"^#{1,6}\s+"


def heading_chunks(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """(doc_id, chunk, start_line, end_line, chars): a chunk begins at each heading."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col(text))).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i")
    starts = (F.col("line").rlike(HEADING) & (F.col("i") > 0)).cast("int")
    return (
        rows.withColumn("chunk", F.sum(starts).over(before))
        .groupBy("doc_id", "chunk")
        .agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.sum(F.length("line")).alias("chars"))
    )


def segments_of(markdown: str, max_chars: int, context: int) -> list[tuple[int, str, int, int]]:
    """(index, text, first line, last line): by headings, then blank lines, small neighbours joined, context added."""
    if not markdown.strip():
        return []
    every = markdown.splitlines(keepends=True)
    if len(markdown) <= max_chars:
        return [(0, markdown, 1, len(every))]
    size = [len(x) for x in every]
    heads = [i for i, x in enumerate(every) if i == 0 or re.match(HEADING, x)]
    spans = list(zip(heads, [*heads[1:], len(every)], strict=True))
    cut: list[tuple[int, int]] = []
    for begin, end in spans:
        if sum(size[begin:end]) > max_chars:
            held = 0
            at = begin
            for i in range(begin, end):
                held += size[i]
                if held >= max_chars and not every[i].strip():
                    cut.append((at, i + 1))
                    at, held = i + 1, 0
            if at < end:
                cut.append((at, end))
        else:
            cut.append((begin, end))
    joined = cut[:1]
    chars = [sum(size[b:e]) for b, e in cut]
    held = chars[0]
    for (begin, end), n in zip(cut[1:], chars[1:], strict=True):
        if min(held, n) < max_chars // 4 and held + n <= max_chars:
            joined[-1] = (joined[-1][0], end)
            held += n
        else:
            joined.append((begin, end))
            held = n
    out = []
    for k, (begin, end) in enumerate(joined):
        body = "".join(every[begin:end]).rstrip("\n")
        before = "".join(every[max(0, begin - context) : begin]).rstrip("\n") + "\n" if k and context else ""
        after = "\n" + "".join(every[end : end + context]).rstrip("\n") if k < len(joined) - 1 and context else ""
        out.append((k, before + body + after, begin + 1, end))
    return out


def segment(docs: DataFrame, max_chars: int = LLMConfig.max_chars_per_segment, context: int = LLMConfig.segment_overlap_lines, text: str = "markdown") -> DataFrame:
    """(doc_id, seg_idx, text, start_line, end_line); blank texts give no rows, null ones neither."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, seg_idx int, text string, start_line int, end_line int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *s) for i, t in zip(frame["doc_id"], frame[text], strict=True) for s in segments_of(t or "", max_chars, context)]
            yield pd.DataFrame(rows, columns=["doc_id", "seg_idx", "text", "start_line", "end_line"])

    ship(docs.sparkSession)
    return docs.select("doc_id", text).mapInPandas(run, schema)
