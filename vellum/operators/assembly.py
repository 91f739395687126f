"""Document assembly: segments back together, splitting at boundaries, gap filling, warnings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import LLMConfig
from vellum.functions.text import bound, sanitize_dirname
from vellum.operators.protocol import PAGE, first_heading


def refined(text: Column, reply: Column) -> Column:
    """The model's reply, or the text where there is none."""
    return F.coalesce(reply, text)


def n_lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def looks_truncated(flagged: Column, text: Column, out: Column, config: LLMConfig = LLMConfig()) -> Column:
    short = (n_lines(text) > config.truncation_min_input_lines) & (n_lines(out) < n_lines(text) * (1 - config.truncation_ratio_threshold))
    return flagged | short


def reassemble(segments: DataFrame) -> DataFrame:
    """(doc_id, markdown): segments' texts in order, one line feed between."""
    own = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda s: s["text"]), "\n").alias("markdown"))


def insert_boundaries(markdown: str, boundaries: list[tuple[str, str]]) -> str:
    """Boundary markers right after the named page's last marker."""
    import json

    out = markdown
    for page, title in reversed(boundaries):
        at = [m for m in re.finditer(PAGE, out) if m[1] == page]
        if at:
            mark = json.dumps({"after_page": page, "new_title": title}, ensure_ascii=False)
            out = out[: at[-1].end()] + f"\n<!-- DOC_BOUNDARY: {mark} -->" + out[at[-1].end() :]
    return out


def page_markers(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """(doc_id, idx, page): page markers in order."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(1))).alias("idx", "page"))


def split_points(markers: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, idx, page, new_title): boundaries at their page's first marker; unknown pages are left out."""
    first = markers.groupBy("doc_id", "page").agg(F.min("idx").alias("idx"))
    return boundaries.withColumnRenamed("after_page", "page").join(first, ["doc_id", "page"]).select("doc_id", "idx", "page", "new_title")


def split_documents(docs: DataFrame, boundaries: DataFrame, text: str = "markdown") -> DataFrame:
    """(doc_id, sub_no, title, pages, markdown): cut before the page that follows each boundary.

    A boundary after the last page cuts nothing, repeated ones count once.  The first title is
    the first heading, or else empty; others come from the boundary.
    """
    body = F.split(F.col(text), r"(?=<!--\s*page:)", -1)
    parts = docs.select("doc_id", F.posexplode(body).alias("at", "part"))
    named = parts.withColumn("page", F.regexp_extract("part", PAGE, 1)).withColumn("marker", F.startswith("part", F.lit("<!--")) & F.col("part").rlike(r"^<!--\s*page:"))
    order = Window.partitionBy("doc_id").orderBy("at")
    numbered = named.withColumn("idx", F.sum(F.col("marker").cast("int")).over(order) - 1)
    cuts = split_points(numbered.where("marker").select("doc_id", "idx", "page"), boundaries).groupBy("doc_id", "idx").agg(F.first("new_title").alias("new_title"))
    after = cuts.select("doc_id", (F.col("idx") + 1).alias("idx"), "new_title", F.lit(1).alias("cut"))
    told = numbered.join(after, ["doc_id", "idx"], "left").withColumn("cut", F.when(F.col("marker"), F.coalesce("cut", F.lit(0))).otherwise(0))
    placed = told.withColumn("sub_no", F.sum("cut").over(order).cast("int"))
    own = F.array_sort(F.collect_list(F.struct("at", "part", "page", "marker")))
    sub = placed.groupBy("doc_id", "sub_no").agg(own.alias("own"), F.max(F.when(F.col("cut") == 1, F.col("new_title"))).alias("new_title"))
    markdown = F.array_join(F.transform("own", lambda p: p["part"]), "")
    return sub.select(
        "doc_id", "sub_no", F.coalesce("new_title", F.when(F.col("sub_no") == 0, first_heading(markdown)), F.lit("")).alias("title"),
        F.transform(F.filter("own", lambda p: p["marker"]), lambda p: p["page"]).alias("pages"), markdown.alias("markdown"),
    )


def images_of(markdown: Column, crops: Column) -> Column:
    """Crop paths that hold a Markdown reference of the text."""
    refs = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return bound(refs, lambda own: F.filter(crops, lambda path: F.exists(own, lambda r: F.contains(path, r))))


def owned(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items (doc_id, page, ...) whose page is among a sub-document's pages."""
    return items.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def gap_requests(gaps: DataFrame, pages: DataFrame) -> DataFrame:
    """Gaps with their page's and the next page's text; unknown pages are left out.

    A page is read again once, however many gaps need it: the join takes each page's text.
    """
    order = Window.partitionBy("doc_id").orderBy("page_seq")
    told = pages.select("doc_id", F.col("page").alias("after_image"), F.col("text").alias("page_text"), F.lead("page").over(order).alias("next_page"), F.lead("text").over(order).alias("next_text"))
    return gaps.join(told, ["doc_id", "after_image"])


def insert_fill(markdown: Column, own: Column, following: Column, content: Column) -> Column:
    """Content before the next page's first marker; at the end where either marker is missing."""
    marker = lambda c: F.concat(F.lit(r"<!--\s*page:\s*\Q"), c, F.lit(r"\E\s*-->"))
    at = F.regexp_instr(markdown, marker(following))
    has_own = F.regexp_count(markdown, marker(own)) > 0
    inside = F.concat(F.substring(markdown, F.lit(1), at - 1), content, F.lit("\n\n"), F.substring(markdown, at, F.length(markdown)))
    return F.when(has_own & following.isNotNull() & (at > 0), inside).otherwise(F.concat(markdown, F.lit("\n"), content, F.lit("\n")))


def warnings(truncated: Column, final_truncated: Column, gaps: Column, blocked: Column) -> Column:
    """Array of messages: segments (1-based), the whole document, unfilled gaps, blocked cloud steps."""
    each = F.transform(truncated, lambda t, i: F.when(t, F.concat(F.lit("段 "), (i + 1).cast("string"), F.lit(" 精修输出疑似被截断"))))
    missing = F.transform(gaps, lambda g: F.when(~g["filled"], F.concat(F.lit("缺口（"), g["after_image"], F.lit(" 之后）未能自动补充"))))
    whole = F.array(F.when(final_truncated, F.lit("整篇文档级精修输出疑似被截断")))
    cloud = F.array(F.when(blocked, F.lit("隐私实体检测失败，已阻止云端处理")))
    return F.array_compact(F.concat(each, whole, missing, cloud))


def output_dir(title: Column, index: Column, total: Column) -> Column:
    """'' for a single document, else its safe title or 文档_i (from 1)."""
    safe = sanitize_dirname(title)
    return F.when(total <= 1, F.lit("")).when(safe == "", F.concat(F.lit("文档_"), (index + 1).cast("string"))).otherwise(safe)


def tree_dir(relative: Column, doc_dir: Column) -> Column:
    """doc_dir below its leaf folder; '.' and '' add nothing."""
    return F.concat_ws("/", F.nullif(F.nullif(relative, F.lit(".")), F.lit("")), F.nullif(doc_dir, F.lit("")))


def with_boundaries(docs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``insert_boundaries`` over a table: boundaries (doc_id, seq, after_page, new_title) of each document."""
    own = boundaries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "after_page", "new_title"))).alias("b"))

    @F.pandas_udf("string")
    def inserted(text: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([insert_boundaries(t, [] if b is None else [(x["after_page"], x["new_title"]) for x in b]) for t, b in zip(text, marks, strict=True)])

    from vellum.shipping import ship

    ship(docs.sparkSession)
    return docs.join(own, "doc_id", "left").withColumn("markdown", inserted("markdown", "b")).drop("b")


#: A reference begins after a bracket or a quote: elsewhere nothing is tried, so time is linear.
ARTIFACT = r"""(?<=[("'])([^/()"'\n]+)_OCR/images/(\d+)\.jpg"""


def render(c: Column) -> Column:
    """Markdown for output: artifact references to ``images/STEM_N.jpg``, page markers away, outer blank lines off."""
    out = F.regexp_replace(c, ARTIFACT, "images/$1_$2.jpg")
    out = F.regexp_replace(out, r"<!--\s*page:.*?-->\n?", "")
    return F.regexp_replace(out, r"\A\n+|\s+\z", "")
