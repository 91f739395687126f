"""Overlap between neighbouring pages, and the fold that merges a group's pages."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.config import DedupConfig
from vellum.functions.text import lines, rewrite_page_images
from vellum.shipping import ship

MARKER = "<!-- page:"


def page_lines_without_markers(pages: DataFrame, text: str = "text") -> DataFrame:
    """Content lines with their place, and markers with the place of content before which they stand."""
    rows = pages.select("group_id", "page_seq", F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("is_marker", F.startswith("line", F.lit(MARKER)))
    before = Window.partitionBy("group_id", "page_seq").orderBy("line_no")
    return rows.withColumn("position", F.sum((~F.col("is_marker")).cast("long")).over(before) - (~F.col("is_marker")).cast("long"))


def neighbours(pages: DataFrame, text: str = "text") -> DataFrame:
    """(group_id, page_seq, a, b): each page's text with the next page's; page_seq is a page's own within its group.

    Only keys are put in order; texts then meet on (group, page), so that a large group's
    texts are spread like all others.
    """
    after = Window.partitionBy("group_id").orderBy("page_seq")
    keys = pages.select("group_id", "page_seq").withColumn("__next", F.lead("page_seq").over(after)).where("__next is not null")
    first = keys.join(pages.select("group_id", "page_seq", F.col(text).alias("a")), ["group_id", "page_seq"])
    second = pages.select("group_id", F.col("page_seq").alias("__next"), F.col(text).alias("b"))
    return first.join(second, ["group_id", "__next"]).select("group_id", "page_seq", "a", "b")


def adjacent_overlap(pages: DataFrame, search_ratio: float = DedupConfig.search_ratio, text: str = "text") -> DataFrame:
    """Longest block of equal lines between each page's tail and the next page's head.

    Relational form: equal lines meet within their pair of pages, blocks are runs on a
    diagonal.  Ties go to the smallest tail line, then head line.  Heads of 200 and more lines
    follow ``merge_pages``' matcher, which passes over lines too common; this form doesn't.
    """
    pairs = neighbours(pages, text).where("a is not null and b is not null").select("group_id", "page_seq", lines(F.col("a")).alias("a"), lines(F.col("b")).alias("b"))
    return overlap_of(pairs, search_ratio)


def overlap_of(pairs: DataFrame, search_ratio: float) -> DataFrame:
    """``adjacent_overlap`` of (group_id, page_seq, a, b), a and b being arrays of lines."""
    cut = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(search_ratio)).cast("int"))
    sized = pairs.withColumns({"na": F.size("a"), "nb": F.size("b")}).where("na > 0 and nb > 0").withColumns({"ta": cut(F.col("na")), "tb": cut(F.col("nb"))})
    tail = sized.select("group_id", "page_seq", "na", "nb", F.posexplode(F.slice("a", F.col("na") - F.col("ta") + 1, F.col("ta"))).alias("i", "line"))
    head = sized.select("group_id", "page_seq", F.posexplode(F.slice("b", F.lit(1), F.col("tb"))).alias("j", "line"))
    met = tail.join(head, ["group_id", "page_seq", "line"]).withColumn("diagonal", F.col("i") - F.col("j"))
    along = Window.partitionBy("group_id", "page_seq", "diagonal").orderBy("i")
    blocks = (
        met.withColumn("island", F.col("i") - F.row_number().over(along))
        .groupBy("group_id", "page_seq", "diagonal", "island")
        .agg(F.min("i").alias("tail_start"), F.min("j").alias("head_start"), F.count("*").alias("size"), F.count_if(F.trim("line") != "").alias("non_blank"))
    )
    best = blocks.groupBy("group_id", "page_seq").agg(F.min(F.struct((-F.col("size")).alias("less"), "tail_start", "head_start", "non_blank")).alias("m"))
    return best.select("group_id", "page_seq", "m.tail_start", "m.head_start", (-F.col("m.less")).alias("size"), "m.non_blank").withColumn("accepted", F.col("non_blank") >= 2)


def merge_adjacent(pages: DataFrame, search_ratio: float = DedupConfig.search_ratio, text: str = "text") -> DataFrame:
    """(group_id, page_seq, text, overlap_lines, similarity) of each page merged with the next one, for texts without markers.

    Relational form of ``merge_pair``: up to the block's end in the first page, then what follows it in the second.
    """
    pairs = neighbours(pages, text).where("b is not null")
    found = overlap_of(pairs.where("a is not null").select("group_id", "page_seq", lines(F.col("a")).alias("a"), lines(F.col("b")).alias("b")), search_ratio)
    told = pairs.join(found, ["group_id", "page_seq"], "left")
    na, nb = F.size(lines(F.col("a"))), F.size(lines(F.col("b")))
    tail = F.greatest(F.lit(1), F.floor(na * F.lit(search_ratio)).cast("int"))
    taken = F.slice(lines(F.col("a")), F.lit(1), (na - tail + F.col("tail_start") + F.col("size")).cast("int"))
    rest = F.slice(lines(F.col("b")), (F.col("head_start") + F.col("size") + 1).cast("int"), nb)
    whole = F.when((na == 0) | (nb == 0), F.concat("a", F.lit("\n"), "b")).when(F.coalesce("accepted", F.lit(False)), F.array_join(F.concat(taken, rest), "\n")).otherwise(F.concat("a", F.lit("\n\n"), "b"))
    size = F.when(F.coalesce("accepted", F.lit(False)), F.col("size")).otherwise(0)
    return told.select("group_id", "page_seq", whole.alias("text"), size.cast("long").alias("overlap_lines"), F.when(size > 0, 1.0).otherwise(0.0).alias("similarity"))


def separated(text: str) -> tuple[list[tuple[int, str]], list[str]]:
    """Markers with their content position, and the content lines."""
    markers, content = [], []
    for line in text.splitlines():
        if line.startswith(MARKER):
            markers.append((len(content), line))
        else:
            content.append(line)
    return markers, content


def merge_pair(a: str, b: str, search_ratio: float = DedupConfig.search_ratio) -> tuple[str, int, float]:
    """(text, overlapping lines, similarity) of two texts that may overlap.

    An accepted block has two lines at least that aren't blank; what ``a`` has after it and
    ``b`` before it is dropped.  Its similarity is 1.0, as its lines are equal.
    """
    if not a.splitlines() or not b.splitlines():
        return f"{a}\n{b}", 0, 0.0
    (marks_a, own_a), (marks_b, own_b) = separated(a), separated(b)
    tail, head = max(1, int(len(own_a) * search_ratio)), max(1, int(len(own_b) * search_ratio))
    at = max(0, len(own_a) - tail)
    found = SequenceMatcher(None, own_a[at:], own_b[:head]).find_longest_match(0, len(own_a) - at, 0, min(head, len(own_b)))
    if sum(bool(x.strip()) for x in own_a[at + found.a : at + found.a + found.size]) < 2:
        return f"{a}\n\n{b}", 0, 0.0
    end_b = found.b + found.size
    content = own_a[: at + found.a + found.size] + own_b[end_b:]
    placed = sorted([(p, 0, k, m) for k, (p, m) in enumerate(marks_a)] + [(len(own_a) + p - end_b, 1, k, m) for k, (p, m) in enumerate(marks_b)], key=lambda x: (x[1], x[2]))
    out, used = [], 0
    for position, _, _, marker in placed:
        upto = max(used, min(position, len(content)))
        out += content[used:upto]
        out.append(marker)
        used = upto
    return "\n".join(out + content[used:]), found.size, 1.0


class Fold:
    """Pages merged one after another, as ``merge_pair`` does, with the lines, markers and places of lines kept between pages.

    A page costs its own lines and the places where they stand in the text so far, not that
    text's length.  The text before the last overlap is its lines; what came after is kept as it was.
    """

    def __init__(self, first: str, search_ratio: float):
        self.ratio = search_ratio
        self.marks, self.content = separated(first)
        self.where: dict[str, list[int]] = {}
        for i, line in enumerate(self.content):
            self.where.setdefault(line, []).append(i)
        self.prefix: tuple[int, int, bool] | None = None  # lines, markers and a last line end: the text up to the last overlap
        self.raw = [first]
        self.ends = ends_line(first)

    def text(self) -> str:
        rest = "".join(self.raw)
        if self.prefix is None:
            return rest
        size, marks, ends = self.prefix
        out, used = [], 0
        for position, marker in self.marks[:marks]:
            out += self.content[used:position]
            out.append(marker)
            used = position
        return "\n".join(out + self.content[used:size]) + "\n" * ends + rest

    def longest(self, head: list[str], at: int) -> tuple[int, int, int]:
        """(place in the content, place in ``head``, lines) of the longest block of equal lines from ``at`` on.

        Ties go to the smallest place in the content, then in the head.  As in difflib, lines that
        make up more than a hundredth of a head of 200 lines and more begin no block but may
        extend one.
        """
        places: dict[str, list[int]] = {}
        for j, line in enumerate(head):
            places.setdefault(line, []).append(j)
        if len(head) >= 200:
            most = len(head) // 100 + 1
            places = {line: js for line, js in places.items() if len(js) <= most}
        hits = sorted(i for line in places if line in self.where for i in self.where[line][bisect_left(self.where[line], at) :])
        best, before, last = (at, 0, 0), {}, -2
        for i in hits:
            now = {}
            earlier = before if i == last + 1 else {}
            for j in places[self.content[i]]:
                n = now[j] = earlier.get(j - 1, 0) + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
            before, last = now, i
        a, b, n = best
        while a > at and b > 0 and self.content[a - 1] == head[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while a + n < len(self.content) and b + n < len(head) and self.content[a + n] == head[b + n]:
            n += 1
        return a, b, n

    def grow(self, lines_: list[str]) -> None:
        for line in lines_:
            self.where.setdefault(line, []).append(len(self.content))
            self.content.append(line)

    def add(self, page: str) -> int:
        """Merge the next page; returns the lines that overlap."""
        marks, own = separated(page)
        size = len(self.content)
        tail, head = max(1, int(size * self.ratio)), max(1, int(len(own) * self.ratio))
        at = max(0, size - tail)
        a, b, n = self.longest(own[:head], at)
        if sum(bool(x.strip()) for x in self.content[a : a + n]) < 2:
            gap = [""] * (2 if self.ends else 1)
            self.marks += [(size + len(gap) + p, m) for p, m in marks]
            self.grow(gap + own)
            self.raw += ["\n\n", page]
            self.ends = ends_line(page)
            return 0
        while len(self.content) > a + n:
            self.where[self.content.pop()].pop()
        end = b + n
        self.grow(own[end:])
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] <= len(self.content):
                break
            self.marks[k] = (len(self.content), self.marks[k][1])
        for p, marker in marks:
            used = self.marks[-1][0] if self.marks else 0
            self.marks.append((max(used, min(size + p - end, len(self.content))), marker))
        # A last empty line is the end of the one before.
        self.ends = bool(self.content) and self.content[-1] == "" and not (self.marks and self.marks[-1][0] == len(self.content))
        if self.ends:
            self.where[self.content.pop()].pop()
        self.prefix, self.raw = (len(self.content), len(self.marks), self.ends), []
        return n


#: What ``str.splitlines`` takes for the end of a line.
LINE_ENDS = ("\n", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def ends_line(text: str) -> bool:
    """Whether a line end put after ``text`` opens an empty line; a return and a line feed are one end."""
    return text.endswith(LINE_ENDS) and not text.endswith("\r")


def merge_pages(
    pages: DataFrame, search_ratio: float = DedupConfig.search_ratio, text: str = "text", name: str = "image_name", raw: str | None = None, ocr_dir: str | None = None
) -> DataFrame:
    """(group_id, markdown, n_pages, overlap_lines): each group's pages folded in order.

    Before its page stands its marker; references to ``images/`` get the page's folder before
    them: ``ocr_dir``, or where that is null or not asked for the name's stem and _OCR.  Where the text is
    null or empty ``raw`` stands in, if given.  The fold is not associative, so a group is one
    task, which holds the group's texts; groups run side by side.
    """
    schema = "group_id string, markdown string, n_pages long, overlap_lines long"

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_seq", kind="stable")
        merged, overlap = None, 0
        for page, own in zip(frame["__name"], frame["__text"], strict=True):
            marked = f"{MARKER} {page} -->\n{own or ''}"
            if merged is None:
                merged = Fold(marked, search_ratio)
            else:
                overlap += merged.add(marked)
        return pd.DataFrame({"group_id": [frame["group_id"].iloc[0]], "markdown": [merged.text().rstrip("\n")], "n_pages": [len(frame)], "overlap_lines": [overlap]})

    ship(pages.sparkSession)
    own = F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(raw) if raw else F.lit(""), F.lit(""))
    stem = F.concat(F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", ""), F.lit("_OCR"))
    folder = F.coalesce(F.col(ocr_dir), stem) if ocr_dir else stem
    source = pages.select(F.col("group_id").cast("string").alias("group_id"), "page_seq", F.col(name).alias("__name"), rewrite_page_images(own, folder).alias("__text"))
    return source.groupBy("group_id").applyInPandas(fold, schema)


def merged_images(pages: DataFrame, regions: str = "regions") -> DataFrame:
    """(group_id, images): the regions of a group's pages, an array in page order, then in each page's own."""
    held = F.array_sort(F.collect_list(F.struct("page_seq", F.col(regions).alias("r"))))
    return pages.groupBy(F.col("group_id").cast("string").alias("group_id")).agg(F.flatten(F.transform(F.filter(held, lambda p: p["r"].isNotNull()), lambda p: p["r"])).alias("images"))


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, text_a, text_b) with text, overlap_lines and similarity."""

    @F.pandas_udf("text string, overlap_lines long, similarity double")
    def merged(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merge_pair(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["text", "overlap_lines", "similarity"])

    ship(pairs.sparkSession)
    return pairs.select("pair_id", merged("text_a", "text_b").alias("m")).select("pair_id", "m.*")


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether difflib's ratio is over the threshold; two cheaper bounds of it come first."""
    most = threshold * (len(a) + len(b)) / 2
    if min(len(a), len(b)) <= most - 1e-9 or (Counter(a) & Counter(b)).total() <= most - 1e-9:
        return False
    return SequenceMatcher(None, a, b).ratio() > threshold


def remove_repetitions(column, threshold: float = 0.9):
    """Paragraphs much like the last one kept are dropped (difflib ratio over ``threshold``)."""
    import re

    def one(text: str | None) -> str | None:
        parts = re.split(r"\n\s*\n", text) if text is not None else []
        if len(parts) <= 1:
            return text
        kept = parts[:1]
        for part in parts[1:]:
            last, now = kept[-1].strip(), part.strip()
            if not last or not now or not alike(last, now, threshold):
                kept.append(part)
        return "\n\n".join(kept)

    ship(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return cleaned(column)
