"""Scalar text functions as Spark columns.

Blanks, lines and digits are those of Unicode, as ``str.strip`` and ``str.splitlines``
see them; null stays null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

#: Characters that a page's text may hold in any number, and the run of others that is garbage.
READABLE = (
    r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}a-zA-Z0-9\s\x1c-\x1f\-_.,;:!?()（）【】「」《》、。，；：！？·…—"
    r"\[\]{}#*+=/\\|@&\^~`'\"$%<>"
)
GARBAGE_RUN = 20
#: Characters that names of folders can't have, and the tags that stay as they are.
UNSAFE = r"""[/\\:*?"<>|\x00-\x1f]"""
MAX_NAME = 64
TAGS = "div|img|table|thead|tbody|tr|td|th|br|hr|span|p|b|i|u|strong|em|sub|sup|ul|ol|li|a|code|pre|h[1-6]|blockquote"


def bound(value: Column, f) -> Column:
    """f(value), value worked out once although f names it often, in lambdas too."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n+\z", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    return bound(F.split(c, LINE_END, -1), lambda every: F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every))


def normalize_line(c: Column) -> Column:
    """Trimmed, every run of blanks one space."""
    return F.trim(F.regexp_replace(c, rf"(?U){BLANK}+", " "))


def normalized_lines(c: Column) -> Column:
    return F.transform(lines(c), lambda x: normalize_line(x))


def remove_garbage(c: Column, run: int = GARBAGE_RUN) -> Column:
    """Without runs of ``run`` or more characters outside READABLE."""
    return F.regexp_replace(c, f"(?U)[^{READABLE}]{{{run},}}", "")


def normalize_whitespace(c: Column) -> Column:
    """Three and more line feeds become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def drop_exact_repeats(c: Column) -> Column:
    """Paragraphs equal, but for outer blanks, to the last one kept are dropped; blank ones stay.

    The last one kept equals the one before, kept or dropped, so neighbours decide.
    """

    def walked(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(parts, F.lit(1), F.size(parts) - 1))
        kept = F.zip_with(parts, before, lambda p, b: F.when(b.isNull() | (strip(p) == "") | (strip(p) != strip(b)), p))
        return F.when(F.size(parts) <= 1, c).otherwise(F.array_join(kept, "\n\n"))  # nulls are passed over

    return bound(F.split(c, r"\n\s*\n", -1), walked)


def sanitize_dirname(c: Column) -> Column:
    name = F.regexp_replace(strip(c), UNSAFE, "_")
    name = F.regexp_replace(F.replace(name, F.lit(".."), F.lit("")), "_+", "_")
    name = F.ltrim(F.trim(name, F.lit("_")), F.lit("."))
    return F.when(F.length(name) > MAX_NAME, F.rtrim(F.substring(name, 1, MAX_NAME), F.lit("_"))).otherwise(name)


def secure_filename(c: Column) -> Column:
    """Separators to underscores; letters, digits and ``. - _`` and space stay; 'unnamed' if nothing does."""
    name = F.regexp_replace(F.regexp_replace(c, r"[/\\]", "_"), r"[^\p{L}\p{N}._\- ]", "")
    name = strip(name)
    return F.when(name == "", F.lit("unnamed")).otherwise(name)


def secure_relpath(c: Column) -> Column:
    """Each part made secure; null for absolute paths and those with a part '..'."""
    slashed = F.replace(c, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/", -1), lambda p: (p != "") & (p != "."))
    safe = F.array_join(F.transform(parts, secure_filename), "/")
    return F.when(F.startswith(slashed, F.lit("/")) | F.array_contains(parts, "..") | (F.size(parts) == 0), F.lit(None).cast("string")).otherwise(safe)


def escape_unknown_tags(c: Column) -> Column:
    """``<x>`` of no known tag becomes ``&lt;x&gt;``."""
    gaps, tags = F.split(c, "<[^>]*>", -1), F.regexp_extract_all(c, F.lit("<[^>]*>"), F.lit(0))
    known = lambda t: t.rlike(rf"(?i)^</?\s*(?:{TAGS})\b")
    shown = lambda t: F.when(t.isNull(), "").when(known(t), t).otherwise(F.concat(F.lit("&lt;"), F.substring(t, F.lit(2), F.length(t) - 2), F.lit("&gt;")))
    return F.array_join(F.zip_with(gaps, tags, lambda g, t: F.concat(g, shown(t))), "")


def quoted(c: Column) -> Column:
    """As literal text in a replacement."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def rewrite_image_urls(c: Column, task_id: Column, doc_dir: Column) -> Column:
    """References to pages' own artifacts go; ``images/`` references get the asset address."""
    out = F.regexp_replace(c, r"!\[[^\]]*\]\([^)/]+_OCR/images/[^)]+\)", "")
    out = F.regexp_replace(out, r"""<img\s[^>]*src=["'][^"'/]+_OCR/images/[^"']+["'][^>]*/?>""", "")
    folder = F.when(F.coalesce(doc_dir, F.lit("")) == "", F.lit("")).otherwise(F.concat(doc_dir, F.lit("/")))
    base = quoted(F.concat(F.lit("/api/v1/tasks/"), task_id, F.lit("/assets/"), folder))
    out = F.regexp_replace(out, F.lit(r"!\[([^\]]*)\]\((images/[^)]+)\)"), F.concat(F.lit("![$1]("), base, F.lit("$2)")))
    return F.regexp_replace(out, F.lit(r"""(<img\s[^>]*?)src=(["'])(images/[^"']+)\2"""), F.concat(F.lit("$1src=$2"), base, F.lit("$3$2")))


#: Substrings (all of one entry) and the message that they stand for, in order of precedence.
PROGRESS_RULES = [
    (("Using cached",), "模型文件已缓存，跳过下载"),
    (("already exist",), "模型文件已缓存，跳过下载"),
    (("Checking connectivity",), "检查模型源连通性..."),
    (("EngineCore", "pid="), "vLLM 推理引擎初始化中..."),
    (("gpu_memory_utilization",), "GPU 显存分配中..."),
    (("GPU blocks",), "GPU 显存分配中..."),
]
LOADING, DOWNLOADING = r"Loading.*shards:\s+(\d+%)", r"Downloading.*?(\d+%)"
LATE_RULES = [("创建 vLLM 引擎", "创建 vLLM 推理引擎..."), ("Creating engine", "创建 vLLM 推理引擎..."), ("初始化完成", "模型加载完成")]


def progress_message(c: Column) -> Column:
    """Message for a worker's log line; null where the line says nothing to users."""
    out = F.when(c.rlike(LOADING), F.concat(F.lit("加载模型权重... "), F.regexp_extract(c, LOADING, 1)))
    for needles, message in PROGRESS_RULES:
        hit = F.lit(True)
        for needle in needles:
            hit = hit & c.contains(needle)
        out = out.when(hit, F.lit(message))
    out = out.when(c.rlike(DOWNLOADING), F.concat(F.lit("下载模型文件... "), F.regexp_extract(c, DOWNLOADING, 1)))
    for needle, message in LATE_RULES:
        out = out.when(c.contains(needle), F.lit(message))
    return out.when(F.lower(c).contains("initialized"), F.lit("模型加载完成"))


def is_out_of_memory(c: Column) -> Column:
    return F.lower(c).contains("out of memory") | F.lower(c).contains("oom")


def error_summary(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.substring(message, 1, 200))


def percent(current: Column, total: Column) -> Column:
    """current / total in per cent with one digit, rounded as binary floats are; 0 where total is 0."""
    @F.pandas_udf("double")
    def rounded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x != x or y != y else round(x / y * 100, 1) if y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")

    return rounded(current.cast("double"), total.cast("double"))


def rewrite_page_images(c: Column, folder: Column) -> Column:
    """``images/`` references of a page, in Markdown and HTML, moved below its artifact folder."""
    out = F.regexp_replace(c, F.lit(r"!\[([^\]]*)\]\(images/"), F.concat(F.lit("![$1]("), quoted(folder), F.lit("/images/")))
    return F.regexp_replace(out, F.lit('src="images/'), F.concat(F.lit('src="'), quoted(folder), F.lit("/images/")))
