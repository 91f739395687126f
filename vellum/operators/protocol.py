"""Text protocol with a language model: prompts out, markers in.

The call itself is a boundary: a function from messages to a reply, run in ``mapInPandas``
with as many partitions as requests may be in flight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import LLMConfig
from vellum.shipping import ship

#: Markers inside the text and the reply that says a gap can't be filled.
GAP = r'<!--\s*GAP:\s*after_image\s*=\s*([^,\s]+)\s*,\s*context_before\s*=\s*"([^"]*)"\s*,\s*context_after\s*=\s*"([^"]*)"\s*-->'
BOUNDARY = r"<!--\s*DOC_BOUNDARY:\s*(\{[^}]+\})\s*-->"
PAGE = r"<!--\s*page:\s*(.+?)\s*-->"
CANNOT_FILL = "无法补充"

#: What the model is told; a parameter of every builder.
SYSTEM = {
    "refine": "Repair the format of recognised Markdown. Leave out exact repeats, keep all other wording, page markers and image references. Mark missing content by a GAP comment.",
    "final": "Leave out repeats across segments of this document. Keep all other wording, page markers, GAP comments and image references.",
    "gap": f"Find the missing passage in the recognised text of the pages. Answer with it alone, or with {CANNOT_FILL}.",
    "pii": 'Name persons and organisations in the text, verbatim, as JSON: {"person_names": [...], "org_names": [...]}.',
    "boundary": 'Say where another document begins, as a JSON array: [{"after_page": "...", "new_title": "..."}].',
}

MESSAGE = "array<struct<role:string,content:string>>"


def messages(system: str, user: Column) -> Column:
    part = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(part("system", F.lit(system)), part("user", user))


def block(title: str, body: Column) -> Column:
    """A titled block, or nothing for an empty body."""
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"---{title}---\n"), body, F.lit("\n")))


def refine_prompt(text: Column, index: Column, total: Column, before: Column, after: Column, system: str = SYSTEM["refine"]) -> Column:
    head = F.format_string("请修复以下 OCR 产出的 markdown（第 %d/%d 段）：\n", index, total)
    return messages(system, F.concat(head, block("前段上下文", before), F.lit("---正文开始---\n"), text, F.lit("\n---正文结束---\n"), block("后段上下文", after)))


def final_prompt(text: Column, system: str = SYSTEM["final"]) -> Column:
    return messages(system, F.concat(F.lit("请对以下完整文档做最终去重精修：\n---文档开始---\n"), text, F.lit("\n---文档结束---")))


def gap_prompt(after_image: Column, before: Column, after: Column, page: Column, next_page: Column, next_name: Column, system: str = SYSTEM["gap"]) -> Column:
    following = F.when(next_page.isNotNull() & next_name.isNotNull(), F.concat(F.lit("### 下一页（"), next_name, F.lit("）\n"), next_page, F.lit("\n\n"))).otherwise("")
    user = F.concat(
        F.lit("## 缺口信息\n缺口出现在 "), after_image, F.lit(" 之后。\n\n### 缺口前的内容\n"), before, F.lit("\n\n### 缺口后的内容\n"), after,
        F.lit("\n\n## 相邻页面 OCR 文本\n### 当前页（"), after_image, F.lit("）\n"), page, F.lit("\n\n"), following, F.lit("请提取缺失的内容片段："),
    )
    return messages(system, user)


def detect_prompt(text: Column, kind: str) -> Column:
    """kind: pii or boundary."""
    return messages(SYSTEM[kind], text)


def parse_gaps(c: Column) -> Column:
    """struct<cleaned, gaps>."""
    part = lambda k, name: F.regexp_extract_all(c, F.lit(GAP), F.lit(k)).alias(name)
    return F.struct(F.regexp_replace(c, GAP, "").alias("cleaned"), F.arrays_zip(part(1, "after_image"), part(2, "context_before"), part(3, "context_after")).alias("gaps"))


def parse_boundaries(c: Column) -> Column:
    """struct<cleaned, boundaries>: markers with bad JSON or no page give none, but all are removed."""
    found = F.transform(F.regexp_extract_all(c, F.lit(BOUNDARY), F.lit(1)), lambda j: F.from_json(j, "after_page string, new_title string"))
    good = F.filter(found, lambda b: F.coalesce(b["after_page"], F.lit("")) != "")
    titled = F.transform(good, lambda b: F.struct(b["after_page"].alias("after_page"), F.coalesce(b["new_title"], F.lit("")).alias("new_title")))
    return F.struct(F.regexp_replace(c, BOUNDARY, "").alias("cleaned"), titled.alias("boundaries"))


def first_heading(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1))


def gap_reply(c: Column) -> Column:
    return F.when(c.contains(CANNOT_FILL), F.lit("")).otherwise(F.regexp_replace(c, r"\A\s+|\s+\z", ""))


def boundary_reply(c: Column) -> Column:
    """Boundaries of a JSON array; anything else gives none."""
    items = F.from_json(c, "array<struct<after_page:string,new_title:string>>")
    return F.coalesce(F.filter(items, lambda b: F.coalesce(b["after_page"], F.lit("")) != ""), F.expr("cast(array() as array<struct<after_page:string,new_title:string>>)"))


def entity_reply(c: Column) -> Column:
    """struct<person_names, org_names>, null where the reply isn't JSON: detection has failed."""
    parsed = F.from_json(c, "person_names array<string>, org_names array<string>")
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.try_parse_json(c).isNotNull(), F.struct(F.coalesce(parsed["person_names"], none).alias("person_names"), F.coalesce(parsed["org_names"], none).alias("org_names")))


def is_local(provider: Column) -> Column:
    return provider == "local"


def complete(requests: DataFrame, call: Callable[[list[dict]], tuple[str, str]], config: LLMConfig = LLMConfig(), key: str = "request_id") -> DataFrame:
    """(key, reply, truncated, failed) of (key, messages); ``call`` gives (reply, finish reason).

    At most ``max_concurrent_requests`` tasks call at a time; failures are retried
    ``max_retries`` times, then told by ``failed`` with a null reply.
    """
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, reply string, truncated boolean, failed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, m in zip(frame[key], frame["messages"], strict=True):
                for attempt in range(config.max_retries + 1):
                    try:
                        reply, finish = call([{"role": x["role"], "content": x["content"]} for x in m])
                        rows.append((i, reply, finish == "length", False))
                        break
                    except Exception:  # noqa: BLE001 - whatever a client raises counts as a failed call
                        if attempt == config.max_retries:
                            rows.append((i, None, False, True))
            yield pd.DataFrame(rows, columns=[key, "reply", "truncated", "failed"])

    ship(requests.sparkSession)
    return requests.select(key, "messages").repartition(config.max_concurrent_requests).mapInPandas(run, schema)
