"""Lines that repeat across a group's pages: document frequency, noise sets, block removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import DedupConfig
from vellum.functions.text import lines, normalize_line, normalized_lines
from vellum.storage import written


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """(group_id, page_seq, line_no, line, norm), one row for each line of each page."""
    return pages.select("group_id", "page_seq", F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("norm", normalize_line(F.col("line")))


def line_frequency(pages: DataFrame, text: str = "text") -> DataFrame:
    """(group_id, norm, n_pages): pages of a group that hold a line; lines of one character don't count.

    A page's distinct lines are taken before anything moves, so counting needs one shuffle of partial counts.
    """
    norms = F.array_distinct(F.filter(normalized_lines(F.col(text)), lambda x: F.length(x) > 1))
    return pages.select("group_id", F.explode(norms).alias("norm")).groupBy("group_id", "norm").agg(F.count("*").alias("n_pages"))


def noise_lines(pages: DataFrame, threshold: float, min_pages: int, text: str = "text") -> DataFrame:
    """(group_id, norm, n_pages) of lines on at least int(pages * threshold) pages of a group of min_pages and more."""
    sizes = pages.groupBy("group_id").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    least = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(threshold)).cast("int"))
    return line_frequency(pages, text).join(sizes, "group_id").where(F.col("n_pages") >= least).select("group_id", "norm", "n_pages")


def noise_flags(norms: Column, noise: Column) -> Column:
    """A string of 0 and 1, one for each line; ``noise`` holds those of the page's own lines that are noise."""
    return F.array_join(F.transform(norms, lambda x: F.when(F.array_contains(noise, x), "1").otherwise("0")), "")


def in_long_runs(flags: Column, least: int) -> Column:
    """Flags with every 1 that stands in a run of ``least`` or more turned to x."""
    places = "|".join(f"(?<=1{{{i}}})1(?=1{{{least - 1 - i}}})" for i in range(least))
    return F.regexp_replace(flags, places, "x")


#: Noise sets of up to this size go to all executors; larger ones meet their pages by shuffle, over salted groups.
BROADCAST_BYTES, SALTS = 16 << 20, 64


def with_noise(pages: DataFrame, noise: DataFrame, key: str) -> DataFrame:
    """``pages`` with a column ``__noise``, null where their group has none; noise: (group_id, norm)."""
    size = noise.agg(F.coalesce(F.sum(F.length("norm") * 4 + 64), F.lit(0))).first()[0]
    sets = noise.groupBy("group_id").agg(F.collect_list("norm").alias("__noise"))
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(sets), "group_id", "left")
    spread = sets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(spread, ["group_id", "__salt"], "left").drop("__salt")


def strip_repeated_lines(pages: DataFrame, config: DedupConfig = DedupConfig(), text: str = "text") -> DataFrame:
    """``pages`` with noise blocks of ``repeated_line_min_block`` and more lines taken out of ``text``, and ``removed``.

    A group's noise set is small whatever its number of pages: each of its lines is on a
    fixed share of them.  The sets are stored and their size is measured before they are broadcast.  A page is
    compared with its group's set once, by hash; its lines then with what they share.
    Pages that lose nothing keep their text as it is.
    """
    noise = written(noise_lines(pages, config.repeated_line_threshold, config.repeated_line_min_pages, text).select("group_id", "norm"), "noise")
    none = F.expr("cast(array() as array<string>)")
    # A page of a group with noise is split and normalised once.
    joined = with_noise(pages, noise, "page_seq").withColumn("__norms", F.when(F.col("__noise").isNotNull(), normalized_lines(F.col(text))))
    told = joined.withColumn("__mine", F.coalesce(F.array_intersect("__norms", "__noise"), none)).drop("__noise")
    flags = F.when(F.size("__mine") == 0, F.lit("")).otherwise(in_long_runs(noise_flags(F.col("__norms"), F.col("__mine")), config.repeated_line_min_block))
    marked = told.withColumn("__flags", flags).withColumn("removed", F.length("__flags") - F.length(F.replace("__flags", F.lit("x"), F.lit(""))))
    kept = F.filter(F.zip_with(lines(F.col(text)), F.split("__flags", r"(?!^)(?!\z)"), lambda x, f: F.when(f != "x", x)), lambda x: x.isNotNull())
    return marked.withColumn(text, F.when(F.col("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))).drop("__mine", "__norms", "__flags")
