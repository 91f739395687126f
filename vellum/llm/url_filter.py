"""URL filter: expressions of host suffixes and path prefixes, joined on short hashes.

Every URL expands into (host suffix, path prefix) expressions.  They meet the rules in
an equi-join on the first eight hex digits of their SHA-256; the full digest then
confirms the pair, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this count and size are broadcast; more are joined by shuffle, over salted keys.
BROADCAST_RULES, BROADCAST_BYTES = 50_000, 16 << 20
SALTS = 32
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url) -> tuple:
    """(host, path) columns: '' for both where the URL is null or has no '://'."""
    host = F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    rules: (action, host, path).  A rule fits its host and all subdomains if the URL's
    path starts with the rule's path; the longest host plus path wins, then the longer
    host, then block before allow.  Where none fits, rule is null and verdict is
    ``default``.  Null or malformed URLs have empty host and path and so get the default;
    repeated rows each get their row; no rules: all default; no pages: no rows.  URLs of any
    length are read whole.  Existing columns of the four result names are replaced; others stay.
    """
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    rules = rules.where("rule_host is not null and rule_host <> ''").distinct()
    # Bounded facts: as many values as URLs have labels or path characters.
    facts = rules.agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")).alias("bytes"),
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(url))
    parsed = pages.withColumns({"__h": host, "__p": path}).select(*keep, F.col("__h").alias("host"), F.col("__p").alias("path"))
    if not facts["n"]:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    many = facts["n"] > BROADCAST_RULES or facts["bytes"] > BROADCAST_BYTES
    salts = SALTS if many else 1
    digest = lambda h, p: F.sha2(F.concat(h, p), 256)
    keyed = rules.select("*", digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, 8))
    keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if many else keyed.withColumn("salt", F.lit(0))
    # Each different address once: a hot URL is judged once, whatever its share of the rows.
    addresses = parsed.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.filter(
        F.transform(F.array(*map(F.lit, facts["labels"])), lambda k: F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))),
        lambda x: x.isNotNull(),
    )
    prefixes = F.filter(
        F.transform(F.array(*map(F.lit, facts["lengths"])), lambda k: F.when(F.length("path") >= k, F.expr("path").substr(F.lit(1), k))),
        lambda x: x.isNotNull(),
    )
    expressions = (
        addresses.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("prefixes"))
        .select("host", "path", "h", F.explode("prefixes").alias("p"))
        .withColumn("digest", digest(F.col("h"), F.col("p")))
        .withColumn("short", F.substring("digest", 1, 8))
        .withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
        (F.col("action") == "block").cast("int").alias("b"),
    )
    judged = (
        expressions.join(keyed if many else F.broadcast(keyed), ["short", "salt"])
        .where("digest = rule_digest and h = rule_host and p = rule_path")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("won"))
    )
    # Addresses without a host fit no rule: they are dealt by partition, not to one task.
    at = F.when(F.col("host") == "", F.concat(F.lit("/"), F.spark_partition_id().cast("string"))).otherwise(F.col("host"))
    judged = judged.select(F.col("host").alias("__at"), F.col("path").alias("__path"), "won")
    told = parsed.withColumns({"__at": at, "__path": F.col("path")})
    return told.join(judged, ["__at", "__path"], "left").select(
        *keep, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict")
    )
