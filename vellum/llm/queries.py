"""The ten operators as queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, license_scan, near_dedup, packing, pii_scan, quality, secret_scan, topk, url_filter, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that op5 judges by.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.scan_pii(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_top_k, op2_license_scan, op3_best_fit_packing, op4_bpe, op5_url_filter,
        op6_secret_scan, op7_quality, op8_vector_dedup, op9_minhash, op10_pii_scan,
    )
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of symmetric links e(a, b) over nodes n(id): the smallest id reachable.
REACHED = """r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT id, least(id, coalesce(min(r.b), id)) AS component_id FROM n LEFT JOIN r ON r.a = n.id GROUP BY id)"""


def license_sql() -> str:
    """The templates as regular expressions over ``' word  word  '``, the base phrases as places in the list of words."""
    import re

    def pattern(template: str) -> str:
        out = ""
        for mark, plain in license_scan.MARK.findall(template):
            if mark == "beginOptional":
                out += "(?:"
            elif mark == "endOptional":
                out += ")?"
            elif mark:
                out += f"(?: [^ ]+ ){{0,{mark.partition('max=')[2]}}}"
            else:
                out += "".join(f" {re.escape(w.decode())} " for w in license_scan.words_of(plain))
        return out

    every = [*((label, phrase) for phrase, label in license_scan.BASE.items()), *license_scan.TEMPLATES]
    hits = ", ".join(f"CASE WHEN regexp_matches(flat, '{pattern(t)}') THEN {{'label': '{label}', 'm': {license_scan.compile_template(label, t).mandatory}}} END" for label, t in every)
    places = []
    for phrase, label in license_scan.BASE.items():
        equal = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {equal}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
f AS (SELECT *, CASE WHEN len(ws) = 0 THEN '' ELSE ' ' || array_to_string(ws, '  ') || ' ' END AS flat FROM w),
p AS (SELECT doc_id, ws, list_concat({places[0]}, list_concat({", ".join(places[1:])})) AS base, list_filter([{hits}], lambda h: h IS NOT NULL) AS hits FROM f)
SELECT doc_id, len(ws) AS n_words, len(base) AS n_base, list_min(list_transform(base, lambda b: b['at'])) AS first_word, list_max(list_transform(base, lambda b: b['at'])) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(base, lambda b: b['label']))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h['label']))), ','), '') AS labels,
  1 - pow(2.0, -coalesce(list_max(list_transform(hits, lambda h: h['m'])), 0) / 2.0) AS score
FROM p"""


ORACLE = {
    "op2_license_scan": license_sql(),
    "op8_vector_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) >= 0.95),
n AS (SELECT vec_id AS id FROM embeddings), {REACHED}, c AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(links, 0) AS n_links, component_id, id = component_id AS kept FROM k LEFT JOIN c ON a = id""",
    "op9_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id AS id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT id, len(sh) AS n, unnest(sh) AS h FROM s),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS common, any_value(x.n) AS na, any_value(y.n) AS nb FROM u x JOIN u y ON x.h = y.h AND x.id <> y.id GROUP BY x.id, y.id),
e AS (SELECT a, b FROM o WHERE 100 * common >= 85 * (na + nb - common)), n AS (SELECT id FROM s), {REACHED}
SELECT id AS doc_id, len(sh) AS n_shingles, component_id, id = component_id AS kept FROM k JOIN s USING (id)""",
    "op1_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op5_url_filter": r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT u.host, u.path, max_by({'rule': h || p, 'action': action}, length(h || p)) AS won
  FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY ALL)
SELECT page_id, u.host, u.path, won.rule AS rule, coalesce(won.action, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
""",
}
