"""Every operator as a query over the given tables, with DuckDB SQL where SQL can express it.

``documents`` stand for recognised pages (group: source, order: doc_id), ``events`` for
progress and layout boxes, ``orders`` and ``lineitem`` for tasks and their results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.config import DedupConfig, LLMConfig, PIIConfig
from vellum.functions import pii
from vellum.functions import text as tx
from vellum.operators import assembly, frequency, layout, merge, protocol, segment, tasks
from vellum.sources import files
from vellum.storage import scratch
from vellum.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def joined(c):
    """An array as one string, so that results compare by plain values."""
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("page_seq"), "text")


PAGES = "p AS (SELECT source AS group_id, doc_id AS page_seq, text FROM documents)"
#: Lines and normalised lines of p; a final line feed opens no line.
LINES = (
    PAGES
    + r""",
l0 AS (SELECT group_id, page_seq, text, CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END AS body FROM p WHERE text <> ''),
l AS (SELECT group_id, page_seq, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM l0),
n AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS norm FROM l)"""
)

# Cleaning


GARBAGE_SQL = tx.READABLE.replace(r"\s\x1c-\x1f", r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}").replace("'", "''")


@query(f"SELECT doc_id, regexp_replace(text, '[^{GARBAGE_SQL}]{{2,}}', '', 'g') AS cleaned FROM documents")
def cln_2_garbage(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.remove_garbage(F.col("text"), 2).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS cleaned FROM documents")
def cln_3_blank_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_whitespace(F.replace("text", F.lit(". "), F.lit("\n\n\n\n"))).alias("cleaned"))


@query(f"WITH {LINES} SELECT page_seq AS doc_id, (line_no - 1)::INT AS line_no, norm FROM n")
def cln_4_normalized_lines(spark, sf):
    return frequency.page_lines(pages_of(spark, sf)).select(F.col("page_seq").alias("doc_id"), "line_no", "norm")


#: Paragraphs of one letter each, so that their likeness is that of their lengths; a run of symbols stands inside the last but one.
LIKE_PARTS = "SELECT p_partkey, (p_size + 20)::INT AS a, (p_size + 20 + p_partkey % 9)::INT AS b, (p_size + 22 + p_partkey % 13)::INT AS c FROM part"
LIKE_KEPT = f"""l AS ({LIKE_PARTS}),
k AS (SELECT *, 2 * least(a, b) / (a + b) <= 0.9 AS second FROM l),
t AS (SELECT *, 2 * least(CASE WHEN second THEN b ELSE a END, c) / (CASE WHEN second THEN b ELSE a END + c) <= 0.9 AS third FROM k)"""


def alike_parts(spark, sf):
    x = lambda n: F.expr(f"repeat('x', int({n}))")
    own = F.concat_ws("\n \n", x("p_size + 20"), x("p_size + 20 + p_partkey % 9"), x("p_size + 22 + p_partkey % 13"), F.concat(F.lit("z"), F.expr("repeat('\u2603', 20 + p_size % 5)"), F.lit("w")), F.expr("repeat('\u2603', 40)"), F.lit("end"))
    return table(spark, sf, "part").select("p_partkey", own.alias("text"))


@query(f"""WITH {LIKE_KEPT} SELECT p_partkey, repeat('x', a) || chr(10) || chr(10) || CASE WHEN second THEN repeat('x', b) || chr(10) || chr(10) ELSE '' END || CASE
  WHEN third THEN repeat('x', c) || chr(10) || chr(10) ELSE '' END
  || 'z' || repeat('\u2603', (20 + p_size % 5)::INT) || 'w' || chr(10) || chr(10) || repeat('\u2603', 40) || chr(10) || chr(10) || 'end' AS cleaned FROM t
  JOIN part USING (p_partkey)""")
def cln_1_repetitions(spark, sf):
    """Paragraphs more than nine tenths like the last one kept go."""
    return alike_parts(spark, sf).select("p_partkey", merge.remove_repetitions(F.col("text")).alias("cleaned"))


@query()
def cln_1_repetitions_of_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", merge.remove_repetitions(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("cleaned"))


@query(r"""WITH p AS (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p), t AS (SELECT *, regexp_replace(part, '^\s+|\s+$', '', 'g') AS s FROM u),
k AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM t)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY i) AS cleaned FROM k WHERE i = 1 OR s = '' OR s <> before GROUP BY doc_id""")
def cln_1_exact_repeats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.drop_exact_repeats(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("cleaned"))


@query(f"""WITH {LIKE_KEPT} SELECT p_partkey, repeat('x', a) || chr(10) || chr(10) || CASE WHEN second THEN repeat('x', b) || chr(10) || chr(10) ELSE '' END || CASE
  WHEN third THEN repeat('x', c) || chr(10) || chr(10) ELSE '' END
  || 'zw' || chr(10) || chr(10) || 'end' AS cleaned FROM t""")
def cln_0_clean(spark, sf):
    """Repetitions, then runs of symbols, then blank lines, of which the symbols' paragraph leaves four."""
    return alike_parts(spark, sf).select("p_partkey", tx.normalize_whitespace(tx.remove_garbage(merge.remove_repetitions(F.col("text")))).alias("cleaned"))


@query()
def cln_0_clean_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_whitespace(tx.remove_garbage(merge.remove_repetitions(F.col("text")))).alias("cleaned"))


# Lines that repeat across pages

DEMO = DedupConfig(repeated_line_threshold=0.05, repeated_line_min_block=1)
COUNTED = LINES + ", f AS (SELECT group_id, norm, count(DISTINCT page_seq) AS n_pages FROM n WHERE length(norm) > 1 GROUP BY ALL)"
NOISE = COUNTED + """, g AS (SELECT group_id, count(*) AS total FROM p GROUP BY ALL), z AS (SELECT group_id, norm, n_pages FROM f JOIN g USING (group_id) WHERE total >= 4
  AND n_pages >= greatest(1, floor(total * 0.05)))"""


def removal(block: int) -> str:
    return f"""WITH {NOISE},
m AS (SELECT n.*, z.norm IS NOT NULL AS noise FROM n LEFT JOIN z USING (group_id, norm)),
i AS (SELECT *, line_no - row_number() OVER (PARTITION BY group_id, page_seq, noise ORDER BY line_no) AS island FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY group_id, page_seq, noise, island) AS run FROM i),
k AS (SELECT group_id, page_seq, count_if(noise AND run >= {block}) AS removed,
  coalesce(string_agg(CASE WHEN NOT (noise AND run >= {block}) THEN line END, chr(10) ORDER BY line_no), '') AS rest FROM c GROUP BY ALL)
SELECT group_id, page_seq, CASE WHEN coalesce(removed, 0) > 0 THEN rest ELSE text END AS text, coalesce(removed, 0)::INT AS removed FROM p LEFT
  JOIN k USING (group_id, page_seq)"""


@query("SELECT source AS group_id, count(*) AS n_pages, count(*) >= 4 AS counted FROM documents GROUP BY source")
def frq_1_page_gate(spark, sf):
    return pages_of(spark, sf).groupBy("group_id").agg(F.count("*").alias("n_pages")).withColumn("counted", F.col("n_pages") >= DEMO.repeated_line_min_pages)


@query(f"WITH {COUNTED} SELECT * FROM f")
def frq_2_line_frequency(spark, sf):
    return frequency.line_frequency(pages_of(spark, sf))


@query(f"WITH {NOISE} SELECT * FROM z")
def frq_3_noise_lines(spark, sf):
    return frequency.noise_lines(pages_of(spark, sf), DEMO.repeated_line_threshold, DEMO.repeated_line_min_pages)


@query(removal(1))
def frq_filtered_pages(spark, sf):
    return frequency.strip_repeated_lines(pages_of(spark, sf), DEMO)


@query(removal(2))
def frq_4_block_removal(spark, sf):
    return frequency.strip_repeated_lines(pages_of(spark, sf), DedupConfig(repeated_line_threshold=0.05, repeated_line_min_block=2))


@query("SELECT source AS group_id, doc_id AS page_seq, text, 0 AS removed FROM documents")
def frq_5_defaults_keep_text(spark, sf):
    return frequency.strip_repeated_lines(pages_of(spark, sf))


# Merging


def marked(spark, sf):
    own = F.concat(F.lit("<!-- page: p"), F.col("doc_id").cast("string"), F.lit(" -->\n"), F.col("text"), F.lit("\n<!-- page: end -->"))
    return table(spark, sf, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("page_seq"), own.alias("text"))


MARKED = r"""WITH p AS (SELECT source AS group_id, doc_id AS page_seq, '<!-- page: p' || doc_id || ' -->' || chr(10) || text || chr(10) || '<!-- page: end -->' AS text
  FROM documents),
l AS (SELECT group_id, page_seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM p)"""


@query(MARKED + """ SELECT group_id, page_seq, line_no::INT AS line_no, line, starts_with(line, '<!-- page:')
  AS is_marker, (sum((NOT starts_with(line, '<!-- page:'))::INT) OVER (PARTITION BY group_id, page_seq
  ORDER BY line_no) - (NOT starts_with(line, '<!-- page:'))::INT)::BIGINT AS position FROM l""")
def mrg_1_markers(spark, sf):
    return merge.page_lines_without_markers(marked(spark, sf))


@query(f"""WITH {LINES},
s AS (SELECT group_id, page_seq, line, line_no - 1 AS k, count(*) OVER (PARTITION BY group_id, page_seq) AS n FROM l),
x AS (SELECT group_id, page_seq, lead(page_seq) OVER (PARTITION BY group_id ORDER BY page_seq) AS nxt FROM p),
a AS (SELECT s.*, nxt, k - (n - greatest(1, floor(n * 0.7))) AS i FROM s JOIN x USING (group_id, page_seq) WHERE nxt IS NOT NULL AND k >= n - greatest(1, floor(n * 0.7))),
h AS (SELECT *, k AS j FROM s WHERE k < greatest(1, floor(n * 0.7))),
m AS (SELECT a.group_id, a.page_seq, a.line, a.i, h.j, a.i - h.j AS d FROM a JOIN h ON a.group_id = h.group_id AND a.nxt = h.page_seq AND a.line = h.line),
r AS (SELECT *, i - row_number() OVER (PARTITION BY group_id, page_seq, d ORDER BY i) AS island FROM m),
b AS (SELECT group_id, page_seq, min(i) AS i, min(j) AS j, count(*) AS size, count_if(trim(line) <> '') AS non_blank FROM r GROUP BY group_id, page_seq, d, island),
w AS (SELECT *, row_number() OVER (PARTITION BY group_id, page_seq ORDER BY size DESC, i, j) AS turn FROM b)
SELECT group_id, page_seq, i::INT AS tail_start, j::INT AS head_start, size, non_blank::BIGINT AS non_blank, non_blank >= 2 AS accepted FROM w WHERE turn = 1""")
def mrg_2_adjacent_overlap(spark, sf):
    return merge.adjacent_overlap(pages_of(spark, sf))


ADJACENT = ORACLE["mrg_2_adjacent_overlap"].rpartition("SELECT group_id")[0]


@query(ADJACENT + """, o AS (SELECT * FROM w WHERE turn = 1 AND non_blank >= 2),
q AS (SELECT group_id, page_seq, text AS a, lead(text) OVER (PARTITION BY group_id ORDER BY page_seq) AS b FROM p),
s2 AS (SELECT q.*, string_split(CASE WHEN a LIKE '%' || chr(10) THEN a[:-2] ELSE a END, chr(10)) AS la, string_split(CASE WHEN b LIKE '%' || chr(10) THEN b[:-2]
  ELSE b END, chr(10)) AS lb FROM q WHERE b IS NOT NULL)
SELECT group_id, page_seq, CASE WHEN o.size IS NULL THEN a || chr(10) || chr(10) || b
  ELSE array_to_string(list_concat(la[:(len(la) - greatest(1, floor(len(la) * 0.7)) + o.i + o.size)::BIGINT], lb[(o.j + o.size + 1)::BIGINT:]), chr(10)) END AS text,
  coalesce(o.size, 0) AS overlap_lines, CASE WHEN o.size IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity FROM s2 LEFT JOIN o USING (group_id, page_seq)""")
def mrg_5_merge_adjacent(spark, sf):
    """Rules for accepting a block, for joining pages without one, and for what is kept around one."""
    return merge.merge_adjacent(pages_of(spark, sf))


#: The longest block of lines that pages x(id, a, b) of lines share, as mrg_2 has it; o holds the accepted ones.
SHARED = """s AS (SELECT id, len(a) AS na, len(b) AS nb, greatest(1, floor(len(a) * 0.7))::BIGINT AS ta, greatest(1, floor(len(b) * 0.7))::BIGINT AS tb, a, b FROM x),
ua AS (SELECT id, na, ta, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM s), ub AS (SELECT id, tb, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS j
  FROM s),
m AS (SELECT ua.id, ua.line, i, j, i - j AS d FROM ua JOIN ub ON ua.id = ub.id AND ua.line = ub.line WHERE i >= na - ta AND j < tb),
r AS (SELECT *, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS island FROM m),
g AS (SELECT id, min(i) AS i, min(j) AS j, count(*) AS size, count_if(trim(line) <> '') AS solid FROM r GROUP BY id, d, island),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, i, j) AS turn FROM g),
o AS (SELECT s.*, w.size, w.i + w.size AS ea, w.j + w.size AS eb, list_concat(a[:w.i + w.size], b[w.j + w.size + 1:]) AS c FROM s JOIN w USING (id) WHERE turn = 1
  AND solid >= 2)"""


def marked_pairs(spark, sf):
    pages = marked(spark, sf).withColumn("group_id", F.lit("all"))
    return merge.neighbours(pages).select(F.col("page_seq").alias("pair_id"), F.col("a").alias("text_a"), F.col("b").alias("text_b"))


#: Markers at the ends of both pages: A's keep their places among the merged lines, B's come after what B adds.
@query(f"""WITH p AS (SELECT doc_id, text, lead(doc_id) OVER (ORDER BY doc_id) AS nid, lead(text) OVER (ORDER BY doc_id) AS ntext FROM documents),
x AS (SELECT doc_id AS id, string_split(text, chr(10)) AS a, string_split(ntext, chr(10)) AS b, text, ntext, nid FROM p WHERE nid IS NOT NULL), {SHARED},
q AS (SELECT *, len(c) AS n, least(na, len(c)) AS p2 FROM o),
q3 AS (SELECT *, greatest(p2, least(na - eb, n)) AS p3 FROM q), q4 AS (SELECT *, greatest(p3, least(na + nb - eb, n)) AS p4 FROM q3)
SELECT x.id AS pair_id, CASE WHEN q4.size IS NULL THEN '<!-- page: p' || x.id || ' -->' || chr(10) || text || chr(10) || '<!-- page: end -->' || chr(10) || chr(10) ||
  '<!-- page: p' || nid || ' -->' || chr(10) || ntext || chr(10) || '<!-- page: end -->'
  ELSE array_to_string(list_concat(['<!-- page: p' || x.id || ' -->'], list_concat(c[:p2], list_concat(['<!-- page: end -->'], list_concat(c[p2 + 1:p3],
  list_concat(['<!-- page: p' || nid || ' -->'], list_concat(c[p3 + 1:p4], list_concat(['<!-- page: end -->'], c[p4 + 1:]))))))), chr(10)) END AS text,
  coalesce(q4.size, 0)::BIGINT AS overlap_lines, CASE WHEN q4.size IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity FROM x LEFT JOIN q4 ON q4.id = x.id""")
def mrg_7_merge_pairs(spark, sf):
    """Neighbouring pages with markers at both ends."""
    return merge.merge_pairs(marked_pairs(spark, sf))


def pages_of_two(spark, sf):
    """Documents two by two, each with an image of the same name."""
    group = F.floor(F.col("doc_id") / 2).cast("string")
    own = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("![](images/0.jpg)\n"), "text"))
    raw = F.concat(F.lit("![](images/0.jpg)\n"), "text")
    return table(spark, sf, "documents").select(
        group.alias("group_id"), F.col("doc_id").alias("page_seq"), F.format_string("p%d.jpg", "doc_id").alias("image_name"), own.alias("cleaned"), raw.alias("raw"),
        F.when(F.col("doc_id") % 3 == 0, F.format_string("p%d_cropped_OCR", "doc_id")).alias("ocr_dir"), F.array(F.struct(F.col("doc_id").alias("page"), F.lit(0).alias("k"))).alias("regions"),
    )


@query(f"""WITH d AS (SELECT doc_id, doc_id // 2 AS g, '![](p' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_cropped' ELSE '' END || '_OCR/images/0.jpg)' || chr(10) || text
  AS t FROM documents),
l AS (SELECT *, string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)) AS ls FROM d),
y AS (SELECT f.doc_id, f.g, f.t AS first_text, f.ls AS a, n.doc_id AS nid, n.t AS next_text, n.ls AS b FROM l f LEFT JOIN l n ON n.g = f.g AND n.doc_id = f.doc_id + 1
  WHERE f.doc_id % 2 = 0),
x AS (SELECT g AS id, a, b FROM y WHERE nid IS NOT NULL), {SHARED}, q AS (SELECT *, greatest(0, least(na - eb, len(c))) AS p FROM o)
SELECT g::VARCHAR AS group_id, rtrim(CASE WHEN nid IS NULL THEN '<!-- page: p' || doc_id || '.jpg -->' || chr(10) || first_text
  WHEN q.size IS NULL THEN '<!-- page: p' || doc_id || '.jpg -->' || chr(10) || first_text || chr(10) || chr(10) || '<!-- page: p' || nid || '.jpg -->' || chr(10) ||
  next_text
  ELSE array_to_string(list_concat(['<!-- page: p' || doc_id || '.jpg -->'], list_concat(c[:p], list_concat(['<!-- page: p' || nid || '.jpg -->'], c[p + 1:]))), chr(10))
  END, chr(10)) AS markdown,
  CASE WHEN nid IS NULL THEN 1 ELSE 2 END::BIGINT AS n_pages, coalesce(q.size, 0)::BIGINT AS overlap_lines FROM y LEFT JOIN q ON q.id = y.g""")
def mrg_8_merge_pages(spark, sf):
    """Cleaned texts, or raw ones where they are empty; images of one name keep apart by their pages' folders."""
    return merge.merge_pages(pages_of_two(spark, sf), text="cleaned", raw="raw", ocr_dir="ocr_dir")


@query("SELECT (doc_id // 2)::VARCHAR AS group_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS images FROM documents GROUP BY ALL")
def mrg_8_merged_images(spark, sf):
    return merge.merged_images(pages_of_two(spark, sf)).select("group_id", joined(F.transform("images", lambda r: r["page"])).alias("images"))


@query()
def mrg_8_merge_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("group_id"), F.col("turn").alias("page_seq"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".jpg")).alias("image_name"), "text")
    return merge.merge_pages(turns)


@query("""SELECT doc_id, replace(replace('![x](images/0.jpg) <img src=\"images/1.jpg\">' || text, '](images/', '](p' || doc_id || '_OCR/images/'), 'src=\"images/',
  'src=\"p' || doc_id || '_OCR/images/') AS text FROM documents""")
def mrg_9_image_refs(spark, sf):
    docs = table(spark, sf, "documents")
    own = F.concat(F.lit('![x](images/0.jpg) <img src="images/1.jpg">'), F.col("text"))
    return docs.select("doc_id", tx.rewrite_page_images(own, F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("_OCR"))).alias("text"))


# Segmentation


def headed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# T\n"), F.replace("text", F.lit(". "), F.lit("\n## H\n"))).alias("markdown"))


@query(r"""WITH d AS (SELECT doc_id, '# T' || chr(10) || replace(text, '. ', chr(10) || '## H' || chr(10)) AS m FROM documents),
b AS (SELECT doc_id, CASE WHEN m LIKE '%' || chr(10) THEN m[:-2] ELSE m END AS m FROM d),
l AS (SELECT doc_id, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS i FROM b),
c AS (SELECT *, sum((i > 1 AND regexp_matches(line, '^#{1,6}\s+'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM l)
SELECT doc_id, chunk::BIGINT AS chunk, min(i)::INT AS start_line, max(i)::INT AS end_line, sum(length(line))::BIGINT AS chars FROM c GROUP BY ALL""")
def seg_1_heading_chunks(spark, sf):
    return segment.heading_chunks(headed(spark, sf))


def segment_sql(markdown: str, most: int, context: int = 5) -> str:
    """Headings, cuts at blank lines, joined neighbours, context: the folds over a document's lines and pieces are reductions of lists."""
    return f"""WITH d AS (SELECT doc_id, {markdown} AS m FROM documents),
k AS (SELECT doc_id, m, string_split(CASE WHEN m LIKE '%' || chr(10) THEN m[:-2] ELSE m END, chr(10)) AS ls FROM d
  WHERE trim(m, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
l AS (SELECT doc_id, length(m) > {most} AS long, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, m LIKE '%' || chr(10) AS ended FROM k),
z AS (SELECT *, length(line) + (i < n OR ended)::INT AS size, trim(line) = '' AS blank, i = 1 OR regexp_matches(line, '^#{{1,6}}\\s+') AS head FROM l),
c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM z),
b AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, chunk) > {most} AS big FROM c),
-- Blank lines after which a chunk is cut: where what was held since the last cut reaches the bound.
r AS (SELECT doc_id, list_reduce(list_prepend({{'i': 0::BIGINT, 'size': 0::HUGEINT, 'blank': false, 'head': false, 'big': false, 'cuts': []::BIGINT[], 'now': false}},
    list({{'i': i::BIGINT, 'size': size::HUGEINT, 'blank': blank, 'head': head, 'big': big, 'cuts': []::BIGINT[], 'now': false}} ORDER BY i)),
  lambda a, x: {{'i': x.i, 'size': CASE WHEN x.head OR a.now THEN x.size ELSE a.size + x.size END, 'blank': x.blank, 'head': x.head, 'big': x.big,
    'cuts': CASE WHEN x.big AND x.blank AND CASE WHEN x.head OR a.now THEN x.size ELSE a.size + x.size END >= {most} THEN list_append(a.cuts, x.i) ELSE a.cuts END,
    'now': x.big AND x.blank AND CASE WHEN x.head OR a.now THEN x.size ELSE a.size + x.size END >= {most}}}).cuts AS cuts FROM b WHERE long GROUP BY doc_id),
p AS (SELECT b.*, sum((head OR list_contains(cuts, i - 1))::INT) OVER (PARTITION BY b.doc_id ORDER BY i) AS piece FROM b JOIN r USING (doc_id)),
g AS (SELECT doc_id, piece, min(i) AS first, sum(size) AS n FROM p GROUP BY ALL),
-- Neighbours are joined while one of them is small and both fit.
j AS (SELECT doc_id, list_reduce(list_prepend({{'first': 0::BIGINT, 'n': -1::HUGEINT, 'starts': []::BIGINT[]}}, list({{'first': first::BIGINT, 'n': n::HUGEINT, 'starts':
  []::BIGINT[]}} ORDER BY piece)),
  lambda a, x: CASE WHEN a.n >= 0 AND least(a.n, x.n) < {most // 4} AND a.n + x.n <= {most} THEN {{'first': a.first, 'n': a.n + x.n, 'starts': a.starts}}
    ELSE {{'first': x.first, 'n': x.n, 'starts': list_append(a.starts, x.first)}} END).starts AS starts FROM g GROUP BY doc_id),
s AS (SELECT doc_id, unnest(starts) AS start_line, generate_subscripts(starts, 1) - 1 AS seg_idx, unnest(list_append(starts[2:], len(ls) + 1)) - 1 AS end_line, len(starts)
  AS total, ls, m LIKE '%' || chr(10) AS ended FROM j JOIN k USING (doc_id)),
t AS (SELECT *, rtrim(array_to_string(ls[start_line:end_line], chr(10)), chr(10)) AS body, CASE WHEN seg_idx > 0 AND {context} > 0
  THEN rtrim(array_to_string(ls[greatest(1, start_line - {context}):start_line - 1], chr(10)), chr(10)) || chr(10) ELSE '' END AS before,
  CASE WHEN seg_idx < total - 1 AND {context} > 0 THEN chr(10) || rtrim(array_to_string(ls[end_line + 1:end_line + {context}], chr(10)), chr(10)) ELSE '' END AS after
  FROM s)
SELECT doc_id, seg_idx::INT AS seg_idx, before || body || after AS text, start_line::INT AS start_line, end_line::INT AS end_line FROM t
UNION ALL SELECT doc_id, 0, m, 1, len(ls)::INT FROM k WHERE length(m) <= {most}"""


@query(segment_sql("text", 8000))
def seg_0_all_documents(spark, sf):
    """Long documents too, with the defaults of production."""
    return segment.segment(table(spark, sf, "documents").select("doc_id", F.col("text").alias("markdown")))


@query(segment_sql("replace(text, '. ', '.' || chr(10) || chr(10))", 600))
def seg_2_blank_line_cuts(spark, sf):
    return segment.segment(table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("markdown")), max_chars=600)


@query(segment_sql("'# T' || chr(10) || replace(text, '. ', chr(10) || '## H' || chr(10))", 1200, 0))
def seg_3_joined_neighbours(spark, sf):
    return segment.segment(headed(spark, sf), max_chars=1200, context=0)


@query(segment_sql("'# T' || chr(10) || replace(text, '. ', chr(10) || '## H' || chr(10))", 1200))
def seg_4_segments(spark, sf):
    return segment.segment(headed(spark, sf), max_chars=1200)


# Personal data

EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LUHN_SQL = "list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * reverse({d})[i + 1]::INT > 9 THEN 2 * reverse({d})[i + 1]::INT - 9 ELSE 2 * reverse({d})[i + 1]::INT END) ELSE reverse({d})[i + 1]::INT END)) % 10 = 0"


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[邮箱]', 'g') AS text, len(regexp_extract_all(text, '{EMAIL_SQL}'))::INT AS n FROM documents")
def pii_2_email(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pii.replaced(F.col("text"), pii.EMAIL_ONCE, PIIConfig.email_placeholder).alias("r")).select("doc_id", "r.*")


@query(f"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS digits FROM documents)
  SELECT doc_id, digits, {LUHN_SQL.format(d='digits')} AS valid FROM d""")
def pii_5_luhn(spark, sf):
    runs = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("digits"))
    return runs.withColumn("valid", pii.luhn(F.col("digits")))


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19) AS runs FROM documents)
  SELECT doc_id, len(list_filter(runs, lambda x: {LUHN_SQL.format(d='x').replace('lambda i', 'lambda i')}))::INT AS n FROM d""")
def pii_4_bank_card(spark, sf):
    done = pii.replaced_cards(F.col("text"), PIIConfig.bank_card_placeholder)
    return table(spark, sf, "documents").select("doc_id", done["n"].alias("n"))


def with_numbers(spark, sf):
    """Documents with an identity card and a phone of their own after the text."""
    own = F.concat("text", F.format_string(" 11010519491231%03dX 138%08d", F.col("doc_id") % 1000, "doc_id"))
    return table(spark, sf, "documents").select("doc_id", own.alias("text"))


#: E-mails, then runs of 16 to 19 digits that pass the check, in d(doc_id, text); the documents' own phones and identity cards have none of their forms.
REDACTED = f"""m AS (SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[邮箱]', 'g') AS t, len(regexp_extract_all(text, '{EMAIL_SQL}')) AS emails FROM documents),
n AS (SELECT doc_id, t, emails, string_split_regex(t, '[0-9]+') AS gaps, list_append(regexp_extract_all(t, '[0-9]+'), '') AS runs FROM m),
h AS (SELECT doc_id, emails, gaps, list_transform(runs, lambda x: CASE WHEN length(x) BETWEEN 16 AND 19 AND {LUHN_SQL.format(d="x")} THEN '[银行卡号]' ELSE x END) AS runs
  FROM n),
v AS (SELECT doc_id, emails, len(list_filter(runs, lambda x: x = '[银行卡号]')) AS cards, array_to_string(list_transform(list_zip(gaps, runs), lambda z: z[1] || z[2]), '')
  AS text FROM h)"""


@query(f"""WITH {REDACTED} SELECT doc_id, text || ' [身份证号] [手机号]' AS text,
  array_to_string(list_filter(['id_card=1', CASE WHEN emails > 0 THEN 'email=' || emails END, 'phone=1', CASE WHEN cards > 0
  THEN 'bank_card=' || cards END], lambda x: x IS NOT NULL), ',') AS records FROM v""")
def pii_0_structured(spark, sf):
    return with_numbers(spark, sf).select("doc_id", pii.redact_structured(F.col("text")).alias("r")).select("doc_id", "r.text", joined(F.transform("r.records", lambda x: F.concat_ws("=", x["kind"], x["count"]))).alias("records"))


@query("""WITH t AS (SELECT c_custkey, c_custkey % 2 AS lead, 1880 + c_custkey % 260 AS y, c_custkey % 15 AS m, c_custkey % 36 AS d, CASE c_custkey % 4 WHEN 0 THEN 'x'
  WHEN 1 THEN 'X' WHEN 2 THEN '7' ELSE '77' END AS tail FROM customer),
k AS (SELECT c_custkey, c_name, lead::VARCHAR || '10105' || y || lpad(m::VARCHAR, 2, '0') || lpad(d::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || tail
  AS id, lead = 1 AND y BETWEEN 1900 AND 2099 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND length(tail) = 1 AS ok FROM t JOIN customer USING (c_custkey))
SELECT c_custkey, 'a' || CASE WHEN ok THEN '[身份证号]' ELSE id END || 'b ' || c_name AS text, ok::INT AS n FROM k""")
def pii_1_id_card(spark, sf):
    """Leading digit, century, month, day, last sign and digits around it, right and wrong."""
    key = F.col("c_custkey")
    tail = F.element_at(F.array(*map(F.lit, ("x", "X", "7", "77"))), (key % 4 + 1).cast("int"))
    own = F.concat(F.format_string("a%d10105%d%02d%02d%03d", key % 2, 1880 + key % 260, key % 15, key % 36, key % 1000), tail, F.lit("b "), "c_name")
    return table(spark, sf, "customer").select("c_custkey", pii.replaced(own, pii.ID_CARD, PIIConfig.id_card_placeholder).alias("r")).select("c_custkey", "r.*")


@query("""WITH t AS (SELECT c_custkey, ['', '+86 ', '86-', '+86', '0'][c_custkey % 5 + 1] AS before, ['', ' ', '-', '_'][c_custkey % 4 + 1] AS sep, c_custkey % 10
  AS third, ['', '9', ' 9'][c_custkey % 3 + 1] AS after FROM customer),
k AS (SELECT *, before || '1' || third || '7' || sep || '1234' || sep || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || after AS phone, before <> '0' AND sep <> '_'
  AND third >= 3 AND after <> '9' AS ok FROM t)
SELECT c_custkey, 'tel ' || CASE WHEN ok THEN '[手机号]' || after ELSE phone END || '.' AS text, ok::INT AS n FROM k""")
def pii_3_phone(spark, sf):
    """Country codes, separators, third digits and digits around it, right and wrong."""
    key = F.col("c_custkey")
    one = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (key % n + 1).cast("int"))
    before, sep, after = one(("", "+86 ", "86-", "+86", "0"), 5), one(("", " ", "-", "_"), 4), one(("", "9", " 9"), 3)
    own = F.concat(F.lit("tel "), before, F.lit("1"), (key % 10).cast("string"), F.lit("7"), sep, F.lit("1234"), sep, F.format_string("%04d", key % 10000), after, F.lit("."))
    return table(spark, sf, "customer").select("c_custkey", pii.replaced(own, pii.PHONE, PIIConfig.phone_placeholder, pii.phone_holds).alias("r")).select("c_custkey", "r.*")


COUNT_SQL = "((length({t}) - length(replace({t}, '{w}', ''))) / {n})::INT"


@query(f"""WITH a AS (SELECT doc_id, replace(text, 'their', '[N]') AS t1, {COUNT_SQL.format(t='text', w='their', n=5)} AS n1 FROM documents),
b AS (SELECT doc_id, replace(t1, 'the', '[N]') AS text, n1 + {COUNT_SQL.format(t='t1', w='the', n=3)} AS n FROM a) SELECT * FROM b""")
def pii_6_lexicon(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pii.replace_words(F.col("text"), ["the", "", "their"], "[N]").alias("r")).select("doc_id", "r.*")


@query(f"""WITH a AS (SELECT doc_id, replace(text, 'and', '[人名]') AS t1, {COUNT_SQL.format(t='text', w='and', n=3)} AS persons FROM documents)
SELECT doc_id, replace(t1, 'of', '[机构名]') AS text, persons, {COUNT_SQL.format(t='t1', w='of', n=2)} AS orgs FROM a""")
def pii_7_entities(spark, sf):
    words = lambda *w: F.array(*map(F.lit, w))
    done = table(spark, sf, "documents").select("doc_id", pii.redact_entities(F.col("text"), words("and"), words("of")).alias("r"))
    count = lambda kind: F.coalesce(F.get(F.filter("r.records", lambda x: x["kind"] == kind), F.lit(0))["count"], F.lit(0))
    return done.select("doc_id", "r.text", count("person_name").alias("persons"), count("org_name").alias("orgs"))


CUSTOM = (("the", "[A]"), ("there", "[A]"), ("and", ""), ("", "x"))


@query(f"""WITH a AS (SELECT doc_id, replace(text, 'there', '[A]') AS t1, {COUNT_SQL.format(t='text', w='there', n=5)} AS n1 FROM documents),
b AS (SELECT doc_id, replace(t1, 'the', '[A]') AS t2, n1 + {COUNT_SQL.format(t='t1', w='the', n=3)} AS coded FROM a)
SELECT doc_id, replace(t2, 'and', '[敏感词]') AS text, coded, {COUNT_SQL.format(t='t2', w='and', n=3)} AS plain FROM b""")
def pii_8_custom_words(spark, sf):
    done = table(spark, sf, "documents").select("doc_id", pii.redact_custom(F.col("text"), CUSTOM).alias("r"))
    count = lambda k: F.coalesce(F.try_element_at("r.counts", F.lit(k)), F.lit(0))
    return done.select("doc_id", "r.text", count("[A]").alias("coded"), count("[敏感词]").alias("plain"))


@query(f"""WITH {REDACTED},
a AS (SELECT *, doc_id % 2 = 1 AS failed, CASE WHEN doc_id % 2 = 0 THEN {COUNT_SQL.format(t="text", w="and", n=3)} ELSE 0 END AS persons, CASE WHEN doc_id % 2 = 0
  THEN replace(text, 'and', '[人名]') ELSE text END AS t1 FROM v)
SELECT doc_id, failed, array_to_string(list_filter([CASE WHEN emails > 0 THEN 'email=' || emails END, CASE WHEN cards > 0 THEN 'bank_card=' || cards END, CASE
  WHEN persons > 0 THEN 'person_name=' || persons END], lambda x: x IS NOT NULL), ',') AS records,
  replace(replace(replace(t1, 'there', '[A]'), 'the', '[A]'), 'and', '[敏感词]') AS text FROM a""")
def pii_9_full_redaction(spark, sf):
    """Patterns, then detected entities of a stand-in for the model, then custom words."""
    words = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("and")))
    none = F.expr("cast(array() as array<string>)")
    first = table(spark, sf, "documents").select("doc_id", words.alias("persons"), pii.redact_structured(F.col("text")).alias("a"))
    second = first.select("doc_id", "a", F.col("persons").isNull().alias("failed"), pii.redact_entities(F.col("a.text"), F.coalesce("persons", none), none).alias("b"))
    return second.select("doc_id", "failed", joined(F.transform(F.concat("a.records", "b.records"), lambda x: F.concat_ws("=", x["kind"], x["count"]))).alias("records"), pii.redact_custom(F.col("b.text"), CUSTOM).alias("c")).select("doc_id", "failed", "records", "c.text")


@query(f"SELECT item_id, replace(regexp_replace(text, '{EMAIL_SQL}', '[邮箱]', 'g'), 'the', '[敏感词]') AS text FROM benchmark")
def pii_10_snippets(spark, sf):
    own = pii.redact_structured(F.col("text"), PIIConfig(phone=False, id_card=False, bank_card=False))["text"]
    return table(spark, sf, "benchmark").select("item_id", pii.redact_custom(own, (("the", ""),))["text"].alias("text"))


@query("SELECT doc_id, quality = 0 AS blocked FROM labels")
def pii_11_cloud_block(spark, sf):
    return table(spark, sf, "labels").select("doc_id", pii.cloud_blocked(True, False, F.col("quality") == 0, True).alias("blocked"))


@query("SELECT doc_id, quality = 1 OR toxic > 0 AS phase FROM labels")
def pii_12_phase(spark, sf):
    return table(spark, sf, "labels").select("doc_id", pii.phase_on(F.col("quality") == 1, F.col("toxic")).alias("phase"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: w || '='), ',') AS words FROM documents")
def pii_13_word_list(spark, sf):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", joined(F.transform(F.transform(words, lambda w: F.struct(w.alias("word"), F.lit("").alias("code"))), lambda w: F.concat(w["word"], F.lit("="), w["code"]))).alias("words"))


# Layout: boxes from events, one page for each user and day


def regions_of(spark, sf):
    e = table(spark, sf, "events")
    x1 = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 60).when(F.col("event_id") % 3 == 1, 820 + F.col("event_id") % 40).otherwise(230 + F.col("event_id") % 200)
    wide = F.when(F.col("event_id") % 3 == 2, 300 + F.col("event_id") % 500).otherwise(90 + F.col("event_id") % 50)
    return e.select(
        (F.col("user_id") % 500).alias("page_id"), F.col("event_id").alias("ord"), F.lit("text").alias("label"), x1.cast("int").alias("x1"), (F.col("event_id") * 7 % 900).cast("int").alias("y1"),
        (x1 + wide).cast("int").alias("x2"), (F.col("event_id") * 7 % 900 + 20).cast("int").alias("y2"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("raw_block"),
    )


REGIONS = """r0 AS (SELECT user_id % 500 AS page_id, event_id AS ord, CASE event_id % 3 WHEN 0 THEN event_id % 60 WHEN 1 THEN 820 + event_id % 40
  ELSE 230 + event_id % 200 END AS x1,
  event_id * 7 % 900 AS y1, CASE event_id % 3 WHEN 2 THEN 300 + event_id % 500 ELSE 90 + event_id % 50 END AS w FROM events),
r AS (SELECT page_id, ord, 'text' AS label, x1::INT AS x1, y1::INT AS y1, (x1 + w)::INT AS x2, (y1 + 20)::INT AS y2, 'b' || ord AS raw_block FROM r0)"""
SIDES = (
    REGIONS
    + """, c AS (SELECT *, x1 < 100 AND x2 <= 220 AS lc, x1 >= 800 AND x2 - x1 < 200 AS rc, x2 - x1 < 700 AS narrow FROM r WHERE y1 >= 80),
f AS (SELECT page_id, CASE WHEN count_if(lc) >= 5 AND max(CASE WHEN lc THEN y2 END) - min(CASE WHEN lc THEN y1 END) >= 300 THEN max(CASE WHEN lc THEN x2 END) + 20 END
  AS lb,
  CASE WHEN count_if(rc) >= 5 AND max(CASE WHEN rc THEN y2 END) - min(CASE WHEN rc THEN y1 END) >= 300 THEN min(CASE WHEN rc THEN x1 END) - 20 END AS rb FROM c
  GROUP BY page_id),
x AS (SELECT page_id, any_value(lb) AS lb, any_value(rb) AS rb, count_if(NOT lc AND narrow AND x1 < lb) AS cl, count_if(NOT lc AND narrow) AS nl, count_if(NOT rc
  AND narrow AND x2 > rb) AS cr, count_if(NOT rc AND narrow) AS nr
  FROM c JOIN f USING (page_id) GROUP BY page_id),
b AS (SELECT page_id, coalesce(CASE WHEN lb IS NOT NULL AND cl < greatest(3, nl * 0.3) THEN lb END, 0)::INT AS left_boundary, coalesce(CASE WHEN rb IS NOT NULL
  AND cr < greatest(3, nr * 0.3) THEN rb END, 999)::INT AS right_boundary,
  coalesce((lb IS NOT NULL AND cl < greatest(3, nl * 0.3)) OR (rb IS NOT NULL AND cr < greatest(3, nr * 0.3)), FALSE) AS has_sidebar FROM (SELECT DISTINCT page_id FROM r)
  LEFT JOIN x USING (page_id)),
k AS (SELECT r.* FROM r JOIN b USING (page_id) WHERE NOT ((left_boundary > 0 AND x1 < 100 AND x2 <= left_boundary + 40) OR (right_boundary < 999
  AND x1 >= right_boundary)))"""
)


@query(f"WITH {REGIONS} SELECT * FROM r WHERE y1 >= 80")
def lay_2_chrome_filter(spark, sf):
    return layout.content_regions(regions_of(spark, sf))


@query(f"WITH {REGIONS} SELECT page_id, max(y2) - min(y1) AS spread, max(y2) - min(y1) >= 300 AS wide FROM r GROUP BY page_id")
def lay_3_vertical_spread(spark, sf):
    return layout.vertical_spread(regions_of(spark, sf))


@query(f"WITH {SIDES} SELECT * FROM b")
def lay_4_boundaries(spark, sf):
    return layout.column_boundaries(regions_of(spark, sf))


@query(f"WITH {SIDES} SELECT * FROM k")
def lay_5_main_column(spark, sf):
    r = regions_of(spark, sf)
    return layout.filter_regions(r, layout.column_boundaries(r))


@query(f"WITH {SIDES} SELECT page_id, string_agg(raw_block, chr(10) ORDER BY ord) AS text FROM k GROUP BY page_id")
def lay_6_rebuilt_text(spark, sf):
    r = regions_of(spark, sf)
    return layout.rebuild_text(layout.filter_regions(r, layout.column_boundaries(r)))


@query("SELECT event_id, coalesce(event_id % 23 / nullif(event_id % 29, 0) < 0.2 OR event_id % 23 / nullif(event_id % 29, 0) > 0.95, FALSE) AS again FROM events")
def lay_7_needs_reocr(spark, sf):
    return table(spark, sf, "events").select("event_id", layout.needs_reocr(F.col("event_id") % 29, F.col("event_id") % 23).alias("again"))


@query("SELECT p_partkey, trunc(p_size / 999 * 1920)::INT AS x1, 0 AS y1, trunc((500 + p_size) / 999 * 1920)::INT AS x2, 1080 AS y2 FROM part")
def lay_8_crop_box(spark, sf):
    return table(spark, sf, "part").select("p_partkey", layout.crop_box(F.col("p_size"), 500 + F.col("p_size"), F.lit(1920), F.lit(1080)).alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE array_to_string([trunc(p_size * 999 / (p_size % 10 * 100))::INT, trunc(7 * 999 / 500)::INT,
  trunc((p_size + 50) * 999 / (p_size % 10 * 100))::INT, trunc(90 * 999 / 500)::INT], ',') END AS boxes FROM part""")
def lay_9_normalized_boxes(spark, sf):
    size = F.col("p_size").cast("double")
    items = F.array(F.array(size, F.lit(7.0), size + 50, F.lit(90.0)), F.array(size, F.lit(1.0)))
    return table(spark, sf, "part").select("p_partkey", joined(F.flatten(layout.normalize_boxes(items, F.col("p_size") % 10 * 100, F.lit(500)))).alias("boxes"))


@query(f"""WITH {SIDES} SELECT page_id, has_sidebar, CASE WHEN has_sidebar THEN left_boundary END AS x1, CASE WHEN has_sidebar THEN 0 END AS y1, CASE WHEN has_sidebar
  THEN right_boundary END AS x2, CASE WHEN has_sidebar THEN 999 END AS y2 FROM b""")
def lay_10_sidebar_decision(spark, sf):
    return layout.sidebar_decision(layout.column_boundaries(regions_of(spark, sf))).select("page_id", "has_sidebar", "crop.*")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN array_to_string([p_size, 2, p_size + 5, 9], ',') WHEN 1 THEN array_to_string([p_size, 1, p_size + 4, 8], ',')
  ELSE NULL END AS box FROM part""")
def lay_11_parsed_bbox(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.format_string("[%d, 2, %d, 9]", F.col("p_size"), F.col("p_size") + 5)).when(
        F.col("p_partkey") % 3 == 1, F.format_string("[[%d, 8], [%d, 1], [%d, 3]]", F.col("p_size") + 2, F.col("p_size"), F.col("p_size") + 4)
    )
    return table(spark, sf, "part").select("p_partkey", joined(layout.parse_bbox(F.coalesce(raw, F.lit("oops")))).alias("box"))


def grounded(spark, sf):
    raw = F.format_string("<|ref|>text<|/ref|><|det|>[[%1$d, 2, 300, 400], [5, 6]]<|/det|>\n %2$s \n<|ref|>image<|/ref|><|det|>[[1, 2, %1$d, 4]]<|/det|>\n", F.col("s_suppkey") % 900, F.col("s_name"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), raw.alias("raw_text"), F.lit(1998).alias("width"), F.lit(999).alias("height"))


@query("""SELECT s_suppkey AS page_id, 0 AS ord, 'text' AS label, (s_suppkey % 900)::INT AS x1, 2 AS y1, 300 AS x2, 400 AS y2, s_name
  AS text, '<|ref|>text<|/ref|><|det|>[[' || s_suppkey % 900 || ', 2, 300, 400], [5, 6]]<|/det|>' || chr(10) || s_name AS raw_block FROM supplier
UNION ALL SELECT s_suppkey, 1, 'image', 1, 2, (s_suppkey % 900)::INT, 4, '', '<|ref|>image<|/ref|><|det|>[[1, 2, ' || s_suppkey % 900 || ', 4]]<|/det|>' FROM supplier""")
def lay_1_grounding(spark, sf):
    return layout.grounding_regions(grounded(spark, sf))


@query("""SELECT s_suppkey AS page_id, 0 AS ord, 0 AS k, 'text' AS label, array_to_string([trunc((s_suppkey % 900) / 999 * 1998)::INT, trunc(2 / 999 * 999)::INT, trunc(300
  / 999 * 1998)::INT, trunc(400 / 999 * 999)::INT], ',') AS box, NULL::INT AS crop_no FROM supplier
UNION ALL SELECT s_suppkey, 1, 0, 'image', array_to_string([trunc(1 / 999 * 1998)::INT, trunc(2 / 999 * 999)::INT, trunc((s_suppkey % 900) / 999 * 1998)::INT, trunc(4 /
  999 * 999)::INT], ','), 0 FROM supplier""")
def lay_12_pixel_regions(spark, sf):
    return layout.pixel_regions(grounded(spark, sf)).withColumn("box", joined("box"))


@query("SELECT s_suppkey AS page_id, chr(10) || ' ' || s_name || ' ' || chr(10) || '![](images/0.jpg)' || chr(10) || chr(10) AS text FROM supplier")
def lay_13_replaced_tags(spark, sf):
    return grounded(spark, sf).select("page_id", layout.replace_tags(F.col("raw_text")).alias("text"))


@query("SELECT p_partkey, 'images/a' || p_size || '.jpg,images/c.jpg,images/b' || p_size || '.png' AS refs FROM part")
def lay_14_image_refs(spark, sf):
    own = F.format_string('![x](images/a%1$d.jpg) <img class="i" src="images/b%1$d.png"> ![](images/c.jpg)', "p_size")
    return table(spark, sf, "part").select("p_partkey", joined(layout.image_refs(own)).alias("refs"))


@query("""WITH g AS (SELECT i, j FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i * j BETWEEN 2 AND 6),
s AS (SELECT p_partkey, p_size * 40 + 100 AS w, p_partkey % 30 * 50 + 100 AS h FROM part),
o AS (SELECT s.*, i, j, abs(w / h - i / j) AS off FROM s, g),
b AS (SELECT p_partkey, min(off) AS off FROM o GROUP BY p_partkey)
SELECT p_partkey, abs(arg_min(i, off) / arg_min(j, off) - arg_min(w, off) / arg_min(h, off)) = min(b.off) AS nearest FROM o JOIN b USING (p_partkey, off)
  GROUP BY p_partkey""")
def lay_15_tile_grid(spark, sf):
    """Whether the grid chosen is nearest in aspect; ties by area are tested on fixtures."""
    w, h = F.col("p_size") * 40 + 100, F.col("p_partkey") % 30 * 50 + 100
    grids = [(i, j) for i in range(1, 7) for j in range(1, 7) if 2 <= i * j <= 6]
    least = F.least(*[F.abs(w / h - i / j) for i, j in grids])
    t = layout.tile_grid(w, h)
    return table(spark, sf, "part").select("p_partkey", (F.abs(t["w"] / t["h"] - w / h) == least).alias("nearest"))


@query("SELECT p_partkey, (257 + CASE WHEN p_size % 3 > 1 OR p_size % 2 > 1 THEN 12 * (p_size % 3) * 12 * (p_size % 2) ELSE 0 END)::INT AS tokens FROM part")
def lay_16_image_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", layout.image_tokens(F.col("p_size") % 3, F.col("p_size") % 2).cast("int").alias("tokens"))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::INT) AS ids FROM documents),
i AS (SELECT doc_id, ids, unnest(range(greatest(0, len(ids) - 40), len(ids) - 2)) AS i FROM d WHERE len(ids) >= 3),
h AS (SELECT doc_id, list_sort(list_distinct(list_filter(list(ids[i + 3]) FILTER (ids[i + 1] = ids[-2] AND ids[i + 2] = ids[-1]), lambda t: t <> 5))) AS banned FROM i
  GROUP BY doc_id)
SELECT doc_id, array_to_string(coalesce(banned, []), ',') AS banned FROM d LEFT JOIN h USING (doc_id)""")
def lay_17_banned_tokens(spark, sf):
    ids = F.transform(F.split("text", " "), F.length)
    return table(spark, sf, "documents").select("doc_id", joined(layout.banned_tokens(ids, F.lit(3), F.lit(40), F.array(F.lit(5)))).alias("banned"))


@query("SELECT doc_id, text LIKE '%</s>' OR NOT text LIKE '%...' AS eos FROM documents")
def lay_18_has_eos(spark, sf):
    return table(spark, sf, "documents").select("doc_id", layout.has_eos(F.col("text")).alias("eos"))


# Protocol with the model


def sql_messages(kind: str, user: str, name: str = "messages") -> str:
    return f"{literal(protocol.SYSTEM[kind])} AS {name}_system, {user} AS {name}_user"


def flat_messages(c, name: str = "messages") -> list:
    return [F.element_at(F.filter(c, lambda m: m["role"] == role), 1)["content"].alias(f"{name}_{role}") for role in ("system", "user")]


REFINE = "'请修复以下 OCR 产出的 markdown（第 ' || (doc_id % 5 + 1) || '/5 段）：' || chr(10) || CASE WHEN lang = 'en' THEN '' ELSE '---前段上下文---' || chr(10) || lang || chr(10) END || '---正文开始---' || chr(10) || text || chr(10) || '---正文结束---' || chr(10) || '---后段上下文---' || chr(10) || source || chr(10)"


@query(f"SELECT doc_id, {sql_messages('refine', REFINE)} FROM documents")
def llm_1_refine_prompt(spark, sf):
    before = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", *flat_messages(protocol.refine_prompt(F.col("text"), F.col("doc_id") % 5 + 1, F.lit(5), before, F.col("source"))))


FINAL = "'请对以下完整文档做最终去重精修：' || chr(10) || '---文档开始---' || chr(10) || text || chr(10) || '---文档结束---'"


@query(f"SELECT doc_id, {sql_messages('final', FINAL)} FROM documents")
def llm_2_final_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *flat_messages(protocol.final_prompt(F.col("text"))))


NL = "chr(10)"
GAPPED = f"'## 缺口信息' || {NL} || '缺口出现在 ' || source || ' 之后。' || {NL} || {NL} || '### 缺口前的内容' || {NL} || lang || {NL} || {NL} || '### 缺口后的内容' || {NL} || lang || {NL} || {NL} || '## 相邻页面 OCR 文本' || {NL} || '### 当前页（' || source || '）' || {NL} || text || {NL} || {NL} || CASE WHEN doc_id % 2 = 0 THEN '### 下一页（n）' || {NL} || text || {NL} || {NL} ELSE '' END || '请提取缺失的内容片段：'"


@query(f"SELECT doc_id, {sql_messages('gap', GAPPED)} FROM documents")
def llm_3_gap_prompt(spark, sf):
    c = F.col
    return table(spark, sf, "documents").select("doc_id", *flat_messages(protocol.gap_prompt(c("source"), c("lang"), c("lang"), c("text"), F.when(c("doc_id") % 2 == 0, c("text")), F.lit("n"))))


@query(f"SELECT doc_id, {sql_messages('pii', 'text', 'pii')}, {sql_messages('boundary', 'text', 'boundary')} FROM documents")
def llm_4_detect_prompts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *flat_messages(protocol.detect_prompt(F.col("text"), "pii"), "pii"), *flat_messages(protocol.detect_prompt(F.col("text"), "boundary"), "boundary"))


@query("SELECT doc_id, text || 'xy<!-- GAP: broken -->' AS cleaned, 'p' || doc_id || '.jpg|a b|' || source || ',q||' AS gaps FROM documents")
def llm_5_parsed_gaps(spark, sf):
    own = F.concat("text", F.format_string('x<!-- GAP: after_image=p%d.jpg, context_before="a b", context_after="%s" -->y<!--GAP:after_image = q,context_before="",context_after=""--><!-- GAP: broken -->', "doc_id", "source"))
    return table(spark, sf, "documents").select("doc_id", protocol.parse_gaps(own).alias("g")).select("doc_id", "g.cleaned", joined(F.transform("g.gaps", lambda g: F.concat_ws("|", g["after_image"], g["context_before"], g["context_after"]))).alias("gaps"))


@query("SELECT doc_id, text || 'xy' AS cleaned, 'p' || doc_id || '|' || source || ',q|' AS boundaries FROM documents")
def llm_6_parsed_boundaries(spark, sf):
    own = F.concat("text", F.format_string('x<!-- DOC_BOUNDARY: {"after_page": "p%d", "new_title": "%s"} --><!--DOC_BOUNDARY:{"after_page":"q"}-->y<!-- DOC_BOUNDARY: {oops} --><!-- DOC_BOUNDARY: {"new_title": "t"} -->', "doc_id", "source"))
    return table(spark, sf, "documents").select("doc_id", protocol.parse_boundaries(own).alias("b")).select("doc_id", "b.cleaned", joined(F.transform("b.boundaries", lambda b: F.concat_ws("|", b["after_page"], b["new_title"]))).alias("boundaries"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS heading FROM documents")
def llm_7_first_heading(spark, sf):
    own = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n## no\n#  "), "source", F.lit("\n# later"))).otherwise("\n## no"))
    return table(spark, sf, "documents").select("doc_id", protocol.first_heading(own).alias("heading"))


@query(f"SELECT item_id AS request_id, 'ok ' || {FINAL} AS reply, length({FINAL}) > 400 AS truncated, FALSE AS failed FROM benchmark")
def llm_8_completed(spark, sf):
    """A stand-in for the model answers with the user's message; as many tasks call it as requests may be in flight."""
    requests = table(spark, sf, "benchmark").select(F.col("item_id").alias("request_id"), protocol.final_prompt(F.col("text")).alias("messages"))
    return protocol.complete(requests, lambda m: ("ok " + m[-1]["content"], "length" if len(m[-1]["content"]) > 400 else "stop"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(text, ' ' || chr(10)) END AS fill FROM documents")
def llm_9_gap_reply(spark, sf):
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(protocol.CANNOT_FILL))).otherwise(F.concat(F.lit(" \n"), "text", F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", protocol.gap_reply(reply).alias("fill"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '|' || lang END AS found FROM documents")
def llm_10_boundary_reply(spark, sf):
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("not json")).otherwise(F.format_string('[{"after_page": "%s", "new_title": "%s"}, {"new_title": "x"}]', "source", "lang"))
    return table(spark, sf, "documents").select("doc_id", joined(F.transform(protocol.boundary_reply(reply), lambda b: F.concat_ws("|", b["after_page"], b["new_title"]))).alias("found"))


@query("SELECT doc_id, doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 3 <> 0 THEN source END AS persons FROM documents")
def llm_11_entity_reply(spark, sf):
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("sorry")).otherwise(F.format_string('{"person_names": ["%s"], "org_names": []}', "source"))
    return table(spark, sf, "documents").select("doc_id", protocol.entity_reply(reply).alias("r")).select("doc_id", F.col("r").isNull().alias("failed"), joined("r.person_names").alias("persons"))


@query("SELECT doc_id, lang = 'en' AS local FROM documents")
def llm_12_provider(spark, sf):
    return table(spark, sf, "documents").select("doc_id", protocol.is_local(F.when(F.col("lang") == "en", "local").otherwise("cloud")).alias("local"))


# Assembly


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN upper(source) END, text) AS text FROM documents")
def asm_1_refined(spark, sf):
    return table(spark, sf, "documents").select("doc_id", assembly.refined(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.upper("source"))).alias("text"))


@query("""WITH d AS (SELECT doc_id, text, substr(text, 1, (length(text) * (doc_id % 10) / 10)::INT) AS o FROM documents),
n AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS i, length(o) - length(replace(o, chr(10), '')) + 1 AS k FROM d)
SELECT doc_id, doc_id % 97 = 0 OR (i > 20 AND k < i * (1 - 0.3)) AS truncated FROM n""")
def asm_2_truncation(spark, sf):
    short = F.substring("text", F.lit(1), F.round(F.length("text") * (F.col("doc_id") % 10) / 10).cast("int"))
    return table(spark, sf, "documents").select("doc_id", assembly.looks_truncated(F.col("doc_id") % 97 == 0, F.col("text"), short).alias("truncated"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def asm_3_reassembled(spark, sf):
    return assembly.reassemble(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_idx"), "text"))


def conversations_marked(spark, sf):
    part = F.concat(F.lit("<!-- page: t"), F.col("turn").cast("string"), F.lit(" -->\n"), "text")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_idx"), part.alias("text"))
    return assembly.reassemble(rows)


def some_boundaries(spark, sf):
    rows = table(spark, sf, "conversations").where("turn % 2 = 1")
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("after_page"), F.concat(F.lit("after "), F.col("turn").cast("string")).alias("new_title"), F.col("turn").alias("seq"))


@query("""SELECT conv_id AS doc_id, string_agg('<!-- page: t' || turn || ' -->' || CASE WHEN turn % 2 = 1
  THEN chr(10) || '<!-- DOC_BOUNDARY: {"after_page": "t' || turn || '", "new_title": "after ' || turn || '"} -->' ELSE '' END || chr(10) || text, chr(10) ORDER BY turn)
  AS markdown FROM conversations GROUP BY conv_id""")
def asm_4_inserted_boundaries(spark, sf):
    return assembly.with_boundaries(conversations_marked(spark, sf), some_boundaries(spark, sf))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn, 't' || turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations),
m AS (SELECT doc_id, page, min(idx)::INT AS idx FROM t GROUP BY ALL)
SELECT c.conv_id AS doc_id, m.idx, m.page, 'after ' || turn AS new_title FROM conversations c JOIN m ON m.doc_id = c.conv_id AND m.page = 't' || c.turn WHERE turn % 2 = 1""")
def asm_5_split_points(spark, sf):
    return assembly.split_points(assembly.page_markers(conversations_marked(spark, sf)), some_boundaries(spark, sf).drop("seq"))


@query("""WITH t AS (SELECT conv_id AS doc_id, turn, '<!-- page: t' || turn || ' -->' || chr(10) || text AS part, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)
  AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
s AS (SELECT *, sum(coalesce((before % 2 = 1)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY turn)::INT AS sub_no FROM t)
SELECT doc_id, sub_no, coalesce(max(CASE WHEN before % 2 = 1 THEN 'after ' || before END), '') AS title, string_agg('t' || turn, ',' ORDER BY turn) AS pages,
  string_agg(part || CASE WHEN nxt IS NULL THEN '' ELSE chr(10) END, '' ORDER BY turn) AS markdown FROM s GROUP BY doc_id, sub_no""")
def asm_6_sub_documents(spark, sf):
    return assembly.split_documents(conversations_marked(spark, sf), some_boundaries(spark, sf).drop("seq")).withColumn("pages", joined("pages"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x/images/1.jpg' ELSE '' END AS images FROM documents")
def asm_7_images(spark, sf):
    own = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "![a](images/1.jpg)").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", joined(assembly.images_of(own, F.array(F.lit("x/images/1.jpg"), F.lit("x/images/2.jpg")))).alias("images"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS item FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey
  AND o_orderkey % 7 = l_linenumber)""")
def asm_8_owned(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("item"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7).cast("int").alias("page"))
    return assembly.owned(items, pages)


@query("""WITH p AS (SELECT conv_id AS doc_id, 't' || turn AS after_image, text AS page_text, lead('t' || turn) OVER w AS next_page, lead(text) OVER w AS next_text, turn
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT doc_id, after_image, turn AS gap_no, page_text, next_page, next_text FROM p WHERE turn % 3 = 1""")
def asm_9_gap_requests(spark, sf):
    turns = table(spark, sf, "conversations")
    gaps = turns.where("turn % 3 = 1").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("after_image"), F.col("turn").alias("gap_no"))
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_seq"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("page"), "text")
    return assembly.gap_requests(gaps, pages)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<!-- page: a -->' || chr(10) || text || chr(10) || 'FILL' || chr(10) || chr(10) || '<!-- page: b -->' || chr(10) ||
  'z'
 ELSE '<!-- page: a -->' || chr(10) || text || chr(10) || '<!-- page: b -->' || chr(10) || 'z' || chr(10) || 'FILL' || chr(10) END AS markdown FROM documents""")
def asm_10_filled_gap(spark, sf):
    own = F.concat(F.lit("<!-- page: a -->\n"), "text", F.lit("\n<!-- page: b -->\nz"))
    kind = F.col("doc_id") % 3
    page, following = F.when(kind == 1, "none").otherwise("a"), F.when(kind < 2, "b")
    return table(spark, sf, "documents").select("doc_id", assembly.insert_fill(own, page, following, F.lit("FILL")).alias("markdown"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE upper(lang) END AS markdown FROM documents")
def asm_11_final_refined(spark, sf):
    return table(spark, sf, "documents").select("doc_id", assembly.refined(F.col("text"), F.when(F.col("doc_id") % 4 != 0, F.upper("lang"))).alias("markdown"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN '段 1 精修输出疑似被截断' END, CASE WHEN toxic = 1 THEN '段 2 精修输出疑似被截断' END, CASE
  WHEN doc_id % 2 = 0 THEN '整篇文档级精修输出疑似被截断' END,
 CASE WHEN quality = 1 THEN '缺口（p' || doc_id || ' 之后）未能自动补充' END, CASE WHEN doc_id % 5 = 0 THEN '隐私实体检测失败，已阻止云端处理' END], lambda w: w IS NOT NULL), ',') AS warnings
  FROM labels""")
def asm_12_warnings(spark, sf):
    gaps = F.array(F.struct((F.col("quality") == 0).alias("filled"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("after_image")))
    cut = F.array(F.col("quality") == 0, F.col("toxic") == 1)
    warned = assembly.warnings(cut, F.col("doc_id") % 2 == 0, F.filter(gaps, lambda g: F.lit(True)), F.col("doc_id") % 5 == 0)
    return table(spark, sf, "labels").select("doc_id", joined(warned).alias("warnings"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <= 1 THEN '' WHEN doc_id % 2 = 0 THEN '文档_' || (doc_id % 7 + 1) ELSE 'src_' || source END AS dir FROM documents")
def asm_13_output_dirs(spark, sf):
    title = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.concat(F.lit("src/"), "source"))
    return table(spark, sf, "documents").select("doc_id", assembly.output_dir(title, F.col("doc_id") % 7, F.col("doc_id") % 3).alias("dir"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source || '/' || lang END AS dir FROM documents")
def asm_14_tree_dirs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", assembly.tree_dir(F.when(F.col("doc_id") % 2 == 0, ".").otherwise(F.col("source")), F.col("lang")).alias("dir"))


@query(r"""SELECT doc_id, trim(regexp_replace('![](images/p' || doc_id || '_0.jpg)' || chr(10) || text || chr(10) || 'end', '\s+$', ''), chr(10)) AS markdown
  FROM documents""")
def out_1_rendered(spark, sf):
    own = F.concat(F.format_string("<!-- page: p%1$d.jpg -->\n![](p%1$d_OCR/images/0.jpg)\n", "doc_id"), "text", F.lit("\n<!-- page: q -->\nend\n"))
    return table(spark, sf, "documents").select("doc_id", assembly.render(own).alias("markdown"))


# Scalar functions


@query(r"""WITH a AS (SELECT p_partkey, regexp_replace(trim('.._' || p_name || '/' || p_type || ':' || repeat('x', p_size) || '..'), '[/\\:*?"<>|\x00-\x1f]', '_', 'g')
  AS n FROM part),
b AS (SELECT p_partkey, ltrim(trim(regexp_replace(replace(n, '..', ''), '_+', '_', 'g'), '_'), '.') AS n FROM a)
SELECT p_partkey, CASE WHEN length(n) > 64 THEN rtrim(substr(n, 1, 64), '_') ELSE n END AS name FROM b""")
def str_1_dirname(spark, sf):
    title = F.concat(F.lit(".._"), "p_name", F.lit("/"), "p_type", F.lit(":"), F.expr("repeat('x', p_size)"), F.lit(".."))
    return table(spark, sf, "part").select("p_partkey", tx.sanitize_dirname(title).alias("name"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(replace(replace(text, '/', '_'), '\', '_'), '[^\p{L}\p{N}._\- ]', '', 'g')), ''), 'unnamed') AS name
  FROM documents""")
def str_2_filename(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.secure_filename(F.col("text")).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'a/b_' || p_size || '.jpg' END AS path FROM part")
def str_3_relpath(spark, sf):
    raw = F.when(F.col("p_partkey") % 4 == 0, "/etc/x").when(F.col("p_partkey") % 4 == 1, "a/../b").otherwise(F.format_string("a\\b_%d*.jpg", "p_size"))
    return table(spark, sf, "part").select("p_partkey", tx.secure_relpath(raw).alias("path"))


@query(r"""WITH p AS (SELECT page_id, string_split_regex(html, '<[^>]*>') AS gaps, list_append(regexp_extract_all(html, '<[^>]*>'), '') AS tags FROM pages),
u AS (SELECT page_id, unnest(gaps) AS g, unnest(tags) AS t, generate_subscripts(gaps, 1) AS i FROM p)
SELECT page_id, string_agg(g || CASE WHEN t = '' OR regexp_matches(t,
  '(?i)^</?\s*(?:div|img|table|thead|tbody|tr|td|th|br|hr|span|p|b|i|u|strong|em|sub|sup|ul|ol|li|a|code|pre|h[1-6]|blockquote)\b') THEN t
  ELSE '&lt;' || t[2:-2] || '&gt;' END, '' ORDER BY i) AS html FROM u GROUP BY page_id""")
def str_4_escaped_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.escape_unknown_tags(F.col("html")).alias("html"))


@query("SELECT page_id, ' ![a](/api/v1/tasks/t1/assets/d/images/1.jpg) <img class=\"c\" src=\"/api/v1/tasks/t1/assets/d/images/2.png\"/>' || url AS html FROM pages")
def str_5_image_urls(spark, sf):
    own = F.concat(F.lit('![x](p_OCR/images/0.jpg) ![a](images/1.jpg) <img class="c" src="images/2.png"/>'), "url")
    return table(spark, sf, "pages").select("page_id", tx.rewrite_image_urls(own, F.lit("t1"), F.lit("d")).alias("html"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '加载模型权重... ' || event_id % 100 || '%' WHEN 1 THEN '模型文件已缓存，跳过下载' WHEN 2 THEN 'vLLM 推理引擎初始化中...' WHEN 3
  THEN '下载模型文件... 7%' WHEN 4 THEN '模型加载完成' END AS message FROM events""")
def str_6_progress_messages(spark, sf):
    lines = ["Loading safetensors shards:  %d%% done", "Using cached %d", "EngineCore pid=%d", "Downloading x %d 7%%", "Model Initialized %d", "nothing %d"]
    raw = F.lit(None).cast("string")
    for k, line in enumerate(lines):
        raw = F.when(F.col("event_id") % 6 == k, F.format_string(line, F.col("event_id") % 100)).otherwise(raw)
    return table(spark, sf, "events").select("event_id", tx.progress_message(raw).alias("message"))


@query("SELECT event_id, event_id % 3 < 2 AS oom FROM events")
def str_7_out_of_memory(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "CUDA Out Of Memory").when(F.col("event_id") % 3 == 1, "OOM killed").otherwise("timeout")
    return table(spark, sf, "events").select("event_id", tx.is_out_of_memory(raw).alias("oom"))


@query("SELECT doc_id, source || ': ' || substr(text, 1, 200) AS summary FROM documents")
def str_8_error_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.error_summary(F.col("source"), F.col("text")).alias("summary"))


#: Totals that no share of a thousand divides into halves, where decimal and binary rounding would differ; 0 too.
@query("""WITH e AS (SELECT event_id, event_id % 301 AS done, [0, 3, 7, 9, 11, 13, 300][event_id % 7 + 1] AS total FROM events) SELECT event_id, CASE WHEN total = 0
  THEN 0.0 ELSE round(done / total * 100, 1) END::DOUBLE AS percent FROM e""")
def str_9_percent(spark, sf):
    total = F.element_at(F.array(*map(F.lit, (0, 3, 7, 9, 11, 13, 300))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tx.percent(F.col("event_id") % 301, total).alias("percent"))


# Tasks: orders, with lineitem as results


def tasks_of(spark, sf):
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("O", "pending", "F", "completed", "P", "processing")]), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(None).cast("string").alias("error"))


def results_of(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("doc_title"))


TASKS = """t AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'processing' END
  AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, NULL::VARCHAR AS error FROM orders)"""


@query(f"""WITH {TASKS}, r AS (SELECT l_orderkey AS task_id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT t.*, coalesce(n, 0) AS result_count FROM t LEFT
  JOIN r USING (task_id)""")
def rel_1_tasks_with_counts(spark, sf):
    return tasks.tasks_with_counts(tasks_of(spark, sf), results_of(spark, sf))


@query("SELECT l_orderkey AS task_id, count(l_linenumber) AS n FROM lineitem GROUP BY ALL")
def rel_2_counts(spark, sf):
    return results_of(spark, sf).groupBy("task_id").agg(F.count("id").alias("n"))


@query(f"WITH {TASKS} SELECT count(*) AS total FROM t WHERE status = 'completed'")
def rel_3_count_status(spark, sf):
    return tasks.count_tasks(tasks_of(spark, sf), "completed")


@query(f"WITH {TASKS} SELECT * FROM t WHERE status = 'completed' ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 40")
def rel_4_page_of_tasks(spark, sf):
    return tasks.list_tasks(tasks_of(spark, sf), "completed", page=3, page_size=20)


@query("SELECT l_orderkey AS task_id, l_linenumber AS id, l_returnflag AS doc_title FROM lineitem WHERE l_orderkey = 7")
def rel_5_lookup(spark, sf):
    return tasks.task_results(results_of(spark, sf), 7)


@query(f"""WITH {TASKS} SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'failed' ELSE status END AS status, created_at, CASE WHEN task_id % 5 = 0 THEN 'e' END AS error
  FROM t""")
def rel_6_upsert(spark, sf):
    t = tasks_of(spark, sf)
    return tasks.upsert(t, t.where("task_id % 5 = 0").withColumns({"status": F.lit("failed"), "error": F.lit("e")}), "task_id")


@query("SELECT l_orderkey AS task_id, l_linenumber AS id, l_returnflag AS doc_title FROM lineitem WHERE l_orderkey % 3 <> 0")
def rel_6_delete_cascade(spark, sf):
    t = tasks_of(spark, sf)
    return tasks.delete_cascade(t, results_of(spark, sf), t.where("task_id % 3 = 0"))[1]


@query(f"""WITH {TASKS} SELECT task_id, CASE WHEN status IN ('pending', 'processing') THEN 'failed' ELSE status END AS status, created_at, CASE
  WHEN status IN ('pending', 'processing') THEN '服务重启，任务中断' ELSE error END AS error FROM t""")
def rel_7_recovered(spark, sf):
    return tasks.recover_interrupted(tasks_of(spark, sf))


@query(f"WITH {TASKS} SELECT * FROM t ORDER BY created_at DESC, task_id LIMIT 100")
def rel_8_clamped_page(spark, sf):
    return tasks.list_tasks(tasks_of(spark, sf), page=-3, page_size=5000)


@query(f"WITH {TASKS} SELECT task_id, status FROM t ORDER BY status IN ('pending', 'processing') DESC, created_at DESC, task_id")
def rel_9_sidebar(spark, sf):
    return tasks.sort_for_sidebar(tasks_of(spark, sf)).select("task_id", "status")


def stage_events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.round("value", 2).cast("decimal(18,2)").alias("duration_s"), (F.col("user_id") % 4).cast("int").alias("depth"))


PROFILE = """e AS (SELECT event_type AS name, event_id AS seq, round(value, 2)::DECIMAL(18,2) AS d, (user_id % 4)::INT AS depth FROM events),
a AS (SELECT d AS anchor FROM e ORDER BY name <> 'pipeline.total', seq LIMIT 1),
s AS (SELECT name, count(*) AS n, sum(d) AS total_s, min(depth) AS min_depth FROM e GROUP BY name)"""


@query(f"""WITH {PROFILE} SELECT name, n, total_s::DOUBLE AS total_s, round(total_s::DOUBLE / n, 6) AS mean_s, CASE WHEN anchor > 0
  THEN round(total_s::DOUBLE / anchor::DOUBLE * 100, 4) ELSE 0.0 END AS share, min_depth FROM s, a""")
def rel_10_profile_summary(spark, sf):
    s = tasks.profile_summary(stage_events(spark, sf).withColumn("duration_s", F.col("duration_s").cast("decimal(18,2)")))
    return s.select("name", "n", F.col("total_s").cast("double").alias("total_s"), F.round(F.col("total_s").cast("double") / F.col("n"), 6).alias("mean_s"), F.round(F.col("share").cast("double"), 4).alias("share"), "min_depth")


@query(f"WITH {PROFILE} SELECT name, total_s::DOUBLE AS total_s FROM s ORDER BY total_s DESC, name LIMIT 3")
def rel_11_top_stages(spark, sf):
    return tasks.top_stages(tasks.profile_summary(stage_events(spark, sf)), 3).select("name", F.col("total_s").cast("double").alias("total_s"))


@query("""WITH v AS (SELECT event_type, round(value, 2) AS v FROM events WHERE event_id % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM v)
SELECT event_type, round(avg(v), 6) AS mean, max(v) AS max, max(CASE WHEN k = greatest(1, floor(n * 0.95)) THEN v END) AS p95 FROM r GROUP BY event_type""")
def rel_12_trace_stats(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.round("value", 2).cast("string")).alias("value"))
    return tasks.trace_stats(rows, "value", ("event_type",)).withColumn("mean", F.round("mean", 6))


@query("""SELECT event_type AS config, round(36 / avg(round(value, 2) + 1), 6) AS images_per_s, round(100.0 / nullif(count(*), 0), 6) AS speedup FROM events
  GROUP BY event_type""")
def rel_13_throughput(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("config"), (F.round("value", 2) + 1).alias("seconds"))
    rate = tasks.throughput(runs, F.lit(36)).withColumn("images_per_s", F.round("images_per_s", 6))
    return rate.join(runs.groupBy("config").agg(F.round(tasks.speedup(F.lit(100.0), F.count("*").cast("double")), 6).alias("speedup")), "config")


@query(f"WITH {LINES} SELECT page_seq, count(DISTINCT line) AS n FROM l GROUP BY page_seq")
def rel_14_distinct_lines(spark, sf):
    return table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").alias("page_seq"), F.size(F.array_distinct(tx.lines(F.col("text")))).cast("long").alias("n"))


# Sources and sinks, over paths made from the tables


def made_files(spark, sf):
    name = F.format_string("/r/d%d/%s%d.%s", F.col("p_size") % 7, F.when(F.col("p_size") % 5 == 0, "sub/").otherwise(""), F.col("p_partkey"), F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "bmp", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select(name.alias("path"), F.col("p_size").cast("long").alias("length"))


FILES = """f AS (SELECT '/r/d' || p_size % 7 || '/' || CASE WHEN p_size % 5 = 0 THEN 'sub/'
  ELSE '' END || p_partkey || '.' || ['jpg', 'PNG', 'bmp', 'txt'][p_partkey % 4 + 1] AS path, p_size::BIGINT AS length FROM part)"""


@query(rf"""WITH {FILES}, i AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM f
  WHERE lower(path) SIMILAR TO '.*\.(jpg|jpeg|png)') SELECT *, (row_number() OVER (PARTITION BY dir ORDER BY name) - 1)::INT AS page_seq FROM i""")
def src_1_page_images(spark, sf):
    return files.page_images(made_files(spark, sf))


@query(rf"""WITH {FILES}, d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM f WHERE lower(path) SIMILAR TO '.*\.(jpg|jpeg|png)') SELECT dir FROM d
  WHERE NOT EXISTS (SELECT 1 FROM d a WHERE starts_with(d.dir, a.dir || '/'))""")
def src_2_leaf_dirs(spark, sf):
    return files.leaf_dirs(made_files(spark, sf))


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'file ' || doc_id ELSE text END AS text FROM documents")
def src_3_page_text(spark, sf):
    docs = table(spark, sf, "documents")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ocr_dir"), F.col("text").alias("raw_text"))
    found = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dir"), F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("value"))
    return files.page_text(pages, found).select("page_id", "text")


@query("SELECT doc_id AS stem, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'cropped' ELSE 'plain' END ELSE 'new' END AS text FROM documents")
def src_4_incremental(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("stem"))
    manifest = docs.where("stem % 4 = 0").select("stem", F.lit("plain").alias("text"), F.lit(False).alias("cropped")).union(docs.where("stem % 8 = 0").select("stem", F.lit("cropped"), F.lit(True)))
    return files.to_recognise(docs, manifest).withColumn("text", F.lit("new")).unionByName(files.reused(docs, manifest).select("stem", "text"))


@query(rf"WITH {FILES} SELECT substr(path, 4) AS relative_path, length FROM f WHERE lower(path) SIMILAR TO '.*\.(jpg|jpeg|png|bmp|tiff|tif)'")
def src_5_listing(spark, sf):
    return files.source_listing(made_files(spark, sf), "/r")


@query(rf"""WITH {FILES}, p AS (SELECT string_split(substr(path, 4), '/') AS s, lower(path) SIMILAR TO '.*\.(jpg|jpeg|png|bmp|tiff|tif)' AS image FROM f) SELECT s[1]
  AS name, max(len(s)) > 1 AS is_dir, least(count_if(len(s) = 2 AND image), 9999)::BIGINT AS n_images, NULL::BIGINT AS size FROM p GROUP BY ALL""")
def src_6_browse(spark, sf):
    return files.browse(made_files(spark, sf), "/r")


#: Names of both cases, files and folders, hidden ones and such as aren't images, with their places in the order.
@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'a' WHEN 2 THEN '.c' ELSE 'D' END || p_partkey AS n, p_partkey % 3 AS kind, p_size::BIGINT
  AS size FROM part),
e AS (SELECT CASE kind WHEN 0 THEN n || '.jpg' WHEN 1 THEN n ELSE n || '.txt' END AS name, kind = 1 AS is_dir, CASE WHEN kind = 1 THEN 1 ELSE 0 END::BIGINT AS n_images,
  CASE WHEN kind = 0 THEN size END AS size FROM f WHERE n[1] <> '.' AND kind < 2)
SELECT (row_number() OVER (ORDER BY lower(name), name) - 1)::BIGINT AS place, * FROM e""")
def src_6_browse_order(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("B", "a", ".c", "D"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    ends = F.element_at(F.array(*map(F.lit, (".jpg", "/x.png", ".txt"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    made = table(spark, sf, "part").select(F.concat(F.lit("/r/"), lead, F.col("p_partkey").cast("string"), ends).alias("path"), F.col("p_size").cast("long").alias("length"))
    found = files.browse(made, "/r").coalesce(1)
    return found.withColumn("place", F.monotonically_increasing_id())


@query("""SELECT p_brand AS session_id, '/x' || p_partkey || '/f' || p_size || '.jpg' AS path, 'f' || p_size || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.jpg'
  AS name, NULL::VARCHAR AS error FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS k FROM part)""")
def src_7_staged_names(spark, sf):
    return files.stage_names(table(spark, sf, "part").select(F.col("p_brand").alias("session_id"), F.col("p_partkey").alias("position"), F.format_string("/x%d/f%d.jpg", "p_partkey", "p_size").alias("path")))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_partkey || '.PNG' END AS name, CASE p_partkey % 3 WHEN 0
  THEN 'not an absolute path of a known kind' END AS error FROM part""")
def src_7_bad_paths(spark, sf):
    """A bad path has its error and leaves the others alone."""
    path = F.when(F.col("p_partkey") % 6 == 0, "rel.jpg").when(F.col("p_partkey") % 6 == 3, "/x/a.txt").otherwise(F.format_string("/x/%d.PNG", "p_partkey"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("session_id"), F.lit(0).alias("position"), path.alias("path"))
    return files.stage_names(rows).select(F.col("session_id").cast("long").alias("p_partkey"), "name", "error")


@query(f"WITH {TASKS} SELECT * FROM t")
def src_9_task_store(spark, sf):
    root = scratch(spark, "store")
    files.save_table(tasks_of(spark, sf), root, "tasks")
    return files.load_table(spark, root, "tasks")


@query("SELECT event_type AS name, event_id AS seq, round(value, 2) AS duration_s FROM events")
def out_4_profile_events(spark, sf):
    root = scratch(spark, "profile")
    files.write_events(table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.round("value", 2).alias("duration_s")), root)
    return spark.read.schema("name string, seq long, duration_s double").json(root)


@query("SELECT user_id AS run_idx, 'p' || event_id || '.jpg' AS image_path, printf('%.4f', round(value, 2)) AS elapsed_s FROM events")
def out_4_per_page(spark, sf):
    root = bench_files(spark, sf)
    return spark.read.option("header", "true").schema("run_idx long, image_path string, elapsed_s string").csv(f"{root}/per_page.csv")


@query("""WITH v AS (SELECT user_id AS run_idx, round(value, 2) AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY run_idx ORDER BY v) AS k, count(*)
  OVER (PARTITION BY run_idx) AS n FROM v)
SELECT run_idx, round(avg(v), 6) AS mean, max(v) AS max, max(CASE WHEN k = greatest(1, floor(n * 0.95)) THEN v END) AS p95 FROM r GROUP BY run_idx""")
def out_4_summary(spark, sf):
    root = bench_files(spark, sf)
    return spark.read.schema("run_idx long, mean double, max double, p95 double").json(f"{root}/summary.json").withColumn("mean", F.round("mean", 6))


@query("SELECT event_id % 100 AS gpu, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL")
def out_4_gpu_trace(spark, sf):
    root = bench_files(spark, sf)
    read = spark.read.option("header", "true").schema("seq long, `utilization.gpu` long").csv(f"{root}/gpu_trace.csv")
    column = tasks.find_prefix(read.columns, "utilization.gpu")
    return read.groupBy(F.col(f"`{column}`").alias("gpu")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def bench_files(spark, sf) -> str:
    root, events = scratch(spark, "bench"), table(spark, sf, "events")
    pages = events.select(F.col("user_id").alias("run_idx"), F.format_string("p%d.jpg", "event_id").alias("image_path"), F.round("value", 2).alias("elapsed_s"))
    files.write_bench(pages, events.select(F.col("event_id").alias("seq"), (F.col("event_id") % 100).alias("utilization.gpu")), root)
    return root


def stored_documents(spark, sf) -> tuple[str, DataFrame]:
    """Documents of nations written below a new folder, whose pages have an image each but for every third."""
    root = scratch(spark, "documents")
    fs, base = files.file_system(root)
    rows = table(spark, sf, "nation")
    for r in rows.select("n_nationkey").collect():
        if r[0] % 3:
            fs.create_dir(f"{base}/p{r[0]}_OCR/images")
            with fs.open_output_stream(f"{base}/p{r[0]}_OCR/images/0.jpg") as out:
                out.write(b"image %d" % r[0])
    own = F.format_string("<!-- page: p%1$d.jpg -->\n# %2$s\n![](p%1$d_OCR/images/0.jpg)\n", "n_nationkey", "n_name")
    docs = rows.select("n_nationkey", F.format_string("d%d", "n_nationkey").alias("doc_dir"), own.alias("markdown"))
    files.write_documents(docs, root)
    return root, docs


@query("SELECT 'd' || n_nationkey AS doc_dir, '# ' || n_name || chr(10) || '![](images/p' || n_nationkey || '_0.jpg)' AS markdown FROM nation")
def out_1_written_documents(spark, sf):
    """What the sink has written, read back from document.md."""
    root, _ = stored_documents(spark, sf)
    back = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "document.md").text(root, wholetext=True)
    return back.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/document.md$", 1).alias("doc_dir"), F.col("value").alias("markdown"))


@query("""SELECT 'd' || n_nationkey || '/document.md' AS name, '# ' || n_name || chr(10) || '![](images/p' || n_nationkey || '_0.jpg)' AS held FROM nation
UNION ALL SELECT 'd' || n_nationkey || '/images/p' || n_nationkey || '_0.jpg', 'image ' || n_nationkey FROM nation WHERE n_nationkey % 3 <> 0""")
def out_3_zip(spark, sf):
    """The names and contents of a task's archive, packed from what the sink has written."""
    import tempfile
    import zipfile
    from pathlib import Path

    root, docs = stored_documents(spark, sf)
    with tempfile.TemporaryDirectory() as folder:
        target = str(Path(folder) / "result.zip")
        names = files.zip_documents(root, [r[0] for r in docs.select("doc_dir").collect()], target)
        with zipfile.ZipFile(target) as archive:
            rows = [(n, archive.read(n).decode()) for n in names]
    return spark.createDataFrame(rows, "name string, held string")


@query("SELECT doc_id, text FROM documents")
def out_2_debug_artifacts(spark, sf):
    root = scratch(spark, "debug")
    files.write_debug(table(spark, sf, "documents").select("doc_id", "text"), root, "merged_raw", debug=True)
    return spark.read.parquet(f"{root}/merged_raw")


@query("SELECT event_type, round(sum(round(value, 2)), 4) AS total FROM events GROUP BY event_type")
def rel_15_prefix_column(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy("event_type").agg(F.round(F.sum(F.round(tasks.find_prefix(events.columns, "val"), 2)), 4).alias("total"))


@query("SELECT o_custkey AS session_id, count(*) AS n_files, sum(o_orderkey)::BIGINT AS n_bytes FROM orders GROUP BY ALL")
def src_8_uploads(spark, sf):
    return tasks.uploads(table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("size")))


UPLOADS = """s AS (SELECT c_custkey AS session_id, c_custkey % 4 = 0 AS completed FROM customer WHERE c_custkey % 7 <> 0),
u AS (SELECT o_orderkey AS file_id, o_custkey AS session_id, o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.gif' WHEN 1 THEN '.JPEG' ELSE '.tif' END
  AS name, (o_orderkey % 64 * 1048576 + o_orderkey % 2)::BIGINT AS size FROM orders),
v AS (SELECT u.*, CASE WHEN completed IS NULL THEN 'no such session' WHEN completed THEN 'session is complete' WHEN name LIKE '%.gif' THEN 'unknown kind'
  WHEN size > 52428800 THEN 'too large' ELSE 'accepted' END AS verdict FROM u LEFT JOIN s USING (session_id))"""


def judged(spark, sf):
    key = F.col("o_orderkey")
    name = F.concat(key.cast("string"), F.when(key % 5 == 0, ".gif").when(key % 5 == 1, ".JPEG").otherwise(".tif"))
    rows = table(spark, sf, "orders").select(key.alias("file_id"), F.col("o_custkey").alias("session_id"), name.alias("name"), (key % 64 * 1048576 + key % 2).cast("long").alias("size"))
    sessions = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 4 == 0).alias("completed"))
    return tasks.judged_uploads(rows, sessions)


@query(f"WITH {UPLOADS} SELECT * FROM v")
def src_8_judged_uploads(spark, sf):
    return judged(spark, sf)


@query(f"""WITH {UPLOADS}, n AS (SELECT session_id, count(*) AS n FROM v WHERE verdict = 'accepted' GROUP BY ALL),
q AS (SELECT c_custkey AS session_id, unnest([1, 2])::INT AS seq FROM customer)
SELECT session_id, seq, CASE WHEN n IS NULL THEN 'no files' WHEN seq > 1 THEN 'already complete' ELSE 'complete' END AS verdict FROM q LEFT JOIN n USING (session_id)""")
def src_8_completions(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return tasks.judged_completions(asked, judged(spark, sf))


@query(f"WITH {FILES} SELECT path, 'text of ' || length(path) AS raw_text FROM f")
def src_10_recognised(spark, sf):
    """A stand-in for an engine gives each path's length; it is out of memory for more than two at a time."""

    def engine():
        def read(paths):
            if len(paths) > 2:
                raise MemoryError
            return [f"text of {len(p)}" for p in paths]

        return read

    return files.recognise(made_files(spark, sf), engine)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'paddle-ocr' ELSE 'deepseek' END AS provider, CASE p_partkey % 3 WHEN 0 THEN 'ppocr-v4' WHEN 1 THEN 'ocr-2'
  ELSE 'x/y' END AS model FROM part""")
def src_11_engine(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, "paddle-ocr").when(F.col("p_partkey") % 3 == 1, "deepseek").otherwise("deepseek/x/y")
    return table(spark, sf, "part").select("p_partkey", files.engine_of(name).alias("e")).select("p_partkey", "e.*")


@query("""WITH k AS (SELECT l_orderkey AS page_id, 'i' || l_linenumber || '.jpg' AS old_name FROM lineitem WHERE l_quantity >= 10 AND l_linenumber * 40 >= 64)
SELECT page_id, old_name, (row_number() OVER (PARTITION BY page_id ORDER BY old_name) - 1) || '.jpg' AS new_name FROM k""")
def src_12_kept_crops(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("old_name"), (F.col("l_linenumber") * 40).alias("width"), F.when(F.col("l_quantity") >= 10, 64).otherwise(63).alias("height"))
    return files.kept_crops(rows)


@query("SELECT p_partkey, 'a![](images/0.jpg)c' || p_name AS text FROM part")
def src_12_renamed_refs(spark, sf):
    own = F.concat(F.lit('a![](imgs/x.jpg)<div class="c"><img src="imgs/gone.jpg" /></div>c'), "p_name")
    return table(spark, sf, "part").select("p_partkey", files.rename_refs(own, F.create_map(F.lit("x.jpg"), F.lit("0.jpg"))).alias("text"))


@query("""SELECT l_orderkey AS task_id, l_linenumber AS result_index, CASE WHEN o_orderstatus = 'F' AND l_linenumber = 1 THEN 'edited' ELSE l_returnflag END AS markdown
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def out_5_edited(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("result_index"), F.col("l_returnflag").alias("markdown"))
    edits = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(1).alias("result_index"), F.lit("edited").alias("markdown"))
    return tasks.edit_result(rows, tasks_of(spark, sf), edits)


@query("SELECT p_partkey, p_partkey % 5 < 3 AS allowed FROM part")
def out_6_assets(spark, sf):
    paths = F.array(*map(F.lit, ("document.md", "d/document.md", "d/images/1.jpg", "../images/1.jpg", "a/b/images/1.jpg")))
    return table(spark, sf, "part").select("p_partkey", files.asset_allowed(F.element_at(paths, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("allowed"))


# Progress


@query("SELECT user_id AS task_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stm_1_latest_progress(spark, sf):
    return progress.latest_progress(table(spark, sf, "events").select(F.col("user_id").alias("task_id"), "event_id", "event_type"), order="event_id").select("task_id", "latest.*")


@query("""WITH e AS (SELECT user_id::VARCHAR AS task_id, list(['start', 'complete', 'fail', 'retry', 'cancel'][event_id % 5 + 1] ORDER BY event_id) AS es FROM events
  GROUP BY user_id)
SELECT task_id, list_reduce(list_prepend('pending', es), lambda s, e: CASE WHEN s = 'pending' AND e = 'start' THEN 'processing' WHEN s = 'processing' AND e = 'complete'
  THEN 'completed' WHEN s = 'processing' AND e = 'fail' THEN 'failed'
  WHEN s IN ('pending', 'processing') AND e = 'cancel' THEN 'failed' WHEN s = 'failed' AND e = 'retry' THEN 'pending' ELSE s END) AS status FROM e""")
def stm_3_task_states(spark, sf):
    kinds = F.array(*map(F.lit, ("start", "complete", "fail", "retry", "cancel")))
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("event"))
    return tasks.latest_status(events)


@query("""WITH e AS (SELECT user_id AS task_id, event_id AS seq, ['pending', 'processing', 'completed', 'processing', 'failed'][event_id % 97 % 5 + 1] AS status
  FROM events),
x AS (SELECT task_id, min(seq) AS last FROM e WHERE status IN ('completed', 'failed') GROUP BY ALL) SELECT e.* FROM e LEFT JOIN x USING (task_id) WHERE last IS NULL
  OR seq <= last""")
def stm_2_delivered(spark, sf):
    kinds = F.array(*map(F.lit, ("pending", "processing", "completed", "processing", "failed")))
    events = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 97 % 5 + 1).cast("int")).alias("status"))
    return progress.delivered(events)


@query("SELECT event_id, ts AS created_at FROM events WHERE epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(ts) < 3600")
def stm_4_live_sessions(spark, sf):
    return tasks.live_sessions(table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at")), "2024-01-15 00:00:00")


@query("SELECT doc_id, '[' || doc_id % 9 || '/9 ' || source || '] ' || lang AS message FROM documents")
def stm_6_progress_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tasks.progress_label(F.col("source"), (F.col("doc_id") % 9).cast("int"), F.lit(9), F.col("lang")).alias("message"))


# Settings


@query("""SELECT p_partkey, 'cloud' AS provider, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS model, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, 8000)::INT
  AS max_chars_per_segment, p_size % 5 <> 0 AS enable_gap_fill FROM part""")
def asm_15_merged_requests(spark, sf):
    """Fields of a request that aren't null stand over the defaults."""
    asked = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("model"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("int")).alias("max_chars_per_segment"),
        F.when(F.col("p_size") % 5 == 0, False).alias("enable_gap_fill"),
    )
    return files.merged_requests(asked, LLMConfig()).select("p_partkey", "provider", "model", "max_chars_per_segment", "enable_gap_fill")


@query("SELECT count(*) AS calls, 3::BIGINT AS tasks, 2::BIGINT AS most_tries, count_if(doc_id % 10 = 0) AS failed FROM documents")
def llm_13_in_flight(spark, sf):
    """Calls run in as many tasks as may be in flight at a time; a stand-in fails every tenth call each time it is tried."""

    def call(messages):
        from pyspark import TaskContext

        key = int(messages[0]["content"])
        if key % 10 == 0:
            raise ConnectionError
        return str(TaskContext.get().partitionId()), "stop"

    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.array(F.struct(F.lit("user").alias("role"), F.col("doc_id").cast("string").alias("content"))).alias("messages"))
    config = LLMConfig(max_concurrent_requests=3, max_retries=1)
    done = protocol.complete(asked, call, config)
    return done.agg(F.count("*").alias("calls"), F.count_distinct("reply").alias("tasks"), F.lit(config.max_retries + 1).cast("long").alias("most_tries"), F.count_if("failed").alias("failed"))


@query(f"WITH {FILES} SELECT path, 'batch of 2' AS raw_text FROM f")
def stm_5_back_off(spark, sf):
    """An engine that has memory for two pages: the batch goes from 8 to 4 to 2 and stays there."""

    def engine():
        fitted = grown = False

        def read(paths):
            nonlocal fitted, grown
            if len(paths) > 2:
                grown = grown or fitted  # once a batch has fitted, no larger one is tried again
                raise MemoryError
            fitted = True
            return ["grown" if grown else "batch of 2"] * len(paths)

        return read

    return files.recognise(made_files(spark, sf), engine, batch=8)
