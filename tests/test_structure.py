"""Layout, protocol, assembly, tasks, files."""

import pytest
from pyspark.sql import functions as F

from vellum.config import LLMConfig
from vellum.operators import assembly, layout, protocol, tasks
from vellum.sources import files


def page(left, right, content=10, extra=()):
    rows = [("text", 10, 120 + i * 100, 200, 140 + i * 100) for i in range(left)] + [("text", 850, 120 + i * 100, 990, 140 + i * 100) for i in range(right)]
    rows += [("text", 250, 120 + i * 80, 750, 140 + i * 80) for i in range(content)] + list(extra)
    return rows


@pytest.mark.parametrize(
    ("rows", "has"),
    [
        (page(6, 6), True), (page(6, 0), True), (page(0, 6), True), (page(3, 3), False), (page(0, 0), False),
        (page(6, 0, 5, [("text", 30, 120 + i * 90, 700, 140 + i * 90) for i in range(5)]), False),
        (page(6, 0, 10, [("text", 30, 120 + i * 90, 700, 140 + i * 90) for i in range(2)]), True),
        (page(6, 6, 10, [("text", 0, 100 + i * 200, 999, 120 + i * 200) for i in range(4)]), True),
        ([("text", 10 + i * 50, 10, 60 + i * 50, 40) for i in range(8)], False),
    ],
)
def test_sidebars(spark, rows, has):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id int, ord int, label string, x1 int, y1 int, x2 int, y2 int")
    assert layout.column_boundaries(df).first().has_sidebar is has


def test_grounding(spark):
    raw = "<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4], [5, 6, 7, 8]]<|/det|>\nhello\n<|ref|>x<|/ref|><|det|>oops<|/det|>\nbad\n<|ref|>image<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\n"
    df = spark.createDataFrame([(1, raw), (2, "")], "page_id int, raw_text string")
    rows = layout.grounding_regions(df).orderBy("ord", "x1").collect()
    assert [(r.label, r.x1, r.text) for r in rows] == [("text", 1, "hello"), ("text", 5, "hello"), ("image", 1, "")]


@pytest.mark.parametrize(("ids", "n", "banned"), [([5, 7, 9, 5], 2, [7]), ([5, 7, 3, 5, 8, 2, 5], 2, [7, 8]), ([1, 2, 9, 4, 5, 1, 2], 3, [9]), ([1, 1, 1], 1, []), ([4], 3, [])])
def test_banned_tokens(spark, ids, n, banned):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(layout.banned_tokens(F.col("ids"), F.lit(n), F.lit(90), F.array(F.lit(99)))).first()[0] == banned


def test_tile_ties(spark):
    df = spark.createDataFrame([(2000, 1000), (100, 50), (768, 768)], "w int, h int")
    got = [tuple(r[0]) for r in df.select(layout.tile_grid(F.col("w"), F.col("h"))).collect()]
    assert got[0] == (2, 1) and got[1] == (2, 1) and got[2] == (2, 2)


def test_parsers(spark):
    text = 'a<!-- GAP: after_image=p1.jpg, context_before="x", context_after="y" -->b<!-- GAP: nope --><!-- DOC_BOUNDARY: {"after_page":"p2"} --><!-- DOC_BOUNDARY: {bad} -->'
    row = spark.createDataFrame([(text,)], "t string").select(protocol.parse_gaps(F.col("t")).alias("g"), protocol.parse_boundaries(F.col("t")).alias("b")).first()
    assert [g.after_image for g in row.g.gaps] == ["p1.jpg"] and "nope" in row.g.cleaned
    assert [(b.after_page, b.new_title) for b in row.b.boundaries] == [("p2", "")] and "DOC_BOUNDARY" not in row.b.cleaned


def test_retries(spark):
    def call(messages):
        if messages[-1]["content"] == "bad":
            raise RuntimeError
        return "ok", "length"

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "request_id int, t string").withColumn("messages", protocol.messages("s", F.col("t")))
    assert {tuple(r) for r in protocol.complete(rows, call, LLMConfig(max_retries=1)).collect()} == {(1, "ok", True, False), (2, None, False, True)}


def test_split_and_boundaries(spark):
    markdown = "".join(f"<!-- page: p{i} -->\nbody {i}\n" for i in range(1, 5)).replace("body 1", "# First")
    docs = spark.createDataFrame([(1, markdown)], "doc_id int, markdown string")
    marks = spark.createDataFrame([(1, "p2", "Second"), (1, "p2", "Second"), (1, "gone", "x"), (1, "p4", "end")], "doc_id int, after_page string, new_title string")
    rows = assembly.split_documents(docs, marks).orderBy("sub_no").collect()
    assert [(r.title, r.pages) for r in rows] == [("First", ["p1", "p2"]), ("Second", ["p3", "p4"])]
    assert "".join(r.markdown for r in rows) == markdown
    assert '"after_page": "p2"' in assembly.insert_boundaries(markdown, [("p2", 'a "q"')])


def test_gap_fill(spark):
    text = "<!-- page: a.jpg -->\nx\n<!-- page: b.jpg -->\ny"
    df = spark.createDataFrame([(text, "a.jpg", "b.jpg"), (text, "b.jpg", None), (text, "z", "b.jpg")], "t string, own string, nxt string")
    got = [r[0] for r in df.select(assembly.insert_fill(F.col("t"), F.col("own"), F.col("nxt"), F.lit("FILL"))).collect()]
    assert got[0] == text.replace("<!-- page: b", "FILL\n\n<!-- page: b") and got[1] == got[2] == text + "\nFILL\n"


def test_trace_stats(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1, 21)] + [("n/a",)], "value string")
    row = tasks.trace_stats(df).first()
    assert (row["mean"], row["max"], row.p95) == (10.5, 20.0, 19.0)


def test_task_machine(spark):
    events = [("a", 1, "start"), ("a", 2, "complete"), ("a", 3, "cancel"), ("b", 1, "start"), ("b", 2, "fail"), ("b", 3, "retry"), ("c", 1, "restart")]
    got = tasks.latest_status(spark.createDataFrame(events, "task_id string, seq long, event string"))
    assert dict(map(tuple, got.collect())) == {"a": "completed", "b": "pending", "c": "failed"}


def test_staged_names():
    assert [n for _, n, _ in files.staged_names(["/a/x.jpg", "/b/x.jpg", "/c/x_1.jpg"])] == ["x.jpg", "x_1.jpg", "x_1_1.jpg"]
    assert [(n, e and e[:3]) for _, n, e in files.staged_names(["x.jpg", "/a/x.jpg", None, "/a/x.txt"])] == [(None, "not"), ("x.jpg", None), (None, "not"), (None, "not")]
    many = files.staged_names([f"/a/{k}.jpg" for k in range(files.MAX_STAGED + 2)])
    assert [e for _, _, e in many].count(None) == files.MAX_STAGED and many[-1][1] is None


def test_files_round_trip(spark, tmp_path):
    for name in ("a/1.jpg", "a/2.PNG", "a/sub/3.jpg", "b/c/4.jpeg", "b/c/note.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = files.listed(spark, str(tmp_path / "in"))
    assert sorted(r.dir.rsplit("/in/", 1)[1] for r in files.leaf_dirs(found).collect()) == ["a", "b/c"]
    assert files.page_images(found).count() == 4
    art = tmp_path / "art" / "p1_OCR" / "result.mmd"
    art.parent.mkdir(parents=True)
    art.write_text("hello\nworld")
    assert files.read_artifacts(spark, str(tmp_path / "art")).first().value == "hello\nworld"


@pytest.mark.parametrize("dirs", [["d1", "d2"], [""]])
def test_documents_written_and_packed(spark, tmp_path, dirs):
    """document.md without markers, its images beside it, all of it in the archive; written twice, it is the same."""
    import zipfile

    for stem, n in (("p1", 0), ("p1_cropped", 3)):
        (tmp_path / "out" / f"{stem}_OCR" / "images").mkdir(parents=True)
        (tmp_path / "out" / f"{stem}_OCR" / "images" / f"{n}.jpg").write_bytes(stem.encode())
    text = "<!-- page: p1.jpg -->\n# t\n![a](p1_OCR/images/0.jpg)\n<!-- page: p1_cropped.jpg -->\n<img src=\"p1_cropped_OCR/images/3.jpg\">\n![](gone_OCR/images/9.jpg)\n"
    want = "# t\n![a](images/p1_0.jpg)\n<img src=\"images/p1_cropped_3.jpg\">\n![](images/gone_9.jpg)"
    docs = spark.createDataFrame([(d, text) for d in dirs], "doc_dir string, markdown string")
    for _ in range(2):
        files.write_documents(docs, f"file:{tmp_path}/out")
    for d in dirs:
        assert (tmp_path / "out" / d / "document.md").read_text() == want
        assert (tmp_path / "out" / d / "images" / "p1_cropped_3.jpg").read_bytes() == b"p1_cropped"
    names = files.zip_documents(str(tmp_path / "out"), dirs, str(tmp_path / "z.zip"))
    assert names == [f"{d}/{n}".lstrip("/") for d in dirs for n in ("document.md", "images/p1_0.jpg", "images/p1_cropped_3.jpg")]
    assert zipfile.ZipFile(tmp_path / "z.zip").read(names[0]).decode() == want


def test_missing_text_is_an_error(spark):
    pages = spark.createDataFrame([(1, "d", "")], "page_id int, ocr_dir string, raw_text string")
    with pytest.raises(Exception, match="no recognised text"):
        files.page_text(pages, spark.createDataFrame([], "dir string, value string")).collect()


def test_assets(spark):
    df = spark.createDataFrame([("document.md",), ("a/document.md",), ("a/b/document.md",), ("images/x",), ("a/images/x",), ("../x",), ("/document.md",), ("",)], "p string")
    assert [r[0] for r in df.select(files.asset_allowed(F.col("p"))).collect()] == [True, True, False, True, True, False, False, False]


def test_config_merge():
    assert files.merged_config(LLMConfig(), {"model": "m", "provider": None}).model == "m"


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    """A machine's own folder stands in for it in local mode alone."""
    from types import SimpleNamespace

    from vellum import storage

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert storage.shared_dir(session("local[4]")) and storage.shared_dir(session("spark://x:7077", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))


def test_back_off_goes_with_the_pages(spark, tmp_path):
    """120,000 pages in one task: the work goes with their number, not its square."""
    import time

    from vellum.plans.queries import QUERIES

    parts = spark.range(120_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    began = time.perf_counter()
    got = QUERIES["stm_5_back_off"](spark, str(tmp_path)).groupBy("raw_text").count().collect()
    assert [tuple(r) for r in got] == [("batch of 2", 120_000)]
    assert time.perf_counter() - began < 20


def test_a_session_is_staged_whole(spark):
    """More files than a request may have, of two names of which one is what the other's second file gets."""
    n = files.MAX_STAGED + 1000
    rows = [(7, k, f"/x{k}/" + ("a_1.jpg" if k == 3 else "a.jpg")) for k in range(n)] + [(8, 0, "b.jpg")]
    got = files.stage_names(spark.createDataFrame(rows, "session_id int, position int, path string")).collect()
    assert [(r.path, r.name is None) for r in got if r.error] == [("b.jpg", True)]
    names = {r.path: r.name for r in got if r.session_id == "7"}
    assert len(set(names.values())) == n
    assert [names[f"/x{k}/" + ("a_1.jpg" if k == 3 else "a.jpg")] for k in (0, 1, 2, 3, 4, n - 1)] == ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "a_3.jpg", f"a_{n - 2}.jpg"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_live_sessions_to_the_microsecond(spark, zone, kind):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = ["2024-01-14 22:59:59.999999", "2024-01-14 23:00:00", "2024-01-14 23:00:00.000001", "2024-01-14 23:00:00.9", "2024-01-16 00:00:00", None]
        made = spark.createDataFrame(list(enumerate(times)), "id int, t string").select("id", F.col("t").cast(kind).alias("created_at"))
        assert [r.id for r in tasks.live_sessions(made, "2024-01-15 00:00:00").orderBy("id").collect()] == [2, 3, 4]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
