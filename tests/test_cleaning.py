import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.merge import merge_pages, merge_pair, remove_repetitions
from vellum.operators.segment import segments_of


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_lines_as_python_splits(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\x0bb\x0cc\x1cd\x85e f g\n\n", "\n"]
    assert apply(spark, tx.lines, texts) == [t.splitlines() for t in texts]


def test_normalize_line(spark):
    texts = ["  a \t b ", "　x y\x1c", ""]
    assert apply(spark, tx.normalize_line, texts) == [" ".join(t.split()) for t in texts]


def test_garbage_runs(spark):
    kana = "か" * 20
    assert apply(spark, tx.remove_garbage, ["a" + "é" * 19 + "b", "a" + "é" * 20 + "b", kana, "汉" * 20, "a" + "é" * 10 + " " + "é" * 10]) == [
        "a" + "é" * 19 + "b", "ab", "", "汉" * 20, "a" + "é" * 10 + " " + "é" * 10,
    ]


def test_blank_lines(spark):
    assert apply(spark, tx.normalize_whitespace, ["a\n\n\n\nb", "a\n\nb", None]) == ["a\n\nb", "a\n\nb", None]


def test_repetitions(spark):
    long = "".join(chr(97 + i * 7 % 26) for i in range(319))
    texts = ["one two three four\n\none two three four!\n\nother", "single", "A first\n\nB other\n\nA first", f"{long}\n\nz{long}", None]
    got = apply(spark, remove_repetitions, texts)
    assert got[0] == "one two three four\n\nother" and got[1:3] == texts[1:3] and got[3] == texts[3] and got[4] is None


def test_exact_repeats(spark):
    assert apply(spark, tx.drop_exact_repeats, ["a\n\na \n\nb\n\na", "x", ""]) == ["a\n\nb\n\na", "x", ""]


@pytest.mark.parametrize(
    ("title", "name"),
    [("  a/b:c ", "a_b_c"), ("", ""), ("...", ""), ("a..b", "ab"), ("x" * 65, "x" * 64), ("a\x01b", "a_b"), ("__a__", "a"), ("😀报告", "😀报告")],
)
def test_sanitize_dirname(spark, title, name):
    assert apply(spark, tx.sanitize_dirname, [title]) == [name]


def test_secure_paths(spark):
    assert apply(spark, tx.secure_filename, ["a/b", "é*x.jpg", "***"]) == ["a_b", "éx.jpg", "unnamed"]
    assert apply(spark, tx.secure_relpath, ["a\\b.jpg", "/x", "a/../b", "a//b", ""]) == ["a/b.jpg", None, None, "a/b", None]


def test_tags(spark):
    assert apply(spark, tx.escape_unknown_tags, ["<Select> <b>x</b> <br/> <TABLE> <exit>"]) == ["&lt;Select&gt; <b>x</b> <br/> <TABLE> &lt;exit&gt;"]


def test_percent(spark):
    rows = spark.createDataFrame([(6665, 10000), (1225, 10000), (1, 0), (None, 2)], "a long, b long").select(tx.percent(F.col("a"), F.col("b")))
    assert [r[0] for r in rows.collect()] == [round(6665 / 10000 * 100, 1), 12.2, 0.0, None]


def test_overlap_rules():
    assert merge_pair("a\nb\nc\nd", "c\nd\ne")[1] == 2
    assert merge_pair("a\nb\nc", "c\nz")[1] == 0  # one line isn't enough
    assert merge_pair("a\nb\nc\ntail", "b\nc\nd", 1.0)[0] == "a\nb\nc\nd"  # what follows the block goes
    text, n, _ = merge_pair("<!-- page: 1 -->\na\nb\nc", "<!-- page: 2 -->\nb\nc\nd")
    assert n == 2 and text.splitlines() == ["<!-- page: 1 -->", "a", "<!-- page: 2 -->", "b", "c", "d"]


def test_merge_in_order(spark):
    rows = [("g", i, f"p{i}", f"line {i}\nmore {i}") for i in (3, 1, 2)]
    got = merge_pages(spark.createDataFrame(rows, "group_id string, page_seq int, image_name string, text string")).first()
    assert [x for x in got.markdown.splitlines() if x.startswith("<!--")] == [f"<!-- page: p{i} -->" for i in (1, 2, 3)]
    assert got.n_pages == 3 and got.overlap_lines == 0


def test_segments():
    assert segments_of(" \n", 10, 1) == []
    assert segments_of("a\nb\n", 10, 1) == [(0, "a\nb\n", 1, 2)]
    text = "".join(f"# H{i}\n" + "x" * 30 + "\n" for i in range(6))
    made = segments_of(text, 80, 2)
    assert made[0][2] == 1 and made[-1][3] == 12 and all(a[3] + 1 == b[2] for a, b in zip(made, made[1:], strict=False))
    assert not made[0][1].startswith("x") and "# H1" in made[1][1]
    assert len(segments_of("y" * 300, 80, 2)) == 1  # nothing to cut at


def test_fold_is_pairwise_merging():
    """Pages folded with kept lines give what merging text by text gives, with odd line ends, markers within pages and common lines."""
    import random

    from vellum.operators.merge import MARKER, Fold

    rng = random.Random(1)
    for trial in range(1500):
        ends = ["\n", "\n", "\r\n", "\r", "\x0b"] if rng.random() < 0.3 else ["\n"]
        words, most = (["a", "b", "c", "", " ", "d"], 8) if trial % 30 else (["a", "", *(f"w{k}" for k in range(40))], 400)
        pages, before = [], []
        for k in range(rng.randint(1, 6)):
            body = [rng.choice(words) for _ in range(rng.randint(0, most))]
            if before and rng.random() < 0.6:
                body = before[-rng.randint(1, 1 + most // 2) :] + body
            if rng.random() < 0.2:
                body.insert(rng.randint(0, len(body)), "<!-- page: x -->")
            before = body
            text = "".join(x + rng.choice(ends) for x in body)
            pages.append(f"{MARKER} {k} -->\n{text[: -1 if rng.random() < 0.5 else None]}")
        ratio = rng.choice([0.7, 0.3, 1.0])
        want, lines = pages[0], 0
        fold, n = Fold(pages[0], ratio), 0
        for page in pages[1:]:
            want, more, _ = merge_pair(want, page, ratio)
            lines += more
            n += fold.add(page)
        assert (fold.text(), n) == (want, lines)


def test_pages_keep_their_images_apart(spark):
    rows = [("g", 0, "a.b.jpg", "![x](images/0.jpg)", None, None), ("g", 1, "c.jpg", "", '<img src="images/0.jpg">', None), ("g", 2, "d.jpg", None, None, "d_cropped_OCR")]
    pages = spark.createDataFrame(rows, "group_id string, page_seq int, image_name string, text string, raw string, ocr_dir string")
    got = merge_pages(pages, raw="raw", ocr_dir="ocr_dir").first().markdown
    assert got == '<!-- page: a.b.jpg -->\n![x](a.b_OCR/images/0.jpg)\n\n<!-- page: c.jpg -->\n<img src="c_OCR/images/0.jpg">\n\n<!-- page: d.jpg -->'


def test_noise_sets_past_the_broadcast(spark, monkeypatch):
    """Salted groups give what broadcast sets give, and no text is sorted or shuffled by its group."""
    from vellum.config import DedupConfig
    from vellum.operators import frequency

    rows = [("g" if k % 3 else "h", k, f"top\nown {k}\nmid {k}\n  foot " + ("x" if k % 2 else "")) for k in range(40)] + [("i", 99, "top")]
    pages = spark.createDataFrame(rows, "group_id string, page_seq int, text string")
    read = lambda: sorted(map(tuple, frequency.strip_repeated_lines(pages, DedupConfig(repeated_line_min_block=1)).select("group_id", "page_seq", "text", "removed").collect()))
    want = read()
    assert sum(r[3] for r in want) >= 40
    monkeypatch.setattr(frequency, "BROADCAST_BYTES", -1)
    assert read() == want
