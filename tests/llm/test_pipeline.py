"""Each stage against a plain version, on its own input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import near_dedup, pii_scan, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, sf), name)
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.schema == before.schema


def test_quality_stage(spark, sf, stages):
    before, after = stages["quality_classifier"]
    field = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in before.collect() if quality.score_texts(field, [r.text])[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == want
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(before, "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_dedup_stage(stages):
    from tests.llm.test_text_operators import plain_components

    before, after = stages["minhash_near_dedup"]
    want = {i for i, (_, c) in plain_components([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.SIMILARITY).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_redaction_stage(stages):
    before, after = stages["pii_redaction"]
    was = {r.doc_id: r for r in before.collect()}
    for r in after.collect():
        spans = pii_scan.base_spans(was[r.doc_id].text)
        assert spans or r.text == was[r.doc_id].text
        assert not pii_scan.base_spans(r.text) and r.n_chars == len(r.text)
        assert len(re.findall(r"\[(?:email|ip|card|phone|ssn)\]", r.text)) >= bool(spans)


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_edges(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x y z", "en", "s", 5), (2, "", "en", "s", 0), (3, "mail a.b@c.de", "en", "s", 13)], DOCS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = stage(spark, docs, sf)
    assert docs.count() == 4


def test_n_chars_follows(spark, sf):
    out = corpus_pipeline.redaction(spark, spark.createDataFrame([(3, "mail a.b@c.de", "en", "s", 13)], DOCS), sf).first()
    assert out.text == "mail [email]" and out.n_chars == 12
    assert corpus_pipeline.redaction(spark, spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), sf).columns == ["doc_id", "text"]


def test_dedup_stage_links_from_080(spark, sf):
    """Pairs of similarity 0.80 to 0.85 are near duplicates in the pipeline, 0.79 and less are not; op9_minhash begins at 0.85."""
    rows, want = [], set()
    for i, own in enumerate(range(6, 16)):
        # Words that occur once: texts of 100 shingles with 100 - own shingles in common have similarity (100 - own) / (100 + own).
        words = [f"w{i}x{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 104 - own] + [f"z{i}x{k}" for k in range(own)]))]
        want |= {2 * i} if 100 * (100 - own) >= 80 * (100 + own) else {2 * i, 2 * i + 1}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, docs, sf).collect()} == want
    usual = {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    assert usual == {2 * i for i in range(10)} | {2 * i + 1 for i, own in enumerate(range(6, 16)) if 100 * (100 - own) < 85 * (100 + own)}


def test_distances_follow_the_similarity():
    rng = np.random.default_rng(1)
    far = near_dedup.reach(80)
    assert near_dedup.reach(85) == (12, 23, 111) and far.distance >= 28 and far.long_distance >= 140
    for _ in range(200):
        a = rng.integers(0, 1 << 16, near_dedup.POSITIONS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.POSITIONS, far.distance, replace=False)] ^= 1
        keys = near_dedup.index_keys(np.stack([a, b]), far.chunks)
        assert (keys[0] == keys[1]).any()
