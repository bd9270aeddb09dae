"""The pipeline's stages and its whole run."""

import random
import tempfile

import duckdb
import pytest

import corpus_pipeline
from docweave.llm import common, mixing, packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), "test-stage")
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_shrink(spark, stages):
    before = common.table(spark, SF, "documents")
    for name, docs in stages[:-1]:
        assert docs.columns == before.columns, name
        assert docs.count() <= before.count()
        before = docs


def test_clean_documents_stay(spark, stages):
    db = duckdb.connect()
    clean = {r[0] for r in db.execute(f"SELECT d.doc_id FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND len(regexp_extract_all(text, '[^ \t\n\r]+')) >= 50").fetchall()}
    junk = {r[0] for r in db.execute(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 0").fetchall()}
    after_quality = {r.doc_id for r in stages[0][1].select("doc_id").collect()}
    assert clean <= after_quality and len(junk & after_quality) <= 0.05 * len(junk)
    near, mixed = ({r.doc_id for r in s[1].select("doc_id").collect()} for s in stages[2:4])
    assert len(clean & near - mixed) <= 0.01 * len(clean & near)  # only what reads as toxic or low is cut


def test_toxic_documents_go(spark):
    """The mixing stage on texts whose toxicity can be learnt: toxic ones go, labelled or not, and clean ones stay."""
    r = random.Random(21)
    plain = "river stone house garden walked quietly morning light paper window".split()
    rows = [(i, " ".join(r.choice(plain) if i % 8 or r.random() > 0.2 else r.choice(["idiot", "moron", "scum"]) for _ in range(120)), "en", "s", 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    with tempfile.TemporaryDirectory() as sf:
        spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 800, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        kept = {x.doc_id for x in corpus_pipeline.mix_sources(spark, docs, sf).collect()}
    assert kept == {i for i in range(800) if i % 8}


def test_packing_holds_every_token(spark, stages):
    docs, pieces = stages[3][1], stages[4][1]
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    own = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in own)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[4][1].count()
