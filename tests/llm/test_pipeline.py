from collections import Counter

import corpus_pipeline
from folioscale.llm import mixing, packing, quality, simhash, toxicity


def test_stages_agree_with_the_operators_decisions(spark, tmp_path):
    """Each stage's rows are those that its operator's verdicts name, over what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    verdicts = [
        lambda d: [r.doc_id for r in quality.quality_rules(d).collect() if r.kept],
        lambda d: [r.doc_id for r in toxicity.toxicity(d, labels).collect() if not r.predicted],
        lambda d: sorted({r.component_id for r in simhash.near_duplicates(d).collect()}),
        lambda d: [r.doc_id for r in mixing.schedule(d).collect()],
    ]
    for (name, stage), verdict in zip(corpus_pipeline.STAGES[:4], verdicts, strict=True):
        kept = stage(spark, docs, sf)
        assert kept.columns == columns, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(verdict(docs)), name
        docs = kept
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    want = Counter((r.doc_id, r.piece, r.length) for r in packing.token_pieces(docs).collect())
    assert Counter((r.doc_id, r.piece, r.length) for r in packed.collect()) == want
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == packed.columns and Counter((r.doc_id, r.piece, r.length) for r in got.collect()) == want


def test_clean_documents_pass_the_filtering_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    low = {r.doc_id for r in labels.where("quality = 0").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").collect()}
    assert not low & kept
    failed = {r.doc_id for r in quality.quality_rules(docs).collect() if r.base_failed}
    assert clean - failed <= kept
    stays = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, sf).select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(good & stays) >= 0.99 * len(good)


def test_empty_documents(spark):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
