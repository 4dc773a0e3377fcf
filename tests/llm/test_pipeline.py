from loomstone.llm import queries, tokens

import corpus_pipeline

from . import helpers


def test_stages_keep_columns_and_every_clean_document(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns and 0.5 * before <= out.count() <= docs.count()
            assert out.where("n_chars <> length(text)").count() == 0
            docs = out
    enc = tokens.encoder(tokens.public("word_bpe_49k.json"))
    assert out.agg({"length": "sum"}).first()[0] == sum(len(x) // 2 + 1 for x in enc.encode([r["text"] for r in docs.collect()]))


def test_run_on_awkward_documents(spark, tmp_path):
    for name, rows in (("documents", helpers.awkward(spark)), ("labels", spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, helpers.prose(70, 20))], "item_id bigint, text string"))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {None, 0, 2, 3, 4, 5, 7, 8, 9, 10}
    helpers.empty(spark).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
