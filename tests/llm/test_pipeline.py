import corpus_pipeline
from panelyard.llm import queries


def test_pipeline_on_small_tables(spark, data):
    out = corpus_pipeline.run(spark, data).toPandas()
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]


def test_stages_keep_columns_and_clean_rows(spark, data, docs):
    own = docs(["a clean text of its own kind", None, "", "another text that is fine"]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, data)
        assert out.columns == own.columns
        assert {0, 3} <= {r.doc_id for r in out.collect()}
        assert stage(spark, own.limit(0), data).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_stages_keep_columns_that_bear_their_working_names(spark, data, docs):
    from pyspark.sql import functions as F

    names = ["y", "_id", "_dk", "dk", "_hit", "_node", "node", "_keep", "_shared", "_starts", "starts", "item_id", "size", "h", "row", "length", "key"]
    own = docs(["a clean text of its own kind", None, "", "another text that is fine"]).withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, data)
        assert out.columns == own.columns and out.where("_node = '_node' AND y = 'y'").count() == out.count() >= 2
    assert corpus_pipeline.packing(spark, own, data).count() == 4
