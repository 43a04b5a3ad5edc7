import random

import numpy as np
import pytest

from panelyard.llm import quality_classifier, toxicity


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def accuracy(out, labels, label):
    return out.join(labels, "doc_id").where("held_out").selectExpr(f"avg(int(predicted = {label})) AS a", "min(score) AS lo", "max(score) AS hi").first()


def test_held_out_accuracy(documents, labels):
    tox = accuracy(toxicity.scores(documents, labels), labels, "toxic")
    good = accuracy(quality_classifier.scores(documents, labels), labels, "quality")
    assert tox.a > 0.9 and good.a > 0.95
    assert 0 <= tox.lo <= tox.hi <= 1 and 0 <= good.lo <= good.hi <= 1


def test_labels_of_the_held_out_fold_teach_nothing(documents, labels):
    from pyspark.sql import functions as F

    from panelyard.llm.folds import held_out

    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    for scores in (toxicity.scores, quality_classifier.scores):
        a = {r.doc_id: round(r.score, 9) for r in scores(documents, labels).collect()}
        b = {r.doc_id: round(r.score, 9) for r in scores(documents, turned).collect()}
        assert a == b


@pytest.mark.parametrize("scores", [toxicity.scores, quality_classifier.scores])
def test_edges(docs, edges, spark, labels, scores):
    rows = [*enumerate(edges), (None, "text"), (5, "word")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for told in (none, spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (3, 0, 1), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")):
        out = scores(docs(rows), told).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert scores(docs([]), labels).count() == 0


def test_grammar():
    scorer = toxicity.Scorer({"idio": 4.0})
    total = lambda t: np.expm1(scorer.features(t)[1])
    assert total("you idiot") > total("an idiot") > total("he said idiot") > 0
    assert total("not an idiot") < total("an idiot")
    assert total("not there. an idiot") == pytest.approx(total("an idiot"))
    assert total("a kind word") == 0
    # a target after the insult is worth as much as before it; a threat needs a target
    assert total("idiot you") == pytest.approx(total("you idiot"))
    assert total("they burn wood") > total("wood will burn") == 0
    assert total("burn them") == pytest.approx(total("they burn"))
    assert total("he said burn them") < total("burn them")


def test_other_columns_do_not_clash(docs, spark, labels):
    """Columns of documents that bear the operators' working names."""
    from pyspark.sql import functions as F

    own = docs(["you idiot", "calm words", None]).withColumns({c: F.lit(9) for c in ("y", "_id", "quality", "toxic", "x", "f0", "held_out", "predicted")})
    for scores in (toxicity.scores, quality_classifier.scores):
        assert scores(own, labels).count() == 3
    assert toxicity.without_toxic(own, labels).columns == own.columns


def test_toxic_documents_go(docs, spark):
    rows = docs(["you are a stupid idiot, a moron and a worthless loser", "a calm text on gardens and rain", None])
    kept = toxicity.without_toxic(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {1, 2}


def test_network_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality_classifier.Network(x, y)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.9
    assert 0.25 <= net.temperature <= 8


def test_random_index_is_sparse_and_stable():
    v = quality_classifier.index_vector("word")
    assert np.abs(v).sum() <= quality_classifier.NONZERO and (v == quality_classifier.index_vector("word")).all()
    random.seed(0)
