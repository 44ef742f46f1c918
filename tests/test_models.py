"""Features and models."""

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from presswork.operators import descent, features, metrics, train
from presswork.plans import corpus
from presswork.sources.models import load_model, save_model

TEXTS = ["cat dog cat", "dog bird", "cat bird fish", "dog dog cat bird", "fish", "cat dog"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")


def test_vectors_equal_the_relational_form(spark, docs):
    terms = features.with_terms(docs)
    vocab = features.vocabulary(terms, len(TEXTS))
    names = [r["term"] for r in vocab.orderBy("term").collect()]
    vectors = features.fit_tfidf(terms, 10_000).transform(terms).select("id", "features").collect()
    left = {(r["id"], names[i]): float(v) for r in vectors for i, v in zip(r["features"].indices, r["features"].values)}
    right = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_terms(docs, vocab, "id").collect()}
    assert left.keys() == right.keys()
    assert all(math.isclose(left[k], right[k], abs_tol=1e-9) for k in left)
    cats = vocab.where("term = 'cat'").first()
    assert (cats["df"], cats["cf"]) == (4, 5) and math.isclose(cats["idf"], math.log(7 / 5) + 1)
    assert features.vocabulary(terms, len(TEXTS), size=2).count() == 2
    assert "cat" not in {r["term"] for r in features.vocabulary(terms, len(TEXTS), max_df=0.5).collect()}


@pytest.fixture(scope="module")
def trained(spark, docs):
    data = docs.withColumn("pet", F.col("content").contains("cat").cast("int")).withColumns(
        {"never": F.lit(0), "always": F.lit(1)})
    return data, train.fit_multilabel(data, ["pet", "never", "always"], size=100, c=100.0)


def test_single_class_labels_are_constant(spark, trained, tmp_path):
    data, model = trained
    assert model.constants == {"never": 0.0, "always": 1.0}
    rows = train.predict_multilabel(data, model).collect()
    for r in rows:
        scores = {s["label"]: s["score"] for s in r["scores"]}
        assert scores["never"] == 0.0 and scores["always"] == 1.0
        assert (r["pred_never"], r["pred_always"], r["pred_pet"]) == (0, 1, r["pet"])
        assert (scores["pet"] > 0.5) == bool(r["pet"])
    save_model(model, str(tmp_path / "m"), spark)
    again = load_model(str(tmp_path / "m"), spark)
    assert again.labels == model.labels and again.constants == model.constants
    assert [r["scores"] for r in train.predict_multilabel(data, again).orderBy("id").collect()] == [
        r["scores"] for r in sorted(rows, key=lambda r: r["id"])]


def test_label_list_must_fit_the_models(spark):
    with pytest.raises(ValueError):
        train.MultiLabelModel(PipelineModel([]), ["a", "b"], {"a": 0.0})


def test_train_stage(spark, trained):
    data, _ = trained
    split = data.withColumn("split", F.when(F.col("id") == 0, "val").when(F.col("id") == 5, "test").otherwise("train"))
    result = corpus.train_stage(split, ["pet", "never"], size=100, c=100.0)
    got = {r["split"]: r["hamming_loss"] for r in result.metrics.collect()}
    assert got == {"val": 0.0, "test": 0.0} and result.seconds > 0
    table = corpus.results_table({"one": result, "two": result}, "stage1")
    assert [r["model"] for r in metrics.best_model(table).collect()] == ["one"]
    doc = corpus.results_document(table, "stage1", ["pet", "never"]).first()
    assert [m["name"] for m in doc["models"]] == ["one", "two"] and doc["num_labels"] == 2
    assert doc["models"][0]["test_metrics"]["hamming_loss"] == 0.0


@pytest.fixture(scope="module")
def shuffled(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = rnd.choices(words, k=rnd.randint(3, 12))
        rows.append((i, " ".join(own), *[int(("w0" in own) ^ (rnd.random() < 0.1 * k)) for k in range(4)], rnd.choice([1.0, 2.0])))
    return spark.createDataFrame(rows, "id int, content string, a int, b int, c int, d int, weight double").repartition(3)


def weights_of(model):
    return {s.getLabelCol(): [*s.coefficients.toArray(), s.intercept] for s in model.pipeline.stages if hasattr(s, "coefficients")}


@pytest.mark.parametrize("weight", [None, "weight"])
def test_labels_fitted_together_equal_single_fits(spark, shuffled, weight):
    from pyspark.ml.classification import LogisticRegression

    labels = ["a", "b", "c", "d"]
    model = train.fit_multilabel(shuffled, labels, size=50, weight=weight)
    one = train.fit_multilabel(shuffled, labels, size=50, weight=weight, partitions=1)
    rows = PipelineModel(model.pipeline.stages[:3]).transform(features.with_terms(shuffled))
    n = shuffled.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    for label in labels:
        lr = LogisticRegression(labelCol=label, regParam=1.0 / n, standardization=False, tol=1e-10, maxIter=1000)
        want = (lr.setWeightCol(weight) if weight else lr).fit(rows.withColumn(label, F.col(label).cast("double")))
        for got in (weights_of(model)[label], weights_of(one)[label]):
            assert got == pytest.approx([*want.coefficients.toArray(), want.intercept], abs=2e-3)


def test_a_pass_serves_all_labels(spark, shuffled, monkeypatch):
    passes = []
    monkeypatch.setattr(descent, "_summed", lambda partials, inner=descent._summed: passes.append(1) or inner(partials))
    train.fit_multilabel(shuffled, ["a"], size=50)
    single, passes[:] = len(passes), []
    train.fit_multilabel(shuffled, ["a", "b", "c", "d"], size=50)
    assert len(passes) < 2 * single + 5


def test_the_size_has_to_be_named(shuffled):
    with pytest.raises(TypeError):
        train.fit_multilabel(shuffled, ["a"])


@pytest.mark.parametrize("ties", [1 << 16, 3])
def test_most_frequent_terms(spark, monkeypatch, ties):
    monkeypatch.setattr(features, "TIES", ties)
    rnd = random.Random(5)
    rows = [(f"t{i}", rnd.choice([1, 1, 1, 2, 5, 9, 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, cf int").repartition(5)
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for size in (1, 7, 30, 200, 299, 300, 1000):
        assert sorted(tuple(r) for r in features.most_frequent(df, size).collect()) == sorted(ordered[:size])
