from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presswork.llm import rules, toxicity
from presswork.llm.labelled import fold, labelled_texts
from presswork.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    ones = label == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_rules_score_alike_in_spark_and_in_rows(spark):
    rnd = np.random.default_rng(1)
    x = rnd.random((500, len(rules.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.8)).astype(float)
    model = rules.fit_rules(x, y)
    assert ((model.score_rows(x) > 0.5) == y).mean() > 0.98
    df = spark.createDataFrame([(i, tuple(map(float, row))) for i, row in enumerate(x[:50])],
                               "i int, s struct<" + ",".join(f"{n}:double" for n in rules.STATISTICS) + ">")
    got = [r[0] for r in df.orderBy("i").select(model.score("s")).collect()]
    assert np.allclose(got, model.score_rows(x[:50]))


def test_lasso_meets_its_conditions():
    rnd = np.random.default_rng(2)
    z = (rnd.random((400, 12)) > 0.5).astype(float)
    y = (rnd.random(400) < 1 / (1 + np.exp(1 - 2 * z[:, 0] - z[:, 1]))).astype(float)
    b, w = rules.lasso_logistic(z, y, 0.01, 4000)
    slope = z.T @ (1 / (1 + np.exp(-(b + z @ w))) - y) / len(y)
    assert np.all(np.abs(slope) <= 0.01 + 1e-5) and np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-5) and (w == 0).any()


def test_statistics_of_odd_texts():
    for text in (None, "", "\n", " " * 1000, "é" * 10, "a" * 200_000, "\ud800"):
        assert len(rules.statistics(text)) == len(rules.STATISTICS) and np.isfinite(rules.statistics(text)).all()


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", 0.5), (2, None, 0.1), (None, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    good = rules.score_quality(docs, rules.fit_quality(docs, labels, F.lit(True))).collect()
    bad = toxicity.score_toxicity(docs, toxicity.fit_on(docs, labels, F.lit(True))).collect()
    assert len(good) == len(bad) == 3 and all(0 <= r["score"] <= 1 for r in good + bad)
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity([], [])).count() == 0
    assert rules.score_quality(empty, rules.fit_rules(np.zeros((0, 21)), np.zeros(0))).count() == 0


def test_labelled_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2 + [(3, 7)], "doc_id long, quality int")
    one = {r[0] for r in labelled_texts(docs, labels, "quality", F.lit(True), 10).collect()}
    two = {r[0] for r in labelled_texts(docs.repartition(5), labels.repartition(4), "quality", F.lit(True), 10).collect()}
    assert one == two and len(one) == 10


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(40).select("id", fold("id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


def test_distance_grows_with_toxic_words():
    rnd = np.random.default_rng(3)
    other = ["".join(rnd.choice(list("aeioulmnrst"), rnd.integers(3, 9))) for _ in range(300)]
    plain = [" ".join(rnd.choice(other, 30)) for _ in range(300)]
    toxic = [f"{' '.join(rnd.choice(other, 20))} zorbak{rnd.choice(['', 'en', 'ig', 'ung'])} {' '.join(rnd.choice(other, 20))}" for _ in range(120)]
    model = toxicity.fit_toxicity(toxic, plain)
    scores = model.scores([" ".join([*other[:20], "zorbak", *other[20:40]]), " ".join(other[:40]), "", None])
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3]


@pytest.mark.skipif(not Path(LARGE).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name,label,least", [("op7_quality_rules", "quality", 0.98), ("op9_compression_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", label)
    rows = QUERIES[name](spark, LARGE).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > least


# ---- the pipeline -------------------------------------------------------------------------------
@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, sizes = docs, []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
            sizes.append(out.count())
        before = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 500
    assert {r[0] for r in before.select("doc_id").distinct().collect()} == {
        r[0] for r in spark.read.parquet(str(tmp_path / "leaks")).select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = spark.read.parquet(str(tmp_path / "quality")).join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 2


def test_near_copies_keep_one_of_each_group(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (2, text.upper()), (2, text.upper()), (9, "quite another text of its own"), (None, text), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(repr(r["doc_id"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted(map(repr, [2, 7, 9]))


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
