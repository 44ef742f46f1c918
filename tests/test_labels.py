"""Scoring, labels, statistics and splits."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork import config
from presswork.config import CATEGORIES, ISSUES, label_key, stage_keys
from presswork.operators import inference, labelling, metrics, scoring, splits, stats
from presswork.plans import corpus

LEX = scoring.Lexicon({c: [f"w{i}"] for i, c in enumerate(CATEGORIES)})


def test_lexicon_counts_whole_words(spark):
    df = spark.createDataFrame([(1, "w0 W0, w0x w1 w1 w1"), (2, None)], "id int, content string")
    rows = {r["id"]: {s["label"]: s["score"] for s in r["scores"]} for r in scoring.score_lexicon(df, LEX).collect()}
    assert rows[1]["Artificial Intelligence"] == 2 / 4 and rows[1]["Technology"] == 3 / 5
    assert set(rows[2].values()) == {0.0}


def test_top_label_prefers_the_first(spark):
    df = spark.createDataFrame([(1, "w2 w1"), (2, ""), (3, "w3 w3 w1")], "id int, content string")
    got = {r["id"]: r["label"] for r in scoring.classify_single(df.withColumn("title", F.lit(None).cast("string")), LEX).collect()}
    assert got == {1: "Technology", 2: "Artificial Intelligence", 3: "Politics"}


def test_failed_slices_score_zero_alone(spark):
    def scorer(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("bad").any():
            raise ValueError("bad text")
        return pd.DataFrame({"a": texts.str.len() / 10.0, "b": 1.0}, index=texts.index)

    rows = [(i, "bad" if i == 5 else "x" * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, content string").coalesce(1)
    out = {r["id"]: r for r in scoring.score_labels(df, ["b", "a"], scorer, batch=4).collect()}
    failed = {i for i, r in out.items() if r["score_error"]}
    assert 5 in failed and len(failed) == 4
    for i, r in out.items():
        scores = {s["label"]: s["score"] for s in r["scores"]}
        assert scores == ({"a": 0.0, "b": 0.0} if i in failed else {"a": (i % 7) / 10, "b": 1.0})
    gated = scoring.score_labels(df.withColumn("g", F.col("id") < 3), ["a", "b"], scorer, where="g").collect()
    assert {r["id"] for r in gated if r["scores"] is not None} == {0, 1, 2}


def test_gate_and_combination(spark):
    gate = labelling.GATE_COLUMN
    first = spark.createDataFrame([(1, 0.6), (2, 0.59), (3, None)], f"id int, {gate} double")
    second = spark.createDataFrame([(1, 0.7)], "id int, stage2_x double")
    assert labelling.gate_counts(first).first().asDict() == {"inside": 1, "outside": 1}
    both = labelling.combine_stages(first, second, "id", ["stage2_x"])
    assert {r["id"]: r["stage2_x"] for r in both.collect()} == {1: 0.7, 2: 0.0}
    empty = labelling.combine_stages(first, second.where("false"), "id", ["stage2_x"])
    assert {r["stage2_x"] for r in empty.collect()} == {0.0}
    flags = labelling.binarize(both, [gate, "stage2_x"])
    assert {(r["id"], r["stage1_binary_artificial_intelligence"], r["stage2_binary_x"]) for r in flags.collect()} == {(1, 1, 1), (2, 0, 0)}


def test_flags_join_last_row_wins(spark):
    articles = spark.createDataFrame([("a",), ("b",)], "id string")
    flags = spark.createDataFrame([("a", {"x": 1, "y": 1}, 0), ("a", {"x": 0}, 1)], "id string, _ai_ethics_binary map<string,int>, line int")
    got = {tuple(r) for r in labelling.attach_flags(articles, flags, ["x", "y"], "line").collect()}
    assert got == {("a", 0, 0), ("b", 0, 0)}


def test_statistics_edges(spark):
    empty = spark.createDataFrame([], "label string, v int")
    assert [r["pct"] for r in stats.category_distribution(empty).collect()] == [0.0] * 6
    bins = stats.histogram(spark.createDataFrame([(i,) for i in (0, 6, 7, 7)], "v int"), F.col("v"), 7).collect()
    assert [r["articles"] for r in bins] == [1, 0, 0, 0, 0, 0, 3]
    tied = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "domain string")
    assert [r["domain"] for r in stats.domain_counts(tied, 2).collect()] == ["c", "a"]
    profile = stats.length_profile(spark.createDataFrame([(1,), (2,), (10,), (20,)], "n long"), F.col("n"), 9).first()
    assert (profile["median_chars"], profile["mean_chars"], profile["over_limit"]) == (6.0, 8.25, 2)


def test_metrics_zero_division(spark):
    pairs = spark.createDataFrame([("a", 0, 0), ("b", 1, 0), ("b", 1, 1)], "label string, y int, p int")
    row = metrics.multilabel_metrics(pairs).first()
    assert math.isclose(row["micro_f1"], 2 / 3) and math.isclose(row["macro_f1"], 1 / 3)
    assert math.isclose(row["hamming_loss"], 1 / 3)
    assert {r["label"]: r["f1"] for r in metrics.per_label_metrics(pairs).collect()}["a"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 9, 100, 101])
def test_random_split_is_exact_and_stable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    for order in ("test_first", "halves"):
        one = {r["k"]: r["split"] for r in splits.split_random(df.repartition(3), "k", order=order).collect()}
        assert one == {r["k"]: r["split"] for r in splits.split_random(df.coalesce(1), "k", order=order).collect()}
        sizes = [sum(v == s for v in one.values()) for s in ("train", "val", "test")]
        if order == "test_first":
            test = math.ceil(n / 10)
            val = math.ceil((n - test) / 9)
        else:
            held = math.ceil(n / 5)
            test = math.ceil(held / 2)
            val = held - test
        assert sizes == [n - test - val, val, test]


def test_stratified_split_with_a_dominant_stratum(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice("aaaaaabc")) for i in range(500)], "k int, s string")
    rows = splits.split_stratified(df.repartition(6), "k", "s").collect()
    assert len(rows) == 500
    for s in "abc":
        part = [r["split"] for r in rows if r["s"] == s]
        held = math.ceil(len(part) / 5)
        assert part.count("test") == math.ceil(held / 2) and part.count("val") == held - math.ceil(held / 2)
    assert not splits.enough_rows(df.limit(99), 100) and splits.enough_rows(df, 100)


def test_analyze_reports_errors(spark):
    second = inference.lexicon_stage(scoring.Lexicon({i: ["zz"] for i in ISSUES}))
    df = spark.createDataFrame([(1, "123456789"), (2, "w0 w0 zz zz zz"), (3, "w1 w1 zz and more"), (4, None)], "id int, text string")
    rows = {r["id"]: r for r in inference.analyze(df, inference.lexicon_stage(LEX), second).collect()}
    assert rows[1]["error"] and rows[1]["category"] is None and rows[4]["error"]
    assert rows[2]["category"] == "Artificial Intelligence" and rows[2]["ethics"]["Job Displacement"] == 0.6
    assert rows[3]["category"] == "Technology" and rows[3]["ethics"] is None and rows[3]["error"] is None
    none = inference.analyze(df, inference.lexicon_stage(LEX), None, gate=None).collect()
    assert all(r["ethics"] is None for r in none)

    def broken(texts):
        raise RuntimeError("no model")

    failed = inference.analyze(df, inference.batch_stage(CATEGORIES, broken), None)
    assert all(r["error"] for r in failed.collect())


def test_labelling_job(spark):
    rows = [(f"id{i}", "w0 w0 w0 zz" if i % 2 else "w1 text") for i in range(240)] + [("blank", " ")]
    df = spark.createDataFrame(rows, "id string, content string")
    second = inference.lexicon_stage(scoring.Lexicon({i: ["zz"] for i in ISSUES}))
    out = corpus.label_articles(df, inference.lexicon_stage(LEX), second)
    assert out.count() == 240
    assert {c for c in out.columns if c.startswith("stage")} == {
        *stage_keys("stage1"), *stage_keys("stage2"), *stage_keys("stage1", True), *stage_keys("stage2", True)}
    column = label_key("Job Displacement", "stage2")
    got = {(r[0], r[1]) for r in out.select(labelling.GATE_COLUMN, F.round(column, 6)).distinct().collect()}
    assert got == {(0.6, 0.333333), (0.0, 0.0)}
    assert labelling.label_columns(out, "stage1_binary_") == sorted(stage_keys("stage1", True))
    parts = corpus.label_splits(out)
    assert set(parts) == {"stage1", "stage2"} and parts["stage2"].count() == 120
    assert parts["stage1"].columns == ["content", *stage_keys("stage1", True), "split"]
    with pytest.raises(ValueError):
        corpus.label_articles(df.drop("content"), inference.lexicon_stage(LEX), second)


def test_single_label_data_sets(spark):
    rows = [(str(i), f"t{i}", f"c{i}", CATEGORIES[i % 2]) for i in range(100)]
    articles = spark.createDataFrame(rows, "id string, title string, content string, label string")
    flags = spark.createDataFrame([("0", {ISSUES[0]: 1}, 0)], "id string, _ai_ethics_binary map<string,int>, line int")
    sets = corpus.single_label_splits(articles, flags, "line")
    sizes = {r["split"]: r["count"] for r in sets["main"].groupBy("split").count().collect()}
    assert sizes == {"train": 80, "val": 10, "test": 10}
    assert sets["issues"].count() == 50 and sets["issues"].agg(F.sum(f"`{ISSUES[0]}`")).first()[0] == 1
    assert config.GATE_CATEGORY == CATEGORIES[0]


def test_null_strata_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = splits.split_stratified(df, "id", "label").groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in got) == 60
    assert {r["split"]: r["count"] for r in got if r["label"] is None} == {"train": 16, "val": 2, "test": 2}


def test_only_text_and_gate_reach_the_model(spark):
    opened = []

    def open_model():
        opened.append(1)
        return lambda texts: pd.DataFrame({"a": texts.str.len() * 1.0, "b": 0.0})

    df = spark.createDataFrame([(i, "x" * i, {"k": i}, None) for i in range(6)], "id int, content string, extra map<string,int>, nothing string").repartition(2)
    scored = scoring.score_labels(df, ["a", "b"], scoring.Opened("lengths", open_model), batch=2)
    assert scored.columns == ["id", "content", "extra", "nothing", "scores", "score_error"]
    assert {r["id"]: [(s["label"], s["score"]) for s in r["scores"]] for r in scored.collect()} == {i: [("a", float(i)), ("b", 0.0)] for i in range(6)}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "run(content" in scan and "extra" not in scan.split("[run(")[1].split("]")[0]
    failing = scoring.score_labels(df, ["a", "b"], lambda t: 1 / 0, on_error="null")
    assert all(r["scores"] is None and r["score_error"] for r in failing.collect())
