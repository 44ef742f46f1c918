"""What the expensive steps do once, and that they do it right."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import QUERIES, labels as L
from presswork.functions import text as X
from presswork.operators import descent, features, scoring, train

LABELS = ["a", "b"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 15))), i % 2, i % 3 % 2) for i in range(200)]
    return spark.createDataFrame([*rows, (200, None, 0, 1)], "id int, content string, a int, b int").repartition(4)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    texts = ["que der los from thing", None, "", "thre" * 3, "from with that this, from", "x" * 9] * 10
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_tokens_are_written_without_their_pairs(small, monkeypatch):
    written = {}
    monkeypatch.setattr(train, "stage", lambda df, name, inner=train.stage: written.setdefault(name, inner(df, name)))
    train.fit_multilabel(small, LABELS, size=50)
    (staged,) = written.values()
    assert all(" " not in t for r in staged.drop(*LABELS).collect() for t in r[0])


def test_few_partial_sums_are_added_at_once(small, monkeypatch):
    def weights():
        model = train.fit_multilabel(small, LABELS, size=50)
        return [v for s in model.pipeline.stages if hasattr(s, "coefficients") for v in [*s.coefficients.toArray(), s.intercept]]

    few = weights()
    monkeypatch.setattr(descent, "DIRECT", 0)
    assert weights() == pytest.approx(few, abs=1e-6)


@pytest.mark.parametrize("entries", [1 << 18, 7])
def test_blocks_hold_unit_rows(spark, monkeypatch, entries):
    monkeypatch.setattr(descent, "BLOCK_ENTRIES", entries)
    rows = [(["a", "b", "a"], 1, 0.5), (None, 0, 1.0), ([], None, 2.0), (["b", None, "zz"], 1, None), (["a"] * 3 + ["c"], 0, 1.0)]
    df = spark.createDataFrame(rows, "terms array<string>, y int, w double").coalesce(1)
    found = []
    for r in descent.blocks(df, ["a", "b", "c"], [1.0, 2.0, 3.0], ["y"], "w").collect():
        (b,) = descent._read([__import__("pyarrow").RecordBatch.from_pylist([r.asDict()])], 1)
        for i, (lo, hi) in enumerate(zip(b.starts, b.starts[1:])):
            found.append(([*b.indices[lo:hi]], [*b.entries[lo:hi]], b.targets[i, 0], b.weights[i]))
    root = math.sqrt
    assert [(i, pytest.approx(v), y, w) for i, v, y, w in found] == [
        ([0, 1], [2 / root(8), 2 / root(8)], 1, 0.5), ([], [], 0, 1), ([], [], 0, 2), ([1], [1.0], 1, 0),
        ([0, 2], [3 / root(18), 3 / root(18)], 0, 1)]


def test_a_prediction_is_computed_once(spark, tables):
    assert plan(QUERIES["predict_multilabel"](spark, tables)).count("regexp_extract_all") == 1


def test_failing_slices_are_scored_once(spark, tables):
    assert plan(QUERIES["score_failures"](spark, tables)).count("ArrowEvalPython") == 1


def test_batch_lexicon():
    score = L.lexicon_scorer(scoring.Lexicon({"one": ["ab", "cd"], "two": ["ef"]}))
    texts = pd.Series(["AB ab,cd abc", None, "", "ef_ ef"], index=[5, 1, 2, 9])
    got = score(texts)
    assert [*got.index] == [5, 1, 2, 9] and [*got.columns] == ["one", "two"]
    assert got.fillna(-1).values.tolist() == [[0.6, 0.0], [-1, -1], [0.0, 0.0], [0.0, 1 / 3]]


@pytest.mark.parametrize("size", [1 << 21, 5])
def test_a_vocabulary_counts_in_one_pass(spark, small, monkeypatch, size):
    monkeypatch.setattr(features, "BATCH_TERMS", size)
    terms = features.with_terms(small)
    vocab = features.vocabulary(terms, 201, min_df=1, max_df=1.0)
    assert plan(vocab).count("regexp_extract_all") == 1
    lists = [r["terms"] for r in terms.collect()]
    cf, df = Counter(t for x in lists for t in x), Counter(t for x in lists for t in set(x))
    assert {r["term"]: (r["df"], r["cf"]) for r in vocab.collect()} == {t: (df[t], cf[t]) for t in cf}
    odd = spark.createDataFrame([(["a", "a", "b"],), (None,), ([],), (["b"],)], "terms array<string>")
    assert {tuple(r)[:3] for r in features.vocabulary(odd, 4, min_df=1, max_df=1.0).collect()} == {("a", 1, 2), ("b", 2, 2)}


def test_a_text_is_not_stripped_to_be_refused(spark):
    texts = [None, "", " " * 30, "a", " a ", "123456789", "1234567890", " 1 34567 9\n", " 1        0 ", "1 \n      0 ", "\t1\n\n\n\n\n\n\n9\t", "x\U0001f600" * 4 + "y", "x\U0001f600" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (0, 1, 2, 10):
        wrong = df.where(X.input_error(F.col("t"), least).isNotNull() != (F.length(X.strip_ws(F.coalesce("t", F.lit("")))) < least))
        assert wrong.collect() == []
    assert "regexp_replace" not in plan(df.select(X.input_error(F.col("t"))))


def test_lexicon_words_are_whole_words(spark):
    lexicon = scoring.Lexicon({"one": ["ab", "ción"], "two": ["cd"], "none": []}, 1.0)
    df = spark.createDataFrame([("AB ab-ab_ CIÓN abcd", ), ("cd cd\ncd ab ab",), ("",)], "t string")
    found = scoring.score_lexicon(df, lexicon, "t").collect()
    assert [[(s["label"], s["score"]) for s in r["scores"]] for r in found] == [
        [("one", 0.75), ("two", 0.0), ("none", 0.0)], [("one", 2 / 3), ("two", 0.75), ("none", 0.0)],
        [("one", 0.0), ("two", 0.0), ("none", 0.0)]]
    assert "regexp_replace" not in plan(scoring.score_lexicon(df, lexicon, "t"))
