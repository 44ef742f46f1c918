"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import corpus_pipeline
import pytest
from presswork.llm import mincut, packing, rules, toxicity
from presswork.llm.queries import tokenizer_path
from pyspark.sql import functions as F

LONG = "plain words stand here and there, " * 30_000
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "some words of a text", "en", "s", 20), (1, "some words of a text", "en", "s", 20), (1, "another text", None, None, None),
        (None, None, None, None, None), (None, "", "en", "s", 0), (3, LONG, "de", "t", len(LONG)), (4, "🙂 é\x00 ", "fr", "t", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENT)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


def test_main_text_replaces_clashing_columns(spark):
    page = "<article><p>" + "A story that goes on for quite a while, as stories do. " * 5_000 + "</p></article>"
    rows = [(1, page, "old", 7), (1, page, "old", 7), (None, None, None, None), (2, "<p>" * 50_000, "x", 1)]
    got = mincut.extract_main_text(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert len(got) == 4 and got[0] == got[1] and got[0]["text"].startswith("A story") and got[2]["text"] == got[3]["text"] == ""
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]


def test_packing_keeps_rows_that_share_a_key(spark, docs):
    from tokenizers import Tokenizer

    got = packing.pack_documents(docs.withColumn("length", F.lit("x")), tokenizer_path()).collect()
    encode = Tokenizer.from_file(tokenizer_path()).encode
    want = sorted(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0) == want and sum(r["length"] for r in got) == sum(want)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("fit, score, label", [(rules.fit_quality, rules.score_quality, "quality"), (toxicity.fit_on, toxicity.score_toxicity, "toxic")])
def test_scores_of_odd_rows(docs, labels, fit, score, label):
    model = fit(docs, labels, F.lit(True))
    got = score(docs.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == len(ROWS) and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert len({r["score"] for r in got if r["text"] == ROWS[0][1]}) == 1
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert score(docs.limit(0), model).count() == 0
    assert score(docs, fit(docs.limit(0), labels.limit(0), F.lit(True))).count() == len(ROWS)


def test_stages_of_odd_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never met in any text of these"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"near_copies": 5, "repeats": 7, "leaks": 7}
    wider = docs.withColumns({"row": F.lit(1), "kept": F.lit("x"), "score": F.lit(2), "component_id": F.lit(3)})
    for name, step in corpus_pipeline.STAGES:
        for given in (docs, wider):
            out = step(spark, given, str(tmp_path))
            if name in want:
                assert out.count() == want[name], name
            if name != "packing":
                assert out.columns == docs.columns
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    repeats = corpus_pipeline.repeats(spark, docs, str(tmp_path)).collect()
    assert sorted(r["text"] for r in repeats) == sorted(t or "" for _, t, *_ in ROWS)
