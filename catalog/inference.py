"""Two-stage scoring queries."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import labels as L
from catalog.registry import query
from presswork import config
from presswork.functions import text as X
from presswork.operators import inference, scoring

STAGE1 = inference.lexicon_stage(fx.STAGE1)
STAGE2 = inference.lexicon_stage(fx.STAGE2)
BEST1 = "best as (select doc_id, label as category, score as confidence from s1 qualify row_number() over (partition by doc_id order by score desc, pos) = 1)"


@query("top_category", f"{fx.SCORES_CTE}, {BEST1} select doc_id, category, round(confidence, 6) as confidence from best")
def top_category(spark, sf):
    best = inference.top_category(F.col("scores"))
    return L.scored1(spark, sf).select("doc_id", best["category"].alias("category"), F.round(best["confidence"], 6).alias("confidence"))


@query("top_category_long", f"{fx.SCORES_CTE}, {BEST1} select doc_id, category, round(confidence, 6) as confidence from best")
def top_category_long(spark, sf):
    long = scoring.to_long(L.scored1(spark, sf), "doc_id")
    return inference.top_category_long(long, "doc_id").withColumn("confidence", F.round("confidence", 6))


@query("threshold_labels", f"{fx.SCORES_CTE} select doc_id, coalesce(string_agg(label, '|' order by pos) filter (where score >= 0.5), '') as labels from s1 group by doc_id")
def threshold_labels(spark, sf):
    return L.scored1(spark, sf).select("doc_id", F.array_join(inference.threshold_labels(F.col("scores")), "|").alias("labels"))


@query("ranked_labels", f"{fx.SCORES_CTE} select doc_id, row_number() over (partition by doc_id order by score desc, pos) - 1 as rank, label, round(score, 6) as probability from s1")
def ranked_labels(spark, sf):
    return L.scored1(spark, sf).select("doc_id", F.posexplode(inference.ranked_labels(F.col("scores"))).alias("rank", "s")).select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "s.label", F.round("s.probability", 6).alias("probability"))


@query("sigmoid", "select doc_id, round(1.0 / (1.0 + exp(-((length(text) - 1000) / 500.0))), 6) as probability from documents")
def sigmoid(spark, sf):
    logit = (F.length("text") - 1000) / F.lit(500.0)
    return fx.documents(spark, sf).select("doc_id", F.round(inference.sigmoid(logit), 6).alias("probability"))


@query("issue_scores", f"{fx.SCORES_CTE} select doc_id, label, round(score, 6) as score from s2")
def issue_scores(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    scored = scoring.score_lexicon(docs, fx.STAGE2, "text", "scores")
    return scored.select("doc_id", inference.issue_scores(F.col("scores")).alias("ethics")).select(
        "doc_id", F.explode("ethics").alias("label", "score")).withColumn("score", F.round("score", 6))


@query("issue_flags", f"""{fx.SCORES_CTE} select doc_id, row_number() over (partition by doc_id order by score desc, pos) - 1 as rank, label,
round(score * 100, 1) as pct, case when score >= 0.5 then 'detected' else 'safe' end as status from s2""")
def issue_flags(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    scored = scoring.score_lexicon(docs, fx.STAGE2, "text", "scores")
    return inference.issue_flags(scored, "doc_id").withColumn("rank", F.col("rank").cast("long"))


# Every 20th text is cut to nine characters, so that it is refused.
REQUESTS_SQL = "select doc_id, case when doc_id % 20 = 3 then substring(text, 1, 9) else text end as text from {documents}"
ANSWERS_CTE = f"""with requests as ({fx.duck(REQUESTS_SQL)}), {fx.duck_lexicon(fx.STAGE1, None, 's1', 'requests')},
{fx.duck_lexicon(fx.STAGE2, None, 's2', 'requests')}, {BEST1},
valid as (select doc_id, text, length(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')) >= 10 as ok from requests),
issues as (select doc_id, string_agg(label || '=' || cast(cast(round(score * 1000) as int) as varchar), '|' order by pos) as ethics from s2 group by doc_id),
answers as (select v.doc_id, case when ok then category end as category, case when ok then round(confidence, 6) end as confidence,
  case when ok and category = 'Artificial Intelligence' then ethics end as ethics,
  case when not ok then 'Please provide valid article text (at least 10 characters)' end as error, v.text
  from valid v join best b on b.doc_id = v.doc_id join issues i on i.doc_id = v.doc_id)"""


def flat_answers(df, *more):
    """Issue maps as text in label order, and ``more`` columns."""
    pairs = F.transform(F.map_entries("ethics"), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 1000).cast("int").cast("string")))
    return df.select("doc_id", "category", F.round("confidence", 6).alias("confidence"),
                     F.array_join(pairs, "|").alias("ethics"), "error", *more)


@query("two_stage", f"{ANSWERS_CTE} select doc_id, category, confidence, ethics, error, substring(text, 1, 200) as preview from answers")
def two_stage(spark, sf):
    answers = inference.analyze(fx.from_sql(spark, sf, REQUESTS_SQL), STAGE1, STAGE2)
    return flat_answers(answers, X.preview(F.col("text")).alias("preview"))


@query("two_stage_ungated", f"""{ANSWERS_CTE} select a.doc_id, a.category, case when a.error is null then i.ethics end as ethics, a.error
from answers a join issues i on i.doc_id = a.doc_id""")
def two_stage_ungated(spark, sf):
    answers = inference.analyze(fx.from_sql(spark, sf, REQUESTS_SQL), STAGE1, STAGE2, gate=None)
    return flat_answers(answers).drop("confidence")


@query("two_stage_batch_model", f"{ANSWERS_CTE} select doc_id, category, confidence, ethics, error from answers")
def two_stage_batch_model(spark, sf):
    """The second stage as a batch model behind the gate."""
    second = inference.batch_stage(config.ISSUES, L.lexicon_scorer(fx.STAGE2))
    return flat_answers(inference.analyze(fx.from_sql(spark, sf, REQUESTS_SQL), STAGE1, second))


@query("predict_article", f"""{fx.SCORES_CTE} select d.doc_id, substring(d.text, 1, 200) as preview,
  string_agg(cast(cast(s.score >= 0.5 as int) as varchar), '' order by s.pos) as predictions,
  coalesce(string_agg(s.label, '|' order by s.pos) filter (where s.score >= 0.5), '') as predicted_labels
from documents d join s1 s on s.doc_id = d.doc_id group by d.doc_id, d.text""")
def predict_article(spark, sf):
    out = inference.predict_labels(fx.documents(spark, sf).select("doc_id", "text"), STAGE1)
    p = F.col("prediction")
    return out.select(
        "doc_id", p["text_preview"].alias("preview"),
        F.array_join(F.transform(p["predictions"], lambda x: x.cast("string")), "").alias("predictions"),
        F.array_join(p["predicted_labels"], "|").alias("predicted_labels"))
