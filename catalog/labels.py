"""Scoring, labelling, joins and splits."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from presswork import config
from presswork.config import CATEGORIES, ISSUES, label_key, stage_keys
from presswork.operators import labelling, scoring, splits
from presswork.operators.rows import array_rows
from presswork.session import stage

S1_COLS = stage_keys("stage1")
S2_COLS = stage_keys("stage2")
B1_COLS = stage_keys("stage1", binary=True)
B2_COLS = stage_keys("stage2", binary=True)
GATE = "stage1_artificial_intelligence"


def scored1(spark, sf):
    """doc_id and in-row stage-1 scores."""
    return scoring.score_lexicon(
        fx.documents(spark, sf).select("doc_id", "text"), fx.STAGE1, "text", "scores"
    ).select("doc_id", "scores")


def _wide(df, lexicon, labels, columns, chars, *keep):
    scored = scoring.widen_in_row(scoring.score_lexicon(df, lexicon, "text", "scores", chars), labels)
    return scored.select("doc_id", *keep, *[F.col(f"`{n}`").alias(c) for n, c in zip(labels, columns)])


def wide1(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    return _wide(docs, fx.STAGE1, CATEGORIES, S1_COLS, None)


def combined(spark, sf):
    """Both stages.  Each is written out once, since scores are expensive and read by column afterwards.

    The second stage sees only texts over the gate.
    """
    docs = fx.documents(spark, sf).select("doc_id", "text")
    first = stage(_wide(docs, fx.STAGE1, CATEGORIES, S1_COLS, None, "text"))
    gated = labelling.in_gate(first).select("doc_id", "text")
    second = _wide(gated, fx.STAGE2, ISSUES, S2_COLS, None)
    return stage(labelling.combine_stages(first.drop("text"), second, "doc_id"))


def labelled(spark, sf):
    """Both stages in one pass over the texts; those outside the gate reach the second stage empty, which scores 0.0."""
    docs = fx.documents(spark, sf).select("doc_id", "text")
    first = _wide(docs, fx.STAGE1, CATEGORIES, S1_COLS, None, "text")
    gated = first.withColumn("text", F.when(F.col(labelling.GATE_COLUMN) >= config.GATE_THRESHOLD, F.col("text")))
    return stage(_wide(gated, fx.STAGE2, ISSUES, S2_COLS, None, *S1_COLS), "labelled")


def binary(spark, sf):
    return labelling.binarize(labelled(spark, sf), [*S1_COLS, *S2_COLS])


def pivot_cte(source: str, name: str, labels, columns) -> str:
    cols = ", ".join(f"max(case when label = '{n}' then score end) as {c}" for n, c in zip(labels, columns))
    return f"{name} as (select doc_id, {cols} from {source} group by doc_id)"


WIDE_CTE = f"""{fx.SCORES_CTE}, {pivot_cte('s1', 'wide1', CATEGORIES, S1_COLS)}, {pivot_cte('s2', 'wide2all', ISSUES, S2_COLS)},
wide2 as (select * from wide2all where doc_id in (select doc_id from wide1 where {GATE} >= 0.6)),
combined as (select w.*, {", ".join(f"coalesce(x.{c}, 0.0) as {c}" for c in S2_COLS)}
  from wide1 w left join wide2 x on x.doc_id = w.doc_id),
binary_labels as (select *, {", ".join(f"cast({c} >= 0.6 as int) as {b}" for c, b in zip([*S1_COLS, *S2_COLS], [*B1_COLS, *B2_COLS]))} from combined)"""


def rounded(columns):
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def rounded_cols(columns):
    return [F.round(c, 6).alias(c) for c in columns]


LONG_OUT = "select doc_id, label, round(score, 6) as score"


@query("score_lexicon", f"{fx.SCORES_CTE} {LONG_OUT} from s1 union all {LONG_OUT} from s2")
def score_lexicon(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    both = [
        scoring.to_long(scoring.score_lexicon(docs, lex, "text", "scores", n), "doc_id")
        for lex, n in ((fx.STAGE1, None), (fx.STAGE2, None))
    ]
    return both[0].unionByName(both[1]).select("doc_id", "label", F.round("score", 6).alias("score"))


def lexicon_scorer(lexicon):
    """The lexicon as a batch model: a slice of texts to a row of scores each, NaN for a text that is None."""
    words, damping = dict(lexicon.words), lexicon.damping

    def hits(text) -> list[float]:
        if not isinstance(text, str):
            return [math.nan] * len(words)
        found = Counter(re.findall(r"\w+", text.lower()))
        return [sum(found[w] for w in own) for own in words.values()]

    def score(texts: pd.Series) -> pd.DataFrame:
        found = np.array([hits(t) for t in texts], float).reshape(-1, len(words))
        return pd.DataFrame(found / (found + damping), texts.index, list(words))

    return score


@query("score_pandas", f"{fx.SCORES_CTE} {LONG_OUT} from s1")
def score_pandas(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text")
    scored = scoring.score_labels(docs, CATEGORIES, lexicon_scorer(fx.STAGE1), "text", "scores")
    return scoring.to_long(scored, "doc_id").select("doc_id", "label", F.round("score", 6).alias("score"))


def _odd(scorer):
    """A model that cannot take texts of an odd length, and whose slices are single texts."""
    def score(texts: pd.Series) -> pd.DataFrame:
        if any(isinstance(t, str) and len(t) % 2 for t in texts):
            raise ValueError("odd")
        return scorer(texts)

    return score


@query("score_failures", f"""{fx.SCORES_CTE} select s1.doc_id, label, round(case when length(text) % 2 = 1 then 0.0 else score end, 6) as score,
  length(text) % 2 = 1 as score_error from s1 join documents d on d.doc_id = s1.doc_id""")
def score_failures(spark, sf):
    """Failing slices score 0 and say so; the model is opened on the worker."""
    docs = fx.documents(spark, sf).select("doc_id", "text")
    model = scoring.Opened("odd-lexicon", lambda: _odd(lexicon_scorer(fx.STAGE1)))
    scored = scoring.score_labels(docs, CATEGORIES, model, "text", "scores", batch=1)
    rows = array_rows(scored, ["doc_id", "score_error"], F.col("scores"), "_s", None)
    return rows.select("doc_id", "score_error", "_s.label", F.round("_s.score", 6).alias("score"))


@query("score_gated", f"""{fx.SCORES_CTE} select s2.doc_id, label, round(score, 6) as score from s2
where s2.doc_id in (select doc_id from s1 where label = '{config.GATE_CATEGORY}' and score >= 0.6)""")
def score_gated(spark, sf):
    """Rows outside the gate never reach the second model."""
    first = scoring.score_lexicon(fx.documents(spark, sf).select("doc_id", "text"), fx.STAGE1, "text", "_first")
    score = F.try_element_at(F.map_from_entries("_first"), F.lit(config.GATE_CATEGORY))
    gated = first.withColumn("inside", score >= config.GATE_THRESHOLD).drop("_first")
    scored = scoring.score_labels(gated, ISSUES, lexicon_scorer(fx.STAGE2), "text", "scores", where="inside")
    return scoring.to_long(scored, "doc_id").select("doc_id", "label", F.round("score", 6).alias("score"))


SINGLE_CTE = f"""with texts as (select doc_id, split_part(text, chr(10), 1) || ' ' || array_to_string(
  string_split(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' '), ' ') as text from documents),
{fx.duck_lexicon(fx.STAGE1, None, 'ss', 'texts')},
single as (select doc_id, label from ss qualify row_number() over (partition by doc_id order by score desc, pos) = 1)"""


def single(spark, sf):
    """Single-label articles, written out before filters and counts read them."""
    return stage(scoring.classify_single(fx.articles(spark, sf), fx.STAGE1))


@query("single_label", f"{SINGLE_CTE} select doc_id, label from single")
def single_label(spark, sf):
    return single(spark, sf).select("doc_id", "label")


@query("scores_wide", f"{WIDE_CTE} select doc_id, {rounded(S1_COLS)} from wide1")
def scores_wide(spark, sf):
    long = scoring.to_long(scored1(spark, sf), "doc_id")
    wide = scoring.widen(long, "doc_id", CATEGORIES)
    return wide.select("doc_id", *[F.round(F.col(f"`{n}`"), 6).alias(c) for n, c in zip(CATEGORIES, S1_COLS)])


@query("attach_scores", f"{WIDE_CTE} select d.doc_id, d.source as domain, d.lang, {rounded(S1_COLS)} from documents d join wide1 w on w.doc_id = d.doc_id")
def attach_scores(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", "source", "lang", "text")
    scored = scoring.score_lexicon(rows, fx.STAGE1, "text", "scores")
    wide = scoring.widen_in_row(scored, CATEGORIES)
    return wide.select("doc_id", F.col("source").alias("domain"), "lang", *[
        F.round(F.col(f"`{n}`"), 6).alias(c) for n, c in zip(CATEGORIES, S1_COLS)])


@query("gate_counts", f"{WIDE_CTE} select count(*) filter (where {GATE} >= 0.6) as inside, count(*) filter (where {GATE} < 0.6) as outside from wide1")
def gate_counts(spark, sf):
    return labelling.gate_counts(wide1(spark, sf))


@query("combine_stages", f"{WIDE_CTE} select doc_id, {rounded([*S1_COLS, *S2_COLS])} from combined")
def combine_stages(spark, sf):
    return combined(spark, sf).select("doc_id", *rounded_cols([*S1_COLS, *S2_COLS]))


@query("binarize", f"{WIDE_CTE} select doc_id, {', '.join([*B1_COLS, *B2_COLS])} from binary_labels")
def binarize(spark, sf):
    return binary(spark, sf).select("doc_id", *B1_COLS, *B2_COLS)


# Label maps for two thirds of the ids; ids with doc_id % 50 = 1 come twice, the later row inverted.
FLAG_COLS = [label_key(n) for n in ISSUES]


def _flags(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "text").where("doc_id % 3 <> 0")
    scored = scoring.score_lexicon(docs, fx.STAGE2, "text", "scores")
    value = lambda invert: F.map_from_entries(F.transform("scores", lambda s: F.struct(
        s["label"], F.when((s["score"] >= 0.3) != F.lit(invert), 1).otherwise(0))))
    first = scored.select(F.col("doc_id").alias("id"), value(False).alias("_ai_ethics_binary"), F.col("doc_id").alias("line"))
    again = scored.where("doc_id % 50 = 1").select(
        F.col("doc_id").alias("id"), value(True).alias("_ai_ethics_binary"), (F.col("doc_id") + 1000000000).alias("line"))
    return first.unionByName(again)


FLAGS_CTE = f"""flag_rows as (select doc_id, label, case when doc_id % 50 = 1 then cast(score < 0.3 as int) else cast(score >= 0.3 as int) end as v
  from s2 where doc_id % 3 <> 0),
flags as (select doc_id, {", ".join(f"max(case when label = '{n}' then v end) as {c}" for n, c in zip(ISSUES, FLAG_COLS))} from flag_rows group by doc_id)"""


@query("ethics_join", f"""{SINGLE_CTE}, {fx.duck_lexicon(fx.STAGE2, None, 's2')}, {FLAGS_CTE}
select a.doc_id as id, {", ".join(f"coalesce(f.{c}, 0) as {c}" for c in FLAG_COLS)}
from single a left join flags f on f.doc_id = a.doc_id where a.label = 'Artificial Intelligence'""")
def ethics_join(spark, sf):
    gated = single(spark, sf).where(F.col("label") == config.GATE_CATEGORY).select(F.col("doc_id").alias("id"))
    joined = labelling.attach_flags(gated, _flags(spark, sf), ISSUES, "line")
    return joined.withColumnsRenamed(dict(zip(ISSUES, FLAG_COLS)))


# ---- splits ---------------------------------------------------------------------
@query("split_hash", """select doc_id, case when d < 'cccccccc' then 'train' when d < 'e6666666' then 'val' else 'test' end as split
from (select doc_id, md5(doc_id || ':42') as d from documents)""")
def split_hash(spark, sf):
    return splits.split_hash(fx.documents(spark, sf).select("doc_id"), "doc_id")


def ranked_split(strata: str, test: str, held: str) -> str:
    over = f"partition by {strata} " if strata else ""
    return f"""select doc_id, {strata + ',' if strata else ''} case when r <= {test} then 'test' when r <= {held} then 'val' else 'train' end as split
from (select *, row_number() over ({over}order by md5(doc_id || ':42'), doc_id) as r, count(*) over ({over}) as n from documents)"""


@query("split_stratified", ranked_split("lang", "ceil(ceil(n / 5.0) / 2.0)", "ceil(n / 5.0)"))
def split_stratified(spark, sf):
    return splits.split_stratified(fx.documents(spark, sf).select("doc_id", "lang"), "doc_id", "lang")


@query("split_random", ranked_split("", "ceil(n / 10.0)", "(ceil(n / 10.0) + ceil((n - ceil(n / 10.0)) / 9.0))"))
def split_random(spark, sf):
    return splits.split_random(fx.documents(spark, sf).select("doc_id"), "doc_id")


@query("split_halves", ranked_split("", "ceil(ceil(n / 5.0) / 2.0)", "ceil(n / 5.0)"))
def split_halves(spark, sf):
    return splits.split_random(fx.documents(spark, sf).select("doc_id"), "doc_id", order="halves")
