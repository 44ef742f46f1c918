"""Label scores: a lexicon scorer in native columns and a vectorised hook for models.

In-row scores are ``array<struct<label, score>>`` in label order; labels travel
by name, never by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.html import let
from presswork.operators.rows import array_rows
from presswork.functions.text import WORD, compose_text, truncate_chars, truncate_words

SCORES = "array<struct<label:string,score:double>>"


@dataclass(frozen=True)
class Lexicon:
    """Words per label; a score is ``hits / (hits + damping)``."""

    words: dict[str, Sequence[str]]
    damping: float = 2.0

    @property
    def labels(self) -> list[str]:
        return list(self.words)


def _occurrences(found: Column, word: str) -> Column:
    return F.size(F.filter(found, lambda w: w == word))


def lexicon_scores(text: Column, lexicon: Lexicon) -> Column:
    """In-row scores of a text.

    The text is cut into words once; those of any label, which are few, are kept and then
    counted by label.  They are bound once, so the expression stays small even where the
    optimizer copies it into a pushed-down filter.
    """
    every = sorted({w for words in lexicon.words.values() for w in words})
    words = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))

    def hits(found: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(label).alias("label"), sum((_occurrences(found, w) for w in own), F.lit(0)).alias("hits"))
            for label, own in lexicon.words.items()
        ])

    return F.transform(
        let(F.filter(words, lambda w: w.isin(every)), hits),
        lambda s: F.struct(
            s["label"].alias("label"), (s["hits"] / (s["hits"] + F.lit(lexicon.damping))).alias("score")
        ),
    )


def score_lexicon(
    df: DataFrame,
    lexicon: Lexicon,
    text: str = "content",
    out: str = "scores",
    max_chars: int | None = None,
) -> DataFrame:
    """Add the in-row scores of a lexicon; no shuffle, no Python worker."""
    source = F.coalesce(F.col(text), F.lit("")) if max_chars is None else truncate_chars(F.col(text), max_chars)
    return df.withColumn(out, lexicon_scores(source, lexicon))


Scorer = Callable[[pd.Series], pd.DataFrame]


class Opened:
    """A scorer that is opened on a worker, once per process, by ``open()``: for models too large or unfit to be sent."""

    _scorers: dict[str, Scorer] = {}

    def __init__(self, name: str, open: Callable[[], Scorer]):
        self.name, self.open = name, open

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        if self.name not in self._scorers:
            self._scorers[self.name] = self.open()
        return self._scorers[self.name](texts)


def score_labels(
    df: DataFrame,
    labels: Sequence[str],
    scorer: Scorer,
    text: str = "content",
    out: str = "scores",
    max_chars: int | None = None,
    batch: int = 128,
    on_error: str = "zero",
    where: str | None = None,
) -> DataFrame:
    """Add scores from a batch model: ``scorer(texts)`` returns one column per label.

    The text and the gate are all that crosses to Python and the scores all that comes
    back; Arrow batches stream through each task and are cut into ``batch`` rows for the
    model.  A failing slice scores 0.0 (``on_error="zero"``) or NULL (``"null"``) and
    sets ``score_error``; ``"raise"`` lets it fail.  Only rows where the boolean column
    ``where`` is true reach the model, others get NULL, so an expensive second
    stage costs nothing for rows outside the gate.  Truncation happens before the
    exchange with Python.  A model that has to be opened comes as ``Opened``.
    """
    names = list(labels)
    if on_error not in ("zero", "null", "raise"):
        raise ValueError(f"unknown on_error: {on_error}")

    def scored(texts: pd.Series) -> tuple[list, bool]:
        try:
            return scorer(texts)[names].to_numpy(dtype=float).tolist(), False
        except Exception:
            if on_error == "raise":
                raise
            return [[0.0] * len(names) if on_error == "zero" else None] * len(texts), True

    @F.pandas_udf("values array<double>, error boolean")
    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gates in columns:
            values, errors = [None] * len(texts), [False] * len(texts)
            chosen = gates.eq(True).to_numpy().nonzero()[0]
            for start in range(0, len(chosen), batch):
                index = chosen[start:start + batch]
                found, failed = scored(texts.iloc[index])
                for row, own in zip(index, found):
                    values[row], errors[row] = own, failed
            yield pd.DataFrame({"values": pd.Series(values, dtype=object), "error": errors})

    source = F.col(text) if max_chars is None else truncate_chars(F.col(text), max_chars)
    gate = F.lit(True) if where is None else F.coalesce(F.col(where), F.lit(False))
    named = F.transform(F.col("_scored.values"), lambda v, i: F.struct(F.get(F.array(*map(F.lit, names)), i).alias("label"), v.alias("score")))
    scores = df.withColumn("_scored", run(source, gate))
    return scores.withColumns({out: named, "score_error": F.col("_scored.error")}).drop("_scored")


def to_long(df: DataFrame, key: str, scores: str = "scores") -> DataFrame:
    """``key, pos, label, score``, one row per label."""
    return array_rows(df, [key], F.col(scores), "_s").select(
        key, "pos", F.col("_s.label").alias("label"), F.col("_s.score").alias("score")
    )


def widen(long: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Long scores to one column per label; explicit pivot values save the distinct job."""
    return long.groupBy(key).pivot("label", list(labels)).agg(F.first("score"))


def widen_in_row(df: DataFrame, labels: Sequence[str], prefix: str = "", scores: str = "scores") -> DataFrame:
    """In-row scores to one column per label, without a shuffle."""
    as_map = F.map_from_entries(F.col(scores))
    return df.withColumn("_m", as_map).withColumns(
        {f"{prefix}{name}": F.try_element_at(F.col("_m"), F.lit(name)) for name in labels}
    ).drop("_m")


def competing(scores: Column) -> Column:
    """Scores divided by their sum, so that labels compete."""

    def share(items: Column) -> Column:
        total = F.aggregate(items, F.lit(0.0), lambda acc, s: acc + s["score"])
        return let(total, lambda t: F.transform(items, lambda s: F.struct(
            s["label"].alias("label"),
            F.coalesce(F.try_divide(s["score"], t), F.lit(0.0)).alias("score"),
        )))

    return let(scores, share)


def classify_single(
    df: DataFrame, lexicon: Lexicon, title: str = "title", content: str = "content",
    max_words: int | None = None,
) -> DataFrame:
    """Add ``label``: the winner of competing scores over title and content, or the content's first ``max_words``."""
    body = F.col(content) if max_words is None else truncate_words(F.col(content), max_words)
    text = compose_text(F.col(title), body)
    scored = score_lexicon(df.withColumn("_text", text), lexicon, "_text", "_scores", None)
    return scored.withColumn("label", top_label(competing(F.col("_scores")))["label"]).drop("_text", "_scores")


def top_label(scores: Column) -> Column:
    """The highest scored struct; the first one wins a tie."""
    ordered = F.transform(
        scores, lambda s, i: F.struct(s["score"].alias("score"), (-i).alias("before"), s["label"].alias("label")))
    return F.array_max(ordered)
