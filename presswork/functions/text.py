"""Text columns: whitespace, truncation, tokens, label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork import config

# Unicode white space as a class that Java and RE2 read alike.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NON_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# Word characters: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def strip_ws(c: Column) -> Column:
    """Strip Unicode white space on both ends (``trim`` only strips spaces)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """One space between words, none at the ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " "))


def compose_text(title: Column, content: Column) -> Column:
    """``title + ' ' + content``; a NULL part counts as '' and the space stays."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))


def non_blank(c: Column) -> Column:
    """True for text that holds something other than white space."""
    return c.isNotNull() & ~c.rlike(rf"^{WS}*$")


def truncate_chars(c: Column, n: int) -> Column:
    """First ``n`` characters; NULL becomes ''."""
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def truncate_words(c: Column, n: int) -> Column:
    """First ``n`` white-space separated words joined by single spaces."""
    return F.array_join(F.slice(F.split(collapse_ws(c), " "), 1, n), " ")


def preview(c: Column, n: int = config.PREVIEW_CHARS) -> Column:
    return F.substring(c, 1, n)


def input_error(c: Column, min_chars: int = config.MIN_INPUT_CHARS) -> Column:
    """NULL for acceptable input, else the reason it is refused."""
    # two characters with enough between them are found near the start; the text is not stripped for it
    enough = NON_WS if min_chars < 2 else rf"{NON_WS}(?s:.{{{min_chars - 2},}}?){NON_WS}"
    too_short = ~F.coalesce(c, F.lit("")).rlike(enough) if min_chars > 0 else F.lit(False)
    return F.when(too_short, F.lit(config.INPUT_ERROR.format(min_chars)))


def tokenize(c: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"{WORD}{{2,}}"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Adjacent token pairs; stays inside the row, so it needs no window."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def label_key(c: Column, stage: str | None = None) -> Column:
    key = F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.concat(F.lit(f"{stage}_"), key) if stage else key


def label_display(c: Column) -> Column:
    """Readable name of a wide column: prefix off, spaces in, words capitalised."""
    bare = F.regexp_replace(c, r"^stage[12]_(binary_)?", "")
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent; 0 when the whole is empty."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def percent_1dp(score: Column) -> Column:
    """A score as a percentage with one decimal."""
    return F.round(score * 100, 1)
