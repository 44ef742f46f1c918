"""Presswork: labelled news corpora as Spark DataFrames.

Stored web pages become articles, articles become label scores, scores become
binary labels, labels become train/validation/test splits and two-stage
classifiers.  Every step is a DataFrame (or Column) function, so Catalyst sees
the whole plan.
"""

from presswork.config import CATEGORIES, ISSUES, CrawlLimits, label_dimension
from presswork.session import build_session, stage

__all__ = [
    "CATEGORIES",
    "ISSUES",
    "CrawlLimits",
    "build_session",
    "label_dimension",
    "stage",
]
