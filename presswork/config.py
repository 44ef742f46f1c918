"""Fixed values and run limits.

Sources and keywords are data: read them with
:func:`presswork.sources.config.read_sources`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: the two label sets, in display order -------------------
CATEGORIES = [
    "Artificial Intelligence",
    "Technology",
    "Business",
    "Politics",
    "Sports",
    "Others",
]
ISSUES = [
    "Bias & Fairness",
    "Privacy & Data Misuse",
    "Job Displacement",
    "Misinformation & Deepfakes",
    "Accountability & Liability",
    "Environmental Impact",
    "Surveillance & Regulation",
    "Safety & Security",
    "Intellectual Property",
    "Lack of Transparency",
    "Algorithmic Manipulation",
    "No Ethical Issue Detected",
]
GATE_CATEGORY = "Artificial Intelligence"
NO_LABELS = "No Labels"

# ---- fixed values: thresholds and text limits -----------------------------
GATE_THRESHOLD = 0.6
BINARY_THRESHOLD = 0.6
DECISION_THRESHOLD = 0.5
STAGE1_CHARS = 4000
STAGE2_CHARS = 5000
SINGLE_LABEL_WORDS = 5000
PREVIEW_CHARS = 200
MIN_INPUT_CHARS = 10
SHORT_TEXT_CHARS = 100
LONG_TEXT_CHARS = 10000
RENDER_BELOW_CHARS = 1000
BLOCK_MIN_CHARS = 500
PARAGRAPH_MIN_CHARS = 50
CRAWL_MAX_DEPTH = 10
CRAWL_FANOUT = 5
MIN_DF = 2
MAX_DF = 0.95
SPLIT_SEED = 42

# ---- fixed values: messages -----------------------------------------------
INPUT_ERROR = "Please provide valid article text (at least {} characters)"
SCORING_ERROR = "An error occurred: scoring failed"

# ---- fixed values: URL rules ----------------------------------------------
ARTICLE_URL_PARTS = [
    r"/20\d{2}/", r"/202\d/", r"/article/", r"/news/", r"/articles/", r"/posts?/", r"/blog/",
    r"/\d{4}/\d{2}/\d{2}/", r"/\d{4}/\d{2}/", r"/story/", r"/p/",
    r"/discover/", r"/technology/", r"/ai-", r"/artificial-intelligence",
    r"/machine-learning", r"/deep-learning", r"/neural", r"/robotics",
    r"/[a-z]+-[a-z]+-[a-z0-9]+", r"/[0-9]{4,}/", r"/tagged/", r"/topic/",
]
EXCLUDED_URL_PARTS = [
    r"/feed/?$", r"/rss/?$", r"/sitemap", r"/category/?$", r"/tag/?$", r"/author/",
    r"/page/\d+/?$", r"/search", r"/wp-content", r"/wp-admin", r"\.xml$", r"\.pdf$",
    r"/login", r"/register", r"/cart", r"/checkout",
]
PAGINATION_WORDS = ["next", "older", "previous", "more", "load"]

# ---- fixed values: article containers, tried in this order ----------------
ARTICLE_SELECTORS = [
    "article",
    '[role="article"]',
    ".article-content",
    ".post-content",
    ".entry-content",
    ".content-body",
    ".article-body",
    "main article",
    ".story-body",
    '[itemprop="articleBody"]',
]


@dataclass(frozen=True)
class CrawlLimits:
    """Limits of an ingest run; numbers of URLs and levels are unlimited unless named."""

    min_content_chars: int = 500
    max_content_chars: int = 10000
    max_urls_per_site: int | None = None
    max_urls: int | None = None
    sitemap_max_nested: int | None = None
    crawl_max_depth: int | None = None
    crawl_fanout: int | None = None


def label_key(name: str, stage: str | None = None) -> str:
    """Column key of a display label: lower case, ``_`` for space, ``and`` for ``&``."""
    key = name.lower().replace(" ", "_").replace("&", "and")
    return f"{stage}_{key}" if stage else key


def stage_labels(stage: str) -> list[str]:
    return {"stage1": CATEGORIES, "stage2": ISSUES}[stage]


def stage_keys(stage: str, binary: bool = False) -> list[str]:
    """Wide column names of a stage, in label order."""
    prefix = f"{stage}_binary" if binary else stage
    return [label_key(name, prefix) for name in stage_labels(stage)]


def label_dimension(spark: SparkSession) -> DataFrame:
    """The label dimension (18 rows): stage, position, key, display."""
    rows = [
        (stage, pos, label_key(name), name)
        for stage in ("stage1", "stage2")
        for pos, name in enumerate(stage_labels(stage))
    ]
    return spark.createDataFrame(rows, "stage string, position int, key string, display string")
