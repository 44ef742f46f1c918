"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork import config
from presswork.functions.html import let
from presswork.functions.text import strip_ws

SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*:"
NETLOC = rf"^(?:{SCHEME})?//([^/?#]*)"
PATH = rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)"
INCLUDE = "(?i)(?:" + "|".join(config.ARTICLE_URL_PARTS) + ")"
EXCLUDE = "(?i)(?:" + "|".join(config.EXCLUDED_URL_PARTS) + ")"
PAGINATION = "|".join(config.PAGINATION_WORDS)


def netloc(url: Column) -> Column:
    """Authority part, with port and user info; '' when there is none."""
    return F.regexp_extract(url, NETLOC, 1)


def url_path(url: Column) -> Column:
    """Path without query, fragment and last-segment parameters."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), r";[^/]*$", "")


def base_url(url: Column) -> Column:
    """``scheme://netloc``."""
    return F.concat(F.regexp_extract(url, rf"^({SCHEME})", 1), F.lit("//"), netloc(url))


def remove_dot_segments(path: Column) -> Column:
    """A path from the root without ``.`` and ``..``; a step above the root stays at the root."""

    def folded(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(
            s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        ).when(s == ".", out).otherwise(F.concat(out, F.array(s))))
        ends = F.element_at(segments, -1).isin(".", "..")
        return F.array_join(F.concat(kept, F.when(ends, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    def rooted(joined: Column) -> Column:
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    return F.when(F.contains(path, F.lit("/.")), let(let(F.split(path, "/"), folded), rooted)).otherwise(path)


def _from_root(href: Column) -> Column:
    """A target from the root with its dot segments resolved; parameters, query and fragment as they are, if not empty."""
    whole = F.regexp_extract(href, r"^([^?#]*)", 1)
    parameters = F.regexp_extract(whole, r"(;[^/]*)$", 1)
    path = F.substring(whole, F.lit(1), F.length(whole) - F.length(parameters))
    rest = F.regexp_replace(F.substring(href, F.length(whole) + 1, F.length(href)), r"#$", "")
    rest = F.regexp_replace(rest, r"^\?(#.*)?$", "$1")
    return F.concat(remove_dot_segments(path), F.when(parameters == ";", "").otherwise(parameters), rest)


def resolve_href(page_url: Column, href: Column) -> Column:
    """Absolute form of an anchor target; NULL for anything but http links.

    Root-relative targets get the page's scheme and host and lose their dot segments,
    ``//host/x`` gets its scheme; relative paths, ``mailto:`` and the like are dropped.
    """
    scheme = F.regexp_extract(page_url, rf"^({SCHEME})", 1)
    return (
        F.when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(base_url(page_url), _from_root(href)))
        .when(href.startswith("http"), href)
    )


def strip_fragment(url: Column) -> Column:
    return strip_ws(F.substring_index(url, "#", 1))


def is_likely_article(url: Column) -> Column:
    """Refused by the exclusions, else taken by the inclusions or by a long hyphenated slug."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    slug = (F.size(parts) >= 2) & (F.length(last) > 10) & F.contains(last, F.lit("-"))
    return ~url.rlike(EXCLUDE) & (url.rlike(INCLUDE) | F.coalesce(slug, F.lit(False)))


def is_pagination(text: Column) -> Column:
    """Anchor text that names a following or preceding page."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(PAGINATION)


def is_http(url: Column) -> Column:
    return url.startswith("http")
