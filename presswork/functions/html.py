"""HTML columns without a parser: patterns, splits and folds over one row.

All patterns avoid look-around and repeated groups, so they run in linear-ish
time on long pages and mean the same in Java and RE2.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork import config
from presswork.functions.text import WS, collapse_ws, strip_ws

NOISE = (
    r"(?is)<(?:script(?:\s[^>]*)?>.*?</script\s*>|style(?:\s[^>]*)?>.*?</style\s*>"
    r"|template(?:\s[^>]*)?>.*?</template\s*>|!--.*?-->)"
)
NOISE_MARK = "<!-->"
TAG = r"<(?:/?[a-zA-Z]|[!?])[^>]*>"
# Elements that end an open paragraph and always need a closing tag.
BLOCK = (
    "address|article|aside|blockquote|body|center|details|div|dl|fieldset|figure|footer|form"
    "|h[1-6]|header|html|main|nav|ol|pre|section|table|ul"
)
#: List items and the parts of a table, whose end tags may be left out.
ITEM = "li|dt|dd|caption|thead|tbody|tfoot|tr|td|th"
P_OPEN = r"(?i)<p(?:\s[^>]*)?/?>"
P_START = r"(?i)^<p(?:\s[^>]*)?/?>$"
P_END = rf"(?i)<(?:/p|/?(?:hr|{BLOCK}|{ITEM}))(?:\s[^>]*)?/?>"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail(items: Column) -> Column:
    """All but the first element."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def strip_noise(html: Column) -> Column:
    """Scripts, styles, templates and comments replaced by an empty comment."""
    return F.regexp_replace(html, NOISE, NOISE_MARK)


ENTITIES = "\n".join(
    f"{name}={char}"
    for name, char in sorted({**{n: chr(cp) for n, cp in name2codepoint.items()}, "apos": "'"}.items())
)


def _entity_table() -> Column:
    # One literal that constant folding turns into a map.
    return F.str_to_map(F.lit(ENTITIES), F.lit("\n"), F.lit("="))


def _code_point(number: Column) -> Column:
    """The character of a code point, NULL outside the valid range."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0"))
    return F.decode(utf32, "UTF-32")


def decode_entities(c: Column) -> Column:
    """Named (HTML 4) and numeric character references, each decoded once."""

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([a-zA-Z][a-zA-Z0-9]*);", 1)
        decimal = F.regexp_extract(piece, r"^#([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        char = (
            F.when(name != "", F.try_element_at(_entity_table(), name))
            .when(decimal != "", _code_point(decimal.cast("long")))
            .when(hexadecimal != "", _code_point(F.conv(hexadecimal, 16, 10).cast("long")))
        )
        rest = F.substring(piece, F.instr(piece, ";") + 1, F.length(piece))
        return (
            F.when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
            .when(F.contains(piece, F.lit(";")),
                  F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def rebuild(pieces: Column) -> Column:
        return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(tail(pieces), decode), ""))

    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), let(F.split(v, "&"), rebuild)).otherwise(v))


def _marked(fragment: Column) -> Column:
    """A fragment's text with every tag as one mark."""
    return decode_entities(F.regexp_replace(fragment, TAG, MARK))


def _join_strings(marked: Column, separator: str) -> Column:
    """The text pieces between marks, each stripped, empty ones dropped, joined."""
    edge = r"[\x01\s\x0b\x1c-\x1f\x{85}\p{Z}]*"
    return strip_ws(F.regexp_replace(marked, rf"{edge}\x01{edge}", separator))


def fragment_text(fragment: Column) -> Column:
    """Visible text of a fragment, pieces separated by one space."""
    return _join_strings(_marked(fragment), " ")


def fragment_text_tight(fragment: Column) -> Column:
    """Visible text of a fragment, pieces joined without a separator."""
    return _join_strings(_marked(fragment), "")


def raw_paragraphs(fragment: Column) -> Column:
    """Inner HTML of each paragraph; one ends at its close tag, the next ``<p>`` or a block tag."""
    pieces = let(F.split(fragment, P_OPEN), tail)
    return F.transform(pieces, lambda p: F.element_at(F.split(p, P_END, 2), 1))


def paragraphs(fragment: Column) -> Column:
    """Text of each paragraph in document order."""
    return F.transform(raw_paragraphs(fragment), fragment_text)


# ---- open elements -----------------------------------------------------------
#: Finds the same paragraphs as ``P_OPEN``: no other tag reaches over a ``<``.
ELEMENT = rf"{P_OPEN}|</?[a-z][^><]*>"
ELEMENT_NAME = r"^</?([a-zA-Z][^\s/>]*)"
VOID = " area base br col embed hr img input link meta param source track wbr "
_TABLE = "table caption"
#: What an open tag closes, and the open elements beyond which it closes nothing.
_IMPLIED = {
    **dict.fromkeys([*BLOCK.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"), "hr", "p"], ("p", f"{_TABLE} td th button object")),
    "li": ("li p", f"ul ol menu {_TABLE} td th button"),
    **dict.fromkeys(["dt", "dd"], ("dt dd p", f"dl {_TABLE} td th button")),
    **dict.fromkeys(["td", "th"], ("td th", "tr table")),
    "tr": ("tr td th caption", "table"),
    **dict.fromkeys(["thead", "tbody", "tfoot"], ("thead tbody tfoot tr td th caption", "table")),
    "option": ("option", "select"),
}
#: A close tag does not reach beyond an open element of a higher rank.
_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}


def _known(table: dict[str, str], name: Column) -> Column:
    # One literal that constant folding turns into a map.
    text = "\n".join(f"{k}={v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\n"), F.lit("=")), name)


def _named(names: Column, name: Column) -> Column:
    return F.contains(names, F.concat(F.lit(" "), name, F.lit(" ")))


def paragraph_parents(clean_html: Column) -> Column:
    """For each paragraph its parent element, by the number of its open tag; -1 where nothing is open.

    The tags of a page are folded over the stack of open elements. End tags that may be
    left out are implied by the next open tag, as for items, cells and paragraphs; a close tag
    ends what is open inside its element, and means nothing without one.
    """
    def event(tag: Column, number: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, ELEMENT_NAME, 1))
        return F.struct(
            number.alias("number"), name.alias("name"), tag.startswith("</").alias("close"), tag.rlike(P_START).alias("p"),
            (_named(F.lit(VOID), name) | tag.endswith("/>")).alias("empty"))

    def known(e: Column) -> Column:
        spaced = {k: tuple(f" {x} " for x in v) for k, v in _IMPLIED.items()}
        return F.struct(
            *[e[c].alias(c) for c in ("number", "name", "close", "p", "empty")],
            _known({k: v[0] for k, v in spaced.items()}, e["name"]).alias("closes"),
            _known({k: v[1] for k, v in spaced.items()}, e["name"]).alias("scope"),
            F.coalesce(_known({k: str(v) for k, v in _RANK.items()}, e["name"]), F.lit("0")).alias("rank"))

    def places(stack: Column, test) -> Column:
        return F.filter(F.transform(stack, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())

    def implied(stack: Column, e: Column) -> Column:
        """What stays open when ``e`` opens."""
        bound = F.coalesce(F.array_max(places(stack, lambda x, i: _named(e["scope"], x["name"]))), F.lit(-1))
        first = let(bound, lambda b: F.array_min(places(stack, lambda x, i: (i > b) & _named(e["closes"], x["name"]))))
        return F.when(e["closes"].isNull(), stack).otherwise(F.slice(stack, F.lit(1), F.coalesce(first, F.size(stack))))

    def closed(stack: Column, e: Column) -> Column:
        """What stays open when ``e`` closes."""
        bound = F.coalesce(F.array_max(places(stack, lambda x, i: x["rank"] > e["rank"])), F.lit(-1))
        last = let(bound, lambda b: F.array_max(places(stack, lambda x, i: (i >= b) & (x["name"] == e["name"]))))
        return F.slice(stack, F.lit(1), F.coalesce(last, F.size(stack)))

    def step(state: Column, e: Column) -> Column:
        def opened(stack: Column) -> Column:
            own = F.array(F.struct(*[e[c].alias(c) for c in ("number", "name", "rank")]))
            parent = F.coalesce(F.try_element_at(stack, F.lit(-1))["number"], F.lit(-1))
            return F.struct(
                F.when(e["empty"] & ~e["p"], stack).otherwise(F.concat(stack, own)).alias("stack"),
                F.when(e["p"], F.concat(state["parents"], F.array(parent))).otherwise(state["parents"]).alias("parents"))

        return F.when(
            e["close"], F.struct(closed(state["stack"], e).alias("stack"), state["parents"].alias("parents"))
        ).otherwise(let(implied(state["stack"], e), opened))

    start = F.struct(
        F.array().cast("array<struct<number:int,name:string,rank:string>>").alias("stack"), F.array().cast("array<int>").alias("parents"))
    events = F.transform(F.transform(F.regexp_extract_all(clean_html, F.lit(ELEMENT), F.lit(0)), event), known)
    return F.aggregate(events, start, step, lambda state: state["parents"])


def largest_block(clean_html: Column) -> Column:
    """Text of the sibling paragraphs with most text, NULL unless it is over the minimum; the earliest parent wins a tie.

    Paragraphs are sorted by parent and folded, so the work grows with a page's length alone.
    """
    def best(texts: Column, parents: Column) -> Column:
        rows = F.array_sort(F.transform(texts, lambda t, i: F.struct(
            F.get(parents, i).alias("parent"), i.alias("at"), F.length(t).alias("chars"))))
        start = F.struct(*[F.lit(v).alias(n) for n, v in (("parent", -2), ("chars", 0), ("first", 0), ("best", -2), ("most", -1), ("best_first", 0))])

        def step(s: Column, r: Column) -> Column:
            same = s["parent"] == r["parent"]
            chars = F.when(same, s["chars"] + 1 + r["chars"]).otherwise(r["chars"])
            first = F.when(same, s["first"]).otherwise(r["at"])
            better = (chars > s["most"]) | (chars == s["most"]) & ((r["parent"] == s["best"]) | (first < s["best_first"]))
            return F.struct(
                r["parent"].alias("parent"), chars.alias("chars"), first.alias("first"),
                F.when(better, r["parent"]).otherwise(s["best"]).alias("best"),
                F.when(better, chars).otherwise(s["most"]).alias("most"),
                F.when(better, first).otherwise(s["best_first"]).alias("best_first"))

        return F.aggregate(rows, start, step)

    def block(found: Column) -> Column:
        texts, parents = found["texts"], found["parents"]
        return let(best(texts, parents), lambda b: F.when(b["most"] > config.BLOCK_MIN_CHARS, collapse_ws(F.array_join(
            F.filter(texts, lambda t, i: F.get(parents, i) == b["best"]), " "))))

    return let(F.struct(paragraphs(clean_html).alias("texts"), paragraph_parents(clean_html).alias("parents")), block)


def selector_pattern(selector: str) -> str:
    """Open-tag pattern of a tag, ``.class`` or ``[attr="value"]`` selector; group 1 is the tag."""
    any_tag = r"<([a-zA-Z][a-zA-Z0-9-]*)(?:\s[^>]*)?"
    if selector.startswith("."):
        name = selector[1:].replace("-", r"\-")
        value = rf"""(?:"(?:[^">]*\s)?{name}(?:\s[^">]*)?"|'(?:[^'>]*\s)?{name}(?:\s[^'>]*)?'|{name})"""
        return rf"{any_tag}\s(?i:class)\s*=\s*{value}(?:\s[^>]*)?/?>"
    if selector.startswith("["):
        attribute, wanted = selector[1:-1].replace('"', "").split("=")
        return rf"""{any_tag}\s(?i:{attribute})\s*=\s*["']?{wanted}["']?(?:\s[^>]*)?/?>"""
    return rf"<((?i:{selector}))(?:\s[^>]*)?>"


def _guard(selector: str) -> str:
    """A substring that must occur in a page, in any case, for the selector to match."""
    return selector.strip('.[]"').replace('"', "").split("=")[-1]


def _balanced_body(rest: Column, tag: Column) -> Column:
    """``rest`` (what follows an open tag) up to the tag's own close tag.

    The close tags are folded with a running depth; an element that is never
    closed runs to the end.
    """
    close = F.concat(F.lit("(?i)</"), tag, F.lit(r"\s*>"))
    opens = F.concat(F.lit("(?i)<"), tag, F.lit(r"(?:\s[^>]*)?>"))
    joiner = F.concat(F.lit("</"), tag, F.lit(">"))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

    def step(state: Column, piece: Column) -> Column:
        after = F.struct(
            (state["depth"] + F.regexp_count(piece, opens) - 1).cast("int").alias("depth"),
            (state["taken"] + 1).alias("taken"),
        )
        return F.when(state["depth"] <= 0, state).otherwise(after)

    def keep(pieces: Column) -> Column:
        taken = F.aggregate(pieces, start, step)["taken"]
        return F.array_join(F.transform(
            F.slice(pieces, F.lit(1), taken), lambda p: F.concat(p, joiner)), "")

    return let(F.split(rest, close), keep)


def element_bodies(html: Column, pattern: Column, limit: int = 2) -> Column:
    """Inner HTML of the first ``limit`` elements whose open tag matches, nested ones included."""

    def cut(found: Column) -> Column:
        opens, before = found["opens"], found["before"]

        def body(i: int) -> Column:
            offset = F.lit(1)
            for k in range(i + 1):
                offset = offset + F.length(F.get(before, F.lit(k))) + F.length(F.get(opens, F.lit(k)))
            rest = F.substring(html, offset, F.length(html))
            tag = F.regexp_extract(F.get(opens, F.lit(i)), r"^<([a-zA-Z][a-zA-Z0-9-]*)", 1)
            return F.when(F.size(opens) > i, let(tag, lambda t: _balanced_body(rest, t)))

        return F.array_compact(F.array(*[body(i) for i in range(limit)]))

    found = F.struct(
        F.regexp_extract_all(html, pattern, F.lit(0)).alias("opens"),
        F.split(html, pattern, limit + 1).alias("before"),
    )
    return let(found, cut)


def _selectors() -> Column:
    """The container selectors as an array of patterns, folded to one literal."""
    rows = []
    for selector in config.ARTICLE_SELECTORS:
        *outer, target = selector.split(" ")
        rows.append(F.struct(
            F.lit(_guard(target).lower()).alias("guard"),
            F.lit(selector_pattern(outer[0]) if outer else None).cast("string").alias("outer"),
            F.lit(selector_pattern(target)).alias("pattern"),
        ))
    return F.array(*rows)


def main_text(clean_html: Column) -> Column:
    """Text of the first article container that is long enough, else NULL.

    Selectors are tried in order by a fold that does no further work after the
    first hit.  A selector's text is that of the paragraphs of its first two
    containers.
    """

    def selected(s: Column) -> Column:
        scope = F.when(s["outer"].isNull(), clean_html).otherwise(
            F.get(element_bodies(clean_html, s["outer"], 1), F.lit(0))
        )
        bodies = let(scope, lambda h: element_bodies(h, s["pattern"]))
        texts = F.flatten(F.transform(bodies, paragraphs))
        return let(
            F.array_join(texts, " "),
            lambda t: F.when(
                F.length(t) > config.BLOCK_MIN_CHARS, F.trim(F.regexp_replace(t, rf"{WS}+", " "))
            ),
        )

    return let(F.lower(clean_html), lambda lowered: F.aggregate(
        _selectors(),
        F.lit(None).cast("string"),
        lambda found, s: F.when(found.isNotNull(), found).when(
            F.contains(lowered, s["guard"]), selected(s)
        ),
    ))


def long_paragraphs(clean_html: Column) -> Column:
    """All paragraphs over 50 characters, joined; '' when there is none."""
    texts = F.transform(raw_paragraphs(clean_html), _marked)
    kept = F.filter(texts, lambda m: F.length(_join_strings(m, "")) > config.PARAGRAPH_MIN_CHARS)
    return collapse_ws(F.array_join(F.transform(kept, lambda m: _join_strings(m, " ")), " "))


def title_of(clean_html: Column) -> Column:
    """Stripped text of the first ``<title>``, '' when there is none."""
    return strip_ws(decode_entities(F.regexp_extract(F.coalesce(clean_html, F.lit("")), TITLE, 1)))


def is_html(html: Column) -> Column:
    """First visible character opens a tag."""
    return F.coalesce(html, F.lit("")).rlike(rf"^{WS}*<")


def needs_render(html: Column) -> Column:
    """Body missing or too small to be a rendered page."""
    return F.coalesce(F.length(html), F.lit(0)) < config.RENDER_BELOW_CHARS
