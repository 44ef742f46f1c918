"""Text, URL and HTML columns on literal rows."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import html as H
from presswork.functions import text as X
from presswork.functions import urls as U
from presswork.operators import extract, links


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_white_space_is_unicode(spark):
    values = [" a\tb c\n", " ", "", None, "\x1ca\x85", "plain"]
    got = apply(spark, values, X.collapse_ws(F.col("v")), X.non_blank(F.col("v")))
    for value, (collapsed, visible) in zip(values, got):
        assert collapsed == " ".join((value or "").split())
        assert visible == bool(value and value.strip())
    assert apply(spark, values, X.strip_ws(F.col("v"))) == [v.strip() if v is not None else None for v in values]


def test_compose_keeps_the_space(spark):
    df = spark.createDataFrame([(None, "c"), ("t", None), (None, None)], "t string, c string")
    assert [r[0] for r in df.select(X.compose_text(F.col("t"), F.col("c"))).collect()] == [" c", "t ", " "]


def test_truncation_and_input_rule(spark):
    values = ["a  b c d", None, "x" * 9, " " + "x" * 10 + " "]
    words, chars, errors = zip(*apply(
        spark, values, X.truncate_words(F.col("v"), 3), X.truncate_chars(F.col("v"), 4), X.input_error(F.col("v"))))
    assert list(words) == ["a b c", "", "x" * 9, "x" * 10]
    assert list(chars) == ["a  b", "", "xxxx", " xxx"]
    assert [e is None for e in errors] == [False, False, False, True]


def test_tokens_and_bigrams(spark):
    values = ["A bc Déf_1 g hi", "one", "", None]
    tokens, pairs = zip(*apply(spark, values, X.tokenize(F.col("v")), X.bigrams(X.tokenize(F.col("v")))))
    assert list(tokens) == [["bc", "déf_1", "hi"], ["one"], [], []]
    assert list(pairs) == [["bc déf_1", "déf_1 hi"], [], [], []]


def test_resolve_href(spark):
    base = F.lit("https://u:p@a.example:80/x/y?q")
    hrefs = ["//host/x", "/p#f", "http://b/", "rel/x", "mailto:a@b", "#f", ""]
    assert apply(spark, hrefs, U.resolve_href(base, F.col("v"))) == [
        "https://host/x", "https://u:p@a.example:80/p#f", "http://b/", None, None, None, None]


def test_url_parts(spark):
    urls = ["http://a:80/x;p/y;z?q#f", "//h/p", "no scheme/x", "https://u@h"]
    got = apply(spark, urls, U.netloc(F.col("v")), U.url_path(F.col("v")))
    assert got == [("a:80", "/x;p/y"), ("h", "/p"), ("", "no scheme/x"), ("u@h", "")]
    assert apply(spark, [" http://a/b#c#d "], U.strip_fragment(F.col("v"))) == ["http://a/b"]


@pytest.mark.parametrize("url,likely", [
    ("https://a.b/2024/05/x", True),
    ("https://a.b/NEWS/x", True),
    ("https://a.b/news/feed/", False),
    ("https://a.b/author/one-two-three", False),
    ("https://a.b/x/somelongslug-1", True),
    ("https://a.b/somelongslug-1", False),
    ("https://a.b/x/short-1", False),
    ("https://a.b/page/3", False),
    ("https://a.b/doc.pdf", False),
    ("https://a.b/", False),
    ("https://a.b/12345/x", True),
])
def test_likely_article(spark, url, likely):
    assert apply(spark, [url], U.is_likely_article(F.col("v"))) == [likely]


def test_entities_are_decoded_once(spark):
    values = ["&amp;lt; &lt;b&gt; &#233;&#xE9;&eacute; &#38;amp;", "a & b &unknown; &;", "&#0; &#x110000; &apos;", "plain", None]
    assert apply(spark, values, H.decode_entities(F.col("v"))) == [
        "&lt; <b> ééé &amp;", "a & b &unknown; &;", "&#0; &#x110000; '", "plain", None]


def test_paragraphs_close_like_a_parser(spark):
    page = "<p>one<p><b>two<br>three<div>x</div><p>four<!-- c -->five</section><p>six<hr>seven<h2>h</h2>"
    assert apply(spark, [page], H.paragraphs(H.strip_noise(F.col("v")))) == [["one", "two three", "four five", "six"]]


LONG = "word " * 120


def test_main_text_takes_selectors_in_order(spark):
    pages = [
        f"<article><p>short</p></article><div class='a post-content b'><div><p>{LONG}</p></div><p>end</p></div><p>out</p>",
        f"<ARTICLE><p>{LONG}</ARTICLE><article><p>two</article><article><p>three</article>",
        f"<div class='post-contents'><p>{LONG}</p></div>",
        f"<section itemprop=articleBody><p>{LONG}",
        "<article><p>short</p></article>",
    ]
    text = LONG.strip()
    assert apply(spark, pages, H.main_text(H.strip_noise(F.col("v")))) == [
        f"{text} end", f"{text} two", None, text, None]


def test_title_and_long_paragraphs(spark):
    page = f"<title> A &amp;\n B </title><p>{'x' * 30} <b> {'y' * 20} </b></p><p>{'x' * 31} <b> {'y' * 20} </b></p>"
    got = apply(spark, [page, "", None], H.title_of(F.col("v")), H.long_paragraphs(F.col("v")))
    assert got[0] == ("A &\n B", f"{'x' * 31} {'y' * 20}")
    assert [g[0] for g in got[1:]] == ["", ""]


def test_largest_block_groups_by_parent(spark):
    a, b = "a" * 300, "b" * 400
    html = f"<body><div><p>{a}</p><div><p>{b}</p></div><p>{a}</p></div><section><p>{b}</p></section></body>"
    tie = f"<body><div><p>{'x' * 600}</p></div><div><p>{'y' * 600}</p></div></body>"
    pages = spark.createDataFrame([(1, html), (2, tie), (3, "<p>short</p>")], "k int, html string")
    got = {r["k"]: r["block"] for r in extract.largest_block(pages, "k").collect()}
    assert got == {1: f"{a} {a}", 2: "x" * 600}


@pytest.mark.parametrize("html, parents", [
    ("<p>1<p>2", [-1, -1]),
    ("<ul><li><p>1<li><p>2<p>3</ul><p>4", [1, 3, 3, -1]),
    ("<ul><li><p>1<ul><li><p>2</ul><p>3</li><li><p>4", [1, 4, 1, 9]),
    ("<table><tr><td><p>1<td><p>2<tr><th><p>3</table><p>4", [2, 4, 7, -1]),
    ("<table><tbody><tr><td><p>1<tbody><tr><td><div><p>2</td></div><td><p>3", [3, 8, 12]),
    ("<dl><dt><p>1<dd><p>2</dl>", [1, 3]),
    ("<x-a><p>1</p></x-a><span><p>2</p><b><p>3</b></p></span><p>4", [0, 4, 7, -1]),
    ("<div><p>1<b>x<div><p>2</div><p>3", [0, 3, 0]),
    ("<DIV><P>1</DIV></div></p></li><p>2<br><img src=x><x/><p>3", [0, -1, -1]),
    ("<p>1<hr><p>2<section><p>3</section><p>4", [-1, -1, 3, -1]),
    ("<div><b><p>1</b><p>2</div><p>3</b>", [1, 0, -1]),
    ("<div><a title='<p>'>x</a><p>1", [0, 0]),
    ("text", []), ("", []),
])
def test_paragraph_parents(spark, html, parents):
    assert apply(spark, [html], H.paragraph_parents(F.col("v"))) == [parents]


def test_items_and_cells_are_groups(spark):
    x, y = "x" * 300, "y" * 301
    pages = [f"<ul><li><p>{x}<p>{x}<li><p>{y}<li><p>{y}</ul>", f"<table><tr><td><p>{y}<td><p>{x}<p>{x}</table>",
             f"<x-a><p>{y}</p></x-a><x-b><p>{x}</p><p>{x}</p></x-b>", f"<ul><li><p>{x}<li><p>{x}</ul>", None, ""]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    assert {r["k"]: r["block"] for r in extract.largest_block(df, "k").collect()} == dict.fromkeys(range(3), f"{x} {x}")


def test_a_page_of_many_cells(spark):
    page = "<table>" + "<tr><td><p>cell" * 3000 + "</table><div>" + "<p>text" * 3000
    assert apply(spark, [page], H.largest_block(F.col("v"))) == [" ".join(["text"] * 3000)]


def test_anchors(spark):
    html = """<a name=x>no href</a><a class=c href='/a?x=1&amp;y=2'>Next <b>page</b></a><a href=/b>open<a href="">e</a>
    <script>var s = '<a href="/no">no</a>'</script>"""
    pages = spark.createDataFrame([("https://h/x", html)], "url string, html string")
    rows = links.extract_links(pages).orderBy("pos").collect()
    assert [(r["href"], r["anchor_text"]) for r in rows] == [("/a?x=1&y=2", "Next page"), ("/b", "open"), ("", "e")]


def test_labels_names(spark):
    assert apply(spark, ["Bias & Fairness"], X.label_key(F.col("v"), "stage2")) == ["stage2_bias_and_fairness"]
    assert apply(spark, ["stage1_binary_artificial_intelligence"], X.label_display(F.col("v"))) == ["Artificial Intelligence"]


def test_main_text_of_an_upper_case_page(spark):
    page = f"<ARTICLE><P>{LONG}</P></ARTICLE>"
    assert apply(spark, [page], H.main_text(H.strip_noise(F.col("v")))) == [LONG.strip()]


def test_dot_segments(spark):
    from urllib.parse import urljoin

    hrefs = ["/a/../b", "/./a", "/a/b/..", "/a/b/.", "/..", "/../..", "/.", "/", "/a//b/../c", "/a/../../b?x=/../y#/./z", "/a/..;p?q", "/a;x/../b", "/a/b;p",
             "/.../x", "/..a/.b", "/a?", "/a#", "/a?#", "/a?#f", "/a;", "//h/x/../y", "/a/./b/./../c/", "/é/../ü"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(U.resolve_href(F.lit("https://u@h.example:8/p/q?x"), F.col("h"))).collect()]
    assert got == [urljoin("https://u@h.example:8", h) for h in hrefs]
