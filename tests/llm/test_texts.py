import itertools
import random
import re
import time
import zlib
from collections import Counter
from html import unescape
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from presswork.llm import decontaminate, mincut, packing, quotes
from presswork.llm.queries import QUERIES, tokenizer_path

# ---- packing ----------------------------------------------------------------------------


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["Word", "straße,", "it's", "a1", "É…!", "x"], k=rnd.choice([0, 3, 40, 900, 2047, 5000]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3]), (99, "")]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, start int, length string").repartition(2)
    out = packing.pack_documents(df, tokenizer_path(), keep_ids=True).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for k, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [packing.END]
        want[k, np.array(ids, "<u4").tobytes()] += 1
    got, open_docs = Counter(), {}
    for r in sorted(out, key=lambda r: (repr(r["doc_id"]), r["start"])):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    by_doc = {}
    for r in out:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc, n), parts in by_doc.items():
        starts = sorted({p["start"] for p in parts})
        copies = sum(p["start"] == 0 for p in parts)
        data = b"".join(next(bytes(p["ids"]) for p in parts if p["start"] == s) for s in starts)
        assert len(data) == 4 * n
        got[doc, data] += copies
    assert got == want and not open_docs
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in out) / (2048 * len(sequences)) > 0.9
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_words_are_tokenised_like_whole_texts():
    encoder = packing.WordTokenizer(tokenizer_path())
    texts = ["İstanbul's it'll ''s don't 'S “x”…! a1b2 ..'s J̌x ǅ ẞ\x1cy\x85z <|endoftext|> x<|startoftext|>y Σίσυφος ΣΑΣ. e.́ é ×x÷ a b ½",
             "<|ENDOFTEXT|> and <|EndOfText|>!", "<|StartOfText|>AB<|startoftext|>C D", "", " ", "a.́", "word.'s word'.s ÀÉ,ÿ ß!! naïve-x", "日本語 テスト。abc"]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 100)
    encoder = packing.WordTokenizer(tokenizer_path())
    texts = ["x" * 500 + " y", "z1" * 300, "a b c", "x" * 500 + " y"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder.ids([t])[0] for t in texts] == want and b"z1" * 300 not in encoder.chunks


def test_patterns_use_every_piece_once():
    rnd = np.random.default_rng(2)
    for counts in (rnd.integers(0, 50, 33), np.eye(1, 33, 1, dtype=int)[0] * 1000, np.zeros(33, int)):
        counts = counts.copy()
        counts[0] = 0
        used = np.zeros(33, int)
        for need, times in packing.patterns(counts):
            assert sum(u * m for u, m in need.items()) <= 32
            for u, m in need.items():
                used[u] += m * times
        assert np.array_equal(used, counts)


def test_least_squares_meets_its_conditions():
    columns = packing.combinations_filling(8, 3)
    assert {tuple(r) for r in columns} == {t for t in itertools.product(range(9), repeat=3) if sum(t) == 8 and list(t) == sorted(t, reverse=True)}
    counts = np.random.default_rng(3).integers(0, 90, 9).astype(float)
    counts[0] = 0
    x = packing.solve(columns, counts)
    amounts = np.array([[(row == u).sum() for u in range(9)] for row in columns], float)
    amounts[:, 0] = 0
    gain = amounts @ (counts - x @ amounts)
    assert x.min() >= 0 and gain.max() < 1.0 and np.abs(gain[x > 0]).max() < 1e-6


# ---- benchmark decontamination ------------------------------------------------------------
def brute_distance(item, text):
    row, best = list(range(len(item) + 1)), (len(item), 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
        row = new
        best = min(best, (row[-1], j))
    return best


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, "".join(rnd.choices("abcd e", k=rnd.randint(40, 90)))) for i in range(8)] + [(8, "short one"), (9, None), (None, "..."), (3, "x" * 50)]
    docs = []
    for i in range(50):
        body = list(rnd.choice(items[:8])[1])
        for _ in range(rnd.randint(0, 7)):
            at = rnd.randrange(len(body))
            body[at:at + rnd.randint(0, 1)] = rnd.choice(["", "a", "Q", "!"])
        docs.append((i, "".join(rnd.choices("abc d", k=30)) + "  " + "".join(body).upper() + "\n" + "".join(rnd.choices("abc d", k=30))))
    docs += [(60, "Short, ONE!"), (61, "a short one"), (62, None), (63, ""), (None, items[0][1]), (64, "x" * 400)]
    want = Counter()
    for d, text in docs:
        t = decontaminate.normal(text or "")
        for i, item in items:
            n = decontaminate.normal(item or "")
            distance, _ = brute_distance(f" {n} ", f" {t} ")
            if n and distance <= int(0.1 * len(n)):
                want[d, i, distance] += 1
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, distance int")
    right = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (1 << 20, 150):
        got = decontaminate.contaminations(left, right, rate=0.1, block_chars=block_chars).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want
    assert len(want) > 20
    assert decontaminate.contaminations(left.limit(0), right).count() == decontaminate.contaminations(left, right.limit(0)).count() == 0


def test_short_items_are_found_inside_texts(spark, tmp_path):
    items = [(1, "What is the capital of France?"), (2, "Why not"), (3, "?!"), (4, "a cat")]
    docs = [(1, "He asked: what is the capitol of France, and left."), (2, "why  NOT, said she"), (3, "why nothing; a catalogue"), (4, "a cat"),
            (5, "anywhy not"), (6, "anything else?"), (7, "a catalogue of a cat")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    left.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op4_edit_decontamination"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, 38), (2, 2, 0, 7), (4, 4, 0, 5), (7, 4, 0, 20)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.leaks(spark, left, str(tmp_path)).collect()) == [3, 5, 6]


@pytest.mark.parametrize("item", ["a cat sat there now", "a cat sat there"])
def test_words_cut_in_two_cost_edits(item):
    matcher = decontaminate.Matcher([(1, item)], 0.06)
    assert matcher.find(f"x{item}x") == [] and matcher.find(f"x {item} x") == [(1, 0, 2 + len(item))]
    assert matcher.find(item) == [(1, 0, len(item))]


def test_leaks_go_by_row(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog every single day of the week"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} it goes"), (None, "a clean text"), (5, f"again {item}"), (5, "another clean text"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.leaks(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)
    assert corpus_pipeline.leaks(spark, docs.limit(0), str(tmp_path)).count() == 0


# ---- main text ------------------------------------------------------------------------------
def test_cut_is_the_cheapest_labelling():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(0, 8)
        content, boiler = ([rnd.randint(0, 20) for _ in range(n)] for _ in range(2))
        edges = {(i, j): rnd.randint(0, 12) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4}

        def cost(labels):
            own = sum(c if x else b for x, c, b in zip(labels, content, boiler))
            return own + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

        assert cost(mincut.minimum_cut(content, boiler, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


STORY = "This is a sentence of the story, long enough to look like one, with commas and an end."
PAGE = f"""<html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a> name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for everybody who reads it, as you know.</div>
<article><header><h1>The&nbsp;title &amp; more</h1></header><p>{STORY}<p>Short one.</p><div class="ad">Buy this now, it is a very good thing to buy.</div>
<p>{STORY} <a href="/x">Link</a>&#x41;</p></article>
<aside class="sidebar"><h3>Related</h3><p>{STORY}</p></aside><form><label>Name</label><input></form>
<section id="comments"><p>{STORY} says a reader, at some length, in a comment.</p></section><footer>&copy; nobody</footer></body></html>"""


def test_page(spark):
    want = "\n".join(["The title & more", STORY, "Short one.", f"{STORY} LinkA"])
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE), (4, "u", "no mark-up at all < here"), (5, "u", PAGE.upper())]
    got = mincut.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = [r["text"] for r in got]
    assert texts[0] == texts[3] == want and texts[1] == texts[2] == "" and got[0]["n_chars"] == len(want)
    assert texts[5].startswith("THE")
    assert mincut.main_text("<p>" + "x " * 200_000).count("x") == 200_000
    assert mincut.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- quotes ------------------------------------------------------------------------------------
def test_levels_and_bodies():
    text = "> > deep words of the first\n>reply words of the second\n\nMy own words here.\n\nAnna wrote:\n> reply words of the second\nThanks"
    body, passages, _ = quotes.parse(text)
    assert body == "My own words here.\nThanks" and {p[0] for p in passages} == {1, 2}
    assert quotes.parse(None)[0] == "" and quotes.parse("plain\n text ")[0] == "plain\n text "


def brute_order(parents):
    children = {}
    for turn, parent in sorted(parents.items()):
        children.setdefault(parent, []).append(turn)
    out = []

    def walk(turn):
        out.append(turn)
        for child in sorted(children.get(turn, []), key=lambda c: (c not in before or before[c] != turn, c)):
            walk(child)

    turns = sorted(parents)
    before = dict(zip(turns[1:], turns))
    for root in children.get(None, []):
        walk(root)
    return out


@pytest.mark.parametrize("slice_turns", [2, 1024])
def test_replies_in_order(spark, slice_turns):
    rnd = random.Random(7)
    rows, parents = [], {}
    for conv in (1, 2):
        said = {}
        for turn in range(0, 40, 2):
            own = f"conversation {conv} says thing number {turn} in so many words"
            target = rnd.choice(list(said)) if said and rnd.random() < 0.5 else None
            quoted = f"On a day X wrote:\n> {said[target].upper()}\n" if target is not None else ""
            rows.append((conv, turn, "user", quoted + own, turn))
            parents[conv, turn] = target if target is not None else max(said, default=None)
            said[turn] = own
    rows += [(3, 0, "user", "> conversation 1 says thing number 4 in so many words\nyes", 1), (None, 1, "user", None, None), (4, None, None, "x", 2),
             (5, 1, "a", "same", 0), (5, 1, "a", "same", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(3)
    out = quotes.build_conversations(df, slice_turns).collect()
    assert len(out) == len(rows) and not any(r["text"].startswith((">", "On a day")) for r in out)
    for conv in (1, 2):
        mine = [r for r in out if r["conv_id"] == conv]
        assert {r["turn"]: r["parent_turn"] for r in mine} == {t: p for (c, t), p in parents.items() if c == conv}
        ordered = [r["turn"] for r in sorted(mine, key=lambda r: r["reply_order"])]
        assert ordered == brute_order({t: p for (c, t), p in parents.items() if c == conv})
    other = next(r for r in out if r["conv_id"] == 3)
    assert (other["quoted_conv"], other["quoted_turn"], other["parent_turn"], other["text"]) == (1, 4, None, "yes")
    assert quotes.build_conversations(df.limit(0)).count() == 0


def test_short_quotes_link_within_a_conversation(spark):
    rows = [(1, 0, "Why not?"), (1, 2, "Because it rains today."), (1, 4, "Let us wait then."), (1, 6, "> Why not?\nIt is late."),
            (2, 0, "> Why not?\nyes"), (2, 2, "> ?!\nno"), (2, 4, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, passages string, own int")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["quoted_conv"], r["quoted_turn"]) for r in quotes.build_conversations(df).collect()}
    assert got[1, 6] == (0, 1, 0)
    assert got[2, 0] == (None, None, None) and got[2, 2] == (0, None, None)


def test_long_threads_of_jumps(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(quotes, "stage", lambda df, name, inner=quotes.stage: staged.append(name) or inner(df, name))
    n = 64  # two threads, each message quotes the one before the last
    rows = [(1, t, f"say {t}" if t < 2 else f"> say {t - 2}\nsay {t}") for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    out = {r["turn"]: r for r in quotes.build_conversations(df).collect()}
    assert all(out[t]["parent_turn"] == t - 2 for t in range(2, n))
    assert [t for t in sorted(out, key=lambda t: out[t]["reply_order"])] == [0, 1, *range(3, n, 2), *range(2, n, 2)]
    assert len(staged) < 16


def test_a_line_of_marks():
    assert quotes.levels(">" * 300_000 + " x") == [(300_000, "x")]
    assert quotes.levels("> >\t> y\n   >z\n    >w") == [(3, "y"), (1, "z"), (0, "    >w")]


TALE = "<p>A whole story with many words in it, that goes on for a while. It says this and that.</p>" * 4


@pytest.mark.parametrize("page, ends", [
    ('<div class="content has-sidebar">{}</div>', True), ('<div class="story" data-id="promo-7">{}</div>', True),
    ('<div class="content sidebar">{}</div>', True), ('<div data-class="ad" id=main>{}</div>', True),
    ("<body><button>go {}", True), ("<body><select><option>a {}", True), ("<title>t <body>{}", True), ("<iframe>{}", True),
    ('<div class="comments">{}</div>', False), ('<div id="relatedPosts">{}</div>', False), ("<aside>{}</aside>", False), ("<script>{}", False),
])
def test_names_and_open_elements(page, ends):
    assert mincut.main_text(page.format(TALE)).endswith("this and that.") == ends


def test_pages_of_odd_shape():
    page = f"<article>{TALE}<ul><li>One item</li><li><a href=x>Two</a></li><li>Three more</li></ul>{TALE}</article>"
    assert "\nOne item\nTwo\nThree more\n" in mincut.main_text(page)
    assert mincut.main_text("A short line") == "A short line" and mincut.main_text("a < b and c") == "a < b and c"
    assert mincut.main_text(f"<article title='a > b'>{TALE}</article><a href=\"x").count("story") == 4


@pytest.mark.parametrize("unit", ["<a ", '<a href="x', "<button>", "<!--", "</section>", "<a \">'", "<![CDATA[", "<?"])
def test_tags_are_found_in_linear_time(unit):
    started = time.time()
    mincut.main_text(unit * ((1 << 20) // len(unit)))
    mincut.main_text("<div>" * 8000 + "</section>" * 8000 + "<ul>" + "<li>a" * 8000)
    assert time.time() - started < 20


def plain_blocks(html):
    """A second reading of well-formed pages: text between block tags outside of what is never content."""
    html = re.sub(r"(?is)<(script|style|nav|footer|aside|form)\b.*?</\1>|<!--.*?-->|<head\b.*?</head>", "\n", html)
    inner = re.search(r"(?is)<article\b[^>]*>(.*)</article>", html)
    parts = re.split(r"(?i)</?(?:p|h[1-6]|li|ul|div|section)\b[^>]*>", inner[1] if inner else "")
    return [x for x in (" ".join(unescape(re.sub(r"(?i)</?(?:b|a|i|em|span|strong)\b[^>]*>", "", re.sub(r"(?i)<br */?>", " ", x))).split()) for x in parts) if x]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_extraction_equals_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = [(mincut.main_text(p["html"]).split("\n"), plain_blocks(p["html"] or "")) for p in pages if "<article" in (p["html"] or "")]
    same = sum(a == b for a, b in got)
    assert same >= 0.9 * len(got) > 20
