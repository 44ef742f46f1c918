import random
import re
import string

import numpy as np
import pytest
import zstandard

from presswork.llm import bands


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    data = text.encode()

    def ratio(b):
        return len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b)) / len(b)

    def inside(b):
        low, high = next((low, high) for below, low, high in bands.BANDS if len(b) < below)
        return low <= ratio(b) <= high

    chunks = [data[i:i + 4096] for i in range(0, len(data), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    kept = not failed and inside(data) and sum(len(c) for c in chunks if not inside(c)) <= 0.25 * len(data)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed, kept


def prose(rnd, n):
    letters = "eeeetttaaooiinnsshhrrdlcumwfgypbvk"
    return " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n))


def texts():
    rnd = random.Random(2)
    noise = "".join(rnd.choices([chr(c) for c in range(0x4e00, 0x9000)], k=4000))
    yield from (None, "", " \n\t", "one", "a b a b a b", "x y \x0b z w", "#*$ %&|<> *" * 9, "é\n é\né \né\n\n\né")
    for n in (49, 50, 51, 120, 700, 3000):
        yield prose(rnd, n)
        yield "\n".join([prose(rnd, n // 4)] * 2 + [prose(rnd, n // 2)])
        yield prose(rnd, n) + " spam" * n
    yield prose(rnd, 60) + " " + " ".join(noise[i:i + 60] for i in range(0, 4000, 60))
    yield prose(rnd, 2500) + " " + " ".join(f"{i:07d}-row-of-a-table" for i in range(700)) + prose(rnd, 100)
    yield " ".join(prose(rnd, 30) for _ in range(20)) + "\r\n" + string.printable


def test_counts_and_verdicts_equal_brute_force(spark, monkeypatch):
    rows = [(i if i % 5 else None, t, "a", 1) for i, t in enumerate([*texts(), *list(texts())[:9]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)
    got = [tuple(r[c] for c in ("doc_id", *bands.COUNTS, "base_failed", "kept")) for r in bands.compression_bands(docs).collect()]
    want = [(i, *brute(t)) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {k for *_, k in want} == {True, False} and any(not f and not k for *_, f, k in want)
    assert bands.compression_bands(docs.limit(0)).count() == 0
    monkeypatch.setattr(bands, "SLICE", 7)
    for text in texts():
        assert bands.base_counts(text or "", (text or "").encode()) == brute(text)[:5]


def test_repetition_and_noise_go_and_prose_stays():
    rnd, ratios = random.Random(3), bands.Ratios()
    for n in (60, 200, 1000, 9000, 60_000):
        plain = prose(rnd, n).encode()
        assert ratios(plain)[4], n
        assert not ratios((prose(rnd, 12).encode() + b"\n") * (n // 12))[4]
        assert not ratios(np.random.default_rng(n).integers(0, 256, 6 * n, dtype=np.uint8).tobytes())[4]
        assert not ratios(plain + b" again and again" * n)[4]


@pytest.mark.parametrize("n", [1, 1023, 4096, 4097, 5119, 5120, 9000])
def test_chunks_cover_the_text(n):
    bounds = bands.chunk_bounds(n)
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_a_very_long_text():
    data = b"word " * 2_000_000 + b"x" * 5_000_000
    assert bands.base_counts(data.decode(), data)[:1] == (2_000_001,)
