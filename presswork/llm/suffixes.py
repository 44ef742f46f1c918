"""Removal of repeated substrings, block by block over a cover sample of the suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a
smaller key. Sorting all suffixes would move many times the corpus, so suffixes are
compared through a cover sample: positions such that two equal strings of ``LENGTH``
bytes hold a sampled position at the same offset. A positional difference cover that
leaves room for 20 sampled bytes takes 6 of 31 positions; here the cover is chosen by
content (all positions whose ``ANCHOR`` bytes have the least hash of some window),
which has the same property and takes 2 of 32.

Only equality is asked for, so the ranks are digests and suffixes are sorted by them,
not by their letters.

1. Each sampled suffix gets two ranks: its bucket order, a digest of its ``ANCHOR``
   bytes, and the rank of its long tie, a digest of all bytes that strings over the
   sample can reach. Copies within a batch are settled at once; only the smallest
   key's sample travels.
2. One bucket at a time is sorted by (order, tie rank). The number of buckets follows the
   size of the corpus, which bounds their memory unless one order has very many different
   ties: a line in a third of all documents, with other text around it in each, is one
   bucket. A sample whose tie rank an earlier document has is repeated as a whole.
3. What is left are samples of one order with different tie ranks, the ends of
   repeats; one stands for all of its text and tie rank, as in a run of one byte.
   Their surrounding bytes are fetched, and each string over them is
   compared. Orders with more than ``hot_ties`` different ties are dealt out by
   string, not by order.
4. Marks meet the texts again by document; texts are shuffled compressed.

Nothing of this is kept on the driver but the corpus size. All digests compared are
at least 88 bits wide within a bucket of bounded size.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import stage

LENGTH = 50
ANCHOR = 20
WINDOW = LENGTH - ANCHOR + 1
REACH = WINDOW - 1
#: Bytes hashed at a time, and the context that a cut of a longer text keeps on both sides.
SEGMENT = 1 << 19
PAD = 128
#: Bytes of text whose samples a worker holds at a time.
CHUNK = 4 << 20
NO_KEY = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, made once per worker."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            cls.up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
            cls.down = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class RangeHash:
    """Digests of any ranges of a buffer, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _Powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:len(data)], out=self.sums[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    n, out = 1, a
    while n * 2 <= width:
        out, n = pick(out[:-n], out[n:]), n * 2
    rest = width - n
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def sample(data: np.ndarray, ends: np.ndarray, first: int = 0, last: int | None = None):
    """(document, position, order, tie rank) of the sampled positions of texts that lie end to end.

    With ``first`` and ``last`` only strings that start in that range of a single text count.
    """
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return empty
    starts = np.concatenate([[0], ends[:-1]])
    ranges = RangeHash(data)
    order = mix((ranges.sums[ANCHOR:] - ranges.sums[:-ANCHOR]) * ranges.down[:len(data) - ANCHOR + 1]) | _U(1)
    least = _sliding(order, WINDOW, np.minimum)
    broken = np.zeros(len(data) + 1, np.int32)  # strings that cross the end of a text
    np.add.at(broken, np.maximum(ends - LENGTH + 1, starts), 1)
    np.add.at(broken, ends, -1)
    least[np.cumsum(broken)[:len(least)] > 0] = 0
    least[:first] = 0
    if last is not None:
        least[last:] = 0
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(order == _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)[:len(order)])
    doc = np.searchsorted(ends, at, side="right")
    low, high = np.maximum(starts[doc], at - REACH), np.minimum(ends[doc], at + LENGTH)
    tie = mix(ranges(low, high) + ((at - low) * 1_000_003 + (high - low) * 7_919).astype(np.uint64))
    return doc, at - starts[doc], order[at], tie


def sample_texts(data: np.ndarray, offsets: np.ndarray):
    """``sample`` over many texts, a segment at a time; texts longer than that in overlapping cuts."""
    parts, at, n = [], 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[stop])
        if high - low <= SEGMENT:
            doc, pos, order, tie = sample(data[low:high], offsets[at + 1:stop + 1] - low)
            parts.append((doc + at, pos, order, tie))
        else:
            found = []
            for cut in range(0, high - low, SEGMENT):
                a, b = max(0, cut - PAD), min(high - low, cut + SEGMENT + PAD)
                _, pos, order, tie = sample(data[low + a:low + b], np.array([b - a]), cut - a, cut - a + SEGMENT)
                found.append((pos + a, order, tie))
            pos, order, tie = (np.concatenate(x) for x in zip(*found))
            pos, once = np.unique(pos, return_index=True)
            parts.append((np.full(len(pos), at), pos, order[once], tie[once]))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else sample(np.empty(0, np.uint8), np.empty(0, np.int64))


# ---- payloads ---------------------------------------------------------------------
def _packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _runs(ids: np.ndarray, rows: np.ndarray):
    """Consecutive equal (id, row) as (ids, rows, lengths)."""
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])) if len(ids) else np.empty(0, int)
    return ids[new], rows[new], np.diff(np.append(new, len(ids))).astype(np.int32)


def _marks(home: int, ids, rows, pos, strings, like: bool = False) -> Iterator[tuple[int, bytes]]:
    """Marks by the place where their texts will be; ``strings``: bits of the repeated strings, all bits for a whole reach.

    With ``like``, strings are positions of the same text: what is marked there is marked at ``pos``.
    """
    place = (rows.view(np.uint64) % _U(home)).astype(np.int64)
    order = np.lexsort((pos, rows, ids, place))
    bounds = np.searchsorted(place[order], np.arange(home + 1))
    for t in range(home):
        own = order[bounds[t]:bounds[t + 1]]
        if len(own):
            yield t, _packed(*_runs(ids[own], rows[own]), pos[own].astype(np.uint32), strings[own], *[True] * like)


WHOLE = np.uint32((1 << WINDOW) - 1)


def _dealt(keys, buckets: int):
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(buckets + 1))
    return [(b, order[bounds[b]:bounds[b + 1]]) for b in range(buckets) if bounds[b + 1] > bounds[b]]


_SENT = "bucket int, place int, payload binary"


def _rows(sent: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, places, payloads = zip(*sent)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(places, pa.int32()), pa.array(payloads, pa.binary())],
        ["bucket", "place", "payload"])


def _send_samples(buckets: int, home: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _bytes_of(batch.column(2))
            doc, pos, order, tie = sample_texts(data, offsets)
            if not len(doc):
                continue
            sort = np.lexsort((tie, order))
            doc, pos, order, tie = doc[sort], pos[sort], order[sort], tie[sort]
            start = np.flatnonzero(np.concatenate([[True], (order[1:] != order[:-1]) | (tie[1:] != tie[:-1])]))
            lowest = np.repeat(np.minimum.reduceat(ids[doc], start), np.diff(np.append(start, len(doc))))
            late = ids[doc] > lowest
            sent = []
            if late.any():
                marks = _marks(home, ids[doc[late]], rows[doc[late]], pos[late], np.full(late.sum(), WHOLE))
                sent += [(t % buckets, t, payload) for t, payload in marks]
            doc, pos, order, tie = doc[~late], pos[~late], order[~late], tie[~late]
            for b, own in _dealt((order % _U(buckets)).astype(np.int64), buckets):
                own = own[np.lexsort((pos[own], doc[own]))]
                rest = order[own] // _U(buckets)
                sent.append((b, -1, _packed(
                    *_runs(ids[doc[own]], rows[doc[own]]), pos[own].astype(np.uint32),
                    rest.astype(np.uint32), (rest >> _U(32)).astype(np.uint8),
                    tie[own].astype(np.uint32), (tie[own] >> _U(32)).astype(np.uint16))))
            yield _rows(sent)

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about CHUNK bytes of text, or of one text."""
    for batch in batches:
        offsets, low = _bytes_of(batch.column(2))[1], 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple[int, bytes]]]]:
    """One bucket at a time: its payloads, and the rows that only pass through."""
    bucket, held, through = None, [], []
    for batch in batches:
        for row in range(batch.num_rows):
            b, place, payload = (batch.column(i)[row].as_py() for i in range(3))
            if b != bucket:
                if bucket is not None:
                    yield bucket, held, through
                bucket, held, through = b, [], []
            if place < 0:
                held.append(payload)
            else:
                through.append((place, payload))
    if bucket is not None:
        yield bucket, held, through


def _sort_bucket(buckets: int, home: int, hot_ties: int):
    """Marks of samples that are repeated as a whole, and the samples that need a closer look."""
    schema = ["place", "marks", "ties"]

    def out(rows):
        places, marks, ties = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(marks, pa.binary()), pa.array(ties, pa.binary())], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, payloads, through in _by_bucket(batches):
            rows = [(place, payload, None) for place, payload in through]
            if payloads:
                parts = []
                while payloads:
                    parts.append(_unpacked(payloads.pop()))
                ids, keys, n, pos, o1, o2, t1, t2 = (np.concatenate(x) for x in zip(*parts))
                del parts
                ids, keys = np.repeat(ids, n), np.repeat(keys, n)
                order = o1.astype(np.uint64) | o2.astype(np.uint64) << _U(32)
                tie = t1.astype(np.uint64) | t2.astype(np.uint64) << _U(32)
                del o1, o2, t1, t2
                sort = np.lexsort((tie, order))
                order, tie = order[sort], tie[sort]
                fresh = np.concatenate([[True], order[1:] != order[:-1]])
                new = fresh | np.concatenate([[True], tie[1:] != tie[:-1]])
                start = np.flatnonzero(new)
                sizes = np.diff(np.append(start, len(order)))
                late = ids[sort] > np.repeat(np.minimum.reduceat(ids[sort], start), sizes)
                heads = np.flatnonzero(fresh)
                ties = np.repeat(np.add.reduceat(new.astype(np.int64), heads), np.diff(np.append(heads, len(order))))
                whole = sort[late]
                rows += [(t, payload, None) for t, payload in _marks(home, ids[whole], keys[whole], pos[whole], np.full(len(whole), WHOLE))]
                near = ~late & (ties > 1)
                look, near = sort[near], np.flatnonzero(near)
                # one sample stands for all of its order, tie rank and text, as in a run of one byte
                group = np.lexsort((pos[look], keys[look], ids[look], start.searchsorted(near, side="right")))
                look, near = look[group], near[group]
                rank = start.searchsorted(near, side="right")
                first = np.ones(len(look), bool)
                first[1:] = (rank[1:] != rank[:-1]) | (ids[look][1:] != ids[look][:-1]) | (keys[look][1:] != keys[look][:-1])
                like = pos[look[first]][np.cumsum(first) - 1]
                rows += [(t, payload, None) for t, payload in _marks(
                    home, ids[look[~first]], keys[look[~first]], pos[look[~first]], like[~first], True)]
                look, near = look[first], near[first]
                named = mix(order[near] * _U(buckets) + _U(bucket))
                hot = ties[near] > hot_ties
                for t, own in _dealt((keys[look].view(np.uint64) % _U(home)).astype(np.int64), home):
                    at = look[own]
                    rows.append((t, None, _packed(ids[at], keys[at], pos[at], named[own], hot[own])))
            for low in range(0, len(rows), 256):
                yield out(rows[low:low + 256])

    return run


def _send_texts(home: int):
    """Rows of every batch by place, as compressed Arrow streams with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for batch in batches:
            place = (batch.column(1).to_numpy().view(np.uint64) % _U(home)).astype(np.int64)
            for t, own in _dealt(place, home):
                part = batch.take(pa.array(own))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["place", "texts"])

    return run


def _texts(column: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for stream in column:
        yield from pa.ipc.open_stream(stream.as_buffer())


def _look(text: np.ndarray, pos: np.ndarray):
    """(bytes left, bytes right, matrix of the bytes a string over each sample can reach)."""
    left, right = np.minimum(pos, REACH), np.minimum(len(text) - pos, LENGTH)
    padded = np.concatenate([np.zeros(REACH, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    around = np.empty((len(pos), REACH + LENGTH), np.uint8)
    for low in range(0, len(pos), TIES):
        around[low:low + TIES] = padded[pos[low:low + TIES, None] + np.arange(REACH + LENGTH)[None, :]]
    return left, right, around


def string_digests(around: np.ndarray, left: np.ndarray, right: np.ndarray):
    """For x up to REACH: (which rows have a whole string that starts x bytes before the sample, its digest)."""
    up, down = _Powers.of(REACH + LENGTH + 1)
    sums = np.zeros((len(around), REACH + LENGTH + 1), np.uint64)
    np.cumsum(_TABLE[around] * up[:REACH + LENGTH][None, :], axis=1, out=sums[:, 1:])
    for x in range(WINDOW):
        low = REACH - x
        yield x, (left >= x) & (right >= LENGTH - x), mix((sums[:, low + LENGTH] - sums[:, low]) * down[low])


def _send_ties(spread: int, home: int):
    def run(texts: pa.Table, ties: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in ties.column("ties").to_pylist() if x is not None]
        if not parts or not texts.num_rows:
            return _rows([(0, 0, b"")]).slice(1)
        ids, keys, pos, named, hot = (np.concatenate(x) for x in zip(*parts))
        sort = np.lexsort((pos, keys, ids))
        ids, keys, pos, named, hot = ids[sort], keys[sort], pos[sort].astype(np.int64), named[sort], hot[sort]
        run_ids, run_keys, run_n = _runs(ids, keys)
        where = {(i, k): (e - n, e) for i, k, n, e in zip(run_ids.tolist(), run_keys.tolist(), run_n.tolist(), np.cumsum(run_n).tolist())}
        found, sent = [], []
        for batch in _texts(texts.column("texts")):
            data, offsets = _bytes_of(batch.column(2))
            for d, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if own in where:
                    low, high = where.pop(own)
                    found.append((np.arange(low, high), *_look(data[offsets[d]:offsets[d + 1]], pos[low:high])))
        at, left, right, around = (np.concatenate(x) for x in zip(*found))
        cold = np.flatnonzero(~hot[at])
        for g, own in _dealt((named[at[cold]] % _U(spread)).astype(np.int64), spread):
            own = cold[own]
            sent.append((g, -1, _packed(
                True, ids[at[own]], keys[at[own]], pos[at[own]].astype(np.uint32), named[at[own]],
                left[own].astype(np.uint8), right[own].astype(np.uint8), around[own])))
        every = np.flatnonzero(hot[at])
        for low in range(0, len(every), TIES):
            warm = every[low:low + TIES]
            held = [[] for _ in range(5)]
            late = np.zeros(len(warm), np.uint32)
            for x, there, digest in string_digests(around[warm], left[warm], right[warm]):
                own = np.flatnonzero(there)
                if not len(own):
                    continue
                string = mix(digest[own] + named[at[warm[own]]] * _U(2 * x + 1))
                repeated = _later(string, ids[at[warm[own]]])
                late[own[repeated]] |= np.uint32(1 << x)
                own, string = own[~repeated], string[~repeated]
                for part, value in zip(held, (string, ids[at[warm[own]]], keys[at[warm[own]]], pos[at[warm[own]]], np.full(len(own), 1 << x, np.uint32))):
                    part.append(value)
            string, i, k, p, bit = (np.concatenate(x) for x in held)
            for g, own in _dealt((string % _U(spread)).astype(np.int64), spread):
                sent.append((g, -1, _packed(False, string[own], i[own], k[own], p[own], bit[own])))
            own = np.flatnonzero(late)
            sent += [(t % spread, t, payload) for t, payload in _marks(
                home, ids[at[warm[own]]], keys[at[warm[own]]], pos[at[warm[own]]], late[own])]
        return pa.Table.from_batches([_rows(sent)])

    return run


def _later(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries share their key with a smaller id."""
    if not len(key):
        return np.zeros(0, bool)
    sort = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], key[sort][1:] != key[sort][:-1]]))
    lowest = np.repeat(np.minimum.reduceat(ids[sort], start), np.diff(np.append(start, len(key))))
    late = np.zeros(len(key), bool)
    late[sort] = ids[sort] > lowest
    return late


#: Samples whose strings are digested at a time.
TIES = 1 << 15


def _compare_ties(home: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, payloads, through in _by_bucket(batches):
            rows = [(0, place, payload) for place, payload in through]
            parts = [_unpacked(x) for x in payloads]
            cold = [x[1:] for x in parts if x[0]]
            if cold:
                ids, keys, pos, named, left, right, around = (np.concatenate(x) for x in zip(*cold))
                sort = np.argsort(named, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], named[sort][1:] != named[sort][:-1]]))
                low = 0
                while low < len(sort):
                    k = np.searchsorted(heads, low + TIES, side="right") - 1
                    high = int(heads[k]) if heads[k] > low else int(heads[k + 1]) if k + 1 < len(heads) else len(sort)
                    high = len(sort) if len(sort) - low <= TIES else high
                    own = sort[low:high]
                    bits = np.zeros(len(own), np.uint32)
                    for x, there, digest in string_digests(around[own], left[own], right[own]):
                        there = np.flatnonzero(there)
                        bits[there[_later(mix(digest[there] + named[own[there]]), ids[own[there]])]] |= np.uint32(1 << x)
                    hit = np.flatnonzero(bits)
                    rows += [(0, t, payload) for t, payload in _marks(home, ids[own[hit]], keys[own[hit]], pos[own[hit]], bits[hit])]
                    low = high
            hot = [x[1:] for x in parts if not x[0]]
            if hot:
                string, ids, keys, pos, bit = (np.concatenate(x) for x in zip(*hot))
                hit = _later(string, ids)
                rows += [(0, t, payload) for t, payload in _marks(home, ids[hit], keys[hit], pos[hit], bit[hit])]
            if rows:
                yield _rows(rows).select(["place", "payload"])

    return run


def _by_text(parts: list[tuple]):
    """Ids, keys, positions and strings of marks in the order of texts, and where each text has its own."""
    ids, keys, n, pos, strings = (np.concatenate(x) for x in zip(*[x[:5] for x in parts]))
    ids, keys = np.repeat(ids, n), np.repeat(keys, n)
    sort = np.lexsort((keys, ids))
    ids, keys, pos, strings = ids[sort], keys[sort], pos[sort].astype(np.int64), strings[sort]
    run_ids, run_keys, run_n = _runs(ids, keys)
    where = {(i, k): (e - m, e) for i, k, m, e in zip(run_ids.tolist(), run_keys.tolist(), run_n.tolist(), np.cumsum(run_n).tolist())}
    return pos, strings, where


def _alike(pos: np.ndarray, strings: np.ndarray, others: np.ndarray, like: np.ndarray):
    """Marks with those of ``like`` also at ``others``."""
    marked, place = np.unique(pos, return_inverse=True)
    bits = np.zeros(len(marked), np.uint32)
    np.bitwise_or.at(bits, place, strings)
    at = np.minimum(np.searchsorted(marked, like), len(marked) - 1)
    hit = marked[at] == like
    return np.concatenate([pos, others[hit]]), np.concatenate([strings, bits[at[hit]]])


def removed(n: int, pos: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which of n bytes the marks cover."""
    edges = np.zeros(n + 1, np.int64)
    whole = strings == WHOLE
    p = pos[whole]
    np.add.at(edges, np.maximum(p - REACH, 0), 1)
    np.add.at(edges, np.minimum(p + LENGTH, n), -1)
    for x in range(WINDOW if not whole.all() else 0):
        p = pos[~whole & (strings >> np.uint32(x) & np.uint32(1) == 1)] - x
        np.add.at(edges, p, 1)
        np.add.at(edges, p + LENGTH, -1)
    return np.cumsum(edges[:n]) > 0


def _finish(names: list[str], schema: pa.Schema, keep: str | None):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in marks.column("payload").to_pylist()]
        plain, alike = [x for x in parts if len(x) == 5], [x for x in parts if len(x) == 6]
        pos, strings, where = _by_text(plain) if plain else (None, None, {})
        others, like, also = _by_text(alike) if alike else (None, None, {})
        done = []
        for batch in _texts(texts.column("texts")):
            data, offsets = _bytes_of(batch.column(2))
            columns: list[list] = [[] for _ in range(5)]
            for d, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = data[offsets[d]:offsets[d + 1]]
                gone = np.zeros(len(text), bool)
                if own in where:
                    low, high = where[own]
                    marked, bits = pos[low:high], strings[low:high]
                    if own in also:
                        low, high = also[own]
                        marked, bits = _alike(marked, bits, others[low:high], like[low:high].astype(np.int64))
                    gone = removed(len(text), marked, bits)
                kept = text[~gone].tobytes()
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                told = [len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()]
                if keep:
                    told.append(kept if keep == "bytes" else kept.decode("utf-8", "ignore"))
                for column, value in zip(columns, told):
                    column.append(value)
            arrays = [batch.column(i) for i in range(3, batch.num_columns)]
            done.append(pa.RecordBatch.from_arrays([*arrays, *map(pa.array, columns[:5 if keep else 4])], names))
        return pa.Table.from_batches(done).cast(schema) if done else schema.empty_table()

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 12 << 20,
    place_bytes: int = 12 << 20, hot_ties: int = 1 << 17, keep: str | None = "bytes",
) -> DataFrame:
    """Every row of ``docs``, its text replaced by what is kept of it, and what was removed.

    New columns: n_bytes, n_removed, n_spans (long), kept_sha256, and ``kept``: binary
    for keep="bytes", for keep="text" a string without the bytes that are no whole
    character any more; with keep=None it is left out. A null text is empty; texts under ``LENGTH`` bytes lose nothing. Rows with equal keys do not
    remove from each other; a null key counts as larger than any other. Columns of
    the input with these names are replaced. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    if keep:
        new["kept"] = {"bytes": "binary", "text": "string"}[keep]
    others = [c for c in docs.columns if c not in (text, *new)]
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    rows = docs.select(id_.alias("__id"), F.xxhash64(F.col(key), F.col(text)).alias("__row"), body.alias("__body"), *others)
    slim = rows.select("__id", "__row", "__body")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, home = -(-total // bucket_bytes) or 1, -(-total // place_bytes) or 1

    sent = slim.mapInArrow(_send_samples(buckets, home), _SENT)
    sorted_ = stage(
        sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_sort_bucket(buckets, home, hot_ties), "place int, marks binary, ties binary"), "suffix-marks")
    ties = sorted_.where(F.col("ties").isNotNull()).select("place", "ties")
    texts = slim.mapInArrow(_send_texts(home), "place int, texts binary")
    ends = stage(
        texts.groupBy("place").cogroup(ties.groupBy("place")).applyInArrow(_send_ties(buckets, home), _SENT)
        .repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_compare_ties(home), "place int, payload binary"), "suffix-ends")
    marks = sorted_.where(F.col("marks").isNotNull()).select("place", F.col("marks").alias("payload")).union(ends)
    kinds = docs.select(*others).schema
    for name, kind in new.items():
        kinds = kinds.add(name, kind)
    whole = rows.mapInArrow(_send_texts(home), "place int, texts binary")
    return whole.groupBy("place").cogroup(marks.groupBy("place")).applyInArrow(
        _finish([*others, *new], to_arrow_schema(kinds), keep), kinds)
