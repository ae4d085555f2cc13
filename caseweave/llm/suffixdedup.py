"""Suffix-array dedup of byte strings by bucket-pointer refinement.

A byte goes if a SPAN-byte string over it also starts in a document with a smaller id. Every SPAN-byte window of a text
belongs to the GRAM-byte string in it with the smallest hash, so equal windows belong to equal grams, and windows next
to each other that share their gram are a run. The bytes of a run's windows are its context.

Documents are bound into slices of a few MB, compressed and numbered, so that a document is a place in a slice.

1. Runs are dealt into buckets by the hash of their gram, as hashes and places only. A gram that no other document has
   can't repeat; the runs of all others are asked for. This is a filter: it decides no byte.
2. The contexts asked for are fetched from the slices and dealt into buckets by their gram. In each, suffixes fall into
   buckets by their first 8 bytes, which are refined by sorting on the bucket identifiers of later offsets: 8 and 8 give
   16, 16 and 16 give 32, 32 and 32 shifted by 18 give all 50 bytes. A suffix alone in its bucket is unique and drops
   out. Suffixes that share the last bucket are equal byte by byte; those whose document isn't the first are repeats.

Copies inside one slice needn't travel: a run whose bytes equal those of a smaller id's run in the slice, which is looked
up byte by byte, is covered at once, so a passage in a third of all documents is a context a slice. A gram with more than
HOT contexts all the same isn't gathered in a task: its windows are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_last, scratch, text_bytes

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Text of a slice; windows of a run at most.
SLICE_BYTES, RUN = 4 << 20, 64
#: Text whose runs a bucket is meant for; contexts a bucket is meant for; contexts of one gram in a task at most.
BUCKET_BYTES, BUCKET_CONTEXTS, HOT = 4 << 20, 20_000, 50_000
#: Runs that a task holds before it drops what is settled.
CHUNK = 200_000
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _slide(a: np.ndarray, w: int) -> np.ndarray:
    """The least of every window of w values, by doubling."""
    out, have = a, 1
    while have * 2 <= w:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    n = len(a) - w + 1
    return out[:n] if have == w else np.minimum(out[:n], out[w - have : w - have + n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, first byte in it, windows, gram hash and context hash of every run; each window stands in one run."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    power, back = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    least = _slide(_mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1]), WINDOW)
    m = len(least)
    # No window crosses the end of a text.
    cut = np.zeros(m + 1, np.int8)
    np.add.at(cut, np.clip(ends - SPAN + 1, np.concatenate([[0], ends[:-1]]), m), 1)
    np.add.at(cut, np.minimum(ends, m), -1)
    whole = np.cumsum(cut[:m]) == 0
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    new[np.minimum(ends[ends < m], m - 1)] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, m))
    first, count = first[whole[first]], count[whole[first]]
    # Long runs, of texts that repeat themselves, are cut.
    parts = -(-count // RUN)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + turn * RUN
    count = np.minimum(np.repeat(count, parts) - turn * RUN, RUN)
    text = np.searchsorted(ends, first, "right")
    context = _mix((total[first + count + SPAN - 1] - total[first]) * back[first] + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return text, first - (ends - sizes)[text], count, least[first], context


def _press(columns: list[tuple[np.ndarray, int]], tail: bytes = b"") -> bytes:
    """Columns of numbers, so many low bytes of each, and a tail, compressed; all first bytes stand first, then all second ones."""
    n = len(columns[0][0])
    parts = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for c, size in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([n], "<u4").tobytes(), *parts, tail]))


def _open(blob: bytes, sizes: list[int]) -> tuple[list[np.ndarray], memoryview]:
    view = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n, at, out = int(np.frombuffer(view, "<u4", 1)[0]), 4, []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(view, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view("<i8").reshape(-1))
        at += n * size
    return out, view[at:]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours; numpy.cumsum undoes it."""
    return np.diff(x, prepend=0)


def _bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to slices: ids and sizes of the texts, and their bytes one after the other, compressed."""

    def slice_(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        known = _press([(np.array(ids, np.int64), 8), (np.fromiter(map(len, texts), np.int64, len(texts)), 4)])
        z = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([known], pa.binary()), pa.array([z], pa.binary())], ["docs", "z"])

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if ids and held + len(text) > SLICE_BYTES:
                yield slice_(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(text)
            held += len(text)
    if ids:
        yield slice_(ids, texts)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """Number, ids, ends of the texts, and bytes of each slice."""
    for k in range(batch.num_rows):
        (ids, sizes), _ = _open(batch.column("docs")[k].as_py(), [8, 4])
        yield k, ids, np.cumsum(sizes), zstandard.ZstdDecompressor().decompress(batch.column("z")[k].as_py())


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes from a and from b are equal, pair by pair."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        own = slice(k, k + (1 << 15))
        at = np.minimum(np.arange(RUN + SPAN - 1), (size[own] - 1)[:, None])
        out[own] = (data[a[own, None] + at] == data[b[own, None] + at]).all(axis=1)
    return out


COVER, ASK, HOTTEST = 1, 2, 3
_STEP = "kind int, bucket int, slice long, n long, data binary"


def _step(kind: int, bucket, number, n, data: list[bytes]) -> pa.RecordBatch:
    wide = [np.broadcast_to(np.asarray(x, np.int64), len(data)) for x in (kind, bucket, number, n)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([*[pa.array(x).cast(k) for x, k in zip(wide, kinds, strict=True)], pa.array(data, pa.binary())], ["kind", "bucket", "slice", "n", "data"])


def _intervals(start: np.ndarray, stop: np.ndarray) -> bytes:
    """Intervals as bytes, those that touch joined."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    start, stop = start[new], np.append(reach[new[1:] - 1], reach[-1])
    return _press([(_steps(start), 4), (stop - start, 4)])


def _deal(buckets: int):
    """Slices to packed runs by bucket (kind 0), and to bytes that are covered inside a slice."""

    def pieces(ends: np.ndarray, text: bytes) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Document, place and bytes of pieces, about SLICE_BYTES at a time. Pieces of a long text overlap."""
        docs, places, parts, held = [], [], [], 0
        for doc, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            for at in range(a, max(a + 1, b - SPAN + 1), SLICE_BYTES):
                parts.append(text[at : min(b, at + SLICE_BYTES + SPAN - 1)])
                docs.append(doc)
                places.append(at)
                held += len(parts[-1])
                if held >= SLICE_BYTES:
                    yield docs, places, parts
                    docs, places, parts, held = [], [], [], 0
        if parts:
            yield docs, places, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, ids, ends, text in _slices(batch):
                for docs, places, parts in pieces(ends, text):
                    yield from deal(batch.column("slice")[k].as_py(), ids, np.frombuffer(text, np.uint8), np.array(docs), np.array(places), parts)

    def deal(number: int, ids: np.ndarray, data: np.ndarray, docs: np.ndarray, places: np.ndarray, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        piece, place, count, gram, context = runs(parts)
        if not len(piece):
            return
        doc, at = docs[piece], places[piece] + place
        order = np.lexsort((ids[doc], context, gram))
        doc, at, count, gram, context = (x[order] for x in (doc, at, count, gram, context))
        alike = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
        head = np.flatnonzero(alike)[np.cumsum(alike) - 1]
        later = np.flatnonzero((ids[doc] > ids[doc[head]]) & (count == count[head]))
        covered = np.zeros(len(doc), bool)
        covered[later] = _same_bytes(data, at[later], at[head[later]], count[later] + SPAN - 1)
        if covered.any():
            yield _step(COVER, number % buckets, number, 0, [_intervals(at[covered], (at + count)[covered] + SPAN - 1)])
        doc, at, count, gram = (x[~covered] for x in (doc, at, count, gram))
        bucket = ((gram >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((at, bucket))
        doc, at, count, gram, bucket = (x[order] for x in (doc, at, count, gram, bucket))
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = [*cuts[1:].tolist(), len(doc)]
        own = [slice(a, b) for a, b in zip(cuts.tolist(), ends, strict=True)]
        yield _step(0, bucket[cuts], number, np.diff([*cuts, len(doc)]), [_press([(_steps(doc[o]), 4), (_steps(at[o]), 4), (count[o], 1), (gram[o], 4)]) for o in own])

    return run


def _ask(hot: int):
    """Buckets of runs, one after the other, to the runs whose gram stands in two documents, by slice.

    A bucket streams through: what stays in memory is a run of each gram met once, and the grams met twice.
    """

    def settle(bucket: int, held: list[tuple[int, bytes]], state: dict) -> Iterator[pa.RecordBatch]:
        rows = [state["waiting"]]
        for number, blob in held:
            (doc, at, count, gram), _ = _open(blob, [4, 4, 1, 4])
            rows.append(np.stack([np.full(len(doc), number), np.cumsum(doc.astype(np.int32)), np.cumsum(at), count, gram]))
        number, doc, at, count, gram = rows = np.concatenate(rows, axis=1)
        rows = rows[:, np.lexsort((at, number, gram))]
        number, doc, at, count, gram = rows
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        first = np.flatnonzero(new)
        other = ~new
        other[1:] &= (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
        size = np.diff(np.append(first, len(gram)))
        known = np.isin(gram[first], state["twice"], assume_unique=True)
        twice = known | np.logical_or.reduceat(other, first)
        grams = np.concatenate([state["twice"], gram[first][twice & ~known]])
        met = np.concatenate([state["met"], np.zeros(len(grams) - len(state["met"]), np.int64)])
        order = np.argsort(grams)
        state["twice"], state["met"] = grams[order], met[order]
        state["met"][np.searchsorted(state["twice"], gram[first][twice])] += size[twice]
        asked = np.repeat(twice, size)
        state["waiting"] = rows[:, ~asked]
        rows = rows[:, asked]
        rows = rows[:, np.lexsort((rows[2], rows[0]))]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(rows[0]) != 0])) if rows.shape[1] else []
        parts = np.split(rows, cuts[1:], axis=1) if len(cuts) else []
        if parts:
            yield _step(ASK, bucket, [p[0, 0] for p in parts], [p.shape[1] for p in parts], [_press([(_steps(p[1]), 4), (_steps(p[2]), 4), (p[3], 1), (p[4], 4)]) for p in parts])

    def end(bucket: int, state: dict) -> Iterator[pa.RecordBatch]:
        crowded = state["twice"][state["met"] > hot]
        if len(crowded):
            yield _step(HOTTEST, bucket, 0, len(crowded), [_press([(crowded, 4)])])

    def fresh() -> dict:
        none = np.zeros(0, np.int64)
        return {"twice": none, "met": none, "waiting": np.zeros((5, 0), np.int64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, held, size = fresh(), None, [], 0
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds > 0).any():
                yield batch.filter(pa.array(kinds > 0))
            for i in np.flatnonzero(kinds == 0).tolist():
                bucket = batch.column("bucket")[i].as_py()
                if now is not None and bucket != now:
                    if held:
                        yield from settle(now, held, state)
                    yield from end(now, state)
                    state, held, size = fresh(), [], 0
                now = bucket
                held.append((batch.column("slice")[i].as_py(), batch.column("data")[i].as_py()))
                size += batch.column("n")[i].as_py()
                if size >= CHUNK:
                    yield from settle(now, held, state)
                    held, size = [], 0
        if held:
            yield from settle(now, held, state)
        if now is not None:
            yield from end(now, state)

    return run


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray]]:
    """Number, ids of the documents, bytes of each slice, and what it is asked for: document, place, windows, gram and whether that is crowded."""
    for k, ids, _, text in _slices(batch):
        rows = []
        for ask in batch.column("asks")[k].as_py():
            (doc, at, count, gram), _ = _open(ask["data"], [4, 4, 1, 4])
            crowded = _open(ask["crowded"], [4])[0][0] if ask["crowded"] else np.zeros(0, np.int64)
            rows.append(np.stack([np.cumsum(doc.astype(np.int32)), np.cumsum(at), count, gram | (ask["bucket"] << 32), np.isin(gram, crowded)]))
        yield batch.column("slice")[k].as_py(), ids, text, np.concatenate(rows, axis=1)


def _contexts(parts: int):
    """Packed contexts by bucket, but for those of crowded grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, text, rows in _asked(batch):
                doc, at, count, gram, _ = rows[:, rows[4] == 0]
                if not len(doc):
                    continue
                bucket = (_mix(gram.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((at, bucket))
                doc, at, count, bucket = doc[order], at[order], count[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0]))
                bounds, blobs = [*cuts.tolist(), len(doc)], []
                spans = list(zip(at.tolist(), (at + count + SPAN - 1).tolist(), strict=True))
                for a, b in zip(bounds, bounds[1:], strict=False):
                    blobs.append(_press([(_steps(ids[doc[a:b]]), 8), (_steps(at[a:b]), 4), (count[a:b], 1)], b"".join([text[i:j] for i, j in spans[a:b]])))
                wide = np.full(len(blobs), number)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(wide), pa.array(blobs, pa.binary())], ["bucket", "slice", "data"])

    return run


def _crowded_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of crowded grams, one a row."""
    for batch in batches:
        for number, ids, text, rows in _asked(batch):
            doc, at, count, _, _ = rows[:, rows[4] == 1]
            start = np.repeat(at, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            own = np.repeat(ids[doc], count)
            for k in range(0, len(start), 1 << 16):
                a = start[k : k + (1 << 16)]
                columns = [pa.array(np.full(len(a), number)), pa.array(own[k : k + (1 << 16)]), pa.array(a), pa.array([text[i : i + SPAN] for i in a.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "_id", "start", "w"])


def refine(contexts: bytes, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset in it) of each SPAN-byte suffix that also starts in a context of a smaller id.

    ``contexts`` has the contexts one after the other, ``sizes`` their bytes and ``ids`` their documents' ids.
    """
    n = len(contexts)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)  # bytes to the end of its context
    wide = np.concatenate([np.frombuffer(contexts, np.uint8), np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    at, bucket = np.flatnonzero(left >= 8), np.full(n + SPAN, -1, np.int32)
    key = key[at]
    for have, shift in ((8, 8), (16, 16), (32, SPAN - 32), (SPAN, 0)):
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        bucket[:] = -1
        several = count[number] > 1
        bucket[at[several]] = number[several]
        if have == SPAN:
            break
        at = np.flatnonzero((left >= have + shift) & (bucket[:n] >= 0) & (bucket[shift : shift + n] >= 0))
        key = (bucket[at].astype(np.uint64) << np.uint64(32)) | bucket[at + shift].astype(np.uint64)
    at = np.flatnonzero(bucket >= 0)
    if not len(at):
        return at, at
    at = at[np.argsort(bucket[at], kind="stable")]
    own, number = ids[owner[at]], bucket[at]
    new = np.concatenate([[True], number[1:] != number[:-1]])
    repeat = np.sort(at[own > np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]])
    return owner[repeat].astype(np.int64), repeat - (ends - sizes)[owner[repeat]]


_SPANS = "slice long, data binary"


def _spans(number: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Intervals of each slice."""
    order = np.argsort(number, kind="stable")
    number, start, stop = number[order], start[order], stop[order]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0])) if len(number) else np.zeros(0, np.int64)
    bounds = [*cuts.tolist(), len(number)]
    data = [_intervals(start[a:b], stop[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] if len(cuts) else []
    return pa.RecordBatch.from_arrays([pa.array(number[cuts]), pa.array(data, pa.binary())], ["slice", "data"])


def _refine_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def settle(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows, texts = [], []
        for number, blob in held:
            (ids, at, count), text = _open(blob, [8, 4, 1])
            rows.append(np.stack([np.full(len(ids), number), np.cumsum(ids), np.cumsum(at), count]))
            texts.append(text)
        number, ids, at, count = np.concatenate(rows, axis=1)
        context, offset = refine(b"".join(texts), count + SPAN - 1, ids)
        new = np.ones(len(context), bool)
        new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(context))[: len(first)] - 1
        c = context[first]
        return _spans(number[c], at[c] + offset[first], at[c] + offset[last] + SPAN)

    held, now = [], None
    for batch in batches:
        for bucket, number, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "data")), strict=True):
            if bucket != now and held:
                yield settle(held)
                held = []
            now = bucket
            held.append((number, data))
    if held:
        yield settle(held)


def _crowded_repeats(windows: DataFrame) -> DataFrame:
    """Repeats among the windows of crowded grams: grouped by their bytes, the smallest id is the first."""
    least = windows.groupBy("w").agg(F.min("_id").alias("first"))
    return windows.join(least, "w").where(F.col("_id") > F.col("first")).select("slice", "start").mapInArrow(_window_spans, _SPANS)


def _window_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = batch.column("start").to_numpy()
        yield _spans(batch.column("slice").to_numpy(), start, start + SPAN)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices and their spans to documents without the covered bytes."""
    for batch in batches:
        for k, ids, ends, text in _slices(batch):
            spans = [_open(s, [4, 4])[0] for s in batch.column("spans")[k].as_py() or []]
            a = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(s[0]) for s in spans]])
            b = a + np.concatenate([np.zeros(0, np.int64), *[s[1] for s in spans]])
            if len(a):
                (a, b), _ = _open(_intervals(a, b), [4, 4])
                a = np.cumsum(a)
                b = a + b
                # Runs of removed bytes end with their document.
                edges = ends[np.searchsorted(ends, a, "right")] < b
                while edges.any():
                    split = ends[np.searchsorted(ends, a[edges], "right")]
                    a, b = np.concatenate([a[~edges], a[edges], split]), np.concatenate([b[~edges], split, b[edges]])
                    order = np.argsort(a)
                    a, b = a[order], b[order]
                    edges = ends[np.searchsorted(ends, a, "right")] < b
            out, starts = [], [0, *ends[:-1].tolist()]
            lows, highs = np.searchsorted(a, starts), np.searchsorted(a, ends)
            for low, high, i, j in zip(lows.tolist(), highs.tolist(), starts, ends.tolist(), strict=True):
                x, y = a[low:high].tolist(), b[low:high].tolist()
                kept = b"".join(text[p:q] for p, q in zip([i, *y], [*x, j], strict=True))
                out.append((j - i, j - i - len(kept), len(x), kept))
            n, removed, count, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary).

    Null text is empty. Rows with equal ids never cover each other; null ids stand last and don't cover each other.
    Repeated rows give equal rows. Other columns of ``df`` are not read. An empty table gives an empty result.
    """
    bound = df.select(id_or_last(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(_bind, "docs binary, z binary")
    slices = scratch(bound.select(F.monotonically_increasing_id().alias("slice"), "docs", "z"), "suffix-slices")
    buckets = slices.count() * SLICE_BYTES // BUCKET_BYTES + 1
    dealt = slices.mapInArrow(_deal(buckets), _STEP).repartition("bucket").sortWithinPartitions("bucket")
    known = scratch(dealt.mapInArrow(_ask(hot), _STEP), "suffix-runs")
    del bound, dealt

    asks = known.where(F.col("kind") == ASK)
    n = asks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = known.where(F.col("kind") == HOTTEST).select("bucket", F.col("data").alias("crowded"))
    some_crowded = not crowded.isEmpty()
    heat = asks.join(crowded, "bucket", "left") if some_crowded else asks.withColumn("crowded", F.lit(None).cast("binary"))

    def fetch(rows: DataFrame) -> DataFrame:
        return slices.join(rows.groupBy("slice").agg(F.collect_list(F.struct("bucket", "data", "crowded")).alias("asks")), "slice")

    packed = fetch(heat).mapInArrow(_contexts(int(n) // BUCKET_CONTEXTS + 1), "bucket int, slice long, data binary")
    spans = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine_buckets, _SPANS)
    if some_crowded:
        windows = scratch(fetch(heat.where(F.col("crowded").isNotNull())).mapInArrow(_crowded_windows, "slice long, _id long, start long, w binary"), "suffix-crowded")
        spans = spans.unionByName(_crowded_repeats(windows))
    spans = spans.unionByName(known.where(F.col("kind") == COVER).select("slice", "data"))
    found = spans.groupBy("slice").agg(F.collect_list("data").alias("spans"))
    out = slices.join(found, "slice", "left").mapInArrow(_cut, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
