"""Periodic runs of words, by partition refinement.

The word positions of a text fall into classes of equal factors of length 1, 2, 3 and so on. A step refines the classes
of one length to those of the next: of every class that split in the step before, all parts but the largest send their
members' left neighbours out of their classes (the smaller half, so a position is moved a logarithmic number of times).
Neighbouring members of a class whose distance is the factor's length are the halves of a square without a smaller
period; squares of one period at consecutive positions are a run.

All texts of a bounded batch are refined side by side: a class never has members of two texts, and a mark behind each
text keeps factors inside it. Classes are segments of one array; members are linked in text order, and a link tells since
which length it has held, so a distance is looked at only when it changes. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_bytes, widened

#: Least words of a run, and text of one batch.
MIN_WORDS, BATCH_BYTES = 12, 6 << 20


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def squares(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of every square whose half is no power, in one row of texts.

    ``word`` has the word numbers of all texts, ``counts`` the words of each. Positions count a mark behind every text.
    """
    ends = np.cumsum(counts + 1)
    n = int(ends[-1]) if len(ends) else 0
    symbol = np.full(n, 2**32 - 1, np.int64)
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    symbol[inner] = word
    symbol |= np.repeat(np.arange(len(counts), dtype=np.int64), counts + 1) << 32
    member = np.argsort(symbol, kind="stable").astype(np.int32)
    new = np.diff(symbol[member], prepend=-1) != 0
    first = np.flatnonzero(new)
    kind, place = np.empty(n, np.int32), np.empty(n, np.int32)
    kind[member], place[member] = np.cumsum(new) - 1, np.arange(n)
    begin, size = np.empty(2 * n + 1, np.int32), np.zeros(2 * n + 1, np.int32)
    begin[: len(first)], size[: len(first)] = first, np.diff(np.append(first, n))
    kinds = len(first)
    # n stands for no neighbour.
    after, before = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
    inside = np.flatnonzero(~new)
    after[member[inside - 1]], before[member[inside]] = member[inside], member[inside - 1]
    since, moved = np.ones(n + 1, np.int32), np.zeros(n + 1, bool)
    found, periods, length, movers = [], [], 1, np.arange(1, n)
    while True:
        left = movers - 1
        left = left[(left >= 0) & (size[kind[left]] > 1)]
        if not len(left):
            break
        key = np.sort((kind[left].astype(np.int64) << 32) | left)
        old, left = key >> 32, key & (2**32 - 1)
        order = np.argsort((old << 32) | kind[left + 1], kind="stable")
        # Parts of each class by what follows, and what stays untouched.
        follow, own = kind[left[order] + 1], old[order]
        edge = np.concatenate([[True], own[1:] != own[:-1]])
        cut = edge.copy()
        cut[1:] |= follow[1:] != follow[:-1]
        part = np.flatnonzero(cut)
        parts = np.diff(np.append(part, len(own)))
        top = np.flatnonzero(edge[part])  # a class's first part
        classes = own[part[top]]
        touched = np.diff(np.append(part[top], len(own)))
        rest = size[classes] - touched
        several = np.diff(np.append(top, len(part)))
        split = (several > 1) | (rest > 0)
        if not split.all():
            keep = np.repeat(split, touched)
            order = (np.cumsum(keep) - 1)[order[keep]]  # classes stand in one order in both
            left, old, own = left[keep], old[keep], own[keep]
            keep = np.repeat(split, several)
            parts = parts[keep]
            classes, touched, rest, several = classes[split], touched[split], rest[split], several[split]
            if not len(classes):
                break
            part, top = np.cumsum(parts) - parts, np.cumsum(several) - several
        length += 1
        moving = left[order]
        # The largest part, the first of them, of each class; it keeps the number where nothing stays.
        most = np.maximum.reduceat(parts, top)
        of = np.repeat(np.arange(len(classes)), several)
        largest = np.flatnonzero(parts == most[of])
        largest = largest[np.concatenate([[True], of[largest][1:] != of[largest][:-1]])]
        number = np.zeros(len(parts), np.int64)
        fresh = np.ones(len(parts), bool)
        fresh[largest[rest == 0]] = False
        number[fresh] = kinds + np.arange(fresh.sum())
        kinds += int(fresh.sum())
        number[~fresh] = classes[rest == 0]
        # Links: what stays closes up around those that go, those that go are linked by part.
        moved[left] = True
        a, b = before[left[~moved[before[left]]]], after[left[~moved[after[left]]]]
        nxt, prv = np.full(len(moving), n, np.int64), np.full(len(moving), n, np.int64)
        joined = np.ones(len(moving), bool)
        joined[part] = False
        joined = np.flatnonzero(joined)
        nxt[joined - 1], prv[joined] = moving[joined], moving[joined - 1]
        changed = np.concatenate([a[a < n], moving[nxt != after[moving]]])
        apart = after[changed] - changed
        square = (after[changed] < n) & (since[changed] <= apart) & (apart < length)
        found.append(changed[square])
        periods.append(apart[square])
        since[changed] = length
        after[a], before[b] = b, a
        after[moving], before[moving] = nxt, prv
        # Segments: those that go fill the end of their class's segment.
        zone = _ranges(begin[classes] + size[classes] - touched, touched)
        there = member[zone]
        there = there[~moved[there]]
        vacated = place[left[place[left] < np.repeat(begin[classes] + size[classes] - touched, touched)]]
        member[vacated], place[there] = there, vacated
        member[zone], place[moving] = moving, zone
        moved[left] = False
        size[classes] = rest
        begin[number], size[number] = zone[part], parts
        kind[moving] = np.repeat(number, parts)
        # All but the largest child of each class move their left neighbours next.
        whole = rest < most
        out = np.zeros(len(parts), bool)
        out[largest[whole]] = True
        stay = whole & (rest > 0)
        movers = np.concatenate([moving[~np.repeat(out, parts)], member[_ranges(begin[classes[stay]], rest[stay])]]).astype(np.int64)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(periods).astype(np.int64)


def runs(word: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, first word, words, period) of all runs of ``min_words`` or more, by text, first word and period."""
    at, period = squares(word, counts)
    key = np.sort((period << 32) | at)
    if not len(key):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    period, first, last = key[new] >> 32, key[new] & (2**32 - 1), key[np.append(new[1:], len(key)) - 1] & (2**32 - 1)
    ends = np.cumsum(counts + 1)
    text = np.searchsorted(ends, first, "right")
    rows = np.stack([text, first - (ends - counts - 1)[text], last + 2 * period - first, period], axis=1)
    rows = rows[rows[:, 2] >= min_words]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _find(min_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in (s for batch in batches for s in bounded(batch, "_text", BATCH_BYTES)):
            texts = [t.split() for t in text_bytes(small.column("_text"))]  # bytes split at ASCII white space only
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            word = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            rows = runs(word.astype(np.int64), counts, min_words)
            # Words behind a run's first period go.
            base = np.cumsum(counts) - counts
            covered = np.zeros(int(counts.sum()) + 1, np.int64)
            np.add.at(covered, base[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
            np.add.at(covered, base[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
            kept = np.cumsum(covered) == 0
            hit = set(rows[:, 0].tolist())
            left = [b" ".join(compress(t, kept[base[k] : base[k] + counts[k]].tolist()) if k in hit else t) for k, t in enumerate(texts)]
            offsets = pa.array(np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)), pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            columns = [pa.array(counts), pa.ListArray.from_arrays(offsets, spans), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([small.column("_row"), *columns], ["_row", "n_words", "runs", "collapsed"])

    return find


def find_runs(df: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` (start, length, period: words; by start, then period) and ``collapsed``, the words
    that no run holds behind its first period, joined by one space.

    A run is a stretch of words of smallest period q and at least ``min_words`` and 2q words that can't be made longer.
    Columns of ``df`` with those names are replaced, all others stay. Null and empty texts have no words, no runs and an
    empty ``collapsed``. Every row gives one row, repeated rows too; an empty table gives an empty one. A text is taken
    whole, however long; memory goes with a batch of BATCH_BYTES or one longer text.
    """
    rest = df.drop("n_words", "runs", "collapsed")
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("_row"), F.col(text_col).alias("_text"))
    schema = widened(rows.select("_row"), "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return rows.mapInArrow(_find(min_words), schema).select("_row.*", "n_words", "runs", "collapsed")
