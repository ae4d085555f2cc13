"""Benchmark decontamination with training suffix arrays.

Each shard of documents (a bounded slice of a scan task) becomes one sequence of word numbers, and a suffix array over
it: the start positions sorted by the words that follow. Suffixes that no benchmark window could match, because a word
outside the benchmark stands among their first words, are left out. Every suffix of every benchmark item is then
found in the array by binary search, which gives all places of its distinct 13-word windows as ranges of the array.
Places that touch are runs of hit words; each item gives its longest verbatim match from its first place in a text. Words
are told apart by a hash first and then by their letters.

The benchmark travels to the tasks in blocks of about BLOCK_WORDS words (some 60 MB), each item whole. There is one block at
most sizes, and then nothing is shuffled; with more, the matches of all blocks are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratch, text_bytes, widened

WINDOW = 13
#: Words of one broadcast block of the benchmark, text of one shard, windows searched for at once, and matches in memory at once.
BLOCK_WORDS, SHARD_BYTES, SEARCHED, ROWS = 2 << 20, 4 << 20, 1 << 16, 1 << 19
#: A document is contaminated if one word in so many is hit.
SHARE = 20
#: Multiplier of the rolling word hash (odd).
BASE = 0x9E3779B97F4A7C15

_KIND = np.zeros(256, bool)
_KIND[ord("0") : ord("9") + 1] = _KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = _KIND[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: list[bytes], base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, the number of words of each text, and the words themselves: their
    letters in a row, the first letter of each, and their sizes."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = _KIND[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.uint8), none, none
    sizes = ends - starts
    letters = _LOWER[data[inside]]
    first = np.cumsum(sizes) - sizes
    power = np.cumprod(np.full(int(sizes.max()), base, np.uint64))
    hashes = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(letters)) - np.repeat(first, sizes)], first)
    hashes ^= hashes >> np.uint64(29)
    hashes = hashes * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))), letters, first, sizes


def _equal(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether words of the same size are equal letter by letter."""
    if not len(sizes):
        return np.zeros(0, bool)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    same = a[np.repeat(a_first, sizes) + at] == b[np.repeat(b_first, sizes) + at]
    return np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * WINDOW}").reshape(-1)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _window_numbers(number: np.ndarray) -> np.ndarray:
    """A number for each stretch of WINDOW words that is the same for equal ones: pairs of pairs, as far as they reach."""
    out, have = number.astype(np.int64), 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        out, have = np.unique((out[:-step] << 32) | out[step:], return_inverse=True)[1], have + step
    return out


def windows(items: list[tuple[int | None, str | None]], base: int = BASE) -> dict:
    """A block of the benchmark as plain arrays, to be broadcast; about 30 bytes a word.

    Its vocabulary (hashes in order, and the letters behind them), the word numbers of all items, one after the other
    (an item of fewer words than a window is filled up with zeros), and for each distinct window the places where an item
    first holds it (``where``, from ``owned[k]`` on). Windows that the same items hold have one number in ``kin``.
    """
    hashes, counts, letters, first, sizes = words([(t or "").encode() for _, t in items], base)
    vocabulary, sample, number = np.unique(hashes, return_index=True, return_inverse=True)
    if not (sizes == sizes[sample[number]]).all() or not _equal(letters, first, letters, first[sample[number]], sizes).all():
        return windows(items, (base * 5 + 2) % 2**64 | 1)  # two words share a hash
    width = np.where(counts > 0, np.maximum(counts, WINDOW), 0)
    begin = np.cumsum(width) - width
    flat = np.zeros(int(width.sum()), np.int32)
    flat[_ranges(begin, counts)] = number + 1
    own = sizes[sample]
    out = {
        "base": base, "vocabulary": vocabulary, "letters": letters[_ranges(first[sample], own)], "first": np.append(0, np.cumsum(own)).astype(np.int32), "ids": [i for i, _ in items], "number": flat,
        "begin": begin, "count": counts, "owned": np.zeros(1, np.int32), "where": np.zeros(0, np.int32), "kin": np.zeros(0, np.int32),
    }
    if not len(flat):
        return out
    many = np.maximum(width - WINDOW + 1, 0)
    start, item = _ranges(begin, many), np.repeat(np.arange(len(items)), many)
    window = np.unique(_window_numbers(flat)[start], return_inverse=True)[1]
    # One row a distinct window and item, at its first place there.
    key = (window << 32) | item
    order = np.argsort(key, kind="stable")
    order = order[np.diff(key[order], prepend=-1) != 0]
    window, item, start = window[order], item[order], start[order]
    owned = np.flatnonzero(np.diff(window, prepend=-1))
    # Windows held by the same items: alike by a sum of hashes, then compared item by item.
    mixed = (item.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    many = np.diff(np.append(owned, len(window)))
    _, like, kin = np.unique(np.add.reduceat(mixed, owned), return_index=True, return_inverse=True)
    alike = many == many[like[kin]]
    at = _ranges(owned[alike], many[alike])
    same = item[at] == item[_ranges(owned[like[kin[alike]]], many[alike])]
    alike[alike] = np.logical_and.reduceat(same, np.cumsum(many[alike]) - many[alike])
    kin = np.where(alike, like[kin], np.arange(len(kin)))
    return out | {"owned": np.append(owned, len(window)).astype(np.int32), "where": start.astype(np.int32), "kin": kin.astype(np.int32)}


def _numbered(texts: list[bytes], bench: dict) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary's number of every word of all texts (zero without one), and the words of each text."""
    hashes, counts, letters, first, sizes = words(texts, bench["base"])
    if not len(hashes) or not len(bench["vocabulary"]):
        return np.zeros(len(hashes), np.int64), counts
    number = np.minimum(np.searchsorted(bench["vocabulary"], hashes), len(bench["vocabulary"]) - 1)
    known = np.flatnonzero((bench["vocabulary"][number] == hashes) & (np.diff(bench["first"])[number] == sizes))
    known = known[_equal(letters, first[known], bench["letters"], bench["first"][number[known]].astype(np.int64), sizes[known])]
    out = np.zeros(len(number), np.int64)
    out[known] = number[known] + 1
    return out, counts


def _places(number: np.ndarray, counts: np.ndarray, bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in the texts windows stand, which, and of how many words; in order of place."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(number) or not len(bench["where"]):
        return none
    width = np.minimum(bench["count"], WINDOW)
    # How many benchmark words follow without a break; a text's end is one.
    stop = np.zeros(len(number) + 1, bool)
    stop[np.cumsum(counts)] = True
    stop[:-1] |= number == 0
    stops = np.flatnonzero(stop)
    run = stops[np.searchsorted(stops, np.arange(len(number)), "right")] - np.arange(len(number))
    run[number == 0] = 0
    starts = np.flatnonzero(run >= width[width > 0].min())
    if not len(starts):
        return none
    padded = np.concatenate([number, np.zeros(WINDOW, np.int64)])
    rows = padded[starts[:, None] + np.arange(WINDOW)]
    rows[np.arange(WINDOW) >= run[starts][:, None]] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    array = keys[order]
    # Windows with a word that the texts lack aren't searched for.
    there = np.zeros(len(bench["vocabulary"]) + 1, bool)
    there[number] = there[0] = True
    lacking = np.concatenate([[0], np.cumsum(~there[bench["number"]])])
    place = bench["where"][bench["owned"][:-1]]
    wanted = np.flatnonzero(lacking[place + WINDOW] == lacking[place])
    at, window, size = [], [], []
    for k in range(0, len(wanted), SEARCHED):
        mine = wanted[k : k + SEARCHED]
        low = bench["number"][place[mine][:, None] + np.arange(WINDOW)]
        left = np.searchsorted(array, _keys(low), "left")
        right = np.searchsorted(array, _keys(np.where(low == 0, 2**32 - 1, low.astype(np.int64))), "right")
        # A place of the text holds one window of 13 words and a shorter one of each size at most.
        found = np.maximum(right - left, 0)
        at.append(starts[order[_ranges(left, found)]])
        window.append(np.repeat(mine, found))
        size.append(np.repeat((low > 0).sum(axis=1), found))
    at, window, size = (np.concatenate(x) if x else none[0] for x in (at, window, size))
    place = np.argsort(at, kind="stable")
    return at[place], window[place], size[place]


def _runs(at: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (text, first hit word, word behind) of stretches of hit words."""
    if not len(at):
        return np.zeros((0, 3), np.int64)
    ends = np.cumsum(counts)
    reach = np.maximum.accumulate(at + size)
    text = np.searchsorted(ends, at, "right")
    open_ = np.flatnonzero(np.concatenate([[True], (at[1:] > reach[:-1]) | (text[1:] != text[:-1])]))
    close = np.append(reach[open_[1:] - 1], reach[-1])
    begin = (ends - counts)[text[open_]]
    return np.stack([text[open_], at[open_] - begin, close - begin], axis=1)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Of rows with the same last two keys, the one with the least of the others."""
    order = np.lexsort(keys)
    new = np.concatenate([[True], (np.diff(keys[-1][order]) != 0) | (np.diff(keys[-2][order]) != 0)]) if len(order) else np.zeros(0, bool)
    return order[new]


def _longest(text: np.ndarray, window: np.ndarray, at: np.ndarray, number: np.ndarray, counts: np.ndarray, bench: dict) -> np.ndarray:
    """Rows (text, item, first word in the text, first word in the item, words): one match for each text and item of its windows.

    It begins at the first of the item's windows in the text and goes on as long as text and item go on alike. Windows are
    spread out to their items ROWS at a time.
    """
    held = bench["owned"][window + 1] - bench["owned"][window]
    kept = [np.zeros((4, 0), np.int64)]
    for group in np.split(np.arange(len(window)), np.flatnonzero(np.diff(np.cumsum(held, dtype=np.int64) // ROWS)) + 1):
        where = bench["where"][_ranges(bench["owned"][window[group]].astype(np.int64), held[group])].astype(np.int64)
        own, place = np.repeat(text[group], held[group]), np.repeat(at[group], held[group])
        item = np.searchsorted(bench["begin"], where, "right") - 1
        kept.append(np.stack([own, item, place, where])[:, _first_of(where, place, item, own)])
    text, item, at, where = np.concatenate(kept, axis=1)
    once = _first_of(where, at, item, text)
    text, item, at, where = text[once], item[once], at[once], where[once]
    ends, place = np.cumsum(counts), where - bench["begin"][item]
    most = np.minimum(ends[text] - at, bench["count"][item] - place)
    size, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        live = live[size[live] < most[live]]
        live = live[number[at[live] + size[live]] == bench["number"][where[live] + size[live]]]
        size[live] += 1
    return np.stack([text, item, at - (ends - counts)[text], place, size], axis=1)


def _firsts(at: np.ndarray, window: np.ndarray, counts: np.ndarray, bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, place): of a text's windows that the same items hold, the first; by text."""
    text, kin = np.searchsorted(np.cumsum(counts), at, "right"), bench["kin"][window]
    once = _first_of(at, kin, text)
    return text[once], window[once], at[once]


def matches(texts: list[bytes], bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; rows (text, first hit word, word behind) of its runs of hit words; and rows (text, item, first
    word in the text, first word in the item, words), one for each text and item whose windows it holds."""
    number, counts = _numbered(texts, bench)
    at, window, size = _places(number, counts, bench)
    return counts, _runs(at, size, counts), _longest(*_firsts(at, window, counts, bench), number, counts, bench)


_MATCH = "array<struct<item_id:bigint,doc_word:bigint,item_word:bigint,n_words:bigint>>"
_HITS = "array<struct<start:bigint,stop:bigint>>"


def _lists(rows: np.ndarray, n: int, columns: list[pa.Array], names: list[str]) -> pa.Array:
    """Rows in the order of their text (first column) as one list of structs a text."""
    offsets = np.searchsorted(rows[:, 0], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        ids = pa.array(bench["ids"], pa.int64())
        for small in (s for batch in batches for s in bounded(batch, "_text", SHARD_BYTES)):
            number, counts = _numbered(text_bytes(small.column("_text")), bench)
            at, window, size = _places(number, counts, bench)
            hits = _runs(at, size, counts)
            text, window, at = _firsts(at, window, counts, bench)
            # Texts leave in groups of about ROWS matches, so that many items in many texts don't stand in memory at once.
            owned = np.bincount(text, bench["owned"][window + 1] - bench["owned"][window], len(counts)).cumsum() // ROWS
            cuts = [0, *(np.flatnonzero(np.diff(owned)) + 1).tolist(), len(counts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                mine = slice(*np.searchsorted(text, [a, b]))
                found = _longest(text[mine], window[mine], at[mine], number, counts, bench)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                found[:, 0] -= a
                part = hits[slice(*np.searchsorted(hits[:, 0], [a, b]))] - [a, 0, 0]
                spans = _lists(part, b - a, [pa.array(part[:, 1]), pa.array(part[:, 2])], ["start", "stop"])
                own = ids.take(pa.array(found[:, 1])) if len(found) else pa.array([], pa.int64())
                lists = _lists(found, b - a, [own, *[pa.array(found[:, k]) for k in (2, 3, 4)]], ["item_id", "doc_word", "item_word", "n_words"])
                rest = [small.column(i).slice(a, b - a) for i in range(small.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts[a:b], pa.int64()), spans, lists], [*small.schema.names, "_n", "_hits", "_found"])

    return run


def find_matches(df: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``hits`` (runs of hit words) and ``matches`` (for each item found, the longest match from its first place).

    Null or empty texts have no words; items without words match nothing; equal items match alike; items with a null
    id match as others do, under a null id. Columns of ``df`` with those names are replaced. Every row of ``df`` gives
    one row, repeated rows too; an empty table gives an empty result. A benchmark of more than ``block_words`` words (an item
    counts WINDOW at least) is taken in blocks, one scan of ``df`` a block, one block in memory at a time.
    """
    spark = df.sparkSession
    items = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    size = int(items.agg(F.coalesce(F.sum(F.greatest(n, F.lit(WINDOW))), F.lit(0))).first()[0])
    blocks = max(1, -(-size * 2 // block_words)) if size > block_words else 1
    rows = df.drop("n_words", "hits", "matches")
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(text_col).alias("_text"))
    back = [f"_row.`{c}`" for c in df.columns if c not in ("n_words", "hits", "matches")]
    schema = lambda x: widened(x, f"_n long, _hits {_HITS}, _found {_MATCH}")

    def block(k: int):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(windows([(r[0], r[1]) for r in own]))

    if blocks == 1:
        found = rows.mapInArrow(_scan(block(0)), schema(rows))
        return found.select(*back, F.col("_n").alias("n_words"), F.col("_hits").alias("hits"), F.col("_found").alias("matches"))
    # Only texts with a match leave a block's scan; a text stands for all rows that hold it.
    parts = None
    texts = df.select(F.sha2(F.col(text_col), 256).alias("_key"), F.col(text_col).alias("_text"))
    for k in range(blocks):
        shared = block(k)
        hit = texts.mapInArrow(_scan(shared), schema(texts)).where(F.size("_hits") > 0).select("_key", "_hits", "_found")
        hit = scratch(hit.groupBy("_key").agg(F.first("_hits").alias("_hits"), F.first("_found").alias("_found")), "decontaminate-block")
        shared.destroy()
        parts = hit if parts is None else parts.unionByName(hit)
    merged = parts.groupBy("_key").agg(F.flatten(F.collect_list("_hits")).alias("hits"), F.flatten(F.collect_list("_found")).alias("matches"))
    empty = spark.sparkContext.broadcast(windows([]))
    counted = rows.mapInArrow(_scan(empty), schema(rows)).withColumn("_key", F.sha2("_text", 256)).select("_row", "_key", F.col("_n").alias("n_words"))
    joined = counted.join(merged, "_key", "left")
    return joined.select(*back, "n_words", F.coalesce("hits", F.array().cast(_HITS)).alias("hits"), F.coalesce("matches", F.array().cast(_MATCH)).alias("matches"))


def hit_words(hits: Column) -> Column:
    """Words covered by runs, which may overlap: a fold over them in the order of their start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["stop"]).alias("upto"))
    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def item_ids(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"].cast("string"))))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """Judged contaminated: a word is hit, and one word in SHARE at least."""
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def judge(df: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, hits, matches, ``n_hit``, ``item_ids`` (sorted as strings) and ``contaminated``; odd rows as in find_matches()."""
    found = find_matches(df, bench, text_col).withColumns({"n_hit": hit_words(F.col("hits")), "item_ids": item_ids(F.col("matches"))})
    return found.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))
