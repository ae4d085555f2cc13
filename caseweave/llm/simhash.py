"""SimHash near-dedup by a binary trie self-join.

Fingerprints are grouped first, so equal ones are one leaf. Two fingerprints that differ in at most three of 64 bits
agree in one of four 16-bit blocks. So the join walks four tries, each over the fingerprints rotated to bring another
block to the front: on the first 16 levels the error budget is zero, below it is three. Node pairs are walked
together, from (node, node) at level 16 down: each step pairs the children, adds the bit in which they differ, and
drops a pair over the budget. A pair of small nodes is finished leaf by leaf.

A trie node with up to NODE_LEAVES leaves is walked inside a task. A heavier one is split 8 levels further into pairs
of its descendants within the budget, again and again, so no task holds more than two nodes of that size at once.
Links inside a unit are emitted as a spanning forest (a row a leaf at most), never as all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.scratch import discard, tidied

from .common import NULL_ID, bounded, id_or_last, scratch, text_bytes

SEED, WORDS, BITS, MAX_DIFFERENT = 42, 3, 64, 3
BLOCKS, BLOCK_BITS = 4, 16
#: Leaves of a trie node that one task may walk; levels by which a heavier node is split; leaf pairs finished directly.
NODE_LEAVES, SPLIT_LEVELS, DIRECT = 1 << 15, 8, 64
#: Shingle size and least Jaccard similarity of near copies in keep_similar_one(); bands of minima, and minima a band.
SIMILAR_WORDS, SIMILAR = 5, 0.8
BANDS, BAND_ROWS = 24, 6
#: Leaves that a task gathers before it walks them; node pairs that it walks together.
BUFFER, FRONTIER = 1 << 17, 1 << 18


def shingles(texts: list[bytes], words: int) -> tuple[list[int], np.ndarray]:
    """XXH64 of each text's word shingles, text after text, repeats included, and their number a text."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = text.lower().split()
        if not parts:
            continue
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1)
        starts = (ends - sizes - 1).tolist()
        n = max(1, len(parts) - words + 1)
        last = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts[:n], last, strict=True)]
        counts[i] = n
    return hashes, counts


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit SimHash of each text, from XXH64 of its word shingles, repeats included."""
    hashes, counts = shingles(texts, words)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        h = np.array(hashes, dtype=">u8")
        ones = np.empty((len(some), BITS), np.int64)
        for j in range(8):  # a byte of the hash at a time keeps the unpacked bits small
            bits = np.unpackbits(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, j])[:, None], axis=1)
            ones[:, 8 * j : 8 * j + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > counts[some][:, None], axis=1).reshape(-1).view(">u8")
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for small in bounded(batch, "text"):
            found = fingerprints(text_bytes(small.column("text")))
            yield pa.RecordBatch.from_arrays([small.column("_id"), small.column("_text_hash"), pa.array(found.view(np.int64), pa.int64())], ["_id", "_text_hash", "fp"])


def rotated(fp: Column, block: Column) -> Column:
    """The fingerprint with this block's 16 bits in front."""
    left = block * BLOCK_BITS
    return F.when(block == 0, fp).otherwise(_shift(fp, left, True).bitwiseOR(_shift(fp, F.lit(BITS) - left, False)))


def _shift(value: Column, by: Column, left: bool) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, by.cast("int"))


def walk(keys: np.ndarray, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray, differ: np.ndarray, level: np.ndarray, budget: int = MAX_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (indices into ``keys``) within the budget below the given trie node pairs.

    A node is a slice of ``keys``, sorted within it; ``level`` is how many leading bits its leaves share.
    """
    left, right, waiting = [], [], []
    while len(low) or waiting:
        if not len(low):
            low, high, other_low, other_high, differ, level = waiting.pop()
        elif len(low) > FRONTIER:  # the rest waits, so what is held at once is bounded
            state = (low, high, other_low, other_high, differ, level)
            waiting.append(tuple(x[FRONTIER:] for x in state))
            low, high, other_low, other_high, differ, level = (x[:FRONTIER] for x in state)
        n, m, same = high - low, other_high - other_low, low == other_low
        done = (n * m <= DIRECT) | (level >= BITS)
        if done.any():
            pairs = (n * m)[done]
            which = np.repeat(np.arange(len(pairs)), pairs)
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a = low[done][which] + k // m[done][which]
            b = other_low[done][which] + k % m[done][which]
            near = (np.bitwise_count(keys[a] ^ keys[b]) <= budget) & (~same[done][which] | (a < b))
            left.append(a[near])
            right.append(b[near])
            low, high, other_low, other_high, differ, level, same = (x[~done] for x in (low, high, other_low, other_high, differ, level, same))
        if not len(low):
            continue
        middle, other_middle = _split(keys, low, high, level), _split(keys, other_low, other_high, level)
        out = []
        for a0, a1, b0, b1, cost, keep in (
            (low, middle, other_low, other_middle, 0, None),
            (middle, high, other_middle, other_high, 0, None),
            (low, middle, other_middle, other_high, 1, None),
            (middle, high, other_low, other_middle, 1, ~same),
        ):
            ok = (a1 > a0) & (b1 > b0) & (differ + cost <= budget)
            if keep is not None:
                ok &= keep
            out.append((a0[ok], a1[ok], b0[ok], b1[ok], differ[ok] + cost, level[ok] + 1))
        low, high, other_low, other_high, differ, level = (np.concatenate(x) for x in zip(*out, strict=True))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where in each node the leaves with a one at this level begin: a binary search in all nodes at once."""
    bit = (np.uint64(1) << (BITS - 1 - level).astype(np.uint64)).astype(np.uint64)
    a, b = low.copy(), high.copy()
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) > 0
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)
    return a


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) of n indices make up a spanning forest: components of more than one index hook to a smaller one by a link."""
    root, kept, live = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while len(live := live[root[a[live]] != root[b[live]]]):
        x, y = root[a[live]], root[b[live]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        root[high[first]] = low[first]
        kept.append(live[first])
        while not np.array_equal(root, up := root[root]):
            root = up
    return np.concatenate(kept)


def _walk_units(batches: Iterator[pa.RecordBatch], near: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and side to star links, with ``near`` to those links of the walk that make up a spanning forest; units
    are walked together, about BUFFER leaves at a time."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        unit, side, level, differ, turn, key = (np.concatenate(x) for x in zip(*rows, strict=True))
        key = key.view(np.uint64)
        order = np.lexsort((key, side, unit))
        unit, side, level, differ, turn, key = (x[order] for x in (unit, side, level, differ, turn, key))
        start = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
        stop = np.append(start[1:], len(unit))
        first = np.flatnonzero(side[start] == 0)
        two = np.append(side[start], 0)[first + 1] == 1
        other = np.where(two, first + 1, first)
        other = np.minimum(other, len(start) - 1)
        a, b = walk(key, start[first], stop[first], start[other], stop[other], differ[start[first]].astype(np.int64), level[start[first]].astype(np.int64))
        if near:
            kept = spanning(a, b, len(key))
            a, b = a[kept], b[kept]
        else:
            root = forest(a, b, len(key))
            a = np.flatnonzero(root != np.arange(len(key)))
            b = root[a]
        back = lambda i: _rotate(key[i], turn[i])
        return pa.RecordBatch.from_arrays([pa.array(back(a).view(np.int64)), pa.array(back(b).view(np.int64))], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        unit = rows[0]
        if n >= BUFFER and len(unit):
            ends = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            cut = 0 if unit[0] != held[-1][0][-1] else int(ends[0]) if len(ends) else len(unit)
            if cut < len(unit):
                held.append([x[:cut] for x in rows])
                yield links(held)
                held, n, rows = [], 0, [x[cut:] for x in rows]
        held.append(rows)
        n += len(rows[0])
    if n:
        yield links(held)


def _rotate(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Undo rotated()."""
    right = (turn.astype(np.uint64) * np.uint64(BLOCK_BITS)) % np.uint64(BITS)
    return np.where(right == 0, key, (key >> right) | (key << ((np.uint64(BITS) - right) % np.uint64(BITS))))


def near_links(unique: DataFrame, node_leaves: int = NODE_LEAVES, near: bool = False) -> DataFrame:
    """Links (a, b) that join all fingerprints (column ``fp``, distinct) within MAX_DIFFERENT bits of each other.

    With ``near`` the two of each link are themselves so near, else one is the smallest that a task reaches from the other.
    """
    leaves = unique.select(F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), rotated(F.col("fp"), F.lit(t)).alias("key")) for t in range(BLOCKS)])).alias("x")).select("x.*")
    cut = lambda depth: _shift(F.col("key"), F.lit(BITS - depth), False)
    counts = leaves.groupBy("turn", cut(BLOCK_BITS).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    counts = scratch(counts, "simhash-nodes")
    units = [counts.where(F.col("n") <= node_leaves).select("turn", F.col("node").alias("left"), F.col("node").alias("right"), F.lit(0).alias("differ"), F.lit(BLOCK_BITS).alias("level"))]
    heavy = counts.where(F.col("n") > node_leaves).select("turn", F.col("node").alias("left"), F.col("node").alias("right"), F.lit(0).alias("differ"))
    depth = BLOCK_BITS
    while depth < BITS and not heavy.isEmpty():
        deeper = min(BITS, depth + SPLIT_LEVELS)
        node = leaves.select("turn", cut(depth).alias("up"), cut(deeper).alias("node")).groupBy("turn", "up", "node").agg(F.count("*").alias("n"))
        child = lambda side: node.select("turn", F.col("up").alias(side), F.col("node").alias(f"{side}_node"), F.col("n").alias(f"{side}_n"))
        pairs = heavy.join(child("left"), ["turn", "left"]).join(child("right"), ["turn", "right"])
        differ = F.bit_count(F.col("left_node").bitwiseXOR(F.col("right_node")))  # of the whole prefixes
        ordered = (F.col("left") != F.col("right")) | (F.col("left_node") <= F.col("right_node"))
        pairs = pairs.where(ordered).withColumn("differ", differ).where(F.col("differ") <= MAX_DIFFERENT)
        pairs = scratch(pairs.select("turn", F.col("left_node").alias("left"), F.col("right_node").alias("right"), "differ", F.greatest("left_n", "right_n").alias("n")), "simhash-pairs")
        light = (F.col("n") <= node_leaves) | F.lit(deeper == BITS)
        units.append(pairs.where(light).select("turn", "left", "right", "differ", F.lit(deeper).alias("level")))
        heavy, depth = pairs.where(~light).drop("n"), deeper
    rows = None
    for k, unit in enumerate(units):
        level = BLOCK_BITS + k * SPLIT_LEVELS
        own = leaves.withColumn("node", cut(min(BITS, level)))
        left = own.join(unit.withColumnRenamed("left", "node"), ["turn", "node"]).select("turn", F.col("node").alias("l"), F.col("right").alias("r"), "level", "differ", F.lit(0).alias("side"), "key")
        part = left
        if k:
            right = own.join(unit.where("left != right").withColumnRenamed("right", "node"), ["turn", "node"]).select("turn", F.col("left").alias("l"), F.col("node").alias("r"), "level", "differ", F.lit(1).alias("side"), "key")
            part = left.unionByName(right)
        rows = part if rows is None else rows.unionByName(part)
    unit = F.xxhash64("turn", "l", "r", "level")
    rows = rows.select(unit.alias("unit"), "side", "level", "differ", "turn", "key")
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: _walk_units(batches, near), "a long, b long")


def _tidy(df: DataFrame, tag: str, tidy: bool = True) -> DataFrame:
    """scratch() whose shuffle files go as it ends, if ``tidy``."""
    with tidied(df.sparkSession, tidy):
        return scratch(df, tag)


def components(links: DataFrame, tidy: bool = False) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (a, b), root being the smallest node of its component.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until the links stay the same. With
    ``tidy`` no step's table outlives the next.
    """
    at, seen = _tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "components", tidy), None
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        last, at = at, _tidy(small.select("x.a", "x.b").where("a != b").distinct(), "components", tidy)
        if tidy:
            discard(last)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Working columns of every row of ``df``: ``_id``, ``_text_hash``, ``fp`` and ``component``, nulls as in near_duplicates()."""
    docs = df.select(id_or_last(id_col).alias("_id"), text_hash(text_col).alias("_text_hash"), F.col(text_col).alias("text"))
    marked = scratch(docs.mapInArrow(_fingerprint, "_id long, _text_hash long, fp long"), "simhash-docs")
    unique = scratch(marked.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-unique")
    found = components(near_links(unique.select("fp")))
    rooted = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    groups = rooted.join(smallest, "root").select("fp", "component")
    return marked.join(groups, "fp")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_col, F.octet_length(F.col(text_col)))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id of its group).

    Texts of fewer than three words are one shingle; null, empty and blank texts have fingerprint zero. Links join
    fingerprints at three or fewer differing bits. Rows with equal ids are kept; null ids stand last, and the
    component of a group with no other id is null. An empty table gives an empty result.
    """
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    rows = grouped(df, id_col, text_col)
    return rows.select(known("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), known("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group, the document with the smallest id stays, in one row.

    Among rows that share this id, one text stays, chosen by hash.
    """
    rows = scratch(grouped(df, id_col, text_col), "simhash-groups")
    kept = rows.groupBy("component").agg(F.min(F.struct("_id", "_text_hash")).alias("k")).select("k.*")
    again = rows.groupBy("_id", "_text_hash").count().where("count > 1")
    named = df.withColumns({"_id": id_or_last(id_col), "_text_hash": text_hash(text_col)})
    out = named.join(kept, ["_id", "_text_hash"], "left_semi")
    if not again.isEmpty():
        out = out.dropDuplicates(["_id", "_text_hash"])
    return out.select(df.columns)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of a text's shingles as a hash (``sig``), the text's fingerprint, and BANDS keys of minima of the set; none for an empty one."""
    rng = np.random.default_rng(SEED)
    turn, mix = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)
    for batch in batches:
        for small in bounded(batch, "text"):
            texts = text_bytes(small.column("text"))
            hashes, counts = shingles(texts, SIMILAR_WORDS)
            h, ends = np.array(hashes, np.uint64), np.cumsum(counts)
            sig = [xxhash.xxh64_intdigest(np.unique(h[e - n : e]).tobytes(), SEED) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            some = np.flatnonzero(counts)
            keys = np.zeros((len(some), BANDS), np.uint64)
            if len(some):
                for j in range(BANDS * BAND_ROWS):
                    keys[:, j // BAND_ROWS] += np.minimum.reduceat(h * turn[j], (ends - counts)[some]) * mix[j]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            fp = pa.array(fingerprints(texts).view(np.int64))
            yield pa.RecordBatch.from_arrays([small.column("_id"), small.column("_text_hash"), pa.array(np.array(sig, np.uint64).view(np.int64)), fp, bands], ["_id", "_text_hash", "sig", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set of shingles, as hashes."""
    for batch in batches:
        for small in bounded(batch, "text"):
            hashes, counts = shingles(text_bytes(small.column("text")), SIMILAR_WORDS)
            each = [np.unique(x) for x in np.split(np.array(hashes, np.uint64), np.cumsum(counts)[:-1])] if len(counts) else []
            ends = np.cumsum([0, *map(len, each)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *each]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([small.column("sig"), sets], ["sig", "set"])


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose key has another row."""
    return rows.join(rows.groupBy("key").count().where("count > 1").select("key"), "key")


def _judged(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of SIMILAR or more."""
    side = lambda name: sets.select(F.col("sig").alias(name), F.col("set").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = asked.select("a", "b").distinct().join(side("b"), "b").join(side("a"), "a")
    return _tidy(found.where(both >= SIMILAR * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), "similar-near")


def prefixes(sets: DataFrame) -> DataFrame:
    """Prefix filter: rows (``sig``, ``key``, ``n``, ``at``, ``strong``), a row for each of a set's rarest shingles, n being its size and ``at`` how many are rarer.

    In one order of all shingles, rarest first, two sets with a similarity of t share a shingle among the first
    (1 - t) n + 1 of the longer and the first (1 - 2t / (1 + t)) n + 1 of the shorter; the latter are ``strong``.
    """
    each = sets.select("sig", F.size("set").alias("n"), F.explode("set").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often"))
    ranked = each.join(often, "key").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("s"))
    least = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1
    rows = ranked.select("sig", "n", F.posexplode(F.slice("s", F.lit(1), least(SIMILAR).cast("int"))).alias("at", "x"))
    return rows.where("x.often > 1").select("sig", F.col("x.key").alias("key"), "n", "at", (F.col("at") < least(2 * SIMILAR / (1 + SIMILAR))).alias("strong"))


def trie_pairs(units: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``units`` (sig, fp) that the trie self-join proposes: the first unit of a fingerprint with its others,
    and the first units of two fingerprints within MAX_DIFFERENT bits, along a spanning forest of such links."""
    leaves = _tidy(units.groupBy("fp").agg(F.min("sig").alias("first")), "similar-leaves")
    same = units.join(leaves, "fp").where("sig != first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    of = lambda side: leaves.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    near = near_links(leaves.select("fp"), near=True).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def similar_links(units: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links (a, b) of ``units`` (sig, fp, bands) that leave the components of all links at a similarity of SIMILAR or more as they
    are; ``texts`` has a ``text`` a ``sig``.

    The trie self-join of the fingerprints proposes pairs, and so do bands for those whose fingerprints differ in more bits:
    units that share a band's key are compared with one of them, another by each band. Every pair is checked exactly. Keys
    whose units aren't of one component then are crowded with texts that have much in common: their units meet again by
    prefixes(), the shingles that are rare among them. There each key's strong units are drawn and compared with all of the key's units that a link could join
    by it, but for those that links have brought into their own component by then. A drawn unit leaves the key, and a key is
    done once one component is left in it or no strong unit: so no link by a key stays uncompared, and none is lost there.
    """
    keyed = units.select("sig", F.posexplode("bands").alias("band", "key")).select("sig", F.xxhash64("band", "key").alias("key"))
    rows = _tidy(_shared(keyed), "similar-rows")
    tries = _tidy(trie_pairs(units.select("sig", "fp")), "similar-tries")
    if rows.isEmpty() and tries.isEmpty():
        return None
    asked = rows.select("sig").unionByName(tries.select(F.explode(F.array("a", "b")).alias("sig")))
    pool = texts.join(asked.distinct(), "sig", "left_semi").dropDuplicates(["sig"])
    sets = _tidy(pool.select("sig", "text").mapInArrow(_sets, "sig long, set array<long>"), "similar-sets")
    first = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("sig", "key"), "sig"))["sig"].alias("a"))
    rest = rows.join(first, "key").where("sig != a").withColumnRenamed("sig", "b")
    links = _judged(rest.select("a", "b").unionByName(tries), sets)
    rooted = components(links, tidy=True).withColumnRenamed("node", "sig")
    told = rows.join(rooted, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    crowded = told.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    again = rows.join(crowded, "key").select("sig").distinct()
    rarest = _tidy(prefixes(sets.join(again, "sig", "left_semi")).join(rooted, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "similar-rows")
    discard(rows)
    rows, fresh, turn = _several(rarest, rarest), [], 0
    while True:
        # Twice as many of a key's strong units at every turn, and always one: turns grow with the logarithm of a key.
        draw = F.xxhash64("sig", "key", F.lit(turn))
        sizes = rows.where("strong").groupBy("key").agg(F.count("*").alias("m"), F.min(draw).alias("least"))
        drawn = (draw == F.col("least")) | (F.shiftrightunsigned(draw, 34) * F.col("m") < F.lit(2.0**30) * 2.0**turn)
        chosen = rows.where("strong").join(sizes, "key").where(drawn).select("key", F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("root").alias("root_a"))
        if chosen.isEmpty():
            return links
        # Two similar sets have nothing in common before the first key they share, and enough from there on in both.
        enough = F.least(F.col("n") - F.col("at"), F.col("n_a") - F.col("at_a")) >= SIMILAR / (1 + SIMILAR) * (F.col("n") + F.col("n_a")) - 1e-6
        fits = enough & (F.least("n", "n_a") >= SIMILAR * F.greatest("n", "n_a") - 1e-6) & (F.col("strong") | (F.col("n") >= F.col("n_a")))
        asked = _tidy(rows.join(chosen, "key").where("root != root_a").where(fits).select("a", F.col("sig").alias("b"), "root_a", "root"), "similar-asked")
        near = _judged(asked, sets)
        links = links.unionByName(near)
        fresh.append(_tidy(asked.join(near, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root").alias("b")).distinct(), "similar-met"))
        discard(asked)
        left = rows.join(chosen.select("key", F.col("a").alias("sig")), ["key", "sig"], "left_anti")
        if turn % MEET == MEET - 1:  # components meet now and then: each time is a few jobs
            now = components(reduce(DataFrame.unionByName, fresh), tidy=True).select(F.col("node").alias("root"), F.col("root").alias("_now"))
            left = left.join(now, "root", "left").withColumn("root", F.coalesce("_now", "root")).drop("_now")
            for met in fresh:
                discard(met)
            fresh = []
        rows, turn = _several(left, rows), turn + 1


#: Turns after which the components of the links so far are told again.
MEET = 3


def _several(rows: DataFrame, spent: DataFrame) -> DataFrame:
    """Rows of the keys that have units of several components, and a strong one; ``spent`` is the table behind ``rows``, which goes."""
    open_ = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("strong").alias("any")).where("x != y AND any").select("key")
    out = _tidy(rows.join(open_, "key"), "similar-rows")
    discard(spent)
    return out


def keep_similar_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of texts linked by a Jaccard similarity of SIMILAR or more over sets of
    SIMILAR_WORDS-word shingles, the document with the smallest id stays, in one row.

    Operator 1's fingerprints and tries propose the pairs that differ in at most MAX_DIFFERENT bits. At a similarity of 0.8
    about 10 of 64 bits differ, so bands of minima propose what the tries can't, and each link is checked exactly. Texts
    with no word are copies of each other.
    """
    named = df.withColumns({"_id": id_or_last(id_col), "_text_hash": text_hash(text_col)})
    docs = named.select("_id", "_text_hash", F.col(text_col).alias("text"))
    rows = _tidy(docs.mapInArrow(_bands, "_id long, _text_hash long, sig long, fp long, bands array<long>"), "similar-docs")
    units = _tidy(rows.groupBy("sig").agg(F.min(F.struct("_id", "_text_hash", "fp")).alias("first"), F.first("bands").alias("bands")), "similar-units")
    firsts = units.select("sig", "first._id", "first._text_hash")
    links = similar_links(units.select("sig", "first.fp", "bands"), docs.join(firsts, ["_id", "_text_hash"]).select("sig", "text"))
    kept = firsts
    if links is not None:
        found = components(links, tidy=True).withColumnRenamed("node", "sig")
        rooted = units.join(found, "sig", "left").select("first", F.coalesce("root", "sig").alias("root"))
        kept = rooted.groupBy("root").agg(F.min("first").alias("k")).select("k.*")
    again = rows.groupBy("_id", "_text_hash").count().where("count > 1")
    out = named.join(kept, ["_id", "_text_hash"], "left_semi")
    if not again.isEmpty():
        out = out.dropDuplicates(["_id", "_text_hash"])
    return out.select(df.columns)
