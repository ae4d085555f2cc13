"""How filters of a corpus interact: what each removes in every order of application, and what it removes alone.

The set of filters that a document fails decides its fate in every order, so documents are counted by that set (a mask of
five bits) and the orders are worked out on 32 counts. Only E, an exact copy of an earlier document, looks beyond the
document: rows are routed by the XXH64 of their text to partitions of an RDD and sorted there, so that the rows of one
fingerprint stand together; a chain holds each different text of the fingerprint in full with its least id so far, and
every row that isn't the least leaves as a copy. A task sends a text it has read several times only once: all but
its least row are copies already and travel without text, spread by id, so copies of one text never crowd a task.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Filters; filter k is bit k of a mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
#: Text that a task holds at once to find its own copies.
HELD_BYTES = 32 << 20
#: Text of one partition after routing, about.
PART_BYTES = 64 << 20

_SIGN = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Counts of a mask: documents, good ones, toxic ones.
_COUNTS = 3


def failed_alone(text: str) -> int:
    """The filters among A to D that a text fails: short, repetitive, much in capitals, or with one of # $ % & * |."""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    fails = (
        len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * (len(data) - len(data.translate(None, _CAPITALS))) > MAX_CAPITAL_PERCENT * len(text), _SIGN.search(text) is not None,
    )
    return sum(1 << k for k, f in enumerate(fails) if f)


def _later(a: int | None, b: int | None) -> int:
    """-1, 0 or 1 as id ``a`` stands before, with or after ``b``; null stands after every id."""
    x, y = (a is None, a or 0), (b is None, b or 0)
    return (x > y) - (x < y)


def _settle(chain: dict, key, mask: int | None, id_: int | None, part: str, n: int) -> Iterator[tuple]:
    """Puts a row into a chain (key: [mask, least id, rows of that id by part]); yields the rows thereby known as copies."""
    entry = chain.get(key)
    if entry is None:
        chain[key] = [mask, id_, {part: n}]
        return
    place = _later(id_, entry[1])
    if place > 0:
        yield entry[0], id_, part, n
    elif place == 0:
        entry[2][part] = entry[2].get(part, 0) + n
    else:
        for p, m in entry[2].items():
            yield entry[0], entry[1], p, m
        entry[1:] = id_, {part: n}


def _spread(id_: int | None) -> int:
    return (((id_ or 0) & (2**64 - 1)) * 0x9E3779B97F4A7C15 >> 20) & (2**31 - 1)


def _contenders(rows: Iterable) -> Iterator[tuple]:
    """((1, fingerprint), (text, mask, id, part, rows)) for the least row of each text of a task, ((0, spread), (None, ...)) for its copies."""
    held, size = {}, 0

    def flush() -> Iterator[tuple]:
        for (mark, text), (mask, id_, parts) in held.items():
            yield from (((1, mark), (text, mask, id_, p, n)) for p, n in parts.items())

    for mark, text, id_, part in rows:
        key = mark, text
        if key not in held:
            size += len(text) + 200
        mask = held[key][0] if key in held else failed_alone(text)
        for m, i, p, n in _settle(held, key, mask, id_, part, 1):
            yield (0, _spread(i)), (None, m, i, p, n)
        if size > HELD_BYTES:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _copies(rows: Iterable) -> Iterator[tuple]:
    """(id, part, mask with E for copies, rows) of rows that come sorted by fingerprint; one chain is held at a time."""
    chain, now = {}, None

    def flush() -> Iterator[tuple]:
        for mask, id_, parts in chain.values():
            yield from ((id_, p, mask, n) for p, n in parts.items())

    for (kind, mark), (text, mask, id_, part, n) in rows:
        if kind == 0:
            yield id_, part, mask | COPY, n
            continue
        if mark != now:
            yield from flush()
            chain, now = {}, mark
        for m, i, p, k in _settle(chain, text, mask, id_, part, n):
            yield i, p, m | COPY, k
    yield from flush()


def failed(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): the filters that ``n`` rows of one id, part and text fail, as bits in the order of FILTERS.

    A row is a copy (E) if a row of a smaller id has the same text; null ids stand after all others, rows of equal id and
    text are copies alike or not at all. A null text counts as empty, a null part as the empty string. Columns
    of further names are not read. An empty table gives none. A task holds HELD_BYTES of text or one longer text, and sorts
    what it gets with Spark's spilling sorter.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = df.select(F.xxhash64(text), text, F.col(id_col).cast("long"), F.coalesce(F.col(part_col), F.lit(""))).rdd
    n = max(size // PART_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitions(_contenders).repartitionAndSortWithinPartitions(n, operator.itemgetter(1))
    return spark.createDataFrame(routed.mapPartitions(_copies), "doc_id long, part string, mask int, n long", verifySchema=False)


def copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id) of the rows whose text a row of a smaller id has; odd rows as in failed()."""
    plain = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.lit("").alias("lang"))
    found = failed(plain).where(F.col("mask").bitwiseAND(COPY) != 0)
    return found.select("doc_id", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_k")).drop("_k")


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every (order, step), and for each count the masks that it takes in: arrays (order and step, mask)."""
    masks = np.arange(1 << len(FILTERS))
    steps, rules = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in permutations(FILTERS):
        before = np.zeros(len(masks), bool)
        for k, name in enumerate(order, 1):
            fails = masks >> FILTERS.index(name) & 1 == 1
            steps.append(("".join(order), k))
            rules["removed"].append(fails & ~before)
            rules["redundant"].append(fails & before)
            rules["unique_fails"].append(masks == 1 << FILTERS.index(name))
            before = before | fails
            rules["kept"].append(~before)
    return steps, {k: np.array(v, np.int64) for k, v in rules.items()}


def _report(vectors: Iterable) -> Iterator[tuple]:
    """The rows of each part from its counts by mask (mask by mask: documents, good ones, toxic ones)."""
    steps, rules = _orders()
    filters = [order[k - 1] for order, k in steps]
    for part, vector in vectors:
        docs, good, toxic = np.array(vector, np.int64).reshape(-1, _COUNTS).T
        columns = [rules["kept"] @ docs, rules["removed"] @ docs, rules["redundant"] @ docs, rules["unique_fails"] @ docs, rules["removed"] @ good, rules["removed"] @ toxic]
        total = dict.fromkeys(FILTERS, 0)
        for f, x in zip(filters, columns[1].tolist(), strict=True):
            total[f] += x
        for (order, k), f, *counts in zip(steps, filters, *(c.tolist() for c in columns), strict=True):
            yield (part, order, k, *counts, total[f])


def _new(row: tuple) -> list[int]:
    return _add([0] * (_COUNTS << len(FILTERS)), row)


def _add(vector: list[int], row: tuple) -> list[int]:
    mask, *counts = row
    for k, x in enumerate(counts):
        vector[_COUNTS * mask + k] += x
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def interactions(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step: part, filter_order, step and the counts of that step's filter.

    found: as of failed(); labels: (doc_id, quality, toxic), of which several rows of an id count as one that is good or
    toxic if one of them is. Ids without a label, and null ids, are neither.
    """
    spark = found.sparkSession
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = found.join(known, "doc_id", "left")
    times = lambda c: F.col("n") * F.coalesce(F.col(c), F.lit(0))
    counted = rows.select("part", F.struct("mask", "n", times("good").alias("good"), times("toxic").alias("toxic")))
    vectors = counted.rdd.map(tuple).combineByKey(_new, _add, _merge)
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return spark.createDataFrame(vectors.mapPartitions(_report), f"part string, filter_order string, step int, {counts}", verifySchema=False)
