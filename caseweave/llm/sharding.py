"""Sharding by sampled splitters.

The range key is (xxhash64(text), id): equal texts lie next to each other, and a large group of copies is cut by id.
Keys are drawn with a probability in proportion to their size, their quantiles bound the ranges, ranges that turn out
overfull get more splitters from a denser draw, and records are range-partitioned. Inside a range a window orders
its records; cut points between shards are multiples of the total over the number of shards, so shard sizes differ
from their mean by one record at most.

The driver holds one size per range and at most 2 * ``MAX_RANGES`` splitters: no more are added once there are MAX_RANGES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Rows that one range should hold, and bounds on the number of ranges.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 500_000, 240, 4096
#: Sampled keys per range in the first draw.
DRAWS = 16
#: A range over this many times the mean range is subdivided.
OVERFULL = 2.0
OVERHEAD = 16


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key (_h, _id): a binary search as a fold over halving steps."""
    if not splitters:
        return F.lit(0)
    high = F.array(*[F.lit(h).cast("long") for h, _ in splitters])
    low = F.array(*[F.lit(i).cast("long") for _, i in splitters])
    top = 1 << (len(splitters).bit_length() - 1)
    steps = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])

    def move(at: Column, step: Column) -> Column:
        to = at + step
        h, i = F.get(high, to - 1), F.get(low, to - 1)
        fits = (to <= len(splitters)) & ((h < F.col("_h")) | ((h == F.col("_h")) & (i <= F.col("_id"))))
        return F.when(fits, to).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def _quantiles(drawn: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """n - 1 keys that cut weighted, sorted draws into n equal parts."""
    total, seen, passed, out = sum(w for _, _, w in drawn), 0, 0, []
    for h, i, w in drawn:
        seen += w
        if passed < min(n - 1, seen * n // total):
            passed = min(n - 1, seen * n // total)
            out.append((h, i))
    return out


def _draw(keys: DataFrame, rate: Column, seed: int) -> list[tuple[int, int, int]]:
    """Keys drawn with probability size * rate; a key with more than one expected draw weighs as many."""
    u = F.shiftrightunsigned(F.xxhash64("_h", "_id", F.lit(seed)), 11) / F.lit(float(2**53))
    expected = F.col("_size") * rate
    drawn = keys.where(u < expected).select("_h", "_id", F.greatest(F.lit(1), F.round(expected)).cast("long").alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.groupBy("_h", "_id").agg(F.sum("w")).collect())


def splitters(keys: DataFrame, shards: int, rows: int, total: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Range boundaries, and (rows, size) of each range."""
    ranges = min(MAX_RANGES // 2, max(MIN_RANGES, shards * 4, -(-rows // RANGE_ROWS)))
    found = sorted(set(_quantiles(_draw(keys, F.lit(ranges * DRAWS / max(1, total)), 1), ranges)))
    for turn in (2, 3, 4):
        sizes = {r[0]: (r[1], r[2]) for r in keys.groupBy(_range_of(found).alias("r")).agg(F.count("*"), F.sum("_size")).collect()}
        full = [r for r, (_, size) in sizes.items() if size > OVERFULL * total / ranges]
        if not full or turn == 4 or len(found) >= MAX_RANGES:
            break
        part = keys.withColumn("_r", _range_of(found)).where(F.col("_r").isin(full))
        more = _draw(part, F.lit(4 * ranges * DRAWS / max(1, total)), turn)
        found = sorted({*found, *[(h, i) for h, i, _ in more[:: 2 * DRAWS]]})
    return found, sizes


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot`` (gapless from 0 within a shard).

    Null text: size 16. A null id comes after all ids. Rows that agree in id and text are told apart only by their
    order inside their range, which changes no shard's size. An empty table gives an empty result. Columns of ``df``
    named size, shard or slot are replaced.
    """
    named = df.withColumns({"_h": F.xxhash64(text_col), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), "_size": record_size(text_col)})
    keys = scratch(named.select("_h", "_id", "_size"), "shard-keys")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    found, sizes = splitters(keys, shards, rows, total)
    before, rows_before, seen, seen_rows = [], [], 0, 0
    for r in range(len(found) + 1):
        n, size = sizes.get(r, (0, 0))
        before, rows_before = [*before, seen], [*rows_before, seen_rows]
        seen, seen_rows = seen + size, seen_rows + n

    def placed(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("_r").orderBy("_h", "_id", "_size")
        longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        upto = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.get(longs(before), F.col("_r"))
        middle = 2 * upto - F.col("_size")
        return rows.withColumn("_r", _range_of(found)).select(
            "*",
            F.least(F.lit(shards - 1), F.floor(middle / F.lit(2.0 * max(1, total)) * shards)).cast("int").alias("_shard"),
            (F.row_number().over(inside) + F.get(longs(rows_before), F.col("_r")) - 1).alias("_at"),
        )

    first = {r[0]: r[1] for r in placed(keys).groupBy("_shard").agg(F.min("_at")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(shards)])
    out = placed(named).withColumns({"size": F.col("_size"), "shard": F.col("_shard"), "slot": F.col("_at") - F.get(starts, F.col("_shard"))})
    return out.drop("_h", "_id", "_size", "_r", "_shard", "_at")
