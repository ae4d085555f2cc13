"""Mixing sources to target weights by hash-threshold histograms.

Every record has a 60-bit hash of its id. A source whose target is m whole times its size plus a rest takes every
record m times, and once more those whose hash lies under a threshold. The threshold comes from nested histograms:
sizes are summed by source and hash bucket, the bucket in which the running sum crosses the rest is found, and only
that bucket is cut into 4,096 finer ones, until it holds one record. Nothing is sorted, and the result depends only on
ids and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits that one histogram resolves.
HASH_BITS, STEP = 60, 12
WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: A source within this share of its target is near enough.
NEAR = 0.005


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(id_col: str) -> Column:
    """60 bits of the id's MD5; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_rank``, the place of its source by code point from 0, null last: sorted ranges, and counts before them."""
    order = F.col("_source").asc_nulls_last()
    parts = scratch(sizes.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    ranked = parts.withColumn("_inside", inside).join(counts.select("_part", before.alias("_before")), "_part")
    return ranked.withColumn("_rank", F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source (``_source``, ``source_size``) gains ``target``.

    Shares follow the weights, a target stops at max_repeats times its source, and what is above goes to the others by
    weight: the level, a share a weight, rises while it caps further sources. Each round is one grouped sum.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    rows = scratch(_ranked(sizes).select("_source", "source_size", weight.alias("_w"), (F.col("source_size") * max_repeats).cast("double").alias("_cap")), "mix-sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_w") if level else F.lit(False)
        n, total, used, free = rows.agg(F.count_if(over), F.sum("source_size").cast("double"), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w")))).first()
        if n == capped or not free:
            break
        level, capped = (total - (used or 0.0)) / free, n
    target = F.col("_cap") if not free else F.least("_cap", F.lit(level) * F.col("_w"))
    return rows.select("_source", "source_size", target.alias("target"))


def thresholds(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a source: ``_base`` copies of all its records, and one more of those inside one of ``_spans``.

    A span holds the records with a hash inside it that are no larger than what was open when it was found. The record
    at its end is taken if that comes nearer to the rest. If it isn't and over NEAR of the target is still open, the
    search goes on behind it among the records that fit, until enough or no such record is left.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = sources.select("_source", "source_size", "target", base.alias("_base")).withColumns(
        {
            "_rest": F.col("target") - F.col("_base") * F.col("source_size"), "_from": F.lit(-1).cast("long"), "_under": F.lit(0).cast("long"),
            "_spans": F.array().cast("array<struct<lo:bigint,hi:bigint,most:double>>"), "_open": F.lit(True), "_done": F.lit(False),
        }
    )
    state = scratch(state, "mix-state")
    while not state.where("_open").isEmpty():
        state = _search(keys.select(F.col("_source").alias("_s"), "_hash", "_n"), state.withColumn("_most", F.col("_rest")))
        near = F.col("_done") | (F.col("_rest") <= NEAR * F.col("target"))
        span = F.array(F.struct(F.col("_from").alias("lo"), F.col("_under").alias("hi"), F.col("_most").alias("most")))
        state = state.select(
            "_source", "source_size", "target", "_base", "_rest", F.col("_behind").alias("_from"), F.lit(0).cast("long").alias("_under"),
            F.when(F.col("_searched"), F.concat("_spans", span)).otherwise(F.col("_spans")).alias("_spans"), (F.col("_searched") & ~near).alias("_open"), "_done",
        )
    return state.select("_source", "source_size", "target", "_base", "_spans")


def _search(keys: DataFrame, state: DataFrame) -> DataFrame:
    """For each open source, the threshold ``_under`` behind ``_from`` at which the running size of records that fit crosses ``_rest``."""
    state = state.withColumns({"_searched": F.col("_open"), "_behind": F.col("_from")})
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        behind = (F.col("_hash") > F.col("_from")) & (F.col("_n") <= F.col("_most")) & (F.shiftright("_hash", shift + STEP) == F.shiftright("_under", shift + STEP))
        inside = keys.join(state.where("_open"), F.col("_s").eqNullSafe(F.col("_source"))).where(behind)
        # 4,096 buckets a source at most, summed within tasks first. One record, or several of one hash, is a lone one.
        buckets = inside.groupBy("_source", "_rest", F.shiftright("_hash", shift).alias("_b")).agg(F.sum("_n").alias("_size"), F.min("_hash").alias("_least"), F.max("_hash").alias("_largest"))
        running = F.sum("_size").over(Window.partitionBy("_source").orderBy("_b"))
        crossed = F.when(F.col("_upto") > F.col("_rest"), F.struct("_b", "_upto", "_size", (F.col("_least") == F.col("_largest")).alias("_lone")))
        edge = buckets.withColumn("_upto", running).groupBy(F.col("_source").alias("_s")).agg(F.min(crossed).alias("_edge"), F.max("_b").alias("_last"))
        # The crossing bucket stays open while it holds several hashes.
        e, bucket = F.col("_edge"), 1 << shift
        before = e["_upto"] - e["_size"]
        lone = e["_lone"]
        take = lone & ((F.col("_rest") - before) * 2 >= e["_size"])
        found = F.col("_open") & F.col("_last").isNotNull()
        state = scratch(
            state.join(edge, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
                "_source", "source_size", "target", "_base", "_from", "_spans", "_searched", "_most",
                F.when(found & e.isNotNull(), F.col("_rest") - before).otherwise(F.col("_rest")).alias("_rest"),
                F.when(found & e.isNull(), (F.col("_last") + 1) * bucket)
                .when(found, (e["_b"] + take.cast("int")) * bucket)
                .otherwise(F.col("_under")).cast("long").alias("_under"),
                (found & e.isNotNull() & ~lone).alias("_open"),
                (F.col("_done") | (F.col("_open") & F.col("_last").isNull()) | (found & (e.isNull() | take))).alias("_done"),
                F.when(found & lone & ~take, (e["_b"] + 1) * bucket - 1).otherwise(F.col("_behind")).cast("long").alias("_behind"),
            ),
            "mix-state",
        )
        if state.where("_open").isEmpty():
            break
    return state


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``df`` with ``size`` (words), ``source_size``, ``target`` (of its source) and ``repeats`` (0 to max_repeats).

    Columns of ``df`` with those names are replaced; no other name can clash. Null text has no words; a null source is a
    source, the last one; rows with equal ids share one hash and, if they fit, are taken together; repeated rows are
    taken alike. An empty table gives an empty result.
    """
    made = ("size", "source_size", "target", "repeats")
    kept = [c for c in df.columns if c not in made]
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), n_words(text_col).alias("_n"), id_hash(id_col).alias("_hash"), F.col(source_col).alias("_s"))
    keys = scratch(named.select(F.col("_s").alias("_source"), "_hash", "_n"), "mix-keys")
    sources = targets(keys.groupBy("_source").agg(F.sum("_n").alias("source_size")), weights, max_repeats)
    state = thresholds(keys, sources)
    inside = F.exists("_spans", lambda v: (F.col("_hash") > v["lo"]) & (F.col("_hash") < v["hi"]) & (F.col("_n") <= v["most"]))
    repeats = F.least(F.lit(max_repeats), F.col("_base") + inside.cast("long"))
    joined = named.join(state, F.col("_s").eqNullSafe(F.col("_source")))
    return joined.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_n").alias("size"), "source_size", "target", repeats.alias("repeats"))
