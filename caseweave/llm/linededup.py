"""Line dedup with two Bloom filters.

A first scan hashes every line key once a document. Each task notes the filter bits of its keys, and which of them it
met in two documents; merged by filter segment, a bit met by two tasks counts as twice seen. So the once-seen and the
twice-seen filter together have no false negatives. A second scan passes on only the keys that the twice-seen filter
suspects, as a 128-bit digest with their document; grouping confirms exactly in how many documents each stands and
which is the one that keeps it. Documents then lose the confirmed lines.

The filters are sized by the bytes of the input and never exceed MAX_BITS each. Beyond that, more lines are suspected
and shuffled, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bounded, id_or_last, scratch, text_bytes

#: Bounds of a filter's bits; bits of a segment; probes a key.
MIN_BITS, MAX_BITS, SEGMENT_BITS, PROBES = 1 << 16, 1 << 28, 1 << 19, 2
BYTES_PER_BIT = 8
BLANK = b" \t\n\x0b\x0c\r"
#: Fewest code points of a key, and fewest documents that hold it.
MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(text: bytes) -> list[bytes | None]:
    """A line's key: stripped of blanks, A-Z lower-cased; None where it is shorter than MIN_CHARS code points."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()
        if len(key) < MIN_CHARS or not key.isascii() and len(key.decode("utf-8", "replace")) < MIN_CHARS:
            key = None
        keys.append(key)
    return keys


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.uint32)


def _note(bits: int):
    """Documents to (segment, bits met once in this batch, bits met twice in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for large in batches for small in bounded(large, "text", 16 << 20)):
            seen: dict[int, int] = {}
            twice = set()
            for doc, text in zip(batch.column("_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                for key in line_keys(text):
                    if key is not None and seen.setdefault(h := xxhash.xxh3_64_intdigest(key), doc) != doc:
                        twice.add(h)
            for again, hashes in ((False, seen.keys() - twice), (True, twice)):
                at = np.sort(_probes(np.fromiter(hashes, np.uint64, len(hashes)), bits))
                for part in np.split(at, np.flatnonzero(np.diff(at // SEGMENT_BITS)) + 1) if len(at) else []:
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[0] // SEGMENT_BITS)], pa.int32()), pa.array([again]), pa.array([(part % SEGMENT_BITS).astype("<u4").tobytes()], pa.binary())], ["segment", "again", "at"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of each segment of the twice-seen filter; a task holds two bitmaps for each of its segments."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, again, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a = once.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
            b = twice.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
            bits, counts = np.unique(np.frombuffer(at, "<u4"), return_counts=True)
            b[bits] |= again | a[bits]
            a[bits] = True
    for segment, b in twice.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())], ["segment", "bits"])


def twice_seen(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The twice-seen filter over all documents, MAX_BITS at most, and its number of bits."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (int(size) // BYTES_PER_BIT).bit_length()))
    found = docs.mapInArrow(_note(bits), "segment int, again boolean, at binary").repartition("segment").mapInArrow(_merge, "segment int, bits binary")
    filled = np.zeros(bits // 8, np.uint8)
    for segment, packed in found.collect():
        part = np.frombuffer(packed, np.uint8)[: bits // 8]
        filled[segment * SEGMENT_BITS // 8 :][: len(part)] = part
    return filled, bits


def _suspects(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(shared.value, np.uint8)

        def met(at: np.ndarray) -> np.ndarray:
            return (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

        for batch in (small for large in batches for small in bounded(large, "text", 8 << 20)):
            docs, keys = [], []
            for doc, text in zip(batch.column("_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                own = {k for k in line_keys(text) if k is not None}
                keys += own
                docs += [doc] * len(own)
            at = _probes(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
            kept = np.flatnonzero(met(at[: len(keys)]) & met(at[len(keys) :]))
            yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in kept], pa.int64()), pa.array([digest(keys[i]) for i in kept], pa.binary())], ["_id", "key"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for small in bounded(batch, "text", 8 << 20):
            out = []
            for text, gone in zip(text_bytes(small.column("text")), small.column("_gone").to_pylist(), strict=True):
                lines = text.split(b"\n")
                if gone:
                    lost = set(gone)
                    kept = [line for line, key in zip(lines, line_keys(text), strict=True) if key is None or digest(key) not in lost]
                else:
                    kept = lines
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
            n, dropped, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [small.column("_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                ["_id", "n_lines", "n_dropped", "kept_text"],
            )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line is split off at \\n, a null or empty text is one empty line. Keys that stand in MIN_DOCS documents lose all
    their lines but those of the largest id. Rows with equal ids count as one document; a null id is larger than all
    others. Other columns of ``df`` are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(id_or_last(id_col).alias("_id"), F.col(text_col).alias("text"))
    filled, bits = twice_seen(docs)
    shared = spark.sparkContext.broadcast(filled.tobytes())
    suspects = scratch(docs.mapInArrow(_suspects(shared, bits), "_id long, key binary").groupBy("key", "_id").agg(F.lit(1).alias("one")).select("key", "_id"), "line-suspects")
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("_id").alias("keeper")).where(F.col("n") >= MIN_DOCS).select("key", "keeper")
    repeated = scratch(repeated, "line-repeated")  # so that a hot key's side of the join can be split
    gone = suspects.join(repeated, "key").where(F.col("_id") != F.col("keeper")).groupBy("_id").agg(F.collect_list("key").alias("_gone"))
    out = docs.join(gone, "_id", "left").mapInArrow(_drop, "_id long, n_lines long, n_dropped long, kept_text string")
    return out.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(id_col), "n_lines", "n_dropped", "kept_text")
