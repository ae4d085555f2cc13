"""What several training-data operators share: ids, texts and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseweave.scratch import clear_scratch, scratch, shared_dir

__all__ = ["NULL_ID", "bounded", "clear_scratch", "id_or_last", "scratch", "shared_dir", "table", "text_bytes", "text_keys", "widened"]

#: Null ids stand after every other id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(column: str) -> Column:
    """A long id with null ids after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_keys(column: str) -> tuple[Column, Column]:
    """128 bits that stand for a text: two hashes of different beginnings. Null has its own."""
    return F.xxhash64(column, F.octet_length(F.col(column))), F.xxhash64(F.lit("second"), F.col(column))


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and further fields, whatever the names inside its structs."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
