"""Chunks, exact vector search, and context for prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseweave.functions import constants as C
from caseweave.functions import text as T


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk: id, ``ord`` and ``chunk``."""
    return docs.select(id_col, F.posexplode(T.chunks(F.col(text_col))).alias("ord", "chunk"))


def visible(df: DataFrame, owner_col: str, user: int | None, staff: bool = False) -> DataFrame:
    """Rows that a user may see: all for staff, else those without an owner and one's own."""
    return df if staff else df.where(F.col(owner_col).isNull() | (F.col(owner_col) == F.lit(user)))


def cosine_distance(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", cut_off: float | None = None) -> DataFrame:
    """The k (1 to 20) nearest vectors by cosine distance, ties by id; the cut-off applies to what the top k holds."""
    k = min(max(int(k), 1), 20)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(vector_col).isNotNull()).withColumn("_raw", cosine_distance(F.col(vector_col), q)).where("_raw IS NOT NULL")
    # Rounded before the sort: a projection above the limit would keep Spark from taking the top k in one step.
    scored = scored.withColumn("distance", F.round(F.greatest("_raw", F.lit(0.0)), 6))
    top = scored.orderBy("_raw", id_col).limit(k).drop("_raw")
    return top if cut_off is None else top.where(F.col("distance") <= cut_off)


def nearest_all(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, vec_id, distance): the k (1 to 20) nearest vectors of every query (query_id, vector), ties by id.

    Queries go out in blocks of about ``block``, so what travels is bounded; each task keeps the k best of a query, and
    only those are shuffled. Vectors of length zero or of another length than the query's are near nothing.
    """
    k, spark = min(max(int(k), 1), 20), queries.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = -(-asked.count() // block)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect()
        shared = spark.sparkContext.broadcast([(r[0], np.array(r[1])) for r in own])
        part = rows.mapInArrow(_best(shared, k), "query_id long, vec_id long, raw double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0.0).alias("raw")).limit(0)
    first = Window.partitionBy("query_id").orderBy("raw", "vec_id")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return top.select("query_id", "vec_id", F.round(F.greatest("raw", F.lit(0.0)), 6).alias("distance"))


def _best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[list, list]] = {}
        for i, v in shared.value:
            if norm := np.linalg.norm(v):
                ids, units = by_size.setdefault(len(v), ([], []))
                ids.append(i)
                units.append(v / norm)
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            for size, (asked, units) in by_size.items():
                own = np.flatnonzero(sizes == size)
                if not len(own):
                    continue
                table = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                norms = np.linalg.norm(table, axis=1)
                own, table = own[norms > 0], table[norms > 0] / norms[norms > 0][:, None]
                far = 1 - np.stack(units) @ table.T
                for q, row in zip(asked, far, strict=True):
                    # All that tie with the k-th are looked at, so the smallest ids stay.
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-12) if len(row) > k else np.arange(len(row))
                    best[q] = sorted(best.get(q, []) + list(zip(row[near].tolist(), ids[own[near]].tolist(), strict=True)))[:k]
        rows = [(q, i, d) for q, found in best.items() for d, i in found]
        q, i, d = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "raw"])

    return run


def compose(parts: DataFrame, key: str, order: list[str], text_col: str, separator: str = "\n\n", limit: int = C.CONTEXT_CHARS) -> DataFrame:
    """Texts of each key joined in order, cut at ``limit`` characters.

    Rows that begin behind the limit go before anything is gathered, so a key's list is bounded whatever its size.
    """
    upto = Window.partitionBy(key).orderBy(*order, text_col).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text_col) + len(separator)).over(upto), F.lit(0))
    near = parts.where(F.col(text_col).isNotNull()).withColumn("_begin", begin).where(F.col("_begin") < limit)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("_text"))))
    joined = F.array_join(F.transform(rows, lambda r: r["_text"]), separator)
    return near.groupBy(key).agg(F.substring(joined, 1, limit).alias("context"))


def compose_documents(docs: DataFrame, with_ids: bool = False, limit: int = C.CONTEXT_CHARS) -> DataFrame:
    """(case_id, context): a case's documents in order, each under its section's header, which names its id if wanted.

    docs: case_id, doc_id, section, ord, text (null counts as empty). A section without a label stands in capitals.
    """
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in C.SECTION_LABELS.items() for x in pair]), F.col("section")), F.upper("section"))
    head = F.concat(F.lit("### Documento "), F.col("doc_id").cast("string"), F.lit(" — "), label) if with_ids else F.concat(F.lit("### "), label)
    body = T.trimmed(F.coalesce("text", F.lit("")))
    rows = docs.select("case_id", "ord", "doc_id", F.concat(head, F.lit("\n"), F.substring(body, 1, limit)).alias("block"))
    return compose(rows, "case_id", ["ord", "doc_id"], "block", limit=limit)


def case_context(drafts: DataFrame, claims: DataFrame, limit: int = C.CASE_CHARS) -> DataFrame:
    """(case_id, context): the facts of a case's draft, then a line a claim with its party, in order, cut at ``limit``.

    drafts (case_id, in_fact), claims (case_id, claim_id, ord, party, text). Cases with neither are left out.
    """
    head = drafts.where(F.coalesce("in_fact", F.lit("")) != "").select("case_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("In fatto: "), "in_fact").alias("line"))
    line = F.concat(F.lit("Richiesta ("), F.coalesce("party", F.lit("")), F.lit("): "), F.coalesce("text", F.lit("")))
    lines = head.unionByName(claims.select("case_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("claim_id").cast("long").alias("id"), line.alias("line")))
    return compose(lines, "case_id", ["part", "ord", "id"], "line", separator="\n", limit=limit)


def rag_context(fragments: DataFrame, query: list[float], user: int | None, k: int = 3, chars: int = 300) -> DataFrame:
    """One row: the first ``chars`` characters of the nearest fragments that are global or one's own, nearest first.

    fragments: vec_id, embedding, text, owner. Staff rights don't count here; without fragments the context is empty.
    """
    near = nearest(visible(fragments, "owner", user), query, k)
    rows = F.array_sort(F.collect_list(F.struct("distance", "vec_id", F.substring("text", 1, chars).alias("t"))))
    return near.agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("context"))
