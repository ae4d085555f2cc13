"""A training corpus from ``documents``: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir). What it returns is written to the shared folder and read again as the next
one's ``docs``. All stages but the last return the columns of documents. Language identification (a fitted model),
checked similarity and the shards' range keys (XXH64) are not SQL, so there is no ORACLE_SQL. Tests hold the near-copy
stage and the operators behind the others against brute-force versions.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and empty tables (an empty table
stays one), and columns of any further names. Null texts have no language and leave at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm import decontaminate, language, mixing, sharding, simhash
from caseweave.llm.common import scratch, table

SHARDS = 40
ORACLE_SQL = None


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The rows of ``docs`` as one column ``_row``, so that no column of theirs can clash, and the named columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    model = language.train(docs)
    clues = language.plain_evidence(F.col("source"), F.col("lang"), F.col("text"))
    scores = scratch(language.score(docs.select(*[c.alias(k) for k, c in clues.items()]), model), "language-scores")
    rows = _packed(docs, *[c.alias(k) for k, c in clues.items()])
    return language.fuse(language.score(rows, model), language.evidence(scores)).where("accepted").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash fingerprints joined by tries, completed by bands of minima,
    every link checked (five-word shingles, similarity 0.8 or more)."""
    return simhash.keep_similar_one(_packed(docs, "doc_id", "text")).select("_row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    judged = decontaminate.judge(_packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target of words; a copy is a row."""
    mixed = mixing.mix(_packed(docs, "doc_id", "text", "source"))
    return mixed.where("repeats > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``size``, ``shard`` and ``slot`` to the columns of documents, in place of any so named."""
    placed = sharding.assign_shards(_packed(docs, "doc_id", "text"), shards=SHARDS)
    return placed.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot")


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", tidy=True)
    return docs
