"""Cases as portable JSON, and back with new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = "struct<doc_id:bigint,section:string,file_name:string,text:string,content:string>"
CLAIM = "struct<claim_id:bigint,party:string,text:string,kind:string,attachments:array<bigint>>"
BACKUP = f"struct<case_id:bigint,title:string,documents:array<{DOCUMENT}>,claims:array<{CLAIM}>>"


def export_cases(cases: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, backup): a JSON text a case. A case's records are gathered; file contents go as base64."""
    content = F.base64("content") if "content" in documents.columns else F.lit(None).cast("string")
    docs = documents.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "section", "file_name", "text", content.alias("content")))).alias("documents"))
    own = claims.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "party", "text", "kind", "attachments"))).alias("claims"))
    rows = cases.select("case_id", "title").join(docs, "case_id", "left").join(own, "case_id", "left")
    return rows.select("case_id", F.to_json(F.struct("case_id", "title", "documents", "claims")).alias("backup"))


def import_cases(backups: DataFrame, id_base: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, claims, attachments) with new ids; attachments to documents that the backup lacks are dropped.

    New ids come from the case, the kind and the place in the backup, so a re-run gives the same ones. Missing
    sections and kinds get defaults; a text that is no backup gives no rows.
    """
    parsed = backups.select(F.from_json("backup", BACKUP).alias("b")).where("b.case_id IS NOT NULL")
    new = lambda kind, pos: F.xxhash64("case_id", F.lit(kind), pos).bitwiseAND(F.lit(2**62 - 1)) + F.lit(id_base)
    docs = parsed.select("b.case_id", F.posexplode("b.documents").alias("pos", "d")).select(
        "case_id", new("document", F.col("pos")).alias("doc_id"), F.col("d.doc_id").alias("old_id"), F.coalesce("d.section", F.lit("generici")).alias("section"), "d.file_name", "d.text", F.unbase64("d.content").alias("content"),
    )
    claims = parsed.select("b.case_id", F.posexplode("b.claims").alias("pos", "c")).select(
        "case_id", new("claim", F.col("pos")).alias("claim_id"), F.coalesce("c.party", F.lit("attore")).alias("party"), F.coalesce("c.kind", F.lit("domanda")).alias("kind"), "c.text", "c.attachments",
    )
    named = claims.select("case_id", "claim_id", F.explode("attachments").alias("old_id"))
    attachments = named.join(docs.select("case_id", "old_id", "doc_id"), ["case_id", "old_id"]).select("case_id", "claim_id", "doc_id")
    return docs.drop("old_id"), claims.drop("attachments"), attachments
